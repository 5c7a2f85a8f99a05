"""The Porter stemmer (1980), applied to a vocabulary rather than to running text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The suffix rules of steps 2, 3 and 4 as published.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _consonant(word: str, i: int) -> bool:
    if word[i] == "y":
        return i == 0 or not _consonant(word, i - 1)
    return word[i] not in "aeiou"


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    kinds = [_consonant(stem, i) for i in range(len(stem))]
    return sum(not a and b for a, b in zip(kinds, kinds[1:]))


def _has_vowel(stem: str) -> bool:
    return any(not _consonant(stem, i) for i in range(len(stem)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _consonant(word, len(word) - 1)


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last none of w, x, y."""
    n = len(word)
    return n > 2 and _consonant(word, n - 3) and not _consonant(word, n - 2) and _consonant(word, n - 1) and word[-1] not in "wxy"


def stem(word: str) -> str:
    """The root form of a lower-case word; words of one or two letters stay."""
    if len(word) < 3 or not word.isascii():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (STEP_2, STEP_3):
        suffix = max((s for s in rules if word.endswith(s)), key=len, default=None)
        if suffix and _measure(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + rules[suffix]
    suffix = max((s for s in STEP_4 if word.endswith(s)), key=len, default=None)
    if suffix:
        head = word[: -len(suffix)]
        if _measure(head) > 1 and (suffix != "ion" or head.endswith(("s", "t"))):
            word = head
    if word.endswith("e"):
        head = word[:-1]
        if _measure(head) > 1 or (_measure(head) == 1 and not _short(head)):
            word = head
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _stems(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else stem(w) for w in words.to_pylist()], pa.string())


def stems(words: DataFrame, column: str = "term") -> DataFrame:
    """word and term: each word of a column of distinct ones, and its stem."""
    return words.select(F.col(column).alias("word"), F.arrow_udf(_stems, "string")(column).alias("term"))


def stemmed(terms: DataFrame, column: str = "term") -> DataFrame:
    """The rows with ``column`` stemmed; Python sees each distinct word once."""
    vocabulary = terms.select(F.col(column).alias("_word")).distinct().withColumn("_stem", F.arrow_udf(_stems, "string")("_word"))
    joined = terms.join(vocabulary, terms[column] == F.col("_word"))
    return joined.select(*[F.col("_stem").alias(c) if c == column else terms[c] for c in terms.columns])
