"""Personal data in plain and in disguised form, with offsets into the source text.

Two passes over each whole text.  The base pass matches e-mail addresses, IP addresses,
card numbers and phone numbers as they stand.  The second pass sends the text through
transducers that undo disguises (lookalike characters, spelled digits, "at" and "dot"
words), matches again on the normalised text, and maps each match back through the offset
arrays that the transducers carry along.  Texts without any disguise skip it.

All matching is linear in the text.  Offsets are code points, ends are exclusive.  Null
and empty texts hold nothing; rows with equal ids are scanned one by one.  Columns other
than id and text are not looked at; the masking form hands them on, whatever their names.

"name at host.tld" with nothing else disguised counts only where the name isn't a plain
word ("j.doe at example.com"), as "look at example.com" is no address.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._common import small_batches, tidy

#: Kinds in the order of the digest.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
#: Everything that holds an address, a card or (but for its plus) a phone number.
_NUMERIC = re.compile(r"[0-9][0-9 .()-]*[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    """Whether a string of decimal digits passes the check-digit sum."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[0::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> list[Span]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            last = domain.end()
            found.append(Span("email", start, last))
            at = text.find("@", last)
        else:
            # no later match can start before this sign: it would have to contain it
            last = at + 1
            at = text.find("@", last)
    return found


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    emails = _emails(text) if "@" in text else []
    ips, cards, phones = [], [], []
    for area in _NUMERIC.finditer(text):
        start, end = area.span()
        if end - start < 7:
            continue
        if text.count(".", start, end) >= 3:
            for m in _IP.finditer(text, start, end):
                if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
                    ips.append(Span("ip", *m.span()))
        if end - start >= 16:
            for m in _CARD.finditer(text, start, end):
                if m.end() - m.start() >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        cards.append(Span("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                phones.append(Span("phone", *m.span()))
    return emails + ips + cards + phones


# Letters of other scripts that look like a Latin one, and what they look like.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝвкмнтАВЕЅІЈКМНОРСТУХΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναι", "aeopcyxijshdqwbkmhtABESIJKMHOPCTYXABEZHIKMNOPTYXovai", strict=True))
# Signs used in place of a plain one; an empty string for those that show nothing.
SIGNS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "․": ".", "。": ".", "·": ".", " ": " ", " ": " ", " ": " ", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": ""}
# Digits as words in the four languages of the tables.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
AT_WORDS = ("at", "arroba", "arobase", "ät")
DOT_WORDS = ("dot", "punkt", "punto", "point")
PLUS_WORDS = ("plus", "más", "mas")


def _glyphs() -> dict[str, str]:
    """The lookalikes, the signs, and every compatibility form of a plain letter, digit or sign."""
    plain = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789@.+-()[]%_")
    out = {}
    for code in (*range(0x660, 0x2E80), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800)):
        char = chr(code)
        digit = unicodedata.decimal(char, None)
        form = str(digit) if digit is not None else unicodedata.normalize("NFKC", char)
        if form in plain:
            out[char] = form
    return out | LOOKALIKES | SIGNS


GLYPHS = _glyphs()
_GLYPH = re.compile("[" + "".join(map(re.escape, sorted(c for c in GLYPHS if c < "\U00010000"))) + "\U0001d400-\U0001d7ff]")
_words = lambda words: "|".join(sorted(words, key=len, reverse=True))
#: An at or dot between brackets; what more brackets and blanks surround it is found by walking outwards.
_BRACKET = re.compile(rf"[\[({{<][ \t]*+(?:(?P<at>@|{_words(AT_WORDS)})|(?P<dot>\.|{_words(DOT_WORDS)}))[ \t]*+[\])}}>]", re.I)
_BARE = re.compile(rf"(?<=[A-Za-z0-9])[ \t]+(?:{_words(AT_WORDS)})[ \t]+(?=(?P<domain>[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+)(?P<dot>[ \t]+(?:{_words(DOT_WORDS)})[ \t]+[A-Za-z0-9-])?)", re.I)
_BARE_DOT = re.compile(rf"[ \t]+(?:{_words(DOT_WORDS)})[ \t]+(?=[A-Za-z0-9])", re.I)
_DIGIT = rf"(?:{_words(DIGIT_WORDS)}|[0-9])"
_JOIN = rf"(?:[ ,\-]{{1,3}}|[ \t]+(?:{_words(DOT_WORDS)})[ \t]+)"
_SPELLED = re.compile(rf"(?:(?:{_words(PLUS_WORDS)})[ -]+)?{_DIGIT}(?:{_JOIN}{_DIGIT}){{3,}}(?![^\W_])", re.I)
_ITEM = re.compile(rf"(?P<plus>{_words(PLUS_WORDS)})|(?P<digit>{_DIGIT})|(?P<dot>{_words(DOT_WORDS)})", re.I)
_LABEL = re.compile(r"\.?[A-Za-z0-9-]+")


class Normalised:
    """A text with, for each of its characters, the source span that it stands for.

    ``changed`` marks characters that some transducer wrote.  Offsets are arrays of machine
    integers, a few bytes for each character.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.starts = np.arange(len(text), dtype=np.int32)
        self.ends = self.starts + 1
        self.changed = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        """Replaces spans (in order, apart from each other) by characters with spans of their own."""
        if not edits:
            return
        chars, starts, ends, changed, last = [], [], [], [], 0
        for start, end, new in [*edits, (len(self.text), len(self.text), [])]:
            chars += [self.text[last:start], *(char for char, _, _ in new)]
            starts += [self.starts[last:start], np.array([self.starts[s] for _, s, _ in new], np.int32)]
            ends += [self.ends[last:start], np.array([self.ends[e - 1] for _, _, e in new], np.int32)]
            changed += [self.changed[last:start], np.ones(len(new), bool)]
            last = end
        self.text, self.starts, self.ends, self.changed = "".join(chars), np.concatenate(starts), np.concatenate(ends), np.concatenate(changed)


def _bracketed(text: str) -> list[tuple[int, int, list[tuple[str, int, int]]]]:
    """Edits of bracketed ats and dots, with all brackets and blanks around them."""
    edits, last = [], 0
    for m in _BRACKET.finditer(text):
        start, end = m.span()
        if start < last:
            continue  # its opening bracket closed the one before
        while start > last and text[start - 1] in "[({<":
            start -= 1
        while start > last and text[start - 1] in " \t":
            start -= 1
        while end < len(text) and text[end] in "])}>":
            end += 1
        while end < len(text) and text[end] in " \t":
            end += 1
        edits.append((start, end, [("@" if m["at"] else ".", start, end)]))
        last = end
    return edits


def _folded(text: str) -> str:
    """Lower case, with all that ``re.I`` takes for a plain letter made plain."""
    return text.lower() if text.isascii() else text.replace("İ", "i").replace("ı", "i").casefold()


def _spells(text: str) -> bool:
    """Whether two digits or digit words, as inside every match of ``_SPELLED``, follow each other, with a dot word between or not."""
    kinds = bytes(map(_KIND.get, words := _folded(text).replace(",", " ").replace("-", " ").split(), [0] * len(words)))
    return b"\1\1" in kinds or b"\1\2\1" in kinds


_BLANK_AT = tuple(f"{a}{w}{b}" for w in map(_folded, AT_WORDS) for a in " \t" for b in " \t")
_KIND = dict.fromkeys(map(_folded, DOT_WORDS), 2) | dict.fromkeys([*map(_folded, DIGIT_WORDS), *"0123456789"], 1)


def disguised(text: str) -> tuple[bool, bool, bool]:
    """Which transducers a text needs: lookalikes, at/dot words, spelled digits.

    The latter two work on what the first one wrote, so that is looked at, by conditions
    that hold wherever their patterns match.
    """
    glyphs = not text.isascii() and bool(_GLYPH.search(text))
    plain = _GLYPH.sub(lambda m: GLYPHS.get(m[0], m[0]), text) if glyphs else text
    folded = _folded(plain)
    return (glyphs, any(w in folded for w in (*DOT_WORDS, *_BLANK_AT)) or bool(_BRACKET.search(plain)), _spells(plain))


def _named(text: str, end: int) -> bool:
    """Whether the word that ends here holds a digit or a sign between its letters, as names of mailboxes do."""
    start = end
    while start and text[start - 1] in _LOCAL:
        start -= 1
    return bool(re.search("[A-Za-z0-9][0-9._%+-]|[0-9][A-Za-z]", text[start:end])) and not text[start:end].isdigit()


def normalise(text: str, glyphs: bool = True, words: bool = True, digits: bool = True) -> Normalised:
    """Sends a text through the transducers."""
    out = Normalised(text)
    if glyphs:
        out.rewrite([(m.start(), m.end(), [(c, m.start(), m.end()) for c in GLYPHS.get(m[0], m[0])]) for m in _GLYPH.finditer(text)])
    if digits:
        now, edits = out.text, []
        for m in _SPELLED.finditer(now):
            if m.start() and (now[m.start() - 1].isalnum() or now[m.start() - 1] == "_"):
                continue
            new = [(("+" if i.lastgroup == "plus" else "." if i.lastgroup == "dot" else DIGIT_WORDS.get(i[0].lower(), DIGIT_WORDS.get(_folded(i[0]), i[0]))), *i.span()) for i in _ITEM.finditer(now, *m.span())]
            edits.append((*m.span(), new))
        out.rewrite(edits)
    if words:
        now = out.text
        out.rewrite(_bracketed(now))
        now, edits = out.text, []
        for m in _BARE.finditer(now):
            # a plain dot counts when it was bracketed or the word before is no plain word, or else every "at" before a host name would
            low, high = m.span("domain")
            host = "." in m["domain"] and re.search("[A-Za-z]", m["domain"])
            if m["dot"] or (host and (any(out.changed[i] and now[i] == "." for i in range(low, high)) or _named(now, m.start()))):
                edits.append((*m.span(), [("@", *m.span())]))
        out.rewrite(edits)
        now, edits, at = out.text, [], -1
        while (at := now.find("@", at + 1)) >= 0:
            label = _LABEL.match(now, at + 1)
            while label:
                end = label.end()
                if dot := _BARE_DOT.match(now, end):
                    edits.append((*dot.span(), [(".", *dot.span())]))
                    end = dot.end()
                label = _LABEL.match(now, end) if dot or now[end : end + 1] == "." else None
        out.rewrite(edits)
    return out


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans of disguised identifiers: each holds a rewritten character and isn't within a base span of its kind."""
    needs = disguised(text)
    if not any(needs):
        return []
    plain = normalise(text, *needs)
    out = []
    for kind, start, end in base_spans(plain.text):
        if plain.changed[start:end].any():
            span = Span(kind, int(plain.starts[start:end].min()), int(plain.ends[start:end].max()))
            if not any(b.kind == kind and b.start <= span.start and span.end <= b.end for b in base):
                out.append(span)
    return out


def listed(spans: list[Span]) -> str:
    """``kind:start:end`` joined by commas, by kind as in KINDS, then start."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(set(spans), key=lambda x: (KINDS.index(x.kind), x.start, x.end)))


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a whole text."""
    base = base_spans(text)
    return base, added_spans(text, base)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each span: id, kind, start, end, disguised (whether the method added it), value.

    ``value`` is the source text of the span.  Texts without spans give no row.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                base, added = scan(text)
                for spans, hidden in ((base, False), (added, True)):
                    rows += [(s.kind, s.start, s.end, hidden, text[s.start : s.end]) for s in spans]
                    at += [i] * len(spans)
            columns = [pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=["id", *schema.names])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(tidy(run), f"id {kind}, kind string, start long, end long, disguised boolean, value string").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts of base spans by kind, their digest, and all spans.

    Columns: id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and
    added), n_added.  One pass, no shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sums, spans, added = [], [], [], []
            for text in batch.column(1):
                base, more = scan(text.as_py() or "")
                counts.append([sum(s.kind == k for s in base) for k in KINDS])
                sums.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + more))
                added.append(len(more))
            by_kind = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *by_kind, pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    out = narrow.mapInArrow(tidy(run), f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_col)


def masked(text: str) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    base, more = scan(text)
    out, last = [], 0
    for kind, start, end in sorted(base + more, key=lambda s: (s.start, -s.end)):
        if start >= last:
            out += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join([*out, text[last:]]) if out else text


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns with personal data masked in the text and its length set anew.

    Null texts stay null; other columns stay as they are.
    """
    small_batches(docs.sparkSession)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([None if t is None else masked(t) for t in batch.to_pylist()], pa.string())

    out = docs.withColumn(text_col, F.arrow_udf(run, "string")(F.col(text_col)))
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
