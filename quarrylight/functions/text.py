"""Text expressions that stay within Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that the relevance gate doesn't count.
STOPWORDS = (
    "the", "and", "for", "are", "was", "this", "that", "with", "from", "what", "where", "when", "why", "how", "does", "did",
    "has", "have", "its", "you", "your", "into", "not", "but", "can", "will", "all", "any", "out", "get", "got", "let", "via",
    "per", "off", "is", "of", "to", "in", "on", "at", "by", "or", "if", "we", "do", "an", "as", "be", "it", "so", "no", "up",
    "my", "me",
)

#: Tokens of one character are dropped.
LEAST_LENGTH = 2
#: Characters of code that go into an embedding.
EMBEDDED_CHARS = 1000


def tokens(text: Column) -> Column:
    """Index tokens: camel case split, lower case, runs of a-z and 0-9, two characters or more."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(spaced), F.lit(f"[a-z0-9]{{{LEAST_LENGTH},}}"), F.lit(0))


def gate_terms(query: Column) -> Column:
    """Terms that the gate counts: lower-cased before any split, so camel case and underscores stay; repeats stay."""
    words = F.split(F.lower(F.coalesce(query, F.lit(""))), r"\W+")
    return F.filter(words, lambda t: (F.length(t) >= LEAST_LENGTH) & ~t.isin(*STOPWORDS))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def estimated_tokens(text: Column) -> Column:
    """Tokens by the fallback rule: a quarter of the UTF-16 length, rounded up."""
    return F.ceil(utf16_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"\s+$", "")


def signature(code: Column) -> Column:
    """First line, trimmed."""
    return trimmed(F.substring_index(code, "\n", 1))


def embedding_input(symbol: Column, code: Column) -> Column:
    return F.concat(symbol, F.lit("\n"), F.substring(code, 1, EMBEDDED_CHARS))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; null if one side is."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def content_hash(text: Column) -> Column:
    return F.sha1(text.cast("binary"))
