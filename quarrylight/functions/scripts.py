"""Script blocks of single-file components."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = re.compile(r"<script[^>]*>(.*?)</script>", re.I | re.S)
_BLANK = re.compile(r"[^\n]")


def mask(content: str) -> str | None:
    """The text with all but the insides of its script blocks blanked out, line for line; None without script."""
    out, last = [], 0
    for block in _BLOCK.finditer(content):
        if block[1].strip():
            start, end = block.span(1)
            out += [_BLANK.sub(" ", content[last:start]), content[start:end]]
            last = end
    return "".join([*out, _BLANK.sub(" ", content[last:])]) if out else None


def _masks(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else mask(t) for t in texts.to_pylist()], pa.string())


def masked(text: Column) -> Column:
    return F.arrow_udf(_masks, "string")(text)
