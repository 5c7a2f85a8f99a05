"""Counting tokens: a byte-pair counter over a vocabulary from outside, or the fallback rule.

A counter maps a text to a number.  The engine and the packing take any; a quarter of the UTF-16
length is what they use without one, and it alone stays within Catalyst.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import text as T


def quarter_length(text: str) -> int:
    """Tokens by the fallback rule."""
    return math.ceil(len(text.encode("utf-16-le", "surrogatepass")) / 2 / 4)


class BytePairs:
    """Counts by the ranks in a file of base64 tokens, each piece that ``pattern`` finds separately.

    The file must be readable on every executor.  It is read once a process, when first needed.
    A text that the tokenizer refuses counts by the fallback rule.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern, self._encoding = path, pattern, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "pattern": self.pattern, "_encoding": None}

    def __call__(self, text: str) -> int:
        if self._encoding is None:
            import tiktoken

            with open(self.path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
            self._encoding = tiktoken.Encoding("counter", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        try:
            return len(self._encoding.encode_ordinary(text))
        except Exception:  # noqa: BLE001  what the tokenizer refuses still has a length
            return quarter_length(text)


def counted(text: Column, counter: Callable[[str], int] | None = None) -> Column:
    """Tokens of a text (null: 0) by a counter; without one, by the fallback rule in Catalyst."""
    if counter is None or counter is quarter_length:
        return T.estimated_tokens(text)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([counter(t or "") for t in texts.to_pylist()], pa.int64())

    return F.arrow_udf(run, "long")(text)
