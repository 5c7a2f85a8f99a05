"""Vectors of chunks: their text form, and a model plugged in from outside."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import changes


def _to_text(vectors: pa.Array) -> pa.Array:
    return pa.array([None if v is None else base64.b64encode(np.asarray(v, "<f4").tobytes()).decode() for v in vectors.to_pylist()], pa.string())


def _from_text(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else np.frombuffer(base64.b64decode(t), "<f4").tolist() for t in texts.to_pylist()], pa.list_(pa.float32()))


def to_text(vector: Column) -> Column:
    """Little-endian 32-bit floats in base64."""
    return F.arrow_udf(_to_text, "string")(vector)


def from_text(text: Column) -> Column:
    return F.arrow_udf(_from_text, "array<float>")(text)


def vector(text: Column, model: Callable[[list[str]], list[list[float]]]) -> Column:
    """The model's vector of a text; null for null."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            held = batch.to_pylist()
            found = iter(model([t for t in held if t is not None]))
            yield pa.array([None if t is None else next(found) for t in held], pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>")(text)


def has_any(chunks: DataFrame) -> bool:
    """Whether some chunk has a vector."""
    return "embedding" in chunks.columns and not chunks.where("embedding IS NOT NULL AND size(embedding) > 0").limit(1).isEmpty()


def embedded(chunks: DataFrame, model: Callable[[list[str]], list[list[float]]] | None, most_in_file: int = 500) -> DataFrame:
    """Adds embedding; null without a model, and for chunks of files with more than ``most_in_file``.

    ``model`` maps texts to vectors of length 1 and runs on executors, a batch at a time.
    """
    if model is None:
        return chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
    guarded = changes.dense_guard(chunks, most_in_file)
    asked = F.when(F.col("embeddable"), T.embedding_input(F.col("symbol_name"), F.col("code")))
    return guarded.withColumn("embedding", vector(asked, model)).drop("embeddable")
