"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, read by Spark alone (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` below the shared folder and reads it again: lineage ends there.

    The files survive lost executors, and later reads of the result never repeat the work
    before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*frames: DataFrame) -> None:
    """Deletes the files of tables made by :func:`written` that no result reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        base = shared_dir(spark).split("://")[-1]
        for parent in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if base.removeprefix("file:") in parent:
                path = jvm.org.apache.hadoop.fs.Path(parent)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that go to a Python worker at once: with whole texts, memory is what bounds a batch.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch to BATCH_BYTES; a lower one stays."""
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH, "64m"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back() -> None:
    """Returns memory that this process holds but doesn't use to the system, where it can."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


#: Memos that a worker process keeps from task to task, and the operator that they are for.
_MEMOS: list[dict] = []
_holder: str = ""


def memo(held: dict) -> dict:
    """Registers a memo: it is emptied when the worker goes on to another operator."""
    _MEMOS.append(held)
    return held


def take_over(operator: str) -> None:
    global _holder
    if _holder != operator:
        for held in _MEMOS:
            held.clear()
        _holder = operator


def tidy(run: Callable) -> Callable:
    """A task that gives its memory back at its end: workers live on, and what they keep adds up over stages."""
    operator = run.__module__

    def within(batches: Iterator) -> Iterator:
        take_over(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return within


def reserved(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns named by place, so that none can clash with an operator's own, and where each name went."""
    names = {c: f"__{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def original(df: DataFrame, like: DataFrame) -> DataFrame:
    """Columns named by :func:`reserved` under their own names again; others go."""
    return df.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(like.columns)])
