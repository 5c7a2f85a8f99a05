"""Incremental maintenance: what changed, and tables with the changes applied."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(indexed: DataFrame, seen: DataFrame) -> DataFrame:
    """file_path and change: add, change, same or unlink.  Both sides: file_path, hash."""
    old, new = indexed.select("file_path", F.col("hash").alias("old_hash")), seen.select("file_path", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "add").when(F.col("new_hash").isNull(), "unlink").when(F.col("old_hash") == F.col("new_hash"), "same").otherwise("change")
    return old.join(new, "file_path", "full").select("file_path", change.alias("change"))


def changed_only(indexed: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of ``seen`` whose path and hash aren't indexed yet."""
    return seen.join(indexed.select("file_path", "hash"), ["file_path", "hash"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "file_path") -> DataFrame:
    """``old`` with all rows of the keys in ``new`` replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def remove(rows: DataFrame, gone: DataFrame, key: str = "file_path") -> DataFrame:
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def dense_guard(chunks: DataFrame, most: int = 500) -> DataFrame:
    """Adds embeddable: false for chunks of files with more than ``most`` chunks."""
    counts = chunks.groupBy("file_path").agg(F.count("*").alias("_n"))
    return chunks.join(counts, "file_path").withColumn("embeddable", F.col("_n") <= most).drop("_n")
