"""Versioned snapshots of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMAT = 2
TABLES = ("files", "chunks", "postings", "edges", "search_log")


def save(spark: SparkSession, folder: str, tables: dict[str, DataFrame], model: str = "") -> int:
    """Writes a new version, then the row that names it; a reader sees whole versions only."""
    version = (_current(spark, folder) or {"snapshot": 0})["snapshot"] + 1
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/v={version}/{name}")
    meta = spark.createDataFrame([(version, FORMAT, model)], "snapshot int, format int, model string")
    meta.coalesce(1).write.mode("append").parquet(f"{folder}/current")
    return version


def _current(spark: SparkSession, folder: str) -> dict | None:
    try:
        rows = spark.read.schema("snapshot int, format int, model string").parquet(f"{folder}/current")
        row = rows.orderBy(rows["snapshot"].desc()).first()
    except Exception:  # noqa: BLE001  nothing readable there is no snapshot
        return None
    return row.asDict() if row else None


def current(spark: SparkSession, folder: str) -> int | None:
    """The newest version's number."""
    found = _current(spark, folder)
    return found and found["snapshot"]


def load(spark: SparkSession, folder: str, model: str = "") -> dict[str, DataFrame] | None:
    """The newest version's tables; None if there is none, or of another format or embedding model."""
    now = _current(spark, folder)
    if now is None or now["format"] != FORMAT or now["model"] != model:
        return None
    out = {}
    for name in TABLES:
        try:
            out[name] = spark.read.parquet(f"{folder}/v={now['snapshot']}/{name}")
        except Exception:  # noqa: BLE001  a table that was not saved
            continue
    return out or None
