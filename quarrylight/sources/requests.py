"""The request log: JSON lines, one for each search."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

_NUMBERS = ("chunks", "naiveTokens", "targetedTokens", "savedTokens")
SCHEMA = S.StructType([*(S.StructField(n, S.StringType()) for n in ("ts", "client", "query")), *(S.StructField(n, S.DoubleType()) for n in _NUMBERS)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """ord, ts, client, query, chunks, naive_tokens, targeted_tokens, saved_tokens.

    Blank and malformed lines and those without a numeric saving are dropped.  A missing
    log is empty.  ``ord`` can be compared: files by when they were last written, then by name,
    then the lines of each.
    """
    if "://" not in path and not os.path.exists(path):
        numbered = spark.createDataFrame([], "value string, ord struct<written: timestamp, file: string, split: long, line: long>")
    else:
        of = F.struct(F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
        numbered = spark.read.text(path).select("value", of.alias("ord"))
    kept = numbered.select("ord", F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"}).alias("r")).where("r.savedTokens IS NOT NULL")
    return kept.select("ord", "r.ts", "r.client", "r.query", F.col("r.chunks").alias("chunks"), F.col("r.naiveTokens").alias("naive_tokens"), F.col("r.targetedTokens").alias("targeted_tokens"), F.col("r.savedTokens").alias("saved_tokens"))


def append(rows: DataFrame, path: str) -> None:
    """Adds searches to the log; columns as :func:`read` gives them, without ord."""
    rows.select("ts", "client", "query", "chunks", F.col("naive_tokens").alias("naiveTokens"), F.col("targeted_tokens").alias("targetedTokens"), F.col("saved_tokens").alias("savedTokens")).write.mode("append").json(path)


def dashboard(summary: DataFrame, clients: DataFrame) -> str:
    """The log's totals and clients as text; one row, and one for each client, come to the driver."""
    s = summary.first()
    if not s["calls"]:
        return "No searches recorded yet."
    lines = [f"Searches        {s['calls']:,}", f"Naive tokens    {s['naive_tokens']:,.0f}", f"Targeted tokens {s['targeted_tokens']:,.0f}", f"Saved tokens    {s['saved_tokens']:,.0f} ({s['saved_pct']}%)", f"Period          {(s['first_ts'] or '')[:10]} to {(s['last_ts'] or '')[:10]}", "", "By client"]
    lines += [f"  {(r['client'] or '?').ljust(20)} {r['calls']:>8,} {r['saved_tokens']:>14,.0f}" for r in clients.orderBy("place").collect()]
    return "\n".join(lines)
