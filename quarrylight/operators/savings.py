"""Accounting of tokens that searches saved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOG_CAP, RECENT = 200, 10


def _rounded(x):
    return F.floor(x + 0.5).cast("long")


def index_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, chunks, last_updated (when a file was last indexed; null where files don't tell)."""
    latest = F.max("updated") if "updated" in files.columns else F.lit(None).cast("timestamp")
    counted = files.agg(F.count("*").alias("files"), latest.alias("last_updated"))
    return counted.crossJoin(chunks.agg(F.count_distinct("chunk_id").alias("chunks"))).select("files", "chunks", "last_updated")


def track_search(results: DataFrame, files: DataFrame, contexts: DataFrame) -> DataFrame:
    """For each query: naive tokens (whole files touched), targeted tokens, saved (never below 0), chunks.

    ``contexts``: qid, targeted_tokens.  Files without a record count 0.
    """
    touched = results.select("qid", "file_path").distinct().join(files.select("file_path", "tokens"), "file_path", "left")
    naive = touched.groupBy("qid").agg(F.sum(F.coalesce("tokens", F.lit(0))).alias("naive_tokens"))
    counts = results.groupBy("qid").agg(F.count("*").alias("chunk_count"))
    joined = naive.join(counts, "qid").join(contexts, "qid")
    return joined.select("qid", "naive_tokens", "targeted_tokens", F.greatest(F.lit(0), F.col("naive_tokens") - F.col("targeted_tokens")).alias("saved_tokens"), "chunk_count")


def net_savings(log: DataFrame) -> DataFrame:
    """One row over the whole log: net saving, its percentage, and calls, which stop counting at the log's cap."""
    sums = log.agg(F.coalesce(F.sum("naive_tokens"), F.lit(0)).alias("naive_tokens"), F.coalesce(F.sum("targeted_tokens"), F.lit(0)).alias("targeted_tokens"), F.count("*").alias("_n"))
    saved = F.greatest(F.lit(0), F.col("naive_tokens") - F.col("targeted_tokens"))
    pct = F.when(F.col("naive_tokens") > 0, _rounded(saved / F.col("naive_tokens") * 100)).otherwise(0)
    return sums.select(F.least(F.col("_n"), F.lit(LOG_CAP)).alias("calls"), "naive_tokens", "targeted_tokens", saved.alias("saved_tokens"), pct.cast("long").alias("saved_pct"))


def _requests(log: DataFrame) -> DataFrame:
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("naive_tokens", "targeted_tokens")]
    return log.where("saved_tokens IS NOT NULL").select("ord", "ts", "client", *zero, "saved_tokens")


def request_summary(log: DataFrame) -> DataFrame:
    """One row: calls, token sums, percentage, and the first and last timestamp by position in the log."""
    rows = _requests(log)
    sums = rows.agg(
        F.count("*").alias("calls"),
        *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("naive_tokens", "targeted_tokens", "saved_tokens")],
        F.min_by("ts", "ord").alias("first_ts"),
        F.max_by("ts", "ord").alias("last_ts"),
    )
    return sums.withColumn("saved_pct", F.when(F.col("naive_tokens") > 0, _rounded(F.col("saved_tokens") / F.col("naive_tokens") * 100)).otherwise(0).cast("long"))


def by_client(log: DataFrame) -> DataFrame:
    """client, calls, saved_tokens and place: most saved first, then who came first."""
    groups = _requests(log).groupBy("client").agg(F.count("*").alias("calls"), F.sum("saved_tokens").alias("saved_tokens"), F.min("ord").alias("first_ord"))
    # one row for each client
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("saved_tokens", 6)), "first_ord")))


def recent(log: DataFrame, n: int = RECENT) -> DataFrame:
    """The last n rows of the log, by position."""
    return _requests(log).orderBy(F.desc("ord")).limit(n)
