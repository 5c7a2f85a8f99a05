"""A stream of changed files kept merged into an index, and the sweep that finds deletions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import changes
from quarrylight.sources import shared

SAVE_SECONDS = 2
#: Deltas that are read beside a base before they become the next base.
MOST_DELTAS = 8


class Index:
    """A table of files below a folder, as a base and deltas; a batch adds a delta.

    What is there is found by listing the folder, so a restarted stream goes on where the last
    one ended.  A batch writes its own rows only; every so often base and deltas become a new
    base.  Unfinished tables are not read, and the next attempt overwrites them.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _tables(self) -> tuple[int, list[int]]:
        """Numbers of the newest base (0: none) and of the deltas after it."""
        numbers = [(kind, int(n)) for kind, _, n in (name.partition("=") for name in shared.listed(self.spark, self.folder)) if n]
        base = max((n for kind, n in numbers if kind == "base"), default=0)
        return base, sorted(n for kind, n in numbers if kind == "delta" and n > base)

    def read(self) -> DataFrame | None:
        """The newest row of each file that isn't gone; None where nothing was ever written."""
        base, deltas = self._tables()
        names = ([("base", base)] if base else []) + [("delta", n) for n in deltas]
        if not names:
            return None
        rows = None
        for kind, n in names:
            one = self.spark.read.parquet(f"{self.folder}/{kind}={n}").withColumn("_at", F.lit(n))
            rows = one if rows is None else rows.unionByName(one)
        if deltas:
            values = [c for c in rows.columns if c not in ("file_path", "_at")]
            rows = rows.groupBy("file_path").agg(F.max_by(F.struct(*values), "_at").alias("_row")).select("file_path", "_row.*")
        return rows.where("NOT gone").select(*[c for c in rows.columns if c not in ("gone", "_at")])

    def write(self, rows: DataFrame) -> None:
        """Adds rows (file_path, gone, and others) as the next delta."""
        base, deltas = self._tables()
        at = max([base, *deltas]) + 1
        rows.write.mode("overwrite").parquet(f"{self.folder}/delta={at}")
        if len(deltas) + 1 >= MOST_DELTAS:
            self.read().withColumn("gone", F.lit(False)).write.mode("overwrite").parquet(f"{self.folder}/base={at}")

    def merge(self, batch: DataFrame, _epoch: int = 0) -> None:
        """Files of a micro-batch replace those with their paths; of one path, the newest row counts."""
        newest = batch.groupBy("file_path").agg(F.max_by(F.struct("hash", "text"), "seq").alias("_row")).select("file_path", "_row.hash", "_row.text", F.lit(False).alias("gone"))
        self.write(newest)

    def sweep(self, seen: DataFrame) -> DataFrame:
        """Brings the index to what is there now and returns what changed; a stream alone can't see deletions."""
        old = self.read()
        if old is None:
            old = seen.where("false")
        found = changes.diff(old, seen).where("change <> 'same'").checkpoint()
        gone = old.join(found.where("change = 'unlink'").select("file_path"), "file_path", "left_semi").withColumn("gone", F.lit(True))
        fresh = changes.changed_only(old, seen).select(*old.columns).withColumn("gone", F.lit(False))
        self.write(gone.unionByName(fresh))
        return found


def follow(spark: SparkSession, source: str, schema: str, index: Index, checkpoint: str, once: bool = False, most_files: int = 1000):
    """A running query that merges files appearing below ``source`` into the index."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(source)
    writer = stream.writeStream.foreachBatch(index.merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{SAVE_SECONDS} seconds")).start()


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as three batches of a stream that is restarted for each, then a sweep in which some are gone: the index that remains."""
    folder = f"{shared.shared_dir(spark)}/reindex-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.concat(F.lit("/repo/doc_"), "doc_id").alias("file_path"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").alias("seq"), "doc_id")
    hashed = rows.withColumn("hash", T.content_hash(F.col("text")))
    for n in range(3):
        hashed.where(F.col("doc_id") % 3 == n).select("file_path", "text", "seq", "hash").write.mode("append").parquet(f"{folder}/in")
        query = follow(spark, f"{folder}/in", "file_path string, text string, seq long, hash string", Index(spark, f"{folder}/index"), f"{folder}/state", once=True)
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    index = Index(spark, f"{folder}/index")
    index.sweep(hashed.where(F.col("doc_id") % 5 != 0).select("file_path", "hash", "text"))
    return index.read().select("file_path", "hash")
