"""Token counts of documents in flat token files, by a scan for separators.

A flat file is token identifiers of a fixed width, one document after the other, each ended
by the end-of-document identifier; there is no index.  Files are cut into blocks that are
read apart; in each a vectorised comparison finds the separators.  Documents that cross
block borders are stitched by a prefix scan over the blocks of a file: the running number
of tokens gives each block its place, the running maximum of separator places gives where
its first document began.

An empty file has no documents; tokens after the last separator are one unended document.
Empty documents (two separators side by side) count zero tokens.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.llm._common import shared_dir, small_batches, tidy, written
from quarrylight.llm.bpe import _shared_codec

BLOCK_TOKENS = 1 << 20


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it; ``file:/x`` is written ``file:///x`` first, and ``s3a`` is ``s3``."""
    if uri.startswith("s3a://"):
        uri = f"s3://{uri[6:]}"
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return pafs.FileSystem.from_uri(uri)


def write_flat(docs: DataFrame, path: str, vocab_path: str, pattern: str, eod: int, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes every document's tokens and a separator to flat files below ``path``.

    Returns the manifest, which has to be written or counted for the files to be made: file,
    ordinal, id.  Every attempt of a task writes a file of its own and the manifest names
    those of the attempts that count, so lost executors and repeated tasks leave no mixture;
    files that the manifest doesn't name are to be ignored.  Null texts are empty documents.
    """
    import tiktoken

    get = _shared_codec(docs.sparkSession, vocab_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ranks = get_ranks()
        if eod in ranks.values() or eod > np.iinfo(dtype).max:
            raise ValueError("the separator must be free in the vocabulary and fit the width")
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        store, base = _open(path)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.tok"
        ordinal = 0
        with store.open_output_stream(f"{base}/{name}") as out:
            for batch in batches:
                if not batch.num_rows:
                    continue
                pieces = []
                for text in batch.column(1):
                    ids = encode(text.as_py() or "")
                    ids.append(eod)
                    pieces.append(np.array(ids, dtype))
                out.write(np.concatenate(pieces).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), batch.column(0)], names=["file", "ordinal", "id"])
                ordinal += n
        if not ordinal:
            store.delete_file(f"{base}/{name}")

    def get_ranks() -> dict[bytes, int]:
        return get().ranks

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(tidy(run), "file string, ordinal long, id long")


def scan(spark: SparkSession, path: str, eod: int, dtype: str = "<u2", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Documents of the flat files below ``path``: file, ordinal (from 0), start (token), n_tokens, ended.

    Files are listed by Spark and read block by block, so their size doesn't matter.
    """
    width = np.dtype(dtype).itemsize
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path).select("path", "length")
    n_tokens = F.floor(F.col("length") / width)
    blocks = files.where(n_tokens > 0).select("path", n_tokens.alias("all"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n_tokens - 1) / block_tokens).cast("long"))).alias("block"))
    spread = blocks.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for uri, total, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                store, name = _open(uri)
                first = block * block_tokens
                count = min(block_tokens, total - first)
                with store.open_input_file(name) as file:
                    tokens = np.frombuffer(file.read_at(count * width, first * width), dtype)
                at = np.flatnonzero(tokens == eod)
                out.append((uri.rsplit("/", 1)[-1], block, count, len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, at[:-1] + 1, np.diff(at) - 1))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.string(), *[pa.int64()] * 5, *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "count", "seps", "first", "last", "begins", "inner"])

    # the blocks are scanned once; sums over a file's blocks carry a few numbers for each, not its documents
    scanned = written(spread.mapInArrow(tidy(run), "file string, block long, count long, seps long, first long, last long, begins array<long>, inner array<long>"), "flat-blocks")
    found, lengths = scanned.drop("begins", "inner"), scanned.where("seps > 1").select("file", "block", "begins", "inner")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    placed = found.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("ordinal", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    stitched = placed.withColumn("begun", F.coalesce(F.max(F.col("start") + F.col("last")).over(before), F.lit(-1)) + 1).withColumn("ends", F.max(F.col("start") + F.col("count")).over(whole)).withColumn("final", F.max(F.col("start") + F.col("last")).over(whole))
    heads = stitched.where("seps > 0").select("file", "ordinal", F.col("begun").alias("start"), (F.col("start") + F.col("first") - F.col("begun")).alias("n_tokens"), F.lit(True).alias("ended"))
    # a document within the block begins after the first separator and the lengths before it
    inner = stitched.join(lengths, ["file", "block"]).select("file", "ordinal", F.col("start").alias("base"), F.posexplode(F.arrays_zip("begins", "inner")).alias("i", "each"))
    within = inner.select("file", (F.col("ordinal") + F.col("i") + 1).alias("ordinal"), (F.col("base") + F.col("each.begins")).alias("start"), F.col("each.inner").alias("n_tokens"), F.lit(True).alias("ended"))
    last = stitched.groupBy("file").agg(F.sum("seps").alias("ordinal"), (F.coalesce(F.max("final"), F.lit(-1)) + 1).alias("start"), F.max("ends").alias("ends"))
    open_end = last.where("ends > start").select("file", "ordinal", "start", (F.col("ends") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return heads.unionByName(within).unionByName(open_end)


def counts(docs: DataFrame, vocab_path: str, pattern: str, eod: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of all documents, read off the flat files that they are written to: id, n_tokens, file, ordinal.

    The files lie in the shared folder until they are scanned.  Repeated rows are documents of
    their own; columns other than id and text are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = shared_dir(spark)
    path = f"{base if '://' in base or base.startswith('file:') else f'file://{base}'}/flat-{uuid.uuid4().hex}"
    manifest = written(write_flat(docs, path, vocab_path, pattern, eod, id_col=id_col, text_col=text_col), "flat-manifest")
    if manifest.limit(1).count() == 0:
        return manifest.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_tokens"), "file", "ordinal")
    found = scan(spark, path, eod)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)  # what was scanned is written
    # both sides have a row for each document: neither is for broadcasting
    return manifest.join(found.hint("merge"), ["file", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens", "file", "ordinal")
