"""Lempel-Ziv phrase fingerprints and the likeness of texts by them.

A text's UTF-8 bytes are parsed into dictionary phrases: each phrase is the shortest run of
bytes that isn't in the dictionary yet, and enters it.  Texts that would compress well
together share phrases.  The fingerprint is the ``SIZE`` smallest 32-bit hashes of the
phrases, and likeness is the share of common values among the ``SIZE`` smallest of both,
an estimate of the Jaccard similarity of the phrase sets.

Equal texts have equal fingerprints.  Null and empty texts have an empty one; two empty
ones are alike (1.0), an empty and another aren't (0.0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._common import small_batches, tidy

#: Values kept of each text; the standard error of likeness is at most 0.5 / sqrt(SIZE).
SIZE = 128
#: Rows of a range of ids that one task goes through in order, and ranges at most.
ROWS_OF_RANGE, MOST_RANGES = 4_000, 20_000


def parse(data: bytes, seen: set[bytes], start: int, end: int) -> tuple[list[bytes], int]:
    """Parses ``data[start:end]``, adding to ``seen``; the new phrases, and where an unfinished one begins.

    A dictionary holds every beginning of its phrases, so membership falls once with
    length: a phrase's end is sought from the length of the one before, up or down.
    """
    phrases: list[bytes] = []
    at, length = start, 1
    while at < end:
        stop = min(at + length, end)
        if data[at:stop] in seen:
            stop += 1
            while stop <= end and data[at:stop] in seen:
                stop += 1
            if stop > end:
                return phrases, at
        else:
            while stop - 1 > at and data[at : stop - 1] not in seen:
                stop -= 1
        phrase = data[at:stop]
        seen.add(phrase)
        phrases.append(phrase)
        length, at = stop - at, stop
    return phrases, at


def _hashes(phrases: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, phrases), np.uint32, len(phrases))


def _smallest(values: np.ndarray) -> np.ndarray:
    if len(values) > 2 * SIZE:
        values = values[values <= np.partition(values, 2 * SIZE - 1)[2 * SIZE - 1]]
    kept = np.unique(values)[:SIZE]
    return kept


def _tail(data: bytes, at: int) -> list[bytes]:
    """An unfinished phrase at the end counts as a phrase."""
    return [data[at:]] if at < len(data) else []


def sketch(text: str) -> np.ndarray:
    """The fingerprint of a text as sorted numbers."""
    data = text.encode("utf-8", "surrogatepass")
    phrases, at = parse(data, set(), 0, len(data))
    return _smallest(_hashes(phrases + _tail(data, at)))


def sketch_both(text: str, edited: str, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two texts whose first ``common`` characters are equal, parsed but once."""
    first, second = text.encode("utf-8", "surrogatepass"), edited.encode("utf-8", "surrogatepass")
    split = len(text[:common].encode("utf-8", "surrogatepass"))
    seen: set[bytes] = set()
    shared, at = parse(first, seen, 0, split)
    out, head = [], _hashes(shared)
    for data, dictionary in ((second, seen.copy()), (first, seen)):
        more, last = parse(data, dictionary, at, len(data))
        out.append(_smallest(np.concatenate([head, _hashes(more + _tail(data, last))])))
    return out[1], out[0]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common values among the smallest of both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    smallest = np.union1d(a, b)
    if max(len(a), len(b)) == SIZE:  # else both are whole, and so is their union
        smallest = smallest[:SIZE]
    return float(np.isin(smallest, np.intersect1d(a, b), assume_unique=True).sum() / len(smallest))


def written_out(values: np.ndarray) -> str:
    """A fingerprint as text: eight hexadecimal digits for each number."""
    return values.astype(">u4").tobytes().hex()


def read_back(fingerprint: str) -> np.ndarray:
    """The numbers of a fingerprint's text."""
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fingerprint`` of every whole text; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [written_out(sketch(t.as_py() or "")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["id", "fingerprint"])

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(tidy(run), f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def compare(pairs: DataFrame, left: str = "fingerprint_a", right: str = "fingerprint_b", name: str = "likeness") -> DataFrame:
    """Adds the likeness of two fingerprint columns; null where one is null."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            yield pa.array([None if x is None or y is None else likeness(read_back(x), read_back(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return pairs.withColumn(name, F.arrow_udf(run, "double")(F.col(left), F.col(right)))


def _ranges(rows: DataFrame) -> tuple[DataFrame, int]:
    """Adds ``range``: about equally filled ranges of ids, found by distributed quantiles; and their number.

    Null ids share one more range, the last.  The bounds on the driver are at most
    MOST_RANGES numbers.
    """
    ids = rows.select(F.col("id").cast("double").alias("id_double"))
    n = max(1, min(MOST_RANGES, ids.count() // ROWS_OF_RANGE + 1))
    held = ids.where("id_double IS NOT NULL")
    bounds = sorted(set(held.approxQuantile("id_double", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    if not bounds:
        return rows.withColumn("range", F.when(F.col("id").isNull(), 1).otherwise(0)), 2
    cut = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol="id_double", outputCol="range_double", handleInvalid="keep")
    out = cut.transform(rows.withColumn("id_double", F.col("id").cast("double")))
    return out.withColumn("range", F.coalesce(F.col("range_double").cast("int"), F.lit(len(bounds) + 1))).drop("id_double", "range_double"), len(bounds) + 2


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compares each document with an edit of itself and with the next document.

    The order is descending id (ties by text, null ids last); after the last comes the
    first.  The edited text is the document with its last floor(n/2) characters replaced by
    the first as many (or all) of the next document.  Null texts count as empty.

    Returns id, n_chars (long), edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next.

    The text is shuffled once, by ranges of ids that are walked in order; the row that opens
    a range also goes, as a guard, to the range before it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ranged, n = _ranges(narrow)
    first_of = {r["range"]: r["first"] for r in ranged.groupBy("range").agg(F.max("id").alias("first")).collect()}  # MOST_RANGES + 2 rows at most
    order = sorted(first_of, key=lambda r: (r == n - 1, -r))
    opening = spark.createDataFrame([(r, first_of[r], order[i - 1]) for i, r in enumerate(order)], "range int, first long, before int")
    marked = ranged.join(F.broadcast(opening), "range")
    own, guard = F.struct(F.col("range").alias("at"), F.lit(False).alias("guard")), F.struct(F.col("before").alias("at"), F.lit(True).alias("guard"))
    placed = marked.select("id", "text", F.inline(F.when(F.col("id").eqNullSafe(F.col("first")), F.array(own, guard)).otherwise(F.array(own))))
    dealt = placed.repartitionById(n, "at").sortWithinPartitions("at", "guard", F.desc_nulls_last("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # id, text, range; its sketch comes with the next row
        rows: list[tuple] = []
        sealed = None  # a range whose guard has been met

        def pair(now: tuple, following: str) -> tuple:
            doc_id, text, _ = now
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            own, other = sketch_both(text, edited, len(text) - half)
            return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        waiting = None  # finished but for the next document's fingerprint
        for batch in batches:
            for doc_id, text, at, guard in zip(*(batch.column(i) for i in range(4)), strict=True):
                doc_id, text, at, guard = doc_id.as_py(), text.as_py(), at.as_py(), guard.as_py()
                if at == sealed:
                    continue  # only the first guard counts
                done = pair(held, text) if held is not None else None
                if waiting is not None and done is not None:
                    rows.append(_row(waiting, done[3]))
                waiting = done
                held = (doc_id, text, at)
                if guard:
                    if waiting is not None:
                        rows.append(_row(waiting, sketch(text)))
                    waiting = held = None
                    sealed = at
                if len(rows) >= 1000:
                    yield emit(rows)
                    rows = []
        if rows:
            yield emit(rows)

    out = dealt.select("id", "text", "at", "guard").mapInArrow(tidy(run), "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id_col)


def _row(now: tuple, following: np.ndarray) -> tuple:
    doc_id, size, digest, own, edited = now
    return doc_id, size, digest, written_out(own), written_out(edited), likeness(own, edited), likeness(own, following)
