"""Sharding by a k-d tree over document metadata.

Each node of the tree is split along the dimension in which it is widest, at the weighted
median of the sizes there (or the quantile that leaves each side its share of the shards),
until leaves reach the target.  Medians are found by distributed histograms: each round
sums the bytes of some hundred bins of every open node at once and goes on in the bin that
holds the cut.  Rows with equal values are told apart by a random number fixed for each
row, so that a hot value, or any group of copies, is split like everything else.

Rows never leave Spark: the driver holds a few numbers for each node of one level.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm._common import remove, written
from quarrylight.llm.mixing import ordered_sums

BINS = 512
#: Rows that are numbered within one task.
ROWS_OF_SLICE = 50_000
_DIMENSIONS = ("by_id", "by_size", "by_source", "by_lang")


@dataclass
class _Cut:
    """The search for one node's cut: along ``dim``, and among equal values along the tie key."""

    node: int
    dim: int
    low: float
    high: float
    goal: float  # bytes that go left
    below: float = 0.0  # bytes known to be left of ``low``
    value: float | None = None  # a value that is itself cut, by the tie key
    at: float | None = None  # rows below it go left
    done: bool = field(default=False)


def _placed(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``by_<name>``: the place of the row's string among all distinct ones in byte order; nulls are -1.

    Whole strings count.  Places come from a range sort of the distinct strings and prefix
    sums of its parts, and go back to the rows by a join, whose hot keys Spark splits.
    """
    values = rows.groupBy(F.col(name).alias("_value")).agg(F.lit(1).alias("_one")).where("_value IS NOT NULL")
    places = written(ordered_sums(values, [F.encode("_value", "UTF-8")], {"_place": "_one"}).select("_value", F.col("_place").cast("double").alias(f"by_{name}")), "kd-places")
    return rows.join(places, F.col(name) == F.col("_value"), "left").drop("_value").withColumn(f"by_{name}", F.coalesce(f"by_{name}", F.lit(-1.0)))


def rows_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A narrow table: id, size, text_crc32, the metadata dimensions and a tie key for each row."""
    have = {c.lower(): docs[c] for c in docs.columns}
    text = F.col(text_col).cast("string")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    named = lambda name: (have[name] if name in have else F.lit(None)).cast("string").alias(name)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"),
        F.coalesce(F.col(id_col).cast("double"), F.lit(-1.0)).alias("by_id"),
        size.cast("double").alias("by_size"),
        named("source"),
        named("lang"),
        (F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id(), F.col(id_col)), 11).cast("double") / F.lit(float(1 << 53))).alias("tie"),
    )
    rows = written(rows, "kd-plain")  # texts are read once
    return _placed(_placed(rows, "source"), "lang").select("id", "size", "crc", *_DIMENSIONS, "tie")


def _frame(spark, cuts: list[_Cut]) -> DataFrame:
    rows = [(c.node, c.dim, c.low, c.high, c.value) for c in cuts]
    return spark.createDataFrame(rows, "node int, dim int, low double, high double, value double")


def _search(rows: DataFrame, cuts: list[_Cut]) -> None:
    """Narrows all open cuts down, one histogram job a round."""
    spark = rows.sparkSession
    while todo := [c for c in cuts if not c.done]:
        spot = F.element_at(F.array(*_DIMENSIONS), F.col("dim") + 1)
        # one row for each open node, so the broadcast is as small as the tree's level
        near = rows.join(F.broadcast(_frame(spark, todo)), "node").withColumn("spot", F.when(F.col("value").isNull(), spot).otherwise(F.when(spot == F.col("value"), F.col("tie"))))
        near = near.where((F.col("spot") >= F.col("low")) & (F.col("spot") <= F.col("high")))
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("spot") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).cast("int")
        bins = near.groupBy("node", F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("spot").alias("first"), F.max("spot").alias("last"))
        order = Window.partitionBy("node").orderBy("bin")
        sums = bins.withColumn("upto", F.sum("bytes").over(order)).withColumn("next", F.lead("first").over(order))
        goal = spark.createDataFrame([(c.node, c.goal - c.below) for c in todo], "node int, left double")
        crossing = sums.join(F.broadcast(goal), "node").where((F.col("upto") >= F.col("left")) & (F.col("upto") - F.col("bytes") < F.col("left")))
        found = {r["node"]: r for r in crossing.collect()}  # one row for each open node
        for c in todo:
            r = found.get(c.node)
            if r is None:  # nothing is to go left
                c.at, c.done = c.low, True
                continue
            before, short = r["upto"] - r["bytes"], c.goal - c.below
            if r["n"] == 1 or (r["first"] == r["last"] and c.value is not None):
                # one row is left: it goes to the side to which it is nearer
                left = r["upto"] - short <= short - before
                c.at = (math.nextafter(r["last"], math.inf) if r["next"] is None else r["next"]) if left else r["first"]
                c.done = True
            elif r["first"] == r["last"]:
                c.below += before
                c.value, c.low, c.high = r["first"], 0.0, 1.0
            else:
                c.below += before
                c.low, c.high = r["first"], r["last"]


def assign(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of about equal bytes: id, size, text_crc32, shard, slot and the row's box in the tree.

    Give the number of shards, or the bytes that a shard should have.  ``size`` is the UTF-8
    bytes of the text (null: none) plus 8; ``slot`` numbers the rows of a shard from 0
    without gaps.  Null ids and texts, ties and repeated rows are placed like any others;
    an empty table gives no rows.  Columns other than id, text, source and lang are not looked
    at, whatever their names.
    """
    rows = written(rows_of(docs, id_col, text_col), "kd-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    want = shards or max(1, math.ceil(total / (target_bytes or 1 << 30)))
    level = rows.withColumn("node", F.lit(0)).withColumn("shards", F.lit(want)).withColumn("first_shard", F.lit(0))
    spread: dict[str, float] = {}
    while True:
        extent = [f(x).alias(f"{f.__name__}_{x}") for x in _DIMENSIONS for f in (F.min, F.max)]
        nodes = level.groupBy("node", "shards", "first_shard").agg(F.sum("size").alias("bytes"), *extent).collect()  # a row for each node of this level
        if not spread:
            spread = {x: max([r[f"max_{x}"] for r in nodes], default=0) - min([r[f"min_{x}"] for r in nodes], default=0) for x in _DIMENSIONS}
        cuts, halves = [], {}
        for r in nodes:
            if r["shards"] > 1:
                wide = [(r[f"max_{x}"] - r[f"min_{x}"]) / spread[x] if spread[x] else 0.0 for x in _DIMENSIONS]
                dim = max(range(len(wide)), key=wide.__getitem__)
                left = r["shards"] // 2
                x = _DIMENSIONS[dim]
                cut = _Cut(r["node"], dim, r[f"min_{x}"], r[f"max_{x}"], r["bytes"] * left / r["shards"])
                if cut.low == cut.high:
                    cut.value, cut.low, cut.high = cut.low, 0.0, 1.0
                cuts.append(cut)
                halves[r["node"]] = (left, r["shards"] - left, r["first_shard"])
        if not cuts:
            break
        _search(level, cuts)
        made = [(c.node, c.dim, c.value, c.at, *halves[c.node]) for c in cuts]
        tree = docs.sparkSession.createDataFrame(made, "node int, dim int, value double, at double, n_left int, n_right int, base int")
        spot = F.element_at(F.array(*_DIMENSIONS), F.col("dim") + 1)
        left = F.when(F.col("value").isNull(), spot < F.col("at")).otherwise((spot < F.col("value")) | ((spot == F.col("value")) & (F.col("tie") < F.col("at"))))
        joined = level.join(F.broadcast(tree), "node", "left")
        split = F.col("dim").isNotNull()
        next_level = joined.select(
            *rows.columns,
            F.when(split, F.col("node") * 2 + F.when(left, 1).otherwise(2)).otherwise(F.col("node")).cast("int").alias("node"),
            F.when(split, F.when(left, F.col("n_left")).otherwise(F.col("n_right"))).otherwise(F.col("shards")).alias("shards"),
            F.when(split, F.when(left, F.col("base")).otherwise(F.col("base") + F.col("n_left"))).otherwise(F.col("first_shard")).alias("first_shard"),
        )
        old, level = level, written(next_level, "kd-level")
        remove(old)
    return _numbered(level)


def _numbered(level: DataFrame) -> DataFrame:
    """Slots: rows are numbered in slices of each shard, and slices start at prefix sums of their counts."""
    count = level.count()
    slices = max(1, math.ceil(count / ROWS_OF_SLICE))
    sliced = level.withColumn("slice", F.least(F.floor(F.col("tie") * slices), F.lit(slices - 1)).cast("int"))
    counts = sliced.groupBy("first_shard", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("first_shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("first_shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = Window.partitionBy("first_shard", "slice").orderBy("tie", "id", "crc", "size")
    return (
        sliced.join(starts, ["first_shard", "slice"])
        .withColumn("slot", (F.col("start") + F.row_number().over(rank) - 1).cast("long"))
        .select("id", "size", F.col("crc").alias("text_crc32"), F.col("first_shard").cast("int").alias("shard"), "slot", *_DIMENSIONS)
    )
