"""Dependency edges between chunks, and expansion of results along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_ADDED, HOPS = 4, 2
# In what order files are tried for an imported path.
SUFFIXES = (".ts", ".tsx", ".js", ".jsx", ".vue", ".svelte", ".py", "/index.ts", "/index.tsx", "/index.js", "/index.jsx", "/__init__.py")


def references(chunks: DataFrame) -> DataFrame:
    """src, dst, pos: references within the file that resolve; others are dropped."""
    asked = chunks.select(F.col("chunk_id").alias("src"), F.posexplode("refs").alias("pos", "dst"))
    return asked.join(chunks.select(F.col("chunk_id").alias("dst")), "dst", "left_semi").select("src", "dst", "pos")


def external_references(chunks: DataFrame) -> DataFrame:
    """src, dst, pos: imported symbols, each resolved to the first file of SUFFIXES that has it."""
    asked = chunks.select(F.col("chunk_id").alias("src"), F.posexplode("ext_refs").alias("pos", "ref"))
    cut = F.length("ref") - F.length(F.substring_index("ref", "::", -1)) - 2
    split = asked.where("locate('::', ref) > 0").select("src", "pos", F.substring("ref", F.lit(1), cut).alias("prefix"), F.substring_index("ref", "::", -1).alias("name"))
    tries = split.select("src", "pos", F.posexplode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat("prefix", s, F.lit("::"), "name"))).alias("priority", "dst"))
    found = tries.join(chunks.select(F.col("chunk_id").alias("dst")), "dst")
    return found.groupBy("src", "pos").agg(F.min_by("dst", "priority").alias("dst")).select("src", "dst", "pos")


def dependencies(chunks: DataFrame) -> DataFrame:
    """src, dst, pos: references, then external ones, in the order in which they are called."""
    own = references(chunks).withColumn("_group", F.lit(0))
    other = external_references(chunks).withColumn("_group", F.lit(1))
    place = Window.partitionBy("src").orderBy("_group", "pos")
    return own.unionByName(other).withColumn("pos", F.row_number().over(place)).drop("_group")


def two_hops(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """What the best match of each query depends on: qid, chunk_id, hop, rank after the ranked rows.

    Breadth first, two hops, four chunks at most; ranked rows are neither added again nor
    walked through.  Each hop takes what is left of the four.
    """
    seen = ranked.select("qid", F.col("chunk_id").alias("dst"))
    counts = ranked.groupBy("qid").agg(F.max("rank").alias("_ranked"))
    start = ranked.where("rank = 1").select("qid", F.col("chunk_id").alias("src"), F.lit(0).alias("_from"))

    def hop(frontier: DataFrame, seen: DataFrame, n: int) -> DataFrame:
        met = frontier.join(edges, "src").select("qid", "dst", "_from", "pos").join(seen, ["qid", "dst"], "left_anti")
        first = met.groupBy("qid", "dst").agg(F.min(F.struct("_from", "pos")).alias("_at"))
        place = Window.partitionBy("qid").orderBy("_at")
        return first.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= MOST_ADDED).select("qid", "dst", "_place", F.lit(n).alias("hop"))

    one = hop(start, seen, 1)
    two = hop(one.select("qid", F.col("dst").alias("src"), F.col("_place").alias("_from")), seen.unionByName(one.select("qid", "dst")), 2)
    order = Window.partitionBy("qid").orderBy("hop", "_place")
    both = one.unionByName(two).withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= MOST_ADDED)
    return both.join(counts, "qid").select("qid", F.col("dst").alias("chunk_id"), "hop", (F.col("_ranked") + F.col("_at")).alias("rank"))


def expanded(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranked rows (hop 0) followed by what the best one depends on: qid, chunk_id, hop, rank."""
    return ranked.select("qid", "chunk_id", F.lit(0).alias("hop"), "rank").unionByName(two_hops(ranked, edges))
