"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm._common import remove, written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node that it reaches) for every node of edges ``a``, ``b``.

    Each round, a node takes the smallest label among its own and its neighbours', then the
    label of that label, so long chains shrink by doubling.  Every round is written to the
    shared folder; only a count comes to the driver.  Nulls take no part, loops are harmless.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    both = written(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "cc-labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        lower = labels.join(around, labels.node == around.a).select("node", F.least("component", "m").alias("next"), F.col("component").alias("was"))
        roots = labels.select(F.col("node").alias("root"), F.col("component").alias("over"))
        jumped = lower.join(roots, lower.next == roots.root, "left").select("node", F.least("next", F.coalesce("over", "next")).alias("component"), "was")
        new = written(jumped, "cc-labels")
        changed = new.where("component < was").limit(1).count()
        remove(labels)
        labels = new.select("node", "component")
        if not changed:
            remove(both)
            return labels
