"""A kept index of vectors: k-means lists, of which a search opens the nearest.

Lists are folders of the written index, so a search reads only those that its queries open.
Centres are fitted on a bounded sample; every vector is in a list.  Vectors that are null, empty,
of length zero or of another dimension than the centres take no part: they have no direction to
compare.  Vectors are compared by their dot product, as everywhere, so they should be of length 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import lexical

#: Vectors that the centres are fitted on, lists at most, and the share of lists that a search opens by default.
MOST_FITTED, MOST_LISTS, OPENED, ITERATIONS, SEED = 100_000, 4096, 0.5, 10, 17
#: Vectors that a list's file holds about.
ROWS_IN_FILE = 50_000


@dataclass
class Index:
    """The fitted centres, and list, chunk_id, embedding of each vector."""

    model: KMeansModel
    rows: DataFrame

    @property
    def lists(self) -> int:
        return len(self.model.clusterCenters())


def _usable(vectors: DataFrame) -> DataFrame:
    held = vectors.where("embedding IS NOT NULL AND size(embedding) > 0").select("chunk_id", "embedding")
    return held.where(F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))


def _listed(vectors: DataFrame, model: KMeansModel) -> DataFrame:
    size = len(model.clusterCenters()[0])
    found = model.transform(_usable(vectors).where(F.size("embedding") == size).withColumn("features", array_to_vector("embedding")))
    return found.select(F.col("prediction").alias("list"), "chunk_id", "embedding")


def build(vectors: DataFrame, lists: int | None = None, most_fitted: int = MOST_FITTED) -> Index | None:
    """Fits about as many lists as the square root of the vectors' number; None without a usable vector.

    ``vectors``: chunk_id, embedding.  The sample is drawn by hash of chunk_id, so reruns agree.
    """
    usable = _usable(vectors)
    sizes = usable.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return None
    share = min(1.0, most_fitted / sizes["count"])
    drawn = usable.where(F.size("embedding") == sizes["size"]).where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    k = max(1, min(lists or int(sizes["count"] ** 0.5), MOST_LISTS))
    fitting = drawn.select(array_to_vector("embedding").alias("features"))
    # k-means wants two centres at least; one that stays empty does no harm
    model = KMeans(k=max(2, k), distanceMeasure="cosine", maxIter=ITERATIONS, seed=SEED).fit(fitting)
    return Index(model, _listed(vectors, model))


def remove(index: Index, gone: DataFrame) -> Index:
    """Without the vectors of the named chunks (chunk_id)."""
    return Index(index.model, index.rows.join(gone.select("chunk_id"), "chunk_id", "left_anti").select("list", "chunk_id", "embedding"))


def add(index: Index, vectors: DataFrame) -> Index:
    """With new vectors; one that is there already is replaced, or goes if its new one is unusable."""
    return Index(index.model, remove(index, vectors).rows.unionByName(_listed(vectors, index.model)))


def save(index: Index, folder: str) -> None:
    index.model.write().overwrite().save(f"{folder}/centres")
    # a list of usual size is one file; no task writes more than one such file of a larger list
    parts = max(1, index.rows.count() // (index.lists * ROWS_IN_FILE))
    index.rows.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(parts))).write.mode("overwrite").partitionBy("list").parquet(f"{folder}/rows")


def load(spark: SparkSession, folder: str, count: int | None = None) -> Index | None:
    """The saved index; None if there is none that can be read, or if it holds another number of vectors than ``count``."""
    try:
        index = Index(KMeansModel.load(f"{folder}/centres"), spark.read.parquet(f"{folder}/rows").select(F.col("list").cast("int"), "chunk_id", "embedding"))
    except Exception:  # noqa: BLE001  nothing readable there is no index
        return None
    return index if count is None or index.rows.count() == count else None


def search(index: Index, queries: DataFrame, most: int, opened: float = OPENED) -> DataFrame:
    """qid, chunk_id, semantic: the ``most`` nearest of each query in the lists that it opens.

    Queries are a stated batch.  Each opens the share ``opened`` of the lists, one at least;
    with 1, the search is exact.  Only lists that a query opens are read, no vector is shuffled,
    and a query's scores are cut to ``most`` before they meet.
    """
    spark = index.rows.sparkSession
    size = len(index.model.clusterCenters()[0])
    asked = queries.where("query_embedding IS NOT NULL").where(F.size("query_embedding") == size).select("qid", "query_embedding")
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(index.model.clusterCenters())], "list int, centre array<double>")
    to_centre = T.dot(F.col("query_embedding"), F.col("centre")) / F.sqrt(T.dot(F.col("centre"), F.col("centre")))
    nearest = Window.partitionBy("qid").orderBy(F.desc(to_centre), "list")
    number = max(1, round(opened * index.lists))
    # as many rows as queries times lists
    chosen = asked.crossJoin(F.broadcast(centres)).withColumn("_at", F.row_number().over(nearest)).where(F.col("_at") <= number).select("qid", "query_embedding", "list")
    scores = index.rows.join(lexical.small(chosen), "list").select("qid", "chunk_id", T.dot(F.col("query_embedding"), F.col("embedding")).alias("semantic"))
    place = Window.partitionBy("qid").orderBy(F.desc("semantic"), "chunk_id")
    return scores.withColumn("_at", F.row_number().over(place)).where(F.col("_at") <= most).drop("_at")
