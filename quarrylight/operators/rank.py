"""Hybrid ranking of batches of queries behind a relevance gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.operators import lexical

LEXICAL_WEIGHT, FLOOR, LEAST_TERMS, DEFAULT_K = 0.2, 0.3, 2, 5


def cosine(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, chunk_id, semantic for each query with a vector and chunk with one; vectors have length 1.

    Queries are a stated batch, broadcast after a count; each is compared with every embedded
    chunk in one pass.
    """
    asked = queries.where("query_embedding IS NOT NULL AND size(query_embedding) > 0").select("qid", "query_embedding")
    embedded = chunks.where("embedding IS NOT NULL").select("chunk_id", "embedding")
    return embedded.crossJoin(lexical.small(asked)).select("qid", "chunk_id", T.dot(F.col("query_embedding"), F.col("embedding")).alias("semantic"))


def wanted(k: int) -> int:
    """How many candidates an index is asked for, for k results."""
    return max(10 * k, 50)


def candidates(scores: DataFrame, k: int, order: str = "chunk_id") -> DataFrame:
    """The nearest max(10k, 50) of each query."""
    place = Window.partitionBy("qid").orderBy(F.desc("semantic"), order)
    return scores.withColumn("_at", F.row_number().over(place)).where(F.col("_at") <= wanted(k)).drop("_at")


def name_hits(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, chunk_id of chunks whose symbol holds the whole trimmed query; empty queries hit nothing."""
    asked = queries.select("qid", T.trimmed(F.lower("query")).alias("_q")).where("_q <> ''")
    return chunks.select("chunk_id", F.lower("symbol_name").alias("_name")).join(lexical.small(asked), F.expr("contains(_name, _q)")).select("qid", "chunk_id", F.lit(True).alias("name_hit"))


def scored(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K, stem: bool = False, nearest_only: bool = False, postings: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, ord, semantic, lexical, matched, name_hit, score of the chunks that pass the gate.

    A chunk passes with a name hit, a semantic score at the floor (queries with a vector
    only) or two gate terms.  Others can't pass, so they are never scored.  ``postings`` is
    an index that was kept; without it, the chunks' words are counted.  With
    ``nearest_only``, semantic scores beyond the nearest max(10k, 50) of a query count as 0,
    as they would with an index that returns no more; ``near`` (qid, chunk_id, semantic) is
    what such an index returned, and all others count as 0.
    """
    has_vectors = "query_embedding" in queries.columns and (near is not None or "embedding" in chunks.columns)
    hits = lexical.hits(lexical.postings(chunks) if postings is None else postings, queries, stem)
    lex = lexical.normalised(lexical.bm25(hits, queries, stem), chunks).select("qid", "chunk_id", "lexical")
    found = lex.join(lexical.matched_terms(hits, queries, stem), ["qid", "chunk_id"], "full").join(name_hits(chunks, queries), ["qid", "chunk_id"], "full")
    if has_vectors:
        if near is None:
            near = cosine(chunks, queries)
            # without a candidate list, a score below the floor still counts where another rule lets the chunk pass
            near = candidates(near, k) if nearest_only else near
        found = found.join(near, ["qid", "chunk_id"], "full")
    else:
        found = found.withColumn("semantic", F.lit(0.0))
    filled = found.select("qid", "chunk_id", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("lexical", 0.0), ("matched", 0), ("name_hit", False), ("semantic", 0.0))])
    gate = F.col("name_hit") | (F.col("matched") >= LEAST_TERMS)
    if has_vectors:
        vectors = queries.select("qid", (F.coalesce(F.size("query_embedding"), F.lit(0)) > 0).alias("_vector"))
        filled = filled.join(vectors, "qid")
        gate = gate | (F.col("_vector") & (F.col("semantic") >= FLOOR))
    score = F.col("semantic") + LEXICAL_WEIGHT * F.col("lexical")
    return filled.where(gate).join(chunks.select("chunk_id", "ord"), "chunk_id").select("qid", "chunk_id", "ord", "semantic", "lexical", "matched", "name_hit", F.round(score, 6).alias("score"))


def top(rows: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """Adds rank and keeps the k best of each query; equal scores stand in index order."""
    place = Window.partitionBy("qid").orderBy(F.desc("score"), "ord")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def rank(chunks: DataFrame, queries: DataFrame, k: int = DEFAULT_K, stem: bool = False, nearest_only: bool = False, postings: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    return top(scored(chunks, queries, k, stem, nearest_only, postings, near), k)
