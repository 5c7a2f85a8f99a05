"""Inverted-index statistics and BM25 over batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import porter
from quarrylight.functions import text as T

K1, B = 1.5, 0.75
#: Rows of a batch of queries, or of what was looked up for one, that are broadcast; larger ones are shuffled.
MOST_SMALL = 100_000
#: The term of the one posting that each chunk has besides those of its words: it carries chunks and lengths.
EVERY = ""


def small(rows: DataFrame) -> DataFrame:
    """The rows marked for broadcasting if they are counted to be few."""
    return F.broadcast(rows) if rows.limit(MOST_SMALL + 1).count() <= MOST_SMALL else rows


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """chunk_id and the tokens of symbol name and code."""
    return chunks.select("chunk_id", T.tokens(F.concat_ws(" ", "symbol_name", "code")).alias("tokens"))


def term_frequency(chunks: DataFrame, stem: bool = False) -> DataFrame:
    """chunk_id, term, f."""
    terms = chunk_tokens(chunks).select("chunk_id", F.explode("tokens").alias("term"))
    return (porter.stemmed(terms) if stem else terms).groupBy("chunk_id", "term").agg(F.count("*").alias("f"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """term, df."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def lengths(chunks: DataFrame) -> DataFrame:
    """chunk_id, len; chunks without tokens count with 0."""
    return chunk_tokens(chunks).select("chunk_id", F.size("tokens").cast("long").alias("len"))


def totals(lens: DataFrame) -> DataFrame:
    """One row: n, avgdl (1 where there are no chunks)."""
    return lens.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("avgdl"))


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, len, term, f for each token of a chunk, and one with the term EVERY for each chunk.

    Not summed: a row for each occurrence.  :func:`kept` sums and orders them for reading again.
    """
    return chunk_tokens(chunks).select("chunk_id", F.size("tokens").cast("long").alias("len"), F.explode(F.concat(F.array(F.lit(EVERY)), "tokens")).alias("term"), F.lit(1).cast("long").alias("f"))


def kept(chunks: DataFrame) -> DataFrame:
    """The postings as an index is kept: summed, in the order of terms, so that a reader skips what isn't asked for."""
    summed = postings(chunks).groupBy("chunk_id", "len", "term").agg(F.sum("f").alias("f"))
    return summed.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id")


def hits(rows: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """chunk_id, len, term, f of the postings that a batch of queries asks for, and those of EVERY.

    The batch's terms are broadcast and meet the postings where these are made or read; only
    what they hit is shuffled, besides a row for each chunk.
    """
    asked = query_tokens(queries, stem).select("term").union(query_gate_terms(queries, stem).select("term"))
    asked = asked.union(asked.sparkSession.createDataFrame([(EVERY,)], "term string")).distinct()
    if stem:  # words whose stem is asked for; Python sees each distinct word once
        vocabulary = porter.stems(rows.select("term").distinct())
        words = small(vocabulary.join(F.broadcast(asked), "term"))
        rows = rows.withColumnRenamed("term", "word").join(words, "word").select("chunk_id", "len", "term", "f")
    else:
        rows = rows.join(small(asked), "term")
    return rows.groupBy("chunk_id", "len", "term").agg(F.sum("f").alias("f"))


def query_tokens(queries: DataFrame, stem: bool = False) -> DataFrame:
    """qid, term, qf: index tokens of each query with how often they occur; stopwords stay."""
    terms = queries.select("qid", F.explode(T.tokens(F.col("query"))).alias("term"))
    return (porter.stemmed(terms) if stem else terms).groupBy("qid", "term").agg(F.count("*").alias("qf"))


def query_gate_terms(queries: DataFrame, stem: bool = False) -> DataFrame:
    """qid, term, times: terms that the relevance gate counts, repeats counted."""
    terms = queries.select("qid", F.explode(T.gate_terms(F.col("query"))).alias("term"))
    return (porter.stemmed(terms) if stem else terms).groupBy("qid", "term").agg(F.count("*").alias("times"))


def bm25(found: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """qid, chunk_id, bm25 of chunks that hold a query token; repeated query tokens count again.

    ``found``: the hits of the batch.  The sums over them (documents with a term, chunks and
    their mean length) use its columns without a filter, so all of them read one shuffle.
    """
    known = found.groupBy("term").agg(F.sum(F.least("f", F.lit(1))).alias("df"))  # as many rows as the batch has terms
    every = F.col("term") == EVERY
    summed = found.agg(F.sum(F.when(every, F.col("f")).otherwise(0)).alias("n"), F.sum(F.when(every, F.col("len")).otherwise(0)).alias("all"))
    totals = summed.select("n", F.when(F.col("n") > 0, F.col("all") / F.col("n")).otherwise(1.0).alias("avgdl"))
    wanted = small(query_tokens(queries, stem))
    met = found.join(wanted, "term").join(F.broadcast(known), "term").crossJoin(F.broadcast(totals))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturated = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return met.groupBy("qid", "chunk_id").agg(F.sum(F.col("qf") * idf * saturated).alias("bm25"))


def normalised(scores: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds lexical: the score over the query's highest (over all chunks), times 0.3 for whole files."""
    top = scores.groupBy("qid").agg(F.max("bm25").alias("_top"))  # a row for each query
    kinds = scores.join(F.broadcast(top), "qid").join(chunks.select("chunk_id", "kind"), "chunk_id")
    share = F.when(F.col("_top") > 0, F.col("bm25") / F.col("_top")).otherwise(0.0)
    return kinds.withColumn("lexical", share * F.when(F.col("kind") == "file", FILE_PENALTY).otherwise(1.0)).select("qid", "chunk_id", "bm25", "lexical")


FILE_PENALTY = 0.3


def matched_terms(found: DataFrame, queries: DataFrame, stem: bool = False) -> DataFrame:
    """qid, chunk_id, matched: gate terms found in a chunk, repeats in the query counted."""
    return found.join(small(query_gate_terms(queries, stem)), "term").groupBy("qid", "chunk_id").agg(F.sum("times").alias("matched"))
