"""The operators of this subpackage bound to the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import bpe, jaccard, kdtree, lz, mixing, nndescent, pii, quality, separators, toxicity
from quarrylight.llm._common import table

#: A vocabulary in which 50,256 is free, so that it can end documents.
ENGLISH, END_OF_DOCUMENT = public_tokenizers.path("byte_bpe_50k.tiktoken"), 50_256
#: A vocabulary of the environment, read where it lies.
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = separators.counts(table(spark, sf_dir, "documents"), ENGLISH, public_tokenizers.PATTERN, END_OF_DOCUMENT)
    return found.select("doc_id", "n_tokens")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nndescent.search(vectors, vectors.where(F.col("vec_id") % 20 == 0).select("vec_id"), k=20).select("query_id", "rank", "vec_id", "score")


def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.edited_likeness(table(spark, sf_dir, "documents"))


def op7_token_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = kdtree.assign(table(spark, sf_dir, "documents"), shards=24)
    return shards.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_separator_scan, op2_nn_descent, op3_ordinal_toxicity, op4_pii, op5_co_training, op6_lz_fingerprint, op7_token_groups, op8_kd_shards, op9_byte_bpe, op10_mixing)
}

ORACLE_SQL: dict[str, str] = {
    "op7_token_groups": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), chr(10)) || chr(10) || least(len(w), 5) AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(d.doc_id, (SELECT min(b) FROM reach WHERE a = d.doc_id)), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id)""",
}
