"""A corpus pipeline: raw documents in, a mixed and tokenised training set out.

Each stage is one operator over all that the stage before it kept.  A stage takes
(spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the
next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarrylight.llm import bpe, jaccard, mixing, pii, quality
from quarrylight.llm._common import table, written
from quarrylight.llm.queries import VOCABULARY


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; it is fitted on those with labels."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near duplicates."""
    return jaccard.representatives(docs)


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data, disguised or not, replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets take them."""
    return mixing.mixed(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, and the digest of what they decode to."""
    return bpe.tokenised(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", keep_quality),
    ("ngram_jaccard_join", one_of_each),
    ("pii", mask_personal),
    ("mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: SQL can't express the fitted classifier, the disguises or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents; what is between them lies in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
