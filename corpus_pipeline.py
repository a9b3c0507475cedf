"""The corpus pipeline: stages over ``documents``, each written and read again.

A stage begins by letting go of what the stages before it have sent to the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logwarden.llm import bpe, exact_dedup, langid, mixing, simhash_dedup
from logwarden.llm.common import release, table, written
from logwarden.llm.queries import vocabulary_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one learned language labels at least half of the words."""
    release()
    return langid.labelled(docs, langid.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, the document with the smallest id stays."""
    release()
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints links of 2 or fewer differing bits connect, the one with the smallest id stays."""
    release()
    return simhash_dedup.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    release()
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    release()
    return bpe.digests(docs, vocabulary_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("simhash_dedup", near_copies),
    ("mixing", source_mix),
    ("bpe", tokens),
]

#: Fitted language scores and near-duplicate links can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
