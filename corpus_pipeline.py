"""The corpus pipeline: language ID, near-duplicate removal, decontamination,
mixing and sharding of ``documents``, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes each stage's result
once, as Parquet in the shared checkpoint folder, and the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recoflow.llm import decontam, hilbert, langid, mixing, simhash
from recoflow.llm.common import table
from recoflow.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or whose language is a toss-up, go."""
    return langid.keep_identified(docs, min_score=0.5)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the smallest id."""
    return simhash.keep_one(docs, shingle=3, radius=3)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped by their rates towards the target weights."""
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Eight shards in Hilbert order, with each row's shard and slot."""
    return hilbert.shard_rows(docs, shards=8, keep=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The classifiers, fingerprints and the fitted rates have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
