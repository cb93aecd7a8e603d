"""A corpus pipeline: each stage applies one training-data operator to what the last one kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logfold.llm import common, curriculum, decontam, jaccard_join, toxicity, training_order

#: Each stage deletes the work folders of the one before, whose result is written by then.
OWNER = "pipeline"
#: Sequences that the last stage permutes among each other: eight shards.
BLOCK = 1 << 16

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents whose score is 0.5 or more go."""
    with common.owned(spark, OWNER):
        return toxicity.keep_civil(docs, common.table(spark, sf_dir, "labels"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group of near duplicates stays.

    As for all near duplicates, words are shingled by five and texts link at 0.8.
    """
    with common.owned(spark, OWNER):
        return jaccard_join.keep_one(docs, size=5, percent=80)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents with a twentieth of their words in benchmark windows go."""
    with common.owned(spark, OWNER):
        return decontam.remove(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: every document as often as its source's target takes it, in curriculum order."""
    with common.owned(spark, OWNER):
        return curriculum.mixed(docs)


def ordered(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids: shards in training order; returns the index of their sequences.

    The curriculum's order is that of the files: it stays, and sequences are permuted
    within blocks of it.
    """
    with common.owned(spark, OWNER):
        return training_order.report(docs, block=BLOCK)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", civil),
    ("ngram_jaccard_join", unlike),
    ("benchmark_decontamination", untested),
    ("curriculum_mixing", mixed),
    ("training_order", ordered),
]

#: The stages learn and permute, which SQL cannot express: see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply every stage to ``documents``; each result is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    base = f"{common.shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
