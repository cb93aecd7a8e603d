"""The thin queries that derive each contract's columns from its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logfold.llm.common import table


def op4_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfold.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op8_ngram_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfold.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_time_varying_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfold.llm.curriculum import plan

    return plan(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfold.llm.decontam import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pattern_grammar_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfold.llm.toxicity import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfold.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


def op1_seekable_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfold.llm import warc

    return warc.digest(warc.write(table(spark, sf_dir, "pages")))


def op2_feistel_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfold.llm.training_order import report

    return report(table(spark, sf_dir, "documents"))


def op5_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfold.llm.suffix_tree import score

    return score(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logfold.llm.jaccard_join import report

    return report(table(spark, sf_dir, "documents"))
