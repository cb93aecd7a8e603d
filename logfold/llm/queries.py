"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from logfold.llm.oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]

#: Query name: module of this subpackage that has the function of that name.
QUERIES = {
    "op1_seekable_bundles": "contracts",
    "op2_feistel_training_order": "contracts",
    "op3_ngram_jaccard_join": "contracts",
    "op4_sampled_splitters": "contracts",
    "op5_suffix_tree_scoring": "contracts",
    "op6_time_varying_curriculum": "contracts",
    "op7_benchmark_decontamination": "contracts",
    "op8_ngram_likelihood_ratio": "contracts",
    "op9_weak_supervision_pii": "contracts",
    "op10_pattern_grammar_toxicity": "contracts",
}


def _late(module: str, name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return getattr(import_module(f"logfold.llm.{module}"), name)(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _late(module, name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
