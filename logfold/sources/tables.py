"""The driver tables as change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.changes import DELETE, INSERT, UPDATE, epoch_millis


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the changes of a table keyed by user: signups insert, errors delete."""
    type_ = F.when(F.col("event_type") == "signup", INSERT).when(F.col("event_type") == "error", DELETE).otherwise(UPDATE)
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("gid"),
        F.lit("events").alias("table_name"),
        F.col("user_id").alias("pk"),
        type_.alias("type"),
        "value",
        "props",
        epoch_millis(F.col("ts")).alias("created_at"),
        (F.col("event_id") % 3 + 1).alias("node_id"),
        F.when(F.col("event_id") % 10 < 8, 1).otherwise(0).alias("state"),
    )


def order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the changes of a table keyed by customer: open ones insert, filled ones update, others delete."""
    type_ = F.when(F.col("o_orderstatus") == "O", INSERT).when(F.col("o_orderstatus") == "F", UPDATE).otherwise(DELETE)
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("gid"),
        F.lit("orders").alias("table_name"),
        F.col("o_custkey").alias("pk"),
        type_.alias("type"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderpriority").alias("props"),
        epoch_millis(F.col("o_orderdate")).alias("created_at"),
        (F.col("o_orderkey") % 3 + 1).alias("node_id"),
        F.when(F.col("o_orderkey") % 10 < 8, 1).otherwise(0).alias("state"),
    )
