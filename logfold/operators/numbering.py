"""Running numbers and neighbours over a total order, without one task that sees all rows.

Rows are cut into buckets of the ordering column. Only one row for each bucket is put in
a global order; numbers, sums and neighbours inside a bucket need that bucket alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 4096


def _bucket(order: str, width: int) -> Column:
    return F.floor(F.col(order) / width).cast("long")


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join that takes null keys for equal."""
    there = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    return left.join(there, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]).drop(*(f"__r_{k}" for k in keys))


def _earlier(buckets: DataFrame, by: list[str], name: str, value: str, fold, none: Column) -> DataFrame:
    """Adds ``name``: ``fold`` of ``value`` over the buckets before, within ``by``.

    In two levels: buckets inside a group of WIDTH neighbours, and one row for each group,
    so that a task sees one in WIDTH ** 2 of a log's rows.
    """
    grouped = buckets.withColumn("__g", _bucket("__b", WIDTH))
    over = lambda keys, order: Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy(*by, "__g").agg(fold(value).alias("__v"))
    before = groups.select(*by, "__g", fold("__v").over(over(by, "__g")).alias("__outer"))
    inner = grouped.withColumn("__inner", fold(value).over(over([*by, "__g"], "__b")))
    return _on(inner, before, [*by, "__g"]).select(*buckets.columns, _both(F.col("__outer"), F.col("__inner"), fold, none).alias(name))


def _both(outer: Column, inner: Column, fold, none: Column) -> Column:
    return F.coalesce(outer, none) + F.coalesce(inner, none) if fold is F.sum else F.coalesce(inner, outer)


def numbered(df: DataFrame, order: str, name: str, by: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """Adds ``name``: 1, 2, ... by ``order`` (a unique integer column), within ``by``."""
    by = by or []
    cut = df.withColumn("__b", _bucket(order, width))
    counts = cut.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    bases = _earlier(counts, by, "__base", "__n", F.sum, F.lit(0)).drop("__n")
    inside = Window.partitionBy(*by, "__b").orderBy(order)
    out = _on(cut.withColumn("__i", F.row_number().over(inside)), bases, [*by, "__b"])
    return out.select(*df.columns, (F.col("__base") + F.col("__i")).cast("long").alias(name))


def with_previous(df: DataFrame, order: str, value: str, name: str, by: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """Adds ``name``: ``value`` of the row before, by ``order``, within ``by``; null for the first."""
    by = by or []
    cut = df.withColumn("__b", _bucket(order, width))
    last = cut.groupBy(*by, "__b").agg(F.max(F.struct(order, value)).alias("__last"))
    earlier = _earlier(last, by, "__edge", "__last", F.max, F.lit(None)).select(*by, "__b", F.col("__edge")[value].alias("__edge"))
    inside = Window.partitionBy(*by, "__b").orderBy(order)
    out = _on(cut.withColumn("__p", F.lag(value).over(inside)).withColumn("__i", F.row_number().over(inside)), earlier, [*by, "__b"])
    return out.select(*df.columns, F.when(F.col("__i") == 1, F.col("__edge")).otherwise(F.col("__p")).alias(name))
