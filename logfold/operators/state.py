"""Table state as a fold over a change log: last writer wins, upserts, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.changes import DELETE, checked_type


def last_writer(changes: DataFrame, key: tuple[str, ...], order: str = "gid") -> DataFrame:
    """The last change of every key by ``order``. Partial aggregation: a hot key costs one row a task."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__last")).select(*key, "__last.*").select(*changes.columns)


def state_of(changes: DataFrame, key: tuple[str, ...], order: str = "gid") -> DataFrame:
    """The rows that remain: last writers that are no deletes."""
    return last_writer(changes, key, order).where(F.col("type") != DELETE)


def apply(base: DataFrame, changes: DataFrame, key: tuple[str, ...], order: str = "gid", guard: str | None = "origin") -> DataFrame:
    """``base`` after ``changes``: inserts and updates replace by key, deletes remove.

    ``guard`` names a column that tells captured rows (base) from applied ones (applied),
    so that applied rows are not captured again. A null-safe full outer join on the key.
    An unknown or null type is an error.
    """
    won = last_writer(changes, key, order)
    names = [c for c in base.columns if c != guard]
    left = base.select(*(F.col(c).alias(f"b_{c}") for c in names), F.lit(True).alias("__there"))
    right = won.select(*(F.col(c).alias(f"c_{c}") for c in names), checked_type(F.col("type")).alias("__op"))
    both = left.join(right, [F.col(f"b_{k}").eqNullSafe(F.col(f"c_{k}")) for k in key], "full_outer")
    applied = F.col("__op").isNotNull()
    out = both.where(~applied | (F.col("__op") != DELETE))
    columns = [F.when(applied, F.col(f"c_{c}")).otherwise(F.col(f"b_{c}")).alias(c) for c in names]
    if guard:
        columns.append(F.when(applied, "applied").otherwise("base").alias(guard))
    return out.select(*columns)


def delete_keys(base: DataFrame, keys: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``base`` without the rows whose whole key is in ``keys``; a null key matches a null."""
    gone = keys.select(*(F.col(k).alias(f"d_{k}") for k in key)).distinct()
    return base.join(gone, [F.col(k).eqNullSafe(F.col(f"d_{k}")) for k in key], "left_anti")


def evict(base: DataFrame, row: DataFrame, unique_keys: tuple[tuple[str, ...], ...]) -> DataFrame:
    """``base`` without rows that conflict with ``row`` on any unique key; nulls never conflict."""
    for unique in unique_keys:
        taken = row.select(*(F.col(k).alias(f"u_{k}") for k in unique)).distinct()
        base = base.join(taken, [F.col(k) == F.col(f"u_{k}") for k in unique], "left_anti")
    return base
