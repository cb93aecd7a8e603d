"""Change logs as DataFrames: capture by comparing versions, row images, log rows.

A change has gid (its place in the global order), table_name, the key columns, type
(insert, update or delete), the row's values, created_at (epoch milliseconds), node_id
and state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"
PENDING, PUBLISHED, FAILED = 0, 1, -1


def epoch_millis(ts: Column) -> Column:
    """Whole seconds and three digits of milliseconds, put together as text: floors, never rounds."""
    micros = F.unix_micros(ts.cast("timestamp"))
    seconds = F.floor(micros / 1_000_000)
    millis = F.lpad((F.floor((micros % 1_000_000) / 1000)).cast("string"), 3, "0")
    return F.concat(seconds.cast("string"), millis).cast("bigint")


def row_image(type_: Column, new: Column, old: Column) -> Column:
    """Deletes record the old row, all others the new one."""
    return F.when(type_ == DELETE, old).otherwise(new)


def checked_type(type_: Column) -> Column:
    """``type_``, or an error that names an unknown operation."""
    known = type_.isin(INSERT, UPDATE, DELETE)
    return F.when(known, type_).otherwise(F.raise_error(F.concat(F.lit("unknown change type "), F.coalesce(type_, F.lit("null")))))


def diff(before: DataFrame, after: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The changes that turn one version of a table into the other: type and the row image's columns.

    A full outer join on the key; an update that changes the key shows as a delete and an
    insert. Key columns are compared null-safe, values by a null-safe struct comparison.
    """
    names = after.columns
    values = [c for c in names if c not in key]
    old = before.select(*(F.col(c).alias(f"o_{c}") for c in names), F.lit(True).alias("o_there"))
    new = after.select(*(F.col(c).alias(f"n_{c}") for c in names), F.lit(True).alias("n_there"))
    on = [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in key]
    both = old.join(new, on, "full_outer")
    same = F.struct(*(F.col(f"o_{c}") for c in values)).eqNullSafe(F.struct(*(F.col(f"n_{c}").alias(f"o_{c}") for c in values))) if values else F.lit(True)
    type_ = F.when(F.col("o_there").isNull(), INSERT).when(F.col("n_there").isNull(), DELETE).otherwise(UPDATE)
    changed = both.where(F.col("o_there").isNull() | F.col("n_there").isNull() | ~same).withColumn("type", type_)
    return changed.select("type", *(row_image(F.col("type"), F.col(f"n_{c}"), F.col(f"o_{c}")).alias(c) for c in names))


def to_log(changes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Log rows: each value column is stored as val_<column>."""
    return changes.withColumnsRenamed({c: f"val_{c}" for c in columns})


def from_log(log: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Log rows (of ``ids``, if given) as changes again: val_ is stripped, the id dropped."""
    rows = log if ids is None else log.join(ids, "id", "left_semi")
    return rows.withColumnsRenamed({c: c[4:] for c in log.columns if c.startswith("val_")}).drop("id")


def envelope(changes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """One VARIANT row for each change, with key, order and origin kept as typed columns."""
    rest = [c for c in changes.columns if c not in columns]
    return changes.select(*rest, F.expr(f"to_variant_object(struct({', '.join(columns)}))").alias("row"))


def unwrap(enveloped: DataFrame, types: dict[str, str]) -> DataFrame:
    """The typed columns back out of the envelope."""
    rest = [c for c in enveloped.columns if c != "row"]
    return enveloped.select(*rest, *(F.expr(f"variant_get(row, '$.{c}', '{t}')").alias(c) for c, t in types.items()))
