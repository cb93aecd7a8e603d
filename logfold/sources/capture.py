"""Capture from a live SQLite table: what has changed since the last capture, as change files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfold import changes as ch
from logfold.operators.numbering import numbered
from logfold.sources import sqlite
from logfold.spec import TableSpec
from logfold.store import Manifest, Store

def read_table(spark: SparkSession, path: str, spec: TableSpec, partitions: int = 1) -> DataFrame:
    """The table as it is now; its schema must be the one that ``spec`` was made with."""
    rows = spark.read.format("sqlite").option("path", path).option("table", spec.name).option("partitions", partitions).load()
    return spec.check(rows) if "rowid" not in spec.names else rows


def capture(spark: SparkSession, path: str, table: str, seen: str, to: str, partitions: int = 1) -> int:
    """Write the inserts, updates and deletes since the last capture into the folder ``to``; how many.

    ``seen`` is a store of the table as the last capture found it. The files are written
    before it moves on, under a name of the capture's number: one that failed in between
    is written again in its place, with what is there by then. The key must be declared:
    without one an update can't be told from a delete and an insert.
    """
    sqlite.register(spark)
    spec = sqlite.table_spec(path, table)
    if "rowid" in spec.key:
        raise ValueError(f"{table} declares no key")
    store = Store(spark, seen)
    last = store.manifest()
    schema = T.StructType([T.StructField(c.name, c.type) for c in spec.columns])
    before = store.read(last)
    # The table may change while it is read twice, so what is compared is what is kept.
    name = store._write(read_table(spark, path, spec, partitions), last.version + 1)
    now = spark.read.schema(schema).parquet(f"{store.path}/{name}")
    diff = ch.diff(spark.createDataFrame([], schema) if before is None else before.select(*spec.names), now, spec.key)
    draft = f"{store.path}/_draft"
    diff.withColumn("__o", F.monotonically_increasing_id()).write.mode("overwrite").parquet(draft)
    first = last.positions.get(0, 0)
    rows = numbered(spark.read.parquet(draft), "__o", "gid", width=1 << 33).withColumn("gid", F.col("gid") + first)
    files = f"{to}/capture-{last.version + 1}"
    rows.select("gid", *diff.columns).write.mode("overwrite").parquet(files)
    n = spark.read.parquet(files).count()
    store._put(Manifest(last.version + 1, {0: first + n}, name), last, name)
    store.folder.delete("_draft")
    return n
