"""SQLite files as a Spark data source: batch reads and a bounded change stream."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from logfold.spec import ColumnSpec, TableSpec, type_of


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def table_spec(path: str, table: str) -> TableSpec:
    """The table's columns and key as the database declares them."""
    with _open(path) as db:
        rows = db.execute("SELECT name, type, \"notnull\", dflt_value, pk FROM pragma_table_info(?)", (table,)).fetchall()
    if not rows:
        raise ValueError(f"{path} has no table {table}")
    return TableSpec(table, tuple(ColumnSpec(n, type_of(t or ""), bool(nn), d, pk) for n, t, nn, d, pk in rows))


def table_names(path: str) -> list[str]:
    with _open(path) as db:
        rows = db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' AND name NOT LIKE '__logfold__%'")
        return sorted(r[0] for r in rows)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table = options["path"], options["table"]
        self.parts, self.names = int(options.get("partitions", "1")), schema.names

    def partitions(self) -> list[_Range]:
        with _open(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [_Range(0, -1)]
        width = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, min(high, a + width - 1)) for a in range(low, high + 1, width)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        columns = ", ".join(_quoted(c) for c in self.names)
        with _open(self.path) as db:
            yield from db.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid BETWEEN ? AND ?", (partition.low, partition.high))


class _StreamReader(SimpleDataSourceStreamReader):
    """Rows in rowid order, ``limit`` at most in a batch; the offset is the last rowid read."""

    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.limit, self.names = options["path"], options["table"], int(options.get("limit", "512")), schema.names

    def initialOffset(self) -> dict:
        return {"rowid": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        columns = ", ".join(_quoted(c) for c in self.names)
        with _open(self.path) as db:
            rows = db.execute(f"SELECT rowid, {columns} FROM {_quoted(self.table)} WHERE rowid > ? ORDER BY rowid LIMIT ?", (start["rowid"], self.limit)).fetchall()
        return iter([r[1:] for r in rows]), {"rowid": rows[-1][0] if rows else start["rowid"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        columns = ", ".join(_quoted(c) for c in self.names)
        with _open(self.path) as db:
            yield from db.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE rowid > ? AND rowid <= ? ORDER BY rowid", (start["rowid"], end["rowid"])).fetchall()


class SQLiteSource(DataSource):
    """``spark.read.format("sqlite").option("path", file).option("table", name)``"""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        spec = table_spec(self.options["path"], self.options["table"])
        return T.StructType([T.StructField(c.name, c.type) for c in spec.columns if c.name != "rowid"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return _StreamReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SQLiteSource)
