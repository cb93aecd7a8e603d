"""What the engine knows about a table: its schema, key and name rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables and columns of the engine itself begin with this.
OWN_PREFIX = "__logfold__"
SYSTEM_PREFIX = "sqlite_"
#: Key of a table that declares none.
ROWID = "rowid"


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: T.DataType
    not_null: bool = False
    default: str | None = None
    pk_index: int = 0

    @property
    def is_key(self) -> bool:
        return self.pk_index > 0


@dataclass(frozen=True)
class TableSpec:
    """A watched table. Its schema is frozen when the spec is made; changes of it are refused."""

    name: str
    columns: tuple[ColumnSpec, ...]
    unique_keys: tuple[tuple[str, ...], ...] = ()

    def __post_init__(self) -> None:
        name = self.name.strip()
        if not name or name.startswith(SYSTEM_PREFIX) or name.startswith(OWN_PREFIX):
            raise ValueError(f"the table name {self.name!r} is reserved or empty")
        if not any(c.is_key for c in self.columns):
            object.__setattr__(self, "columns", (*self.columns, ColumnSpec(ROWID, T.LongType(), True, None, 1)))

    @property
    def key(self) -> tuple[str, ...]:
        """Key columns sorted by name: the order in which they are hashed."""
        return tuple(sorted(c.name for c in self.columns if c.is_key))

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(c.name for c in self.columns)

    def check(self, df: DataFrame) -> DataFrame:
        """``df`` if it has this spec's columns and types, in any order; fails fast otherwise."""
        have = {f.name: f.dataType for f in df.schema}
        for c in self.columns:
            if c.name not in have:
                raise ValueError(f"{self.name}: column {c.name} is missing")
            if have[c.name] != c.type:
                raise ValueError(f"{self.name}: column {c.name} is {have[c.name].simpleString()}, not {c.type.simpleString()}")
        return df


def spec_of(name: str, df: DataFrame, key: tuple[str, ...] = (), unique_keys: tuple[tuple[str, ...], ...] = ()) -> TableSpec:
    return TableSpec(name, tuple(ColumnSpec(f.name, f.dataType, not f.nullable, None, key.index(f.name) + 1 if f.name in key else 0) for f in df.schema), unique_keys)


def type_of(declared: str) -> T.DataType:
    """The Spark type for a declared SQLite column type, by its affinity rules."""
    said = declared.strip().upper()
    for word, kind in (("BOOL", T.BooleanType()), ("DATETIME", T.TimestampNTZType()), ("TIMESTAMP", T.TimestampNTZType())):
        if word in said:
            return kind
    if said == "DATE":
        return T.DateType()
    if "INT" in said:
        return T.LongType()
    if any(w in said for w in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if not said or "BLOB" in said:
        return T.BinaryType()
    return T.DoubleType()


def is_user_table(name: Column) -> Column:
    """Neither a system table nor one of the engine's.

    Case-insensitive, and the underscores are wildcards, as in the SQLite filter that
    this stands for.
    """
    return ~name.ilike(f"{SYSTEM_PREFIX}%") & ~name.ilike(f"{OWN_PREFIX}%")


def may_be_watched(name: Column) -> Column:
    """The stricter, literal rule for tables that changes are captured from."""
    trimmed = F.trim(name)
    return (trimmed != "") & ~trimmed.startswith(SYSTEM_PREFIX) & ~trimmed.startswith(OWN_PREFIX)


def columns_of(spark: SparkSession, spec: TableSpec) -> DataFrame:
    """The spec as rows: name, ordinal (from 1), type (an SQL name), not_null, pk."""
    sql = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "binary": "BLOB", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "date": "DATE"}
    rows = [(c.name, i, sql.get(c.type.simpleString(), c.type.simpleString().upper()), c.not_null, c.is_key) for i, c in enumerate(spec.columns, 1)]
    return spark.createDataFrame(rows, "name string, ordinal long, type string, not_null boolean, pk boolean")
