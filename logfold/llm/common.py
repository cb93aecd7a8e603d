"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts that split on ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

ROOT = str(Path(__file__).resolve().parents[2])

_made: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a temporary folder of its own (its
    executors are this machine); any other master must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='logfold-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def folder_bytes(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


@contextmanager
def owned(spark: SparkSession, owner: str) -> Iterator[None]:
    """Work folders made inside belong to ``owner``; those it had before are deleted first.

    What was read from them must be written by then. Others' folders stay.
    """
    app = spark.sparkContext.applicationId
    for path in _made.pop(f"{app}/{owner}", []):
        remove(spark, path)
    made = _made.setdefault(app, [])
    start = len(made)
    try:
        yield
    finally:
        _made[f"{app}/{owner}"], made[start:] = made[start:], []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Work folders made inside are deleted at the end, but for the last one; after a failure all are."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    start, kept = len(made), 0
    try:
        yield
        kept = 1
    finally:
        last = made[len(made) - kept :] if len(made) > start else []
        for path in made[start : len(made) - len(last)]:
            remove(spark, path)
        made[start:] = last
    settle(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more.

    Its cleaner acts when the driver's garbage is collected, which may take hours; what
    Python held is garbage of the JVM only after a first round.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.2)


def stable_rows(df: DataFrame) -> DataFrame:
    """``df``, or a written copy unless its rows come straight from files.

    Only then does every pass over it see the same partitions, in the same order. How
    files are split may depend on the cores there are, which change when executors are
    lost: from here on the session keeps to those of now, unless it has a number already.
    """
    spark = df.sparkSession
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(max(1, spark.sparkContext.defaultParallelism)))
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return df if plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation") else materialise(df, "rows")


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    return next(name for name in (f"__{stem}{'_' * i}" for i in range(len(taken) + 1)) if name.lower() not in taken)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Where a task reads and writes ``path`` itself."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def small_batches(spark: SparkSession, records: int = 512) -> None:
    """Bound the rows of an Arrow batch: documents may be very long, blocks are megabytes.

    Also lets Python workers import this package where they see the driver's folders; a
    cluster that doesn't share them gets it by --py-files.
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, (env.get("PYTHONPATH"), ROOT)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))


Arrow = Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]]


def lean(run: Arrow) -> Arrow:
    """``run``, after which the worker gives the memory that is free back: it is kept for other tasks, and its executor's memory is shared."""

    def then_trim(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(parts)
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.util.find_library("c")
        if libc and hasattr(handle := ctypes.CDLL(libc), "malloc_trim"):
            handle.malloc_trim(0)

    return then_trim


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2048, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows and about ``limit`` bytes of strings."""
    out: list[tuple] = []
    held = 0
    for row in rows:
        out.append(row)
        held += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(out) >= size or held >= limit:
            yield _batch(out, schema)
            out, held = [], 0
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def words(text: Column) -> Column:
    """The words of a text as a native array; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def held(value: Column) -> Column:
    """``value``, kept where it is computed: no filter from above is pushed through it.

    A pushed filter would repeat the expression, inside the lambdas of its own inputs.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)


def literal_array(values: Iterable[float], kind: str = "double") -> Column:
    """A constant array as one folded literal, however long."""
    said = ",".join(f"{v:.7g}" if kind != "bigint" else str(int(v)) for v in values)
    return F.split(F.lit(said), ",").cast(f"array<{kind}>")


def bounded_labels(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """At most ``bound`` labelled ids with their label, chosen by a hash of the id.

    An id with several labels gets the largest; rows without id or label are left out.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
