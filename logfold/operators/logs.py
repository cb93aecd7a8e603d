"""Operations on change logs and sharded streams: scans, marks, cleanup, retention, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.changes import PENDING, PUBLISHED
from logfold.operators.numbering import numbered


def pending_scan(log: DataFrame, limit: int = 512) -> DataFrame:
    """The first ``limit`` pending changes in global order: a top-k by task, then of those."""
    return log.where(F.col("state") == PENDING).orderBy("gid").limit(limit)


def global_log(changes: DataFrame, table: str) -> DataFrame:
    """id, change_table_id, table_name, created_at: the global log's rows, numbered in order."""
    rows = numbered(changes.select("gid", "created_at"), "gid", "id")
    return rows.select("id", F.col("gid").alias("change_table_id"), F.lit(table).alias("table_name"), "created_at")


def join_entries(global_: DataFrame, logs: dict[str, DataFrame]) -> DataFrame:
    """Each global entry with its pending change, table by table."""
    tagged = [log.where(F.col("state") == PENDING).select(F.lit(t).alias("table_name"), F.col("gid").alias("change_table_id"), "pk", "type") for t, log in logs.items()]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return global_.join(out, ["table_name", "change_table_id"])


def orphans(global_: DataFrame, log: DataFrame) -> DataFrame:
    """Global entries without a pending change: each would stop its publisher."""
    return global_.join(log.where(F.col("state") == PENDING).select(F.col("gid").alias("change_table_id")), "change_table_id", "left_anti")


def mark_published(log: DataFrame, upto: Column) -> DataFrame:
    """The log with every change up to ``upto`` published; what is not has a global entry still."""
    return log.withColumn("state", F.when(F.col("gid") <= upto, PUBLISHED).otherwise(F.col("state")).cast("int"))


def expired(log: DataFrame, cutoff: int) -> Column:
    """What a cleanup removes: published changes created at the cutoff or before."""
    return (F.col("state") == PUBLISHED) & (F.col("created_at") <= cutoff)


def cleanup(log: DataFrame, cutoff: int) -> tuple[DataFrame, DataFrame]:
    """The log that stays, and the removed counts by table with their total."""
    gone = log.where(expired(log, cutoff))
    counts = gone.rollup("table_name").agg(F.count("*").alias("removed"))
    return log.where(~expired(log, cutoff)), counts.select(F.coalesce("table_name", F.lit("(all)")).alias("table_name"), "removed")


def sequenced(log: DataFrame) -> DataFrame:
    """Adds seq: the dense position of a change in its shard's stream, in global order."""
    return numbered(log, "gid", "seq", by=["shard"])


def retained(stream: DataFrame, most: int) -> DataFrame:
    """The newest ``most`` messages of every shard. Positions are dense: no sort is needed."""
    last = stream.groupBy("shard").agg(F.max("seq").alias("last_seq"))
    return stream.join(last, "shard").where(F.col("seq") > F.col("last_seq") - most).drop("last_seq")


def bounds(stream: DataFrame) -> DataFrame:
    return stream.groupBy("shard").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("kept"))


def resume(stream: DataFrame, saved: DataFrame) -> DataFrame:
    """What is still to be applied: each message once, after its shard's saved position."""
    start = saved.select("shard", F.col("seq").alias("saved_seq"))
    fresh = stream.join(start, "shard", "left").where(F.col("seq") > F.coalesce("saved_seq", F.lit(0))).drop("saved_seq")
    return fresh.dropDuplicates(["shard", "seq"])


def advance(positions: DataFrame, more: DataFrame) -> DataFrame:
    """Saved positions never go back: the maximum for each shard."""
    return positions.unionByName(more).groupBy("shard").agg(F.max("seq").alias("seq"))


def gaps(stream: DataFrame, saved: DataFrame) -> DataFrame:
    """Per shard whether the saved position lies before what is retained, and whether any does."""
    rows = bounds(stream).join(saved.select("shard", F.col("seq").alias("saved_seq")), "shard", "left").withColumn("saved_seq", F.coalesce("saved_seq", F.lit(0)).cast("long"))
    rows = rows.withColumn("behind", F.col("saved_seq") < F.col("first_seq"))
    any_ = rows.agg(F.coalesce(F.bool_or("behind"), F.lit(False)).alias("restore"))
    return rows.select("shard", "saved_seq", "first_seq", "behind", any_.scalar().alias("restore"))


def snapshot_points(stream: DataFrame, most: int, shards: int) -> DataFrame:
    """Where shard 1 asks for a snapshot: every ``most // shards`` messages, never if that is 0."""
    every = most // shards
    first = stream.where(F.col("shard") == 1)
    return first.where(F.col("seq") % every == 0) if every else first.limit(0)


def stream_name(prefix: str, shard: Column, compressed: Column) -> Column:
    """Streams of compressed messages have a suffix; their subjects have none."""
    return F.concat(F.format_string(f"{prefix}-changes-%d", shard), F.when(compressed, "-c").otherwise(""))


def subject_name(prefix: str, shard: Column) -> Column:
    return F.format_string(f"{prefix}-change-log-%d", shard)


def digest(rows: DataFrame) -> DataFrame:
    """n and checksum: a sum over the rows' md5 prefixes, the same in any order."""
    said = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(rows.columns)))
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.conv(F.substring(F.md5(said), 1, 8), 16, 10).cast("bigint")), F.lit(0)).alias("checksum"))
