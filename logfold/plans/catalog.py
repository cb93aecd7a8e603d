"""The registered change-log queries. Their DuckDB oracles are in oracles.py."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfold import changes as ch
from logfold.functions.hashing import key_hash, shard_of
from logfold.operators import lease, logs, state
from logfold.operators.numbering import numbered, with_previous
from logfold.plans import oracles
from logfold.plans.oracles import CUTOFF, HALF, IDLE_MS, INTERVAL_MS, LEASE_ATTEMPTS, NAMES, RETAINED, SHARDS
from logfold.sources.tables import event_changes, load, order_changes
from logfold.store import Folder, Store, work_dir
from logfold.spec import OWN_PREFIX, columns_of, is_user_table, may_be_watched, spec_of

Query = Callable[[SparkSession, str], DataFrame]
KEY = ("pk",)
LOGGED = ("pk", "value", "props")

_queries: dict[str, Query] = {}


def query(f: Query) -> Query:
    @wraps(f)
    def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return f(spark, sf_dir)

    _queries[f.__name__] = in_utc
    return in_utc


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracles.all_sql().items() if name in _queries}


def _key_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("h", key_hash("events", {"user_id": (F.col("pk"), T.LongType())}))


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' log, sharded by key and numbered."""
    return logs.sequenced(_key_hash(event_changes(spark, sf_dir)).withColumn("shard", shard_of(F.col("h"), SHARDS)).drop("h"))


def _saved(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, s * 100) for s in range(1, SHARDS + 1)], "shard int, seq long")


@query
def q01_list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(n,) for n in NAMES], "name string")
    name = F.col("name")
    return names.select("name", is_user_table(name).alias("user_table"), may_be_watched(name).alias("watched"), name.ilike(f"{OWN_PREFIX}%").alias("own"))


@query
def q02_table_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = spec_of("orders", load(spark, sf_dir, "orders"), ("o_orderkey",))
    return columns_of(spark, spec).drop("not_null")


@query
def q03_pending_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.pending_scan(event_changes(spark, sf_dir))


@query
def q04_row_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = with_previous(event_changes(spark, sf_dir).withColumn("row", F.struct("value", "props")), "gid", "row", "old", by=["pk"], width=1 << 14)
    image = ch.row_image(F.col("type"), F.col("row"), F.col("old"))
    return c.select("gid", "pk", ch.checked_type(F.col("type")).alias("type"), image["value"].alias("image_value"), image["props"].alias("image_props"), F.lit(ch.PENDING).alias("log_state"))


@query
def q05_diff_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    kept = before.where(F.col("o_orderkey") % 10 != 3)
    touched = F.col("o_orderkey") % 10 == 7
    after = kept.select("o_orderkey", F.when(touched, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(touched, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("o_totalprice"))
    fresh = before.where(F.col("o_orderkey") % 10 == 5).select((F.col("o_orderkey") + 1_000_000_000).alias("o_orderkey"), "o_orderstatus", "o_totalprice")
    return ch.diff(before, after.unionByName(fresh), ("o_orderkey",))


@query
def q06_global_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.global_log(event_changes(spark, sf_dir), "events")


@query
def q07_fetch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = ch.to_log(event_changes(spark, sf_dir).select(F.col("gid").alias("id"), *LOGGED, "type"), LOGGED)
    ids = event_changes(spark, sf_dir).where(F.col("state") == ch.PENDING).select(F.col("gid").alias("id"))
    return ch.from_log(log, ids)


@query
def q08_mark_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_changes(spark, sf_dir)
    upto = c.agg(F.floor(F.count("*") / 2)).scalar()
    marked = logs.mark_published(c.withColumn("state", F.lit(ch.PENDING)), upto)
    return marked.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("state") == ch.PENDING).alias("global_rows"), F.min("gid").alias("first_gid"))


@query
def q09_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = event_changes(spark, sf_dir).unionByName(order_changes(spark, sf_dir))
    return logs.cleanup(both, CUTOFF)[1]


@query
def q10_global_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"events": event_changes(spark, sf_dir), "orders": order_changes(spark, sf_dir)}
    entries = [c.select("table_name", F.col("gid").alias("change_table_id")) for c in tables.values()]
    return logs.join_entries(entries[0].unionByName(entries[1]), tables)


@query
def q11_lww_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.state_of(event_changes(spark, sf_dir), KEY).select("pk", "gid", "type", "value", "props", "node_id")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = event_changes(spark, sf_dir).select("pk", "gid", "type", "value", "props", "node_id")
    return state.state_of(c.where(F.col("gid") < HALF), KEY), c.where(F.col("gid") >= HALF)


@query
def q12_apply_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, later = _halves(spark, sf_dir)
    return state.apply(base, later, KEY)


@query
def q13_apply_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.nullif(F.col("o_custkey") % 20, F.lit(0))
    rows = load(spark, sf_dir, "orders").groupBy(part.alias("k1"), F.col("o_orderpriority").alias("k2")).agg(F.count("*").alias("n"))
    gone = rows.where((F.col("k1").isNull() | (F.col("k1") % 3 == 0)) & (F.col("k2").startswith("1") | F.col("k2").startswith("3")))
    return state.delete_keys(rows, gone, ("k1", "k2"))


@query
def q14_shard_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _key_hash(event_changes(spark, sf_dir).select("pk").distinct())
    return keys.select("pk", F.col("h.hi").alias("hash_hi"), F.col("h.lo").alias("hash_lo"), shard_of(F.col("h"), SHARDS).alias("shard"))


@query
def q15_shard_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream(spark, sf_dir).select("shard", "seq", "gid", "pk")


@query
def q16_pending_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = event_changes(spark, sf_dir).unionByName(order_changes(spark, sf_dir))
    return both.groupBy("table_name").agg(F.count_if(F.col("state") == ch.PENDING).alias("pending"), F.count("*").alias("total"))


@query
def q17_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_changes(spark, sf_dir)
    entries = c.where(F.col("gid") % 7 != 0).select(F.col("gid").alias("change_table_id"), "table_name")
    return logs.orphans(entries, c)


@query
def q18_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _stream(spark, sf_dir).select("shard", "seq", "gid")
    twice = sent.unionByName(sent.where(F.col("gid") % 5 == 0))
    return logs.resume(twice, _saved(spark))


@query
def q19_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.bounds(logs.retained(_stream(spark, sf_dir).select("shard", "seq"), RETAINED))


@query
def q20_gap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.gaps(logs.retained(_stream(spark, sf_dir).select("shard", "seq"), RETAINED), _saved(spark))


@query
def q21_snapshot_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.snapshot_points(_stream(spark, sf_dir), RETAINED, SHARDS).select("shard", "seq", "gid", "created_at")


def _last_point(spark: SparkSession, sf_dir: str) -> F.Column:
    points = logs.snapshot_points(_stream(spark, sf_dir), RETAINED, SHARDS)
    return F.coalesce(points.agg(F.max("gid")).scalar(), F.lit(-1).cast("long"))


@query
def q22_snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_changes(spark, sf_dir).where(F.col("gid") <= _last_point(spark, sf_dir))
    return state.state_of(c, KEY).select("pk", "gid", "type", "value", "props")


@query
def q23_restore_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node that failed takes the latest snapshot and reads the log on from the snapshot's position."""
    c = event_changes(spark, sf_dir).select("pk", "gid", "type", "value", "props", "node_id")
    cut = c.select(_last_point(spark, sf_dir).alias("at")).first()
    lead, late = (Store(spark, work_dir(spark, name)) for name in ("lead", "late"))
    to = work_dir(spark, "snapshot")
    lead.commit(state.state_of(c.where(F.col("gid") <= (cut["at"] if cut else -1)), KEY), {1: cut["at"] if cut else -1}, lead.manifest())
    lead.save_snapshot(to)
    at = late.restore_snapshot(to).positions[1]
    lead.folder.delete()
    Folder(spark, to).delete()
    return state.apply(late.read(), c.where(F.col("gid") > at), KEY, guard=None)


@query
def q24_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.digest(state.state_of(event_changes(spark, sf_dir), KEY).select("pk", "gid", "type", "props"))


@query
def q25_log_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("props") + F.octet_length("type") + F.lit(24)
    return _stream(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("messages"), F.sum(size).cast("long").alias("payload_bytes"))


@query
def q26_lease(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lease.granted(spark.createDataFrame(LEASE_ATTEMPTS, "node long, ts long"))


@query
def q27_interval_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = logs.snapshot_points(_stream(spark, sf_dir), RETAINED, SHARDS).select("seq", "created_at")
    timed = with_previous(points, "seq", "created_at", "previous_at")
    due = F.col("previous_at").isNull() | (F.col("created_at") - F.col("previous_at") >= INTERVAL_MS)
    return timed.select("seq", "created_at", "previous_at", due.alias("due"))


@query
def q28_union_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = event_changes(spark, sf_dir).unionByName(order_changes(spark, sf_dir))
    return both.groupBy("table_name", "type").agg(F.count("*").alias("n"), F.max("gid").alias("last_gid"))


@query
def q29_stream_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1, SHARDS + 1).select(F.col("id").cast("int").alias("shard"), F.explode(F.array(F.lit(False), F.lit(True))).alias("compressed"))
    return rows.select("shard", "compressed", logs.stream_name("logfold", F.col("shard"), F.col("compressed")).alias("stream"), logs.subject_name("logfold", F.col("shard")).alias("subject"))


@query
def q30_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_changes(spark, sf_dir).withColumn("bucket", F.floor(F.col("value") / 10).cast("long"))
    return c.groupBy("bucket").agg(F.count_if(F.col("state") == ch.PUBLISHED).alias("published"), F.count_if(F.col("state") == ch.PENDING).alias("pending"))


@query
def q31_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_changes(spark, sf_dir).select("gid", "pk", "type", "value", "props", "created_at")
    return ch.unwrap(ch.envelope(c, ("value", "props", "created_at")), {"value": "double", "props": "string", "created_at": "bigint"})


@query
def q32_idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = with_previous(event_changes(spark, sf_dir).select("gid", "created_at"), "gid", "created_at", "previous_at")
    idle = F.col("created_at") - F.col("previous_at")
    return c.select("gid", "created_at", idle.alias("idle_ms")).where(F.col("idle_ms") > IDLE_MS)


@query
def q33_by_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = event_changes(spark, sf_dir)
    won = state.state_of(c, KEY).groupBy("node_id").agg(F.count("*").alias("winners"))
    return c.groupBy("node_id").agg(F.count("*").alias("changes")).join(won, "node_id", "left").select("node_id", "changes", F.coalesce("winners", F.lit(0)).cast("long").alias("winners"))
