import random
import sqlite3
import time

import pytest
from pyspark.sql import types as T

from logfold.config import Config, load
from logfold.operators.lease import FileLease
from logfold.sources import sqlite as source
from logfold.spec import TableSpec, ColumnSpec, spec_of, type_of
from logfold.store import Manifest, Store, content_digest
from logfold.streaming import replicate as rep

ROWS = "gid long, type string, id long, title string"


@pytest.fixture
def replication(spark, tmp_path):
    spec = TableSpec("books", (ColumnSpec("id", T.LongType(), True, None, 1), ColumnSpec("title", T.StringType())))
    return rep.Replication(spec, f"{tmp_path}/log", f"{tmp_path}/state", f"{tmp_path}/checkpoints", shards=3)


def state_of(spark, r):
    rows = Store(spark, r.state).read()
    return sorted((x["id"], x["title"]) for x in rows.collect())


def test_publish_apply_restart_and_repeat(spark, replication):
    r = replication
    rep.publish(r, spark.createDataFrame([(i, "insert", i % 20, f"a{i}") for i in range(60)], ROWS))
    schema = spark.read.parquet(r.log).schema
    rep.start(spark, r, schema).awaitTermination()
    want = {i % 20: f"a{i}" for i in range(60)}
    assert state_of(spark, r) == sorted(want.items())
    before = Store(spark, r.state).manifest()
    rep.apply_batch(r, spark.read.schema(schema).parquet(r.log))  # delivered again
    assert Store(spark, r.state).manifest() == before
    rep.publish(r, spark.createDataFrame([(100, "delete", 3, None), (101, "update", 4, "new"), (102, "insert", 77, "x")], ROWS))
    rep.start(spark, r, schema).awaitTermination()
    del want[3]
    want |= {4: "new", 77: "x"}
    assert state_of(spark, r) == sorted(want.items())
    assert sum(Store(spark, r.state).manifest().positions.values()) == 63


def test_a_failure_between_write_and_commit_loses_nothing(spark, replication, monkeypatch):
    r = replication
    rep.publish(r, spark.createDataFrame([(1, "insert", 1, "a"), (2, "insert", 2, "b")], ROWS))
    log = spark.read.parquet(r.log)
    real = Store._put

    def fails(self, new, expected, name):
        raise OSError("lost")

    monkeypatch.setattr(Store, "_put", fails)
    with pytest.raises(OSError, match="lost"):
        rep.apply_batch(r, log)
    assert Store(spark, r.state).read() is None
    monkeypatch.setattr(Store, "_put", real)
    rep.apply_batch(r, log)
    assert state_of(spark, r) == [(1, "a"), (2, "b")]


def test_switches_discard(spark, replication):
    from dataclasses import replace

    off = replace(replication, publish=False)
    rep.publish(off, spark.createDataFrame([(1, "insert", 1, "a")], ROWS))
    assert rep.last_positions(spark, off.log) == {}
    rep.publish(replication, spark.createDataFrame([(1, "insert", 1, "a")], ROWS))
    deaf = replace(replication, replicate=False)
    rep.apply_batch(deaf, spark.read.parquet(deaf.log))
    assert state_of(spark, deaf) == [] and sum(Store(spark, deaf.state).manifest().positions.values()) == 1


def test_snapshot_restore_and_gap(spark, replication, tmp_path):
    r = replication
    rep.publish(r, spark.createDataFrame([(i, "insert", i, f"a{i}") for i in range(50)], ROWS))
    log = spark.read.parquet(r.log)
    rep.apply_batch(r, log)
    store = Store(spark, r.state)
    store.save_snapshot(f"{tmp_path}/snapshot")
    fresh = Store(spark, f"{tmp_path}/other")
    assert fresh.restore_snapshot(f"{tmp_path}/nothing") == Manifest()
    got = fresh.restore_snapshot(f"{tmp_path}/snapshot")
    assert got.positions == store.manifest().positions
    assert content_digest(fresh.read()) == content_digest(store.read())
    rep.trim(spark, r, 5, f"{tmp_path}/trimmed")
    from dataclasses import replace

    late = replace(r, log=f"{tmp_path}/trimmed", state=f"{tmp_path}/empty")
    assert rep.needs_snapshot(spark, late)
    assert not rep.needs_snapshot(spark, replace(r, log=f"{tmp_path}/trimmed"))


def test_commits_refuse_a_second_writer_and_vacuum(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    first = store.manifest()
    one = store.commit(spark.range(3), {1: 5}, first)
    with pytest.raises(RuntimeError, match="another writer"):
        store.commit(spark.range(4), {1: 6}, first)
    two = store.commit(spark.range(5), {1: 4, 2: 1}, one)
    assert two.positions == {1: 5, 2: 1} and store.read().count() == 5
    assert store.vacuum(keep=1) == [1]


def test_two_writers_of_one_version_leave_the_first_ones_rows(spark, tmp_path):
    one, two = (Store(spark, f"{tmp_path}/s") for _ in range(2))
    start = one.commit(spark.range(1), {1: 1}, one.manifest())
    names = [one._write(spark.range(n), 2) for n in (5, 7)]
    kept = one._put(Manifest(2, {1: 2}, names[0]), start, names[0])
    two.manifest = lambda: start  # it looked before the first one was done
    with pytest.raises(RuntimeError, match="another writer"):
        two._put(Manifest(2, {1: 3}, names[1]), start, names[1])
    assert one.manifest() == kept and one.read().count() == 5 and names[1] not in one.folder.names()


def test_a_restored_state_reads_on_from_the_snapshots_position(spark, replication, tmp_path):
    r, to = replication, f"{tmp_path}/snapshot"
    rep.publish(r, spark.createDataFrame([(i, "insert", i, "a") for i in range(20)], ROWS))
    rep.apply_batch(r, spark.read.parquet(r.log))
    store = Store(spark, r.state)
    store.save_snapshot(to)
    rep.publish(r, spark.createDataFrame([(30, "delete", 3, None), (31, "update", 4, "b"), (29, "insert", 50, "c")], ROWS))
    rep.apply_batch(r, spark.read.parquet(r.log))
    want, at = state_of(spark, r), store.manifest()
    with pytest.raises(ValueError, match="older"):
        store.restore_snapshot(to)
    assert store.manifest() == at and len(at.deltas) == 1
    from dataclasses import replace

    other = replace(r, state=f"{tmp_path}/other")
    restored = Store(spark, other.state).restore_snapshot(to)
    assert sum(restored.positions.values()) == 20 and len(state_of(spark, other)) == 20
    rep.apply_batch(other, spark.read.parquet(r.log))
    assert state_of(spark, other) == want


def test_deltas_and_rewritten_states_are_the_same(spark, replication, tmp_path):
    from dataclasses import replace

    rng = random.Random(5)
    often, seldom = replace(replication, deltas=1), replace(replication, state=f"{tmp_path}/other", deltas=50)
    for batch in range(5):
        rows = [(batch * 20 + i, rng.choice(["insert", "update", "delete"]), rng.randrange(15), rng.choice([None, f"t{batch}-{i}"])) for i in range(20)]
        rep.publish(replication, spark.createDataFrame(rows, ROWS))
        for r in (often, seldom):
            rep.apply_batch(r, spark.read.parquet(r.log))
    assert state_of(spark, often) == state_of(spark, seldom)
    assert len(Store(spark, seldom.state).manifest().deltas) == 4


def test_late_and_repeated_changes_are_published_once(spark, replication):
    r = replication
    rep.publish(r, spark.createDataFrame([(10, "insert", 1, "a"), (20, "insert", 2, "b")], ROWS))
    rep.publish(r, spark.createDataFrame([(5, "insert", 3, "late"), (10, "insert", 1, "a"), (15, "insert", 4, "late too")], ROWS))
    rep.publish(r, spark.createDataFrame([], ROWS))
    rep.publish(r, spark.createDataFrame([(20, "insert", 2, "b")], ROWS))
    log = spark.read.parquet(r.log)
    assert sorted(x["gid"] for x in log.collect()) == [5, 10, 15, 20]
    assert log.select("shard", "seq").distinct().count() == 4


@pytest.mark.parametrize("bad", [None, "merge"])
def test_a_change_without_a_known_type_is_not_applied(spark, replication, bad):
    rep.publish(replication, spark.createDataFrame([(1, "insert", 1, "a"), (2, bad, 2, "b")], ROWS))
    with pytest.raises(Exception, match="unknown change type"):
        rep.apply_batch(replication, spark.read.parquet(replication.log))
    assert Store(spark, replication.state).manifest() == Manifest()


def test_a_node_publishes_applies_snapshots_restores_and_sleeps(spark, replication, tmp_path):
    from dataclasses import replace

    from logfold.streaming.node import RESTORE, Node
    from logfold.streaming.schedule import CLEANUP, SLEEP, SNAPSHOT

    now = [0]
    schema = T.StructType.fromDDL(ROWS)
    config = Config(node_id=7, shards=1, max_entries=30, cleanup_interval_ms=1000, sleep_timeout_ms=5000, polling_interval_ms=1)
    (tmp_path / "captured").mkdir()

    def node(name, **options):
        r = replace(replication, state=f"{tmp_path}/{name}", checkpoints=f"{tmp_path}/c-{name}")
        return Node(spark, r, replace(config, **options), f"{tmp_path}/captured", schema, f"{tmp_path}/snapshot", FileLease(tmp_path, "snapshot", 7), lambda: now[0])

    def capture(low, high):
        spark.createDataFrame([(i, "insert", i % 40, f"v{i}") for i in range(low, high)], ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/captured")

    lead = node("lead")
    assert lead.step() == []
    capture(0, 20)
    assert lead.step() == [] and len(state_of(spark, lead.replication)) == 20
    capture(20, 60)
    assert lead.step() == [SNAPSHOT] and Store(spark, f"{tmp_path}/snapshot").manifest().positions == {1: 60}
    now[0] = 1000
    assert lead.step() == [CLEANUP] and lead.metrics.values == {"applied": 60, "retired": 1}
    late = node("late", publish=False)
    assert late.step() == [RESTORE] and state_of(spark, late.replication) == state_of(spark, lead.replication)
    now[0] = 9000
    assert lead.run() == [CLEANUP, SNAPSHOT, SLEEP]
    lead.stop()
    assert lead.run() == []


def test_steps_are_tried_seven_times():
    from logfold.streaming.node import tried

    calls = []

    def fails():
        calls.append(1)
        if len(calls) % 7:
            raise OSError("down")
        return "up"

    assert tried(fails) == "up" and len(calls) == 7
    calls.clear()
    with pytest.raises(OSError):
        tried(fails, attempts=6)
    assert len(calls) == 6


def test_sqlite_source_reads_batches_and_streams(spark, tmp_path):
    path = str(tmp_path / "books.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE Books (id INTEGER PRIMARY KEY, title TEXT NOT NULL, price REAL, cover BLOB)")
    db.execute("CREATE TABLE __logfold__x (a INT)")
    db.executemany("INSERT INTO Books VALUES (?, ?, ?, ?)", [(i, f"t{i}", i / 2, bytes([i])) for i in range(1, 11)])
    db.commit()
    source.register(spark)
    assert source.table_names(path) == ["Books"]
    spec = source.table_spec(path, "Books")
    assert spec.key == ("id",) and spec.columns[1].not_null
    df = spark.read.format("sqlite").option("path", path).option("table", "Books").option("partitions", 3).load()
    assert [f.dataType for f in df.schema] == [T.LongType(), T.StringType(), T.DoubleType(), T.BinaryType()]
    assert sorted(r["id"] for r in df.collect()) == list(range(1, 11))
    stream = spark.readStream.format("sqlite").option("path", path).option("table", "Books").option("limit", 4).load()
    q = stream.writeStream.format("memory").queryName("books_stream").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("books_stream").count() == 10


def test_capture_of_a_live_table_is_published_and_applied(spark, replication, tmp_path):
    from logfold.sources.capture import capture

    path, seen, to = str(tmp_path / "live.db"), f"{tmp_path}/seen", f"{tmp_path}/captured"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE books (id INTEGER PRIMARY KEY, title TEXT)")
    db.executemany("INSERT INTO books VALUES (?, ?)", [(i, f"t{i}") for i in range(9)])
    db.execute("CREATE TABLE loose (a TEXT)")
    db.commit()
    schema = T.StructType.fromDDL("gid long, type string, id long, title string")

    def applied():
        rep.start_publisher(spark, replication, to, schema).awaitTermination()
        rep.apply_batch(replication, spark.read.parquet(replication.log))
        return state_of(spark, replication)

    assert capture(spark, path, "books", seen, to) == 9 and capture(spark, path, "books", seen, to) == 0
    db.execute("UPDATE books SET title = 'new' WHERE id = 3")
    db.execute("DELETE FROM books WHERE id = 5")
    db.execute("INSERT INTO books VALUES (50, NULL)")
    db.execute("UPDATE books SET id = 60 WHERE id = 8")
    db.commit()
    assert capture(spark, path, "books", seen, to) == 5
    assert applied() == sorted(db.execute("SELECT id, title FROM books").fetchall())
    with pytest.raises(ValueError, match="no key"):
        capture(spark, path, "loose", seen, to)
    assert set(rep.drop(spark, replication)) >= {replication.log, replication.state} and rep.drop(spark, replication) == []
    assert rep.last_positions(spark, replication.log) == {}


def test_specs_types_and_configuration(spark, tmp_path):
    assert TableSpec("t", (ColumnSpec("a", T.StringType()),)).key == ("rowid",)
    for bad in ("sqlite_x", "__logfold__y", "  "):
        with pytest.raises(ValueError):
            TableSpec(bad, ())
    kinds = {"INTEGER": "bigint", "varchar(9)": "string", "": "binary", "BLOB": "binary", "FLOAT": "double", "NUMERIC": "double", "BOOLEAN": "boolean", "DATE": "date", "DATETIME": "timestamp_ntz"}
    assert {k: type_of(k).simpleString() for k in kinds} == kinds
    spec = spec_of("t", spark.createDataFrame([(1, "a")], "k long, v string"), ("k",))
    with pytest.raises(ValueError, match="v is missing"):
        spec.check(spark.range(1).withColumnRenamed("id", "k"))
    assert load(tmp_path / "none.toml") == Config()
    (tmp_path / "c.toml").write_text("shards = 8\nmax_entries = 1024\nnode_id = 4\n")
    c = load(tmp_path / "c.toml")
    assert (c.snapshot_every, c.log_replicas, c.node) == (128, 5, 4)
    (tmp_path / "s.toml").write_text("node_id = 4\n[replication_log]\nshards = 8\n[snapshot]\nenabled = false\ninterval = 90\n[stream]\nprefix = 'p'\n")
    c = load(tmp_path / "s.toml")
    assert (c.shards, c.snapshots, c.snapshot_interval_ms, c.stream_prefix, c.snapshot_every) == (8, False, 90, "p", 0)
    for bad, why in (("shard = 8", "unknown"), ("[snapshot]\nx = 1", "snapshot.x"), ("[other]\nx = 1", "other"), ("shards = '8'", "another type")):
        (tmp_path / "bad.toml").write_text(bad)
        with pytest.raises(ValueError, match=why):
            load(tmp_path / "bad.toml")


def test_file_lease(tmp_path):
    a, b = FileLease(tmp_path, "snapshot", 1), FileLease(tmp_path, "snapshot", 2)
    assert a.acquire(0) and not b.acquire(5_000) and a.acquire(6_000)
    assert not b.acquire(15_999) and b.acquire(16_000) and not a.acquire(17_000)
    assert a.refresh_every_ms() == 5_000
    short = FileLease(tmp_path, "short", 1, ttl_ms=200)
    assert short.acquire()
    with short.kept():
        time.sleep(0.6)
        assert not FileLease(tmp_path, "short", 2, ttl_ms=200).acquire()


def test_entry_imports_without_the_training_data_subpackage(spark, tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('corpus_pipeline', 'logfold.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert len(q) == 33 and set(e.oracle_sql()) == set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_publisher_stream_is_idempotent(spark, replication, tmp_path):
    r = replication
    changes = spark.createDataFrame([(i, "insert", i % 9, f"v{i}") for i in range(30)], ROWS)
    changes.coalesce(1).write.mode("append").parquet(f"{tmp_path}/captured")
    rep.start_publisher(spark, r, f"{tmp_path}/captured", changes.schema).awaitTermination()
    rep.publish(r, changes)  # run again: nothing is appended
    changes.withColumn("gid", changes["gid"] + 30).coalesce(1).write.mode("append").parquet(f"{tmp_path}/captured")
    rep.start_publisher(spark, r, f"{tmp_path}/captured", changes.schema).awaitTermination()
    log = spark.read.parquet(r.log)
    assert log.count() == 60 and sum(rep.last_positions(spark, r.log).values()) == 60


def test_schedule():
    from logfold.streaming.schedule import CLEANUP, SLEEP, SNAPSHOT, Schedule

    s = Schedule(Config(cleanup_interval_ms=10, snapshot_interval_ms=100, sleep_timeout_ms=500, shards=8), 0)
    assert s.due(5) == [] and s.due(10) == [CLEANUP] and s.due(15) == [] and s.due(100) == [CLEANUP, SNAPSHOT]
    assert s.after_message(1, 127, 120) == [] and s.after_message(1, 128, 150) == [SNAPSHOT] and s.after_message(2, 128, 150) == []
    s.saw_change(160)
    assert s.due(240) == [CLEANUP] and s.due(700) == [CLEANUP, SNAPSHOT, SLEEP]
    assert Schedule(Config(cleanup_interval_ms=0, snapshots=False, sleep_timeout_ms=5), 0).due(9) == [SLEEP]


def test_metrics(spark):
    from urllib.request import urlopen

    from logfold.telemetry import Metrics, observed, serve

    df, seen = observed(spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "gid long, state int"))
    df.collect()
    assert seen.get == {"published": 2, "pending_publish": 1, "total": 3}
    m = Metrics()
    m.add("published", 2)
    m.add("published")
    m.took("scan", 5)
    assert m.values == {"published": 3} and m.durations == {"scan": {3: 1}}
    assert 'logfold_scan_ms_bucket{le="7"} 1' in m.exposition()
    server = serve(m)
    with urlopen(f"http://127.0.0.1:{server.server_port}/metrics") as said:
        assert said.read().decode() == m.exposition()
    server.shutdown()
