import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from logfold import changes as ch
from logfold.operators import logs, state
from logfold.operators.numbering import numbered, with_previous

BOOKS = [
    (1, "The Hitchhiker's Guide to the Galaxy", "Douglas Adams", 1979),
    (2, "1984", "George Orwell", 1949),
    (3, None, "Jane Austen", 1813),
]
SCHEMA = "gid long, type string, id long, title string"


def random_changes(seed, n=300, keys=25):
    rng = random.Random(seed)
    return [(g, rng.choice(["insert", "update", "update", "delete"]), rng.randrange(keys), rng.choice([None, f"t{g}"])) for g in range(n)]


def in_sqlite(changes):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, title TEXT)")
    for _, type_, key, title in changes:
        if type_ == "delete":
            db.execute("DELETE FROM t WHERE id = ?", (key,))
        else:
            db.execute("INSERT OR REPLACE INTO t VALUES (?, ?)", (key, title))
    return sorted(db.execute("SELECT id, title FROM t").fetchall())


@pytest.mark.parametrize("seed", range(3))
def test_state_is_what_sqlite_ends_up_with(spark, seed):
    changes = random_changes(seed)
    df = spark.createDataFrame(changes, SCHEMA)
    assert sorted(map(tuple, state.state_of(df, ("id",)).select("id", "title").collect())) == in_sqlite(changes)


@pytest.mark.parametrize("cut", [0, 1, 150, 299, 300])
def test_batches_give_the_same_state_and_replay_changes_nothing(spark, cut):
    changes = random_changes(9)
    df = spark.createDataFrame(changes, SCHEMA)
    base = state.state_of(df.where(F.col("gid") < cut), ("id",))
    later = df.where(F.col("gid") >= cut)
    once = state.apply(base, later, ("id",), guard=None)
    want = in_sqlite(changes)
    assert sorted(map(tuple, once.select("id", "title").collect())) == want
    again = state.apply(once, later, ("id",), guard=None)
    assert sorted(map(tuple, again.select("id", "title").collect())) == want


def test_a_changed_key_leaves_the_old_row(spark):
    df = spark.createDataFrame([(1, "insert", 1, "x"), (2, "update", 2, "x")], SCHEMA)
    assert sorted(map(tuple, state.state_of(df, ("id",)).select("id", "title").collect())) == [(1, "x"), (2, "x")]


def test_diff_capture_of_composite_and_null_keys(spark):
    before = spark.createDataFrame([(1, None, "a"), (None, 2, "b"), (3, 3, "c"), (4, 4, None)], "k1 int, k2 int, v string")
    after = spark.createDataFrame([(1, None, "a"), (None, 2, "B"), (4, 4, None), (5, 5, "e")], "k1 int, k2 int, v string")
    got = {tuple(r) for r in ch.diff(before, after, ("k1", "k2")).collect()}
    assert got == {("update", None, 2, "B"), ("delete", 3, 3, "c"), ("insert", 5, 5, "e")}
    keys = ch.diff(before.select("k1"), after.select("k1"), ("k1",))
    assert {tuple(r) for r in keys.collect()} == {("delete", 3), ("insert", 5)}


def test_null_safe_delete_and_unique_eviction(spark):
    base = spark.createDataFrame([(1, None), (1, 2), (None, None)], "a int, b int")
    left = state.delete_keys(base, spark.createDataFrame([(1, None), (None, None)], "a int, b int"), ("a", "b"))
    assert [tuple(r) for r in left.collect()] == [(1, 2)]
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, u string")
    kept = state.evict(rows, spark.createDataFrame([(9, "x"), (10, None)], "id int, u string"), (("u",),))
    assert sorted(r["id"] for r in kept.collect()) == [2, 3]


def test_unknown_type_is_an_error(spark):
    df = spark.createDataFrame([("merge",)], "type string")
    with pytest.raises(Exception, match="unknown change type"):
        df.select(ch.checked_type(F.col("type"))).collect()


def test_numbering_and_neighbours_across_buckets(spark):
    rng = random.Random(3)
    ids = sorted(rng.sample(range(100_000), 2000))
    rows = [(i, i % 3, float(i)) for i in ids]
    df = spark.createDataFrame(rows, "id long, g int, v double")
    got = {r["id"]: r["n"] for r in numbered(df, "id", "n", by=["g"], width=100).collect()}
    prev = {r["id"]: r["p"] for r in with_previous(df, "id", "v", "p", by=["g"], width=100).collect()}
    for g in range(3):
        mine = [i for i in ids if i % 3 == g]
        assert [got[i] for i in mine] == list(range(1, len(mine) + 1))
        assert [prev[i] for i in mine] == [None, *map(float, mine[:-1])]


def test_log_columns_round_trip(spark):
    df = spark.createDataFrame([(i, *b[1:]) for i, b in enumerate(BOOKS)], "id long, title string, author string, year long")
    log = ch.to_log(df, ("title", "author", "year"))
    assert log.columns == ["id", "val_title", "val_author", "val_year"]
    assert sorted(ch.from_log(log).collect(), key=str) == sorted(df.drop("id").collect(), key=str)


def test_envelope_keeps_types(spark):
    df = spark.createDataFrame([(1, b"\x00\xff", 2.5, None), (2, None, None, "x")], "gid long, b binary, d double, s string")
    back = ch.unwrap(ch.envelope(df, ("b", "d", "s")), {"b": "binary", "d": "double", "s": "string"})
    assert [tuple(r) for r in back.orderBy("gid").collect()] == [tuple(r) for r in df.orderBy("gid").collect()]


def test_retention_keeps_the_newest(spark):
    df = spark.createDataFrame([(s, q) for s in (1, 2) for q in range(1, 21 * s)], "shard int, seq long")
    got = {r["shard"]: (r["first_seq"], r["last_seq"], r["kept"]) for r in logs.bounds(logs.retained(df, 15)).collect()}
    assert got == {1: (6, 20, 15), 2: (27, 41, 15)}


def test_resume_skips_applied_and_doubled_messages(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1)], "shard int, seq long")
    saved = spark.createDataFrame([(1, 1)], "shard int, seq long")
    assert sorted(map(tuple, logs.resume(df, saved).collect())) == [(1, 2), (2, 1)]
    moved = logs.advance(saved, spark.createDataFrame([(1, 0), (2, 5)], "shard int, seq long"))
    assert sorted(map(tuple, moved.collect())) == [(1, 1), (2, 5)]
