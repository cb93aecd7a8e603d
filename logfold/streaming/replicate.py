"""Replication as Structured Streaming: publish changes to sharded logs, apply them to state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logfold.changes import checked_type
from logfold.functions.hashing import key_hash, shard_of
from logfold.operators import logs, state
from logfold.spec import TableSpec
from logfold.store import Folder, Journal, Manifest, Store


@dataclass(frozen=True)
class Replication:
    """One table's stream: where its log and its state are, and how the log is sharded."""

    spec: TableSpec
    log: str
    state: str
    checkpoints: str
    shards: int = 1
    files_per_trigger: int = 16
    deltas: int = 8
    polling_ms: int = 1000
    publish: bool = True
    replicate: bool = True
    node_id: int = 0

    def with_shard(self, changes: DataFrame) -> DataFrame:
        types = {c.name: c.type for c in self.spec.columns}
        key = {k: (F.col(k), types[k]) for k in self.spec.key}
        return changes.withColumn("shard", shard_of(key_hash(self.spec.name, key), self.shards))


def publish(r: Replication, changes: DataFrame) -> None:
    """Append a batch of changes (gid, type, key, values) to the sharded log, behind what it holds.

    With publish off the batch is dropped, and is not sent later. Changes whose gid the
    log has already are left out, so a batch may be run again, and a late one with lower
    gids is not lost. A batch is a folder of the log, named by the journal's next number;
    the journal has the positions, so the log isn't read for them. One left over by a
    failure is written again. Of two publishers at once one fails.
    """
    if not r.publish:
        return
    spark = changes.sparkSession
    journal = Journal(spark, f"{r.log}.journal")
    number, last = journal.last()
    positions = {int(s): p for s, p in last.get("last", {}).items()}
    if number:
        low, high = changes.agg(F.min("gid"), F.max("gid")).first()
        if low is None:
            return
        sent = spark.read.parquet(r.log).where(F.col("batch") <= number).where(F.col("gid").between(low, high)).select("gid")
        changes = changes.join(sent, "gid", "left_anti").select(*changes.columns)
    placed = logs.sequenced(r.with_shard(changes)).withColumn("node_id", F.lit(r.node_id).cast(T.DecimalType(20, 0)))
    if positions:
        base = F.create_map(*(F.lit(x) for s, p in positions.items() for x in (s, p)))
        placed = placed.withColumn("seq", F.col("seq") + F.coalesce(F.try_element_at(base, F.col("shard")), F.lit(0)).cast("long"))
    at = f"{r.log}/batch={number + 1}"
    placed.repartition("shard").sortWithinPartitions("seq").write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(at)
    written = {int(x["shard"]): (x["first_seq"], x["last_seq"]) for x in logs.bounds(spark.read.schema(placed.schema).parquet(at)).collect()}
    if not written:
        Folder(spark, at).delete()
    elif not journal.put(number + 1, {"first": {s: a for s, (a, _) in written.items()}, "last": positions | {s: b for s, (_, b) in written.items()}}):
        raise RuntimeError(f"{r.log} was written by another publisher")


def drop(spark: SparkSession, r: Replication) -> list[str]:
    """Delete what the engine keeps of the table: its log, journal, state and checkpoints, and nothing else; what there was."""
    folders = [r.log, f"{r.log}.journal", r.state, r.checkpoints, f"{r.checkpoints}-publisher"]
    gone = [f for f in folders if Folder(spark, f).names()]
    for f in gone:
        Folder(spark, f).delete()
    return gone


def retire(spark: SparkSession, r: Replication, most: int) -> list[int]:
    """Delete the log's batches all of whose messages are older than the newest ``most`` of their shards; which ones."""
    journal, gone = Journal(spark, f"{r.log}.journal"), []
    numbers = journal.numbers()
    last = journal.entry(numbers[-1])["last"] if numbers else {}
    for n in numbers[:-1]:
        entry = journal.entry(n)
        if any(entry["last"][s] > last[s] - most for s in entry["first"]):
            break
        Folder(spark, f"{r.log}/batch={n}").delete()
        journal.forget(n)
        gone.append(n)
    return gone


def last_positions(spark: SparkSession, log: str) -> dict[int, int]:
    if not Folder(spark, log).names():
        return {}
    return {int(x["shard"]): x["last_seq"] for x in logs.bounds(spark.read.parquet(log)).collect()}


def start_publisher(spark: SparkSession, r: Replication, source: str, schema: T.StructType, once: bool = True) -> StreamingQuery:
    """Publish the change files that arrive in the folder ``source``: at first what is there, then (unless ``once``) as they come."""
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", r.files_per_trigger).option("recursiveFileLookup", True).parquet(source)
    write = arriving.writeStream.foreachBatch(lambda batch, _: publish(r, batch)).option("checkpointLocation", f"{r.checkpoints}-publisher")
    return (write.trigger(availableNow=True) if once else write.trigger(processingTime=f"{r.polling_ms} milliseconds")).start()


def apply_batch(r: Replication, batch: DataFrame) -> Manifest:
    """Apply a batch of log messages to the state: exactly-once in effect.

    Messages at or before the committed positions are skipped, the rest are reduced to the
    last writer of each key and committed together with their positions, beside the state;
    after ``deltas`` such batches the state is written anew. With replicate off the
    positions move on and nothing is applied.
    """
    spark = batch.sparkSession
    store = Store(spark, r.state)
    now = store.manifest()
    saved = spark.createDataFrame([(int(s), int(p)) for s, p in now.positions.items()], "shard int, seq long")
    fresh = logs.resume(batch, saved)
    positions = {int(x["shard"]): x["last_seq"] for x in logs.bounds(fresh).collect()}
    if not positions:
        return now
    columns = [*r.spec.names]
    won = state.last_writer(fresh.select(*columns, checked_type(F.col("type")).alias("type"), "seq"), r.spec.key, "seq").select(*columns, "type")
    if now.version == 0 or len(now.deltas) >= r.deltas:
        base = store.read(now)
        if base is None:
            base = spark.createDataFrame([], T.StructType([T.StructField(c.name, c.type) for c in r.spec.columns]))
        return store.commit(state.apply(base, won.withColumn("seq", F.lit(0)), r.spec.key, "seq", guard=None) if r.replicate else base, positions, now)
    return store.append(won if r.replicate else won.limit(0), r.spec.key, positions, now)


def start(spark: SparkSession, r: Replication, schema: T.StructType, once: bool = True) -> StreamingQuery:
    """Apply the log continuously, or (``once``) what it holds now; positions survive restarts."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", r.files_per_trigger).parquet(r.log)
    write = source.writeStream.foreachBatch(lambda batch, _: apply_batch(r, batch)).option("checkpointLocation", r.checkpoints)
    return (write.trigger(availableNow=True) if once else write.trigger(processingTime=f"{r.polling_ms} milliseconds")).start()


def needs_snapshot(spark: SparkSession, r: Replication) -> bool:
    """Whether any shard's log begins after the applied position: the log alone can't catch up."""
    first = {int(x["shard"]): x["first_seq"] for x in logs.bounds(spark.read.parquet(r.log)).collect()}
    saved = Store(spark, r.state).manifest().positions
    return any(saved.get(s, 0) < f for s, f in first.items())


def trim(spark: SparkSession, r: Replication, most: int, to: str) -> None:
    """Write the log's newest ``most`` messages of every shard to ``to``: the oldest are dropped."""
    logs.retained(spark.read.parquet(r.log).drop("batch"), most).write.partitionBy("shard").option("compression", "zstd").parquet(to)
