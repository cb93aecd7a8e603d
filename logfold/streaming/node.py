"""A running node: publishes what is captured, applies the log, cleans up, snapshots, restores, sleeps."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from threading import Event
from typing import TypeVar

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from logfold.config import Config
from logfold.operators.lease import FileLease
from logfold.store import Journal, Manifest, Store
from logfold.streaming import replicate as rep
from logfold.streaming.schedule import CLEANUP, SLEEP, SNAPSHOT, Schedule
from logfold.telemetry import Metrics

RESTORE = "restore"
#: A step is tried so many times, then its error is the node's.
ATTEMPTS = 7
Result = TypeVar("Result")


def tried(step: Callable[[], Result], attempts: int = ATTEMPTS, pause: float = 0.0, metrics: Metrics | None = None) -> Result:
    """``step()``, again after an error; the last error is raised."""
    for left in range(attempts - 1, -1, -1):
        try:
            return step()
        except Exception:
            if metrics:
                metrics.add("retries")
            if not left:
                raise
            time.sleep(pause)
    raise ValueError(f"no attempts: {attempts}")


def _now() -> int:
    return int(time.time() * 1000)


@dataclass
class Node:
    """One node of the engine, with its own state, over a log that nodes share.

    ``captured`` is the folder where change files of ``schema`` arrive; ``snapshots`` the
    folder of the latest snapshot, written under ``lease`` so that one node does it.
    """

    spark: SparkSession
    replication: rep.Replication
    config: Config
    captured: str
    schema: T.StructType
    snapshots: str
    lease: FileLease | None = None
    clock: Callable[[], int] = _now
    metrics: Metrics = field(default_factory=Metrics)
    stopping: Event = field(default_factory=Event)

    def __post_init__(self) -> None:
        c = self.config
        self.replication = replace(self.replication, shards=c.shards, publish=c.publish, replicate=c.replicate, node_id=c.node, polling_ms=c.polling_interval_ms or self.replication.polling_ms)
        self.schedule = Schedule(c, self.clock())
        self.store = Store(self.spark, self.replication.state)

    def log_exists(self) -> bool:
        return bool(Journal(self.spark, f"{self.replication.log}.journal").numbers())

    def step(self) -> list[str]:
        """One round; what it did besides publishing and applying."""
        done, r = [], self.replication
        if r.publish:
            tried(lambda: rep.start_publisher(self.spark, r, self.captured, self.schema).awaitTermination(), metrics=self.metrics)
        before = self.store.manifest()
        if self.log_exists():
            if rep.needs_snapshot(self.spark, r) and Store(self.spark, self.snapshots).manifest().version:
                before = tried(lambda: self.restore(), metrics=self.metrics)
                done.append(RESTORE)
            log = self.spark.read.parquet(r.log)
            after = tried(lambda: rep.apply_batch(r, log), metrics=self.metrics)
            if after.positions != before.positions:
                self.schedule.saw_change(self.clock())
                self.metrics.add("applied", sum(after.positions.values()) - sum(before.positions.values()))
                done += self.passed(before, after)
        for what in (*done, *self.schedule.due(self.clock())):
            if what == CLEANUP:
                self.metrics.add("retired", len(rep.retire(self.spark, r, self.config.max_entries)))
                self.store.vacuum()
            elif what == SNAPSHOT:
                self.snapshot()
            if what not in done:
                done.append(what)
        return done

    def passed(self, before: Manifest, after: Manifest) -> list[str]:
        """A snapshot, if shard 1 has passed one of its points."""
        every = self.config.snapshot_every
        last, now = before.positions.get(1, 0), after.positions.get(1, 0)
        return self.schedule.after_message(1, now - now % every, self.clock()) if every and now // every > last // every else []

    def restore(self) -> Manifest:
        return self.store.restore_snapshot(self.snapshots)

    def snapshot(self) -> bool:
        """Save a snapshot if this node gets the lease and is ahead of the last one."""
        mine, theirs = self.store.manifest(), Store(self.spark, self.snapshots).manifest()
        if not mine.version or not any(p > theirs.positions.get(s, 0) for s, p in mine.positions.items()):
            return False
        if self.lease is None:
            self.store.save_snapshot(self.snapshots)
            return True
        if not self.lease.acquire(self.clock()):
            return False
        with self.lease.kept():
            self.store.save_snapshot(self.snapshots)
        return True

    def run(self, rounds: int | None = None) -> list[str]:
        """Rounds until the node is stopped or falls asleep; what the last one did."""
        done: list[str] = []
        while not self.stopping.is_set() and SLEEP not in done and rounds != 0:
            done = self.step()
            rounds = None if rounds is None else rounds - 1
            if SLEEP not in done:
                self.stopping.wait(self.replication.polling_ms / 1000)
        return done

    def stop(self) -> None:
        self.stopping.set()
