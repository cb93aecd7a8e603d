"""A lease on a name: as a fold over attempts, and as a file that a driver holds."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path
from threading import Event, Thread

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL_MS = 10_000


def granted(attempts: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """node, ts and granted for each attempt (node, ts) on one name, in order of (ts, node).

    Refused if another node holds the lease and it hasn't run out; each grant depends on
    those before, so the attempts of a name are folded as one array: attempts are few, one
    for each node and half time-to-live.
    """
    ordered = attempts.agg(F.array_sort(F.collect_list(F.struct("ts", "node"))).alias("a"))
    start = F.struct(F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("ts"), F.expr("cast(array() as array<struct<node:bigint,ts:bigint,granted:boolean>>)").alias("out"))

    def step(s, x):
        ok = s["node"].isNull() | (s["node"] == x["node"]) | (s["ts"] + ttl_ms <= x["ts"])
        entry = F.struct(x["node"].alias("node"), x["ts"].alias("ts"), ok.alias("granted"))
        return F.struct(F.when(ok, x["node"]).otherwise(s["node"]).alias("node"), F.when(ok, x["ts"]).otherwise(s["ts"]).alias("ts"), F.array_append(s["out"], entry).alias("out"))

    return ordered.select(F.inline(F.aggregate("a", start, step)["out"]))


@dataclass
class FileLease:
    """A lease kept in a file of a shared, POSIX-like folder; taken by an atomic link or rename."""

    folder: Path
    name: str
    node: int
    ttl_ms: int = TTL_MS

    @property
    def path(self) -> Path:
        return Path(self.folder) / f"{self.name}.lease"

    def holder(self) -> tuple[int, int] | None:
        try:
            said = json.loads(self.path.read_text())
            return said["node_id"], said["timestamp"]
        except (FileNotFoundError, ValueError):
            return None

    def acquire(self, now_ms: int | None = None) -> bool:
        now = int(time.time() * 1000) if now_ms is None else now_ms
        held = self.holder()
        if held and held[0] != self.node and held[1] + self.ttl_ms > now:
            return False
        mine = self.path.with_suffix(f".{uuid.uuid4().hex}")
        mine.write_text(json.dumps({"node_id": self.node, "timestamp": now}))
        try:
            if held is None:
                os.link(mine, self.path)
            else:
                if self.holder() != held:
                    return False
                os.replace(mine, self.path)
            return True
        except FileExistsError:
            return False
        finally:
            mine.unlink(missing_ok=True)

    def refresh_every_ms(self) -> int:
        return self.ttl_ms // 2

    @contextmanager
    def kept(self) -> Iterator[None]:
        """Refreshes the lease, which this node has, at half its time-to-live while the body runs."""
        over = Event()

        def refresh() -> None:
            while not over.wait(self.refresh_every_ms() / 1000):
                self.acquire()

        thread = Thread(target=refresh, daemon=True)
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()
