"""Counters of published and pending changes, from observations and streaming progress."""

from __future__ import annotations

from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock, Thread

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from logfold.changes import PENDING, PUBLISHED


@dataclass
class Metrics:
    """Named counters and gauges, and durations in buckets of powers of two (milliseconds)."""

    values: dict[str, int] = field(default_factory=dict)
    durations: dict[str, dict[int, int]] = field(default_factory=dict)
    lock: Lock = field(default_factory=Lock)

    def add(self, name: str, n: int = 1) -> None:
        with self.lock:
            self.values[name] = self.values.get(name, 0) + n

    def put(self, name: str, n: int) -> None:
        with self.lock:
            self.values[name] = n

    def took(self, name: str, ms: float) -> None:
        with self.lock:
            buckets = self.durations.setdefault(name, {})
            bucket = max(0, int(ms)).bit_length()
            buckets[bucket] = buckets.get(bucket, 0) + 1


    def exposition(self, prefix: str = "logfold") -> str:
        """The text format that scrapers read: a line for each value, cumulative buckets for durations."""
        with self.lock:
            lines = [f"{prefix}_{name} {n}" for name, n in sorted(self.values.items())]
            for name, buckets in sorted(self.durations.items()):
                total = 0
                for bits, n in sorted(buckets.items()):
                    total += n
                    lines.append(f'{prefix}_{name}_ms_bucket{{le="{(1 << bits) - 1}"}} {total}')
                lines += [f'{prefix}_{name}_ms_bucket{{le="+Inf"}} {total}', f"{prefix}_{name}_ms_count {total}"]
        return "\n".join(lines) + "\n"


def serve(metrics: Metrics, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """Serve ``metrics`` at /metrics until ``shutdown()``; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            found = self.path.split("?")[0] == "/metrics"
            body = metrics.exposition().encode() if found else b"not found\n"
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", "text/plain; version=0.0.4")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    Thread(target=server.serve_forever, daemon=True).start()
    return server


def observed(log: DataFrame) -> tuple[DataFrame, Observation]:
    """``log`` with counts of its states on the side: they come with the action, without a pass of their own."""
    seen = Observation("changes")
    counts = (F.count_if(F.col("state") == PUBLISHED).alias("published"), F.count_if(F.col("state") == PENDING).alias("pending_publish"), F.count(F.lit(1)).alias("total"))
    return log.observe(seen, *counts), seen


class ProgressListener(StreamingQueryListener):
    """Feeds the batches of streaming queries into ``metrics``."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        self.metrics.add("queries_started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.metrics.add("scan_changes", p.numInputRows)
        self.metrics.took("batch", p.batchDuration)

    def onQueryIdle(self, event) -> None:
        self.metrics.add("idle")

    def onQueryTerminated(self, event) -> None:
        self.metrics.add("queries_ended")
