"""When to clean up, take a snapshot or stop: decisions of the engine's main loop."""

from __future__ import annotations

from dataclasses import dataclass

from logfold.config import Config

CLEANUP, SNAPSHOT, SLEEP = "cleanup", "snapshot", "sleep"


@dataclass
class Schedule:
    """Times are milliseconds since the epoch. An interval of 0 switches its action off."""

    config: Config
    started: int
    last_cleanup: int | None = None
    last_snapshot: int | None = None
    last_activity: int | None = None

    def saw_change(self, now: int) -> None:
        self.last_activity = now

    def after_message(self, shard: int, seq: int, now: int) -> list[str]:
        """Shard 1 asks for a snapshot at every so many messages."""
        every = self.config.snapshot_every
        if shard == 1 and every and seq % every == 0:
            self.last_snapshot = now
            return [SNAPSHOT]
        return []

    def due(self, now: int) -> list[str]:
        """What is to be done now; a sleep takes a snapshot first if snapshots are on."""
        out, c = [], self.config
        if c.cleanup_interval_ms and now - (self.started if self.last_cleanup is None else self.last_cleanup) >= c.cleanup_interval_ms:
            self.last_cleanup = now
            out.append(CLEANUP)
        if c.snapshots and c.snapshot_interval_ms and now - (self.started if self.last_snapshot is None else self.last_snapshot) >= c.snapshot_interval_ms:
            self.last_snapshot = now
            out.append(SNAPSHOT)
        if c.sleep_timeout_ms and now - (self.started if self.last_activity is None else self.last_activity) >= c.sleep_timeout_ms:
            out += [SNAPSHOT] * (c.snapshots and SNAPSHOT not in out) + [SLEEP]
        return out
