"""Engine configuration: TOML over defaults."""

from __future__ import annotations

import socket
import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

from logfold.functions.hashing import fnv1_of


@dataclass(frozen=True)
class Config:
    """Defaults as documented; node_id 0 stands for the hash of the host's name."""

    node_id: int = 0
    publish: bool = True
    replicate: bool = True
    scan_max_changes: int = 512
    cleanup_interval_ms: int = 5000
    sleep_timeout_ms: int = 0
    polling_interval_ms: int = 0
    shards: int = 1
    max_entries: int = 1024
    replicas: int = 0
    compress: bool = True
    snapshot_interval_ms: int = 0
    snapshots: bool = True
    stream_prefix: str = "logfold"

    @property
    def node(self) -> int:
        return self.node_id or fnv1_of(socket.gethostname().encode())

    @property
    def snapshot_every(self) -> int:
        """Messages of shard 1 between snapshots; 0: never."""
        return self.max_entries // self.shards if self.snapshots else 0

    @property
    def log_replicas(self) -> int:
        """One more than half the shards unless set, and five at most."""
        return min(5, self.replicas if self.replicas > 0 else self.shards // 2 + 1)


#: Settings by the section of a file that they may stand in, under their name there.
SECTIONS = {
    "replication_log": {"shards": "shards", "max_entries": "max_entries", "replicas": "replicas", "compress": "compress", "update_existing": None},
    "snapshot": {"enabled": "snapshots", "interval": "snapshot_interval_ms", "interval_ms": "snapshot_interval_ms"},
    "stream": {"prefix": "stream_prefix"},
}


def load(path: str | Path | None = None) -> Config:
    """A TOML file's values over the defaults, flat or in sections.

    A missing file gives the defaults; an unknown key or section, or a value of another
    type, is an error.
    """
    if path is None or not Path(path).exists():
        return Config()
    said, flat = tomllib.loads(Path(path).read_text()), {}
    names, unknown = {f.name: type(f.default) for f in fields(Config)}, []
    for key, value in said.items():
        if isinstance(value, dict) and key in SECTIONS:
            for name, inner in value.items():
                if name not in SECTIONS[key]:
                    unknown.append(f"{key}.{name}")
                elif SECTIONS[key][name]:
                    flat[SECTIONS[key][name]] = inner
        elif key in names:
            flat[key] = value
        else:
            unknown.append(key)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    wrong = [k for k, v in flat.items() if type(v) is not names[k]]
    if wrong:
        raise ValueError(f"settings of another type: {', '.join(sorted(wrong))}")
    return replace(Config(), **flat)
