"""Versioned table state on a plain file system.

A version is a manifest: numbered, written whole, and never replaced. It names the Parquet
folders that make up the state, a base and what has changed since, and the positions that
were applied. Folders have names of their own for each attempt and are written before the
manifest, so a reader sees the old state or the new one, of two writers of one version one
fails without a trace, and a batch that is run again finds its positions applied.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.changes import DELETE, UPDATE
from logfold.operators.state import last_writer

#: Bytes of a snapshot's files.
FILE_BYTES = 128 << 20


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``, which all executors reach.

    Where that is unset, a local session gets a temporary folder (its executors are this
    machine); any other master must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/logfold"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


class Folder:
    """A folder on any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(""))] if self.fs.exists(self.at("")) else []

    def bytes(self, name: str = "") -> int:
        return self.fs.getContentSummary(self.at(name)).getLength()

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, said: str) -> bool:
        """Write a whole file under a name that nothing has; False if something has it.

        A rename that doesn't overwrite: atomic on HDFS; a hard link on local disks.
        Object stores need a conditional put instead.
        """
        self.fs.mkdirs(self.at(""))
        draft = f".{name}-{uuid.uuid4().hex}"
        if self.fs.getUri().getScheme() == "file":
            folder = unquote(urlparse(self.path).path) if self.path.startswith("file:") else self.path
            with open(f"{folder}/{draft}", "w", encoding="utf-8") as f:
                f.write(said)
            try:
                os.link(f"{folder}/{draft}", f"{folder}/{name}")
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{folder}/{draft}")
        out = self.fs.create(self.at(draft), True)
        out.write(bytearray(said.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at("").toUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.fs.makeQualified(self.at(draft)), self.fs.makeQualified(self.at(name)), never)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            self.delete(draft)
            return False


class Journal:
    """Numbered JSON entries in a folder: one writer gets each number."""

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names() if n.endswith(".json") and n[:-5].isdigit())

    def entry(self, number: int) -> dict:
        return json.loads(self.folder.text(f"{number}.json"))

    def last(self) -> tuple[int, dict]:
        numbers = self.numbers()
        return (numbers[-1], self.entry(numbers[-1])) if numbers else (0, {})

    def put(self, number: int, entry: dict) -> bool:
        return self.folder.put_new(f"{number}.json", json.dumps(entry))

    def forget(self, number: int) -> None:
        self.folder.delete(f"{number}.json")


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    positions: dict[int, int] = field(default_factory=dict)
    base: str | None = None
    deltas: tuple[str, ...] = ()
    key: tuple[str, ...] = ()

    def entry(self) -> dict:
        return {"positions": {str(k): v for k, v in sorted(self.positions.items())}, "base": self.base, "deltas": list(self.deltas), "key": list(self.key)}

    @staticmethod
    def of(version: int, x: dict) -> Manifest:
        return Manifest(version, {int(k): v for k, v in x["positions"].items()}, x["base"], tuple(x["deltas"]), tuple(x["key"])) if version else Manifest()


class Store:
    """The state of one table under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = Folder(spark, self.path)
        self.manifests = Journal(spark, f"{self.path}/_manifests")

    def manifest(self) -> Manifest:
        return Manifest.of(*self.manifests.last())

    def read(self, manifest: Manifest | None = None) -> DataFrame | None:
        """The current state, or None before the first commit: the base and, of each key, its last change since."""
        m = manifest or self.manifest()
        if not m.version:
            return None
        base = self.spark.read.parquet(f"{self.path}/{m.base}")
        if not m.deltas:
            return base
        parts = [base.withColumns({"type": F.lit(UPDATE), "__at": F.lit(0)})]
        parts += [self.spark.read.parquet(f"{self.path}/{d}").withColumn("__at", F.lit(i)) for i, d in enumerate(m.deltas, 1)]
        last = last_writer(reduce(DataFrame.unionByName, parts), m.key, "__at")
        return last.where(F.col("type") != DELETE).select(*base.columns)

    def commit(self, rows: DataFrame, positions: dict[int, int], expected: Manifest, exact: bool = False) -> Manifest:
        """Write ``rows`` as the next version; refuses if another writer has committed since ``expected``.

        Positions never go back, unless they are to be ``exact``: those of a restored state.
        """
        name = self._write(rows, expected.version + 1)
        return self._put(Manifest(expected.version + 1, positions if exact else _furthest(expected.positions, positions), name), expected, name)

    def append(self, changes: DataFrame, key: tuple[str, ...], positions: dict[int, int], expected: Manifest) -> Manifest:
        """Write the last change of each key (the columns of the state, and type) beside the state as the next version."""
        name = self._write(changes, expected.version + 1)
        return self._put(Manifest(expected.version + 1, _furthest(expected.positions, positions), expected.base, (*expected.deltas, name), key), expected, name)

    def _write(self, rows: DataFrame, version: int) -> str:
        name = f"v={version}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def _put(self, new: Manifest, expected: Manifest, name: str) -> Manifest:
        if self.manifest().version != expected.version or not self.manifests.put(new.version, new.entry()):
            self.folder.delete(name)
            raise RuntimeError(f"{self.path} was committed by another writer")
        return new

    def vacuum(self, keep: int = 2) -> list[int]:
        """Forget versions older than the last ``keep`` and delete what no other needs; the versions that are gone.

        Folders of versions still to come belong to writers that are at work, and stay.
        """
        numbers = self.manifests.numbers()
        now = numbers[-1] if numbers else 0
        old = [n for n in numbers if n <= now - keep]
        kept = [Manifest.of(n, self.manifests.entry(n)) for n in numbers if n not in old]
        needed = {f for m in kept for f in (m.base, *m.deltas)}
        for n in old:
            self.manifests.forget(n)
        for name in self.folder.names():
            if name.startswith("v=") and name not in needed and int(name[2:].split("-")[0]) <= now:
                self.folder.delete(name)
        return old

    def save_snapshot(self, to: str) -> str:
        """A compacted copy of the current state with its positions: one snapshot, the latest, at ``to``."""
        m = self.manifest()
        rows = self.read(m)
        if rows is None:
            raise ValueError(f"{self.path} has no state yet")
        size = sum(self.folder.bytes(f) for f in (m.base, *m.deltas))
        other = Store(self.spark, to)
        new = other.commit(rows.coalesce(max(1, -(-size // FILE_BYTES))), m.positions, other.manifest(), exact=True)
        other.vacuum(keep=1)
        return f"{to}/{new.base}"

    def restore_snapshot(self, source: str) -> Manifest:
        """Make the snapshot at ``source`` the current state, with its positions: the log is read again from there.

        A missing one changes nothing; one that is ahead of the state in no shard is refused.
        """
        other, now = Store(self.spark, source), self.manifest()
        m = other.manifest()
        if not m.version:
            return now
        if now.version and not any(p > now.positions.get(s, 0) for s, p in m.positions.items()):
            raise ValueError(f"the snapshot at {source} is older than {self.path}")
        return self.commit(other.read(m), m.positions, now, exact=True)


def _furthest(before: dict[int, int], after: dict[int, int]) -> dict[int, int]:
    return {**before, **{k: max(v, before.get(k, 0)) for k, v in after.items()}}


def content_digest(rows: DataFrame) -> tuple[int, int]:
    """Count and order-independent checksum of the rows, to compare a copy with its source."""
    r = rows.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*rows.columns)), F.lit(0))).first()
    return r[0], r[1]
