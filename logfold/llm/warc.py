"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; each bundle ends in a seek table (a
skippable frame that lists the frames' sizes and checksums); an index maps every record
to its bundle, its frame and its offset inside the frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.llm.common import batches, filesystem, materialise, new_dir, small_batches

# Fixed values of the seekable format: a skippable frame's magic, the footer's magic, the flag for checksums.
SKIPPABLE, FOOTER, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Equal payloads of fewer bytes are stored again.
LEAST_SHARED = 100
SALTS = 256
#: Record ids are version 5 UUIDs of a bundle's name and a running number.
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

INDEX = "page_id long, record_type string, refers_to long, bundle string, frame long, frame_offset long, frame_bytes long, record_offset long, record_bytes long"
INDEX_SCHEMA = pa.schema(
    [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bundle", pa.string())] + [(n, pa.int64()) for n in ("frame", "frame_offset", "frame_bytes", "record_offset", "record_bytes")]
)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str, name: str) -> bytes:
    """One WARC/1.1 record with an id of its own. A revisit has the headers of its response and no payload.

    A page_id may be null or occur twice, so pages are named by headers beside the id.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMES, name)}>", f"WARC-Date: {date}", f"X-Page-ID: {_said(page_id)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"X-Refers-To-Page: {_said(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _said(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def _page(said: str) -> int | None:
    return None if said == "none" else int(said)


@dataclass
class Parsed:
    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload: bytes | None
    payload_bytes: int
    payload_digest: str


def parse(data: bytes, at: int = 0) -> tuple[Parsed, int]:
    """The record that starts at ``at``, and where the next one starts; a response's digest is verified."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    size = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut off")
    said, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
    payload, length = None, int(head["X-Payload-Length"])
    if kind == "response":
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if hashlib.sha256(payload).hexdigest() != said or len(payload) != length:
            raise ValueError(f"the payload of {head['WARC-Record-ID']} differs from its digest")
    refers = _page(head["X-Refers-To-Page"]) if "X-Refers-To-Page" in head else None
    return Parsed(_page(head["X-Page-ID"]), head.get("WARC-Target-URI"), kind, refers, payload, length, said), end + 8 + size


@dataclass
class Bundle:
    """A bundle being written: frames go out as they fill, the seek table on close."""

    path: str
    level: int
    held: bytearray = field(default_factory=bytearray)
    frames: list[tuple[int, int, int]] = field(default_factory=list)
    offset: int = 0

    def __post_init__(self) -> None:
        fs, name = filesystem(self.path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        self.out = fs.open_output_stream(name, compression=None)

    def flush(self) -> tuple[int, int]:
        """End the frame; its offset and length in the bundle."""
        raw = bytes(self.held)
        packed = zstandard.ZstdCompressor(level=self.level).compress(raw)
        self.out.write(packed)
        at = self.offset
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.offset += len(packed)
        self.held.clear()
        return at, len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKED, FOOTER)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(data) -> list[tuple[int, int, int, int]]:
    """(offset, compressed bytes, bytes, checksum) of each frame, from an open random-access file."""
    end = data.size()
    data.seek(end - 9)
    count, flags, magic = struct.unpack("<IBI", data.read(9))
    if magic != FOOTER:
        raise ValueError("no seek table at the end")
    width = 12 if flags & CHECKED else 8
    data.seek(end - 9 - width * count)
    body, at, out = data.read(width * count), 0, []
    for i in range(count):
        packed, raw, check = struct.unpack_from("<III" if width == 12 else "<II", body, i * width) + (() if width == 12 else (0,))
        out.append((at, packed, raw, check))
        at += packed
    return out


def frame(data, entry: tuple[int, int, int, int]) -> bytes:
    at, packed, size, check = entry
    data.seek(at)
    raw = zstandard.ZstdDecompressor().decompress(data.read(packed), max_output_size=size)
    if len(raw) != size or (xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF) != check:
        raise ValueError(f"the frame at {at} is damaged")
    return raw


def assign(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, revisit and refers_to of every row of ``pages``.

    Of equal payloads of at least ``LEAST_SHARED`` bytes, the smallest page_id is the
    response (all its rows, if repeated; a null id is larger than any other). Groups are
    reduced and joined by (digest, salt), so a payload that a third of the pages share
    is spread over ``SALTS`` keys.
    """
    html = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    hashed = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes")).withColumn(
        "salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    )
    part = hashed.where(f"bytes >= {LEAST_SHARED}").groupBy("digest", "salt").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    groups = part.groupBy("digest").agg(F.min("least").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1")
    keys = groups.select(F.col("digest").alias("g_digest"), F.explode("salts").alias("g_salt"), "first", F.lit(True).alias("shared"))
    joined = hashed.join(keys, F.expr("digest = g_digest AND salt = g_salt"), "left")
    revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str | None = None, frame_bytes: int = 1 << 20, bundle_bytes: int = 64 << 20, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive every row of ``pages`` (page_id, url, html) under ``path``; returns the index.

    A null html is an empty payload; a null url leaves out the target; a record larger
    than a frame has one of its own; an empty table gives an empty index; extra columns
    are not archived. Every task attempt writes bundles under names of its own, and the
    index, committed by Spark, names those that count; the others are deleted.
    """
    spark = pages.sparkSession
    small_batches(spark)
    path = path or new_dir(spark, "warc")

    def archive(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        yield from batches(_archived(parts, f"{path}/{name}", frame_bytes, bundle_bytes, level, date), INDEX_SCHEMA)

    index = materialise(assign(pages).mapInArrow(archive, INDEX), "warc-index")
    _prune(spark, path, index)
    return index


def _archived(parts: Iterable[pa.RecordBatch], stem: str, frame_bytes: int, bundle_bytes: int, level: int, date: str) -> Iterator[tuple]:
    bundle, pending, made, count = None, [], 0, 0

    def flushed() -> list[tuple]:
        at, size = bundle.flush()
        rows = [(*key, bundle.path, len(bundle.frames) - 1, at, size, start, length) for key, start, length in pending]
        pending.clear()
        return rows

    for b in parts:
        columns = [c.cast(pa.binary()) if pa.types.is_string(c.type) and k == 2 else c for k, c in enumerate(b.columns)]
        for page, url, html, digest, revisit, refers in zip(*(c.to_pylist() for c in columns), strict=True):
            if bundle is None:
                bundle, made = Bundle(f"{stem}-{made:04d}.warc.zst", level), made + 1
            data = record(page, url, html or b"", digest, refers, revisit, date, f"{stem}-{count}")
            count += 1
            if bundle.held and len(bundle.held) + len(data) > frame_bytes:
                yield from flushed()
            pending.append(((page, "revisit" if revisit else "response", refers), len(bundle.held), len(data)))
            bundle.held += data
            if bundle.offset >= bundle_bytes:
                yield from flushed()
                bundle.close()
                bundle = None
    if bundle is not None:
        if pending:
            yield from flushed()
        bundle.close()


def _prune(spark: SparkSession, path: str, index: DataFrame) -> None:
    """Delete bundles that no committed index row names: failed or doubled attempts wrote them."""
    attempt = F.substring_index(F.substring_index("bundle", "/", -1), "-", 3)
    keep = {r["a"] for r in index.select(attempt.alias("a")).distinct().toLocalIterator()}  # one for each task
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatusIterator(where) if fs.exists(where) else None
    while found and found.hasNext():
        at = found.next().getPath()
        if at.getName().rpartition("-")[0] not in keep:
            fs.delete(at, False)


def read(index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names, frame by frame: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    return _bundles(index).mapInArrow(_reader(True), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _bundles(index: DataFrame) -> DataFrame:
    names = index.select("bundle").distinct()
    return names.repartition(max(1, min(names.count(), int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "bundle")


def _reader(payloads: bool):
    kind = [("page_id", pa.int64())] + [("url", pa.string()), ("payload", pa.binary())] * payloads + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(kind)

    def each(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in parts:
            for path in b.column(0).to_pylist():
                fs, name = filesystem(path)
                with fs.open_input_file(name) as data:
                    for entry in seek_table(data):
                        raw, at = frame(data, entry), 0
                        while at < len(raw):
                            r, at = parse(raw, at)
                            yield (r.page_id, *((r.url, r.payload) if payloads else ()), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)

    return lambda parts: batches(each(parts), schema)


def fetch(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The records of the pages in ``ids`` (page_id) alone: only their frames are read."""
    wanted = index.join(ids.select("page_id").distinct(), "page_id", "left_semi").select("bundle", "frame_offset", "frame_bytes", "record_offset")
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def each(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in parts:
            for path, at, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, name = filesystem(path)
                with fs.open_input_file(name) as data:
                    data.seek(at)
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(data.read(size))
                r, _ = parse(raw, start)
                yield r.page_id, r.record_type, r.refers_to, r.payload

    return wanted.mapInArrow(lambda parts: batches(each(parts), schema), "page_id long, record_type string, refers_to long, payload binary")


def digest(index: DataFrame) -> DataFrame:
    """The contract's columns, read back from the archives."""
    return _bundles(index).mapInArrow(_reader(False), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
