"""Benchmark decontamination by a broadcast hash set of test n-grams.

Texts are normalised to words of ASCII letters, digits and other scripts. Rolling
hashes of a document's 13-word windows are looked up in a bitmap of the benchmark's
windows; what passes is verified word by word. Hits lead to spans or documents removed.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import batches, fresh, lean, materialise, small_batches

WINDOW = 13
#: Lower-cases A-Z; every other ASCII byte that is no letter or digit becomes a space.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
FOLDED_WORD = re.compile(rb"[^ ]+")
PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of benchmark text in one broadcast; a worker's tables of it take about ten times as much.
BLOCK = 4 << 20


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` words, put together from windows of powers of two."""
    out, done, power, piece, step = None, 0, PRIME, h, 1
    with np.errstate(over="ignore"):
        while True:
            if width & step:
                part = piece[done : len(h) - width + done + 1]
                out = part.copy() if out is None else out * power + part
                done += step
            step *= 2
            if step > width:
                return out
            piece = piece[:-(step // 2)] * power + piece[step // 2 :]
            power = power * power


class Windows:
    """A block's windows by width: sorted hashes, where a window of each stands, and the items that have it.

    Only the items' normalised texts are sent; the tables, about 30 bytes a window, are
    made in the process that uses them, as hash() is not the same in all.
    """

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.ids = [item for item, _ in items]
        self.texts = [b" ".join(text.encode("utf-8", "surrogatepass").translate(FOLD).split()) for _, text in items]
        self.window = window
        self.tables: dict[int, tuple[np.ndarray, ...]] | None = None

    def ready(self) -> None:
        if self.tables is not None:
            return
        by = defaultdict(list)
        sizes, at = [np.zeros(1, np.int64)], 0
        for item, text in enumerate(self.texts):
            words = text.split()
            width = min(self.window, len(words))
            if width:
                codes = rolled(_hashes(words), width)
                by[width].append((codes, np.arange(at, at + len(codes)), np.full(len(codes), item, np.int32)))
                sizes.append(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                at += len(words)
        self.body, self.starts = b" ".join(t for t in self.texts if t), np.cumsum(np.concatenate(sizes))
        self.tables = {width: self._table(width, *(np.concatenate(c) for c in zip(*parts, strict=True))) for width, parts in sorted(by.items())}

    def _window(self, at: int, width: int) -> bytes:
        return self.body[self.starts[at] : self.starts[at + width] - 1]

    def _table(self, width: int, codes: np.ndarray, at: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((item, codes))
        codes, at, item = codes[order], at[order], item[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        group = np.repeat(first, np.diff(np.append(first, len(codes))))
        for k in np.flatnonzero(group != np.arange(len(codes))):  # windows of one hash are equal but for collisions, which become groups of their own
            if self._window(at[k], width) != self._window(at[group[k]], width):
                group[k] = next((g for g in range(group[k] + 1, k) if group[g] == g and self._window(at[g], width) == self._window(at[k], width)), k)
        order = np.lexsort((item, group))
        group, item = group[order], item[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (item[1:] != item[:-1])))
        group, item = group[new], item[new]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        keys = codes[group[first]]
        bits = max(10, int(16 * len(keys) - 1).bit_length())
        bitmap = np.zeros(1 << bits, bool)
        bitmap[(keys * MIX) >> np.uint64(64 - bits)] = True
        return bitmap, np.uint64(64 - bits), keys, at[group[first]], np.append(first, len(item)), item

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Which words lie in an occurrence of a window (None: none do), and the items that occur."""
        self.ready()
        mark, items = None, set()
        h = _hashes(words)
        with np.errstate(over="ignore"):
            for width, (bitmap, shift, keys, at, first, item) in self.tables.items():
                if width > len(words):
                    break
                codes = rolled(h, width)
                for j in np.flatnonzero(bitmap[(codes * MIX) >> shift]):
                    said = None
                    for k in range(np.searchsorted(keys, codes[j]), np.searchsorted(keys, codes[j], side="right")):
                        said = said or b" ".join(words[j : j + width])
                        if said == self._window(at[k], width):
                            if mark is None:
                                mark = np.zeros(len(words), bool)
                            mark[j : j + width] = True
                            items.update(item[first[k] : first[k + 1]].tolist())
        return mark, {self.ids[i] for i in items}


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The benchmark in blocks of at most ``limit`` bytes, or one item: the bound of each broadcast."""
    block, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text", F.octet_length("text").alias("size")).where("text IS NOT NULL")
    for r in rows.toLocalIterator():
        if block and held + r["size"] > limit:
            yield block
            block, held = [], 0
        block.append((r["item"], r["text"]))
        held += r["size"]
    if block:
        yield block


def _runs(mark: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mark.view(np.int8), [0]))))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def find(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hits (runs of hit words, start and end), items (sorted ids) for every row of ``docs``.

    An item of fewer than ``window`` words, but not none, is one window. Texts of any
    length are scanned whole. Null texts have no words; an item without words or text
    has no windows; items without an id hit words but are not listed; repeated rows give
    repeated results; extra columns are dropped. A benchmark of more than ``block_bytes``
    is broadcast block by block, each scanned against all documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shape = "doc_id long, n_words long, hits array<struct<start:long,end:long>>, items array<string>"
    blocks = _blocks(benchmark, block_bytes)
    first = next(blocks, [])
    second = next(blocks, None)
    if second is None:
        shared = spark.sparkContext.broadcast(Windows(first, window))
        return docs.select("doc_id", "text").mapInArrow(lean(_scanner(shared)), shape)
    rows = materialise(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), "decontam-rows")
    found = None
    while True:
        shared = spark.sparkContext.broadcast(Windows(first, window))
        part = materialise(rows.select("doc_id", "text", "row").mapInArrow(_scanner(shared, True), shape + ", row long"), "decontam-part")
        if found is None:
            found = part
        else:
            more = part.where("size(hits) > 0").select("row", F.col("hits").alias("h2"), F.col("items").alias("i2"))
            both = found.join(more, "row", "left")
            found = materialise(
                both.select(
                    "doc_id",
                    "n_words",
                    F.array_sort(F.concat("hits", F.coalesce("h2", F.expr("array()").cast("array<struct<start:long,end:long>>")))).alias("hits"),
                    F.array_sort(F.array_union("items", F.coalesce("i2", F.expr("array()").cast("array<string>")))).alias("items"),
                    "row",
                ),
                "decontam-found",
            )
        if second is None:
            return found.drop("row")
        first, second = second, next(blocks, None)


def _scanner(shared: Broadcast, rows: bool = False):
    kind = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]
    schema = pa.schema(kind + [("row", pa.int64())] * rows)

    def scan(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value

        def each() -> Iterator[tuple]:
            for b in parts:
                extra = [b.column(2).to_pylist()] if rows else []
                for doc, text, *row in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), *extra, strict=True):
                    words = (text or b"").translate(FOLD).split()
                    mark, items = windows.hits(words)
                    yield doc, len(words), [] if mark is None else _runs(mark), sorted(i for i in items if i is not None), *row

        yield from batches(each(), schema)

    return scan


def hit_words() -> F.Column:
    """The number of words in the union of ``hits``, which may overlap after several blocks."""
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["to"]))).cast("long").alias("n"), F.greatest(s["to"], x["end"]).cast("long").alias("to")
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate("hits", zero, step, lambda s: s["n"])


def report(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options: object) -> DataFrame:
    """The contract's digest: a document is contaminated if 1 in ``share`` of its words is hit."""
    out = find(docs, benchmark, **options).withColumn("n_hit", hit_words())
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "document", share: int = 20, window: int = WINDOW, limit: int = BLOCK) -> DataFrame:
    """``docs`` without contaminated documents, or (mode ``span``) without the hit words' spans.

    All columns of ``docs`` stay. A cut span runs from its first word's first byte to its
    last word's last one. A benchmark over ``limit`` bytes is taken in blocks; what they
    find in the unchanged texts is cut out together.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if mode not in ("document", "span"):
        raise ValueError(f"mode is document or span, not {mode}")
    blocks = _blocks(benchmark, limit)
    first, second = next(blocks, []), next(blocks, None)
    if second is not None:
        return _remove_in_blocks(docs, benchmark, mode, share, window, limit)
    return docs.mapInArrow(lean(_cutter(spark.sparkContext.broadcast(Windows(first, window)), mode, share)), docs.schema)


def _remove_in_blocks(docs: DataFrame, benchmark: DataFrame, mode: str, share: int, window: int, limit: int) -> DataFrame:
    row = fresh(docs, "row")
    rows = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "decontam-docs")
    numbered = rows.select(F.col(row).alias("doc_id"), "text")
    if mode == "document":
        bad = report(numbered, benchmark, share, block_bytes=limit, window=window).where("contaminated").select(F.col("doc_id").alias(row))
        return rows.join(bad, row, "left_anti").select(*docs.columns)
    hits = fresh(docs, "hits")
    found = find(numbered, benchmark, block_bytes=limit, window=window).where("size(hits) > 0").select(F.col("doc_id").alias(row), F.col("hits").alias(hits))
    both = rows.join(found, row, "left").select(*docs.columns, hits)

    def cut(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            at = b.schema.get_field_index("text")
            texts = b.column(at).cast(pa.binary()).to_pylist()
            for k, runs in enumerate(b.column(b.num_columns - 1).to_pylist()):
                if runs:
                    mark = np.zeros(max(r["end"] for r in runs), bool)
                    for r in runs:
                        mark[r["start"] : r["end"]] = True
                    texts[k] = _without(texts[k], mark)
            yield _with_texts(b.select(range(b.num_columns - 1)), at, texts)

    return both.mapInArrow(cut, docs.schema)


def _without(text: bytes, mark: np.ndarray) -> bytes:
    """``text`` without the spans of its marked words."""
    spans = [m.span() for m in FOLDED_WORD.finditer(text.translate(FOLD))]
    out, last = [], 0
    for run in _runs(mark):
        out.append(text[last : spans[run["start"]][0]])
        last = spans[run["end"] - 1][1]
    return b"".join(out) + text[last:]


def _with_texts(b: pa.RecordBatch, at: int, texts: list[bytes | None]) -> pa.RecordBatch:
    columns = list(b.columns)
    columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(columns, names=b.schema.names)


def _cutter(shared: Broadcast, mode: str, share: int):
    def cut(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for b in parts:
            at = b.schema.get_field_index("text")
            texts, stay, changed = b.column(at).cast(pa.binary()).to_pylist(), [], False
            for k, text in enumerate(texts):
                words = (text or b"").translate(FOLD).split()
                mark, _ = windows.hits(words)
                hit = 0 if mark is None else int(mark.sum())
                if mode == "document":
                    stay.append(not (hit and share * hit >= len(words)))
                elif hit:
                    texts[k], changed = _without(text, mark), True
            if mode == "document":
                b = b.filter(pa.array(stay, pa.bool_()))
            elif changed:
                b = _with_texts(b, at, texts)
            yield b

    return cut


def sha_of(items: Iterable[str]) -> str:
    """What ``items_sha256`` holds for these items, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
