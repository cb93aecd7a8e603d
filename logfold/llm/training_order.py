"""Token ids in training order.

Texts become token ids, cut into sequences; a keyed Feistel permutation with
cycle-walking gives sequence i of n the slot feistel(i, n); each range of slots is written
as one shard of fixed stride, so slot s is row s % rows_per_shard of shard
s // rows_per_shard, and a reader can resume anywhere. Where the order of the documents
matters, as after a curriculum, sequences are permuted inside blocks only.

Texts are tokenised twice, as how many sequences there are must be known before one is
placed: keeping the ids between the passes would cost as much disk as their shuffle.
"""

from __future__ import annotations

import base64
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logfold.llm.common import batches, filesystem, lean, materialise, new_dir, small_batches, stable_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's public pre-splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Patterns that find the same pieces without backtracking.
SAME = {PATTERN: r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"}

_loaded: dict[tuple[str, str], object] = {}


def encoding(vocabulary: str = VOCABULARY, pattern: str = PATTERN):
    """The tokenizer, loaded once in a process. The first id after its ranks ends a text."""
    if (vocabulary, pattern) not in _loaded:
        import tiktoken

        fs, name = filesystem(vocabulary)
        with fs.open_input_stream(name, compression=None) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f.read().splitlines() if line)}
        _loaded[vocabulary, pattern] = tiktoken.Encoding("file", pat_str=SAME.get(pattern, pattern), mergeable_ranks=ranks, special_tokens={})
    return _loaded[vocabulary, pattern]


def tokens(text: str | None, vocabulary: str = VOCABULARY) -> np.ndarray:
    """The ids of the whole text, then the end of text. Null and empty texts have the end only."""
    ids = _ids(text, vocabulary)
    ids.append(encoding(vocabulary).max_token_value + 1)
    return np.fromiter(ids, np.uint32, len(ids))


def _ids(text: str | None, vocabulary: str) -> list[int]:
    """The ids without the end; no text is special, so none is looked for."""
    return encoding(vocabulary).encode_ordinary((text or "").encode("utf-8", "replace").decode("utf-8"))


def feistel(n: np.ndarray, size: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 .. size - 1, applied to each of ``n``.

    Balanced Feistel rounds permute the smallest even number of bits that holds ``size``;
    what falls outside walks on along its cycle until it is inside.
    """
    half = max(1, ((max(size - 1, 1)).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = n.astype(np.uint64)
    walk = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(walk):
            left, right = out[walk] >> shift, out[walk] & mask
            for r in range(rounds):
                x = right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((x ^ (x >> np.uint64(31))) & mask)
            out[walk] = (left << shift) | right
            walk = walk[out[walk] >= np.uint64(size)]
    return out.astype(np.int64)


def slots(numbers: np.ndarray, total: int, key: int, block: int | None = None) -> np.ndarray:
    """The slot of each sequence number: permuted among all, or inside its block of ``block`` numbers."""
    if block is None:
        return feistel(numbers, total, key)
    out = np.empty(len(numbers), np.int64)
    for k in np.unique(numbers // block):
        at = np.flatnonzero(numbers // block == k)
        out[at] = k * block + feistel(numbers[at] - k * block, min(block, total - int(k) * block), key + int(k))
    return out


def materialise_order(docs: DataFrame, path: str | None = None, length: int = 512, rows_per_shard: int = 8192, key: int = 20240229, vocabulary: str = VOCABULARY, block: int | None = None) -> DataFrame:
    """Write every row of ``docs`` (doc_id, text) as sequences of ``length`` ids; returns the index.

    A document is tokenised whole, ended, and cut; its last sequence is padded with the
    id after the end's. Ids are two little-endian bytes each, or four where the
    vocabulary needs it. The index has doc_id, part (the sequence's place in its
    document), number (its place among all, in the order of the files and their rows),
    slot (gapless from 0), shard, file, byte_offset, n_tokens (without padding) and
    tokens_crc32 (of the row as stored). Each shard has ``rows_per_shard`` rows, the last
    one what is left. Null ids are kept; repeated rows are separate documents; an empty
    table gives an empty index; extra columns are ignored.

    The first pass counts the sequences of each file split, the second writes: with
    running numbers in the order of the splits the permutation needs no sort. The second
    checks each split against the first. Attempts write files of their own; the committed
    index names those that count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or new_dir(spark, "shards")
    base = stable_rows(docs)
    if base is not docs:
        base = materialise(docs.select("doc_id", "text"), "order-rows")
    rows = base.select("doc_id", F.col("text").cast("binary").alias("text"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    first, total = {}, 0
    for file, at, n, seal in sorted(map(tuple, rows.mapInArrow(lean(_counter(length, vocabulary)), "file string, at long, n long, seal long").collect())):  # a row for each file split
        first[file, at] = (total, n, seal)
        total += n
    enc = encoding(vocabulary)
    width = 2 if enc.max_token_value + 2 < 1 << 16 else 4
    shared = spark.sparkContext.broadcast(first)
    shards = -(-total // rows_per_shard)
    parts = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-shards // SHARDS_PER_TASK))
    cut = rows.mapInArrow(lean(_cutter(shared, total, length, width, key, vocabulary, block)), "doc_id long, part int, number long, slot long, n_tokens int, ids binary")
    placed = cut.withColumn("shard", F.floor(F.col("slot") / rows_per_shard).cast("int"))
    ordered = placed.repartitionById(parts, (F.col("shard") % parts).cast("int")).sortWithinPartitions("slot")
    pad = np.array([enc.max_token_value + 2], f"<u{width}").tobytes()
    return materialise(ordered.mapInArrow(_writer(path, length * width, pad), ", ".join(f"{f.name} {KINDS[f.type]}" for f in INDEX)), "order-index")


#: Shards of 8 MB that one task writes, where there are more than tasks.
SHARDS_PER_TASK = 16
KINDS = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
INDEX = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("slot", pa.int64()), ("shard", pa.int32()), ("file", pa.string()), ("byte_offset", pa.int64()), ("n_tokens", pa.int32()), ("tokens_crc32", pa.int64())]
)


def _sequences(n: int, length: int) -> int:
    return -(-n // length)


def _texts(b: pa.RecordBatch) -> Iterator[tuple]:
    """doc_id, text and the file split of each row; bytes that are no UTF-8 are replaced."""
    for doc, text, file, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
        yield doc, None if text is None else text.decode("utf-8", "replace"), (file, at)


def _seal(doc: int | None, n: int, seal: int) -> int:
    return zlib.crc32(b"%s:%d" % (str(doc).encode(), n), seal)


def _counter(length: int, vocabulary: str):
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("seal", pa.int64())])

    def count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, tuple[int, int]] = {}
        for b in parts:
            for doc, text, split in _texts(b):
                size = len(_ids(text, vocabulary)) + 1
                n, seal = found.get(split, (0, 0))
                found[split] = (n + _sequences(size, length), _seal(doc, size, seal))
        yield from batches([(*split, *v) for split, v in found.items()], schema)

    return count


def _cutter(shared, total: int, length: int, width: int, key: int, vocabulary: str, block: int | None):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("slot", pa.int64()), ("n_tokens", pa.int32()), ("ids", pa.binary())])

    def each(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        found: dict[tuple, tuple[int, int]] = {}
        for b in parts:
            held, at = [], []
            for doc, text, split in _texts(b):
                ids = tokens(text, vocabulary)
                done, seal = found.get(split, (0, 0))
                n = _sequences(len(ids), length)
                raw = ids.astype(f"<u{width}").tobytes()
                held += [(doc, i, raw[i * length * width : (i + 1) * length * width]) for i in range(n)]
                start = shared.value[split][0] + done
                at += range(start, start + n)
                found[split] = (done + n, _seal(doc, len(ids), seal))
            numbers = np.array(at, np.int64)
            for (doc, part, raw), number, slot in zip(held, at, slots(numbers, total, key, block).tolist(), strict=True):
                yield doc, part, number, slot, len(raw) // width, raw
        for split, done in found.items():
            if shared.value[split][1:] != done:
                raise RuntimeError(f"{split} has changed since it was counted")

    return lambda parts: batches(each(parts), schema)


def _writer(path: str, stride: int, pad: bytes):
    def each(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        out, current, name, at = None, None, "", 0
        for b in parts:
            columns = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "part", "number", "slot", "n_tokens", "ids", "shard"))
            for doc, part, number, slot, n, raw, shard in zip(*columns, strict=True):
                if shard != current:
                    if out:
                        out.close()
                    current, at, name = shard, 0, f"{path}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.bin"
                    fs, local = filesystem(name)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local, compression=None)
                row = raw + pad * ((stride - len(raw)) // len(pad))
                out.write(row)
                yield doc, part, number, slot, shard, name, at * stride, n, zlib.crc32(row)
                at += 1
        if out:
            out.close()

    return lambda parts: batches(each(parts), INDEX)


def read_slots(spark: SparkSession, index: DataFrame, length: int = 512, start: int = 0, vocabulary: str = VOCABULARY) -> DataFrame:
    """slot and ids (binary, padding included) from slot ``start`` on, each shard read in sequence."""
    enc = encoding(vocabulary)
    stride = length * (2 if enc.max_token_value + 2 < 1 << 16 else 4)
    small_batches(spark)
    files = index.where(F.col("slot") >= start).groupBy("shard", "file").agg(F.min("slot").alias("slot"), F.min("byte_offset").alias("at"))
    schema = pa.schema([("slot", pa.int64()), ("ids", pa.binary())])

    def each(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in parts:
            for _, file, slot, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, name = filesystem(file)
                with fs.open_input_file(name) as f:
                    f.seek(at)
                    while row := f.read(stride):
                        yield slot, row
                        slot += 1

    return files.mapInArrow(lambda parts: batches(each(parts), schema), "slot long, ids binary")


def report(docs: DataFrame, path: str | None = None, length: int = 512, rows_per_shard: int = 8192, key: int = 20240229, vocabulary: str = VOCABULARY, block: int | None = None) -> DataFrame:
    """The index, with the checksum of what the shards hold for each slot when read back.

    Index files hold their shards' rows in order, so each shard is read in sequence.
    """
    index = materialise_order(docs, path, length, rows_per_shard, key, vocabulary, block)
    stride = length * (2 if encoding(vocabulary).max_token_value + 2 < 1 << 16 else 4)
    schema = pa.schema([f for f in INDEX if f.name != "file"])

    def each(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        current, data = None, None
        for b in parts:
            for doc, part, number, slot, shard, file, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if file != current:
                    if data:
                        data.close()
                    fs, name = filesystem(file)
                    current, data = file, fs.open_input_file(name)
                if data.tell() != at:
                    data.seek(at)
                yield doc, part, number, slot, shard, at, n, zlib.crc32(data.read(stride))
        if data:
            data.close()

    return index.drop("tokens_crc32").mapInArrow(lambda parts: batches(each(parts), schema), ", ".join(f"{f.name} {KINDS[f.type]}" for f in schema))
