"""Language-model scoring with a probabilistic suffix tree over words.

The symbols are a text's tokens: its lower-cased words, then an end. A context is the
words before a token, back to the start of the text at most. It is a state if it is
frequent and its next-token distribution diverges from that of its longest shorter state;
distributions are smoothed towards that state; each token is scored by the longest suffix
of what stands before it that is a state. Contexts of 1, 2, 3, 4, 8, 16, ... words are
tried: no length bounds them, a context is followed until it is too rare or nothing
longer could diverge enough.

Neither the tree nor the vocabulary is broadcast. Documents are packed into bundles of
bounded size; a bundle asks the owners of its words for their counts and numbers, then
those of its (context, next token) grams for what the corpus has of them; each owner puts
together what all bundles say about its share of the contexts, and the answers go back to
the bundles: one round for each reach, for those tokens only whose context occurs often
enough, as the shorter gram before it has told. A context that occurs more often than ``HOT`` is dealt to several owners by its
next tokens; their sums are put together first.

An owner has a range of hashes, so what is sorted by hash is sorted by owner too. What a
bundle says to its owners is laid out once and then cut, and what an owner hears is put
together before it is looked at: a block costs a few slices, as there are as many blocks
as bundles times owners.
"""

from __future__ import annotations

import io
import math
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import batches, exists, folder_bytes, new_dir, remove, settle, small_batches

#: States need this many occurrences, and this gain in nats over their shorter state,
LEAST_COUNT, LEAST_GAIN = 2, 2.0
#: and this much more for each of their next tokens, as many diverge by chance.
TYPE_GAIN = 1.0
#: Occurrences of a context that one owner takes.
HOT = 4 << 20
#: Contexts grow by one word up to this reach, then double.
STEPS = 4

BUNDLE = pa.schema([("bundle", pa.int64()), ("payload", pa.binary())])
BLOCK = pa.schema([("owner", pa.int32()), ("bundle", pa.int64()), ("kind", pa.string()), ("payload", pa.binary())])
REPLY = pa.schema([("bundle", pa.int64()), ("kind", pa.string()), ("owner", pa.int32()), ("payload", pa.binary()), ("tokens", pa.int64()), ("distinct", pa.int64()), ("most", pa.int64())])
SCORE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SUMS = pa.schema([("context", pa.int64()), ("salts", pa.int32()), ("n", pa.int64()), ("types", pa.int64()), ("gain", pa.float64())])
#: Payloads are compressed already, and none is like another.
PLAIN = {"compression": "uncompressed", "parquet.enable.dictionary": "false"}
STATE = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"

#: Between texts: the end of each. A word is followed by a space.
END, GAP = 10, 32
#: A-Z lower-cased, white space as spaces.
SPELLING = bytes(GAP if c in b" \t\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))
BASE = 0x5851F42D4C957F2D
#: Keeps the numbers of words, and the begin's 0, from being hashes of little.
OFFSET = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a word's number.
X_BITS = 40


@dataclass(frozen=True)
class Limits:
    #: Training tokens, distinct ones and 1: what a word's count + 1 is a share of.
    floor: int = 1
    least_count: int = LEAST_COUNT
    least_gain: float = LEAST_GAIN
    hot: int = HOT


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that the model doesn't learn from; rows without id are learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def spelled(text: bytes | None) -> bytes:
    """The text with A-Z lower-cased and spaces for all white space."""
    return (text or b"").translate(SPELLING)


# --- bundles ---------------------------------------------------------------------------


def _pack(limit: int):
    def pack(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(each(parts), BUNDLE, size=1)

    def each(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
        ids, helds, bodies, size, n = [], [], [], 0, 0
        base = TaskContext.get().partitionId() << 32
        for b in parts:
            for doc, held, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                body = spelled(text)
                if ids and size + len(body) > limit:
                    yield base + n, _packed(ids, helds, bodies)
                    ids, helds, bodies, size, n = [], [], [], 0, n + 1
                ids.append(doc)
                helds.append(held)
                bodies.append(body)
                size += len(body) + 1
        if ids:
            yield base + n, _packed(ids, helds, bodies)

    return pack


def _packed(ids: list, helds: list, bodies: list[bytes]) -> bytes:
    """A bundle: its rows, the hashes of its distinct words, sorted, and its tokens as places among these."""
    none = np.zeros(len(ids))
    rows = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(helds, pa.bool_()), *(pa.array(none.astype(k)) for k in (np.int64, np.int64, float, float))], schema=SCORE)
    hashes, local, sizes = _words(bodies)
    return _closed(rows, {"hash": np.diff(hashes, prepend=np.uint64(0)), "at": local.astype("<u4"), "size": sizes})


def _unpacked(payload: bytes) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
    """A packed bundle's rows, the hashes of its words, its tokens and its texts' sizes."""
    rows, kept = _opened(payload)
    return rows, np.cumsum(kept["hash"], dtype=np.uint64), kept["at"].astype(np.int64), kept["size"]


def _sealed(rows: pa.RecordBatch) -> bytes:
    out = io.BytesIO()
    with pa.ipc.new_stream(out, rows.schema) as w:
        w.write_batch(rows)
    return out.getvalue()


def _squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _closed(rows: pa.RecordBatch, arrays: dict[str, np.ndarray]) -> bytes:
    """A bundle: its rows, and arrays over its texts and tokens."""
    parts = [_sealed(rows)]
    for name, a in arrays.items():
        raw = _planes(a)
        parts.append(struct.pack("<4s2sq", name.encode(), a.dtype.str[1:].encode(), len(raw)) + raw)
    return _squeezed(b"".join(struct.pack("<q", len(p)) + p for p in parts))


def _opened(payload: bytes) -> tuple[pa.RecordBatch, dict[str, np.ndarray]]:
    raw, at, parts = zstandard.ZstdDecompressor().decompress(payload), 0, []
    while at < len(raw):
        n = struct.unpack_from("<q", raw, at)[0]
        parts.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    with pa.ipc.open_stream(parts[0]) as r:
        rows = r.read_next_batch()
    arrays = {}
    for p in parts[1:]:
        name, kind, n = struct.unpack_from("<4s2sq", p)
        arrays[name.rstrip(b"\0").decode()] = _unplaned(np.frombuffer(p, np.uint8, n, 14), kind.decode())
    return rows, arrays


def _width(values: np.ndarray) -> int:
    """How many bytes the largest of the values has."""
    return (int(values.max(initial=0)).bit_length() + 7) // 8


def _planes(values: np.ndarray) -> bytes:
    """The values' bytes, those of one place together: they compress better so."""
    size = values.dtype.itemsize
    cells = np.ascontiguousarray(values).view(np.uint8).reshape(-1, size)
    # the higher bytes are mostly zeros: places that no value has are filled in without looking at them
    width = _width(values) if values.dtype.kind == "u" or values.dtype.kind == "i" and values.min(initial=0) >= 0 else size
    return b"".join([cells[:, k].tobytes() for k in range(width)] + [bytes(len(values) * (size - width))])


def _unplaned(raw: np.ndarray, kind: str) -> np.ndarray:
    planes = raw.reshape(np.dtype(kind).itemsize, -1)
    if len(planes) == 1:
        return planes[0].view(kind)
    out = np.zeros((planes.shape[1], len(planes)), np.uint8)
    for k, plane in enumerate(planes):
        if plane.any():
            out[:, k] = plane
    return out.view(kind).ravel()


def _blocks(columns: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[bytes]:
    """Cuts columns of unsigned integers into blocks: each comes with the blocks' edges in it."""
    widths = [_width(v) for v, _ in columns]
    planes = [[memoryview(np.ascontiguousarray(v.view(np.uint8).reshape(-1, v.dtype.itemsize)[:, k])) for k in range(w)] for (v, _), w in zip(columns, widths, strict=True)]
    edges = [e.tolist() for _, e in columns]
    head, wide, compress = struct.Struct(f"<{len(columns)}Q").pack, bytes(widths), zstandard.ZstdCompressor(level=1).compress
    for k in range(len(edges[0]) - 1):
        parts = [wide, head(*(e[k + 1] - e[k] for e in edges))]
        for e, column in zip(edges, planes, strict=True):
            a, b = e[k], e[k + 1]
            parts.extend([plane[a:b] for plane in column])
        yield compress(b"".join(parts))


def _joined(payloads: list[bytes], n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ``n`` columns of several blocks, one block after the other, and the edges of the blocks in each."""
    head, decompress = struct.Struct(f"<{n}Q"), zstandard.ZstdDecompressor().decompress
    planes, lengths = [[[] for _ in range(8)] for _ in range(n)], [[] for _ in range(n)]
    for payload in payloads:
        raw = memoryview(decompress(payload))
        at = n + head.size
        for c, size in enumerate(head.unpack_from(raw, n)):
            lengths[c].append(size)
            for k in range(raw[c]):
                planes[c][k].append((len(lengths[c]) - 1, raw[at : at + size]))
                at += size
    out = []
    for column, sizes in zip(planes, lengths, strict=True):
        edges = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        values = np.zeros((edges[-1], 8), np.uint8)
        for k, plane in enumerate(column):
            if len(plane) == len(sizes):
                values[:, k] = np.frombuffer(b"".join([part for _, part in plane]), np.uint8)
            else:
                for i, part in plane:
                    values[edges[i] : edges[i + 1], k] = part
        out.append((values.view("<u8").ravel(), edges))
    return out


def _steps(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Differences of sorted values, from 0 on in each block."""
    out = np.diff(values, prepend=np.uint64(0))
    out[edges[:-1]] = values[edges[:-1]]
    return out


def _summed(steps: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The values of ``_steps``."""
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(steps, dtype=np.uint64)))
        return sums[1:] - np.repeat(sums[edges[:-1]], np.diff(edges))


# --- what a bundle asks ----------------------------------------------------------------


def _words(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted hashes of the distinct tokens, all tokens as places among them (of every text its words and its end) and the texts' sizes."""
    data = b"".join([part for body in bodies for part in (body, b" \n")])
    raw = np.frombuffer(data, np.uint8)
    edges = np.concatenate(([0], np.flatnonzero((raw == GAP) | (raw == END)) + 1))
    ends = raw[edges[1:] - 1] == END
    sizes = np.diff(edges)
    real = ends | (sizes > 1)
    with np.errstate(over="ignore"):
        parts = _BYTES[raw] * _PLACES[(np.arange(len(raw)) - np.repeat(edges[:-1], sizes)).astype(np.uint8)]
        hashes = _mixed(np.add.reduceat(parts, edges[:-1]))
    for k in np.flatnonzero(sizes > len(_PLACES)).tolist():
        hashes[k] = xxhash.xxh3_64_intdigest(raw[edges[k] : edges[k + 1]])
    if not real.all():
        hashes, ends = hashes[real], ends[real]
    order, hashes, new = _sorted(hashes)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return hashes[new], place, np.diff(np.flatnonzero(ends), prepend=-1)


class Tokens:
    """A bundle's tokens in sequence, as places among its words' sorted numbers, and the sizes of its texts."""

    def __init__(self, ids: np.ndarray, numbers: np.ndarray, sizes: np.ndarray):
        self.ids, self.numbers, self.sizes = ids, numbers, sizes
        self.starts = np.cumsum(sizes) - sizes
        self.text = np.repeat(np.arange(len(sizes)), sizes)

    def contexts(self, pick: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the contexts of ``reach`` words before the tokens ``pick``, and which begin with the text's begin."""
        with np.errstate(over="ignore"):
            values = _mixed(np.append(self.numbers + np.uint64(1), np.uint64(0)) + OFFSET)
            data = np.insert(values[self.ids], self.starts, values[-1])
            text = self.text[pick]
            at, first = pick + text + 1, self.starts[text] + text
            since = np.maximum(at - reach, first)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * _powers(BASE, len(data)), dtype=np.uint64)))
            h = _mixed((sums[at] - sums[since]) * _powers(pow(BASE, -1, 1 << 64), len(data))[since])
        return h, since == first

    def before(self, flags: np.ndarray) -> np.ndarray:
        """For each token, ``flags`` of the token before it; 0 for the first of a text."""
        out = np.roll(flags, 1)
        out[self.starts] = 0
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


#: What a word's hash adds up: a factor of the byte times one of its place.
_BYTES, _PLACES = _mixed(np.arange(1, 257, dtype=np.uint64)), _mixed(np.arange(257, 513, dtype=np.uint64)) | np.uint64(1)
_power: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``; those of a bundle's usual size are kept."""
    if len(out := _power.get(base, _NONE)) < n:
        out = np.full(n, np.uint64(base))
        out[:1] = 1
        with np.errstate(over="ignore"):
            out = np.multiply.accumulate(out)
        if n <= 1 << 20:
            _power[base] = out
    return out[:n]


_NONE = np.zeros(0, np.uint64)


def _sorted(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of the hashes ``h`` in their order, the hashes in it, and which of these are the first of their kind.

    Plain values sort many times faster than places by their values: so what is sorted
    is the leading bits of ``h`` with the place below them.
    """
    bits = np.uint64(len(h).bit_length())
    mask = (np.uint64(1) << bits) - np.uint64(1)
    low = h.min()
    key = np.sort((h - low << np.uint64(64 - max(1, int(h.max() - low).bit_length()))) & ~mask | np.arange(len(h), dtype=np.uint64))
    order = (key & mask).astype(np.int64)
    h = h[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    if (new[1:] & (key[1:] >> bits == key[:-1] >> bits)).any():  # apart in the bits that are cut only
        again = np.argsort(h, kind="stable")
        order, h = order[again], h[again]
        new = np.concatenate(([True], h[1:] != h[:-1]))
    return order, h, new


def _ranked(h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the pairs (h, x), by h, then by x, and which of them are the first of their kind."""
    order, _, new = _sorted(h)
    bits = np.uint64(len(h).bit_length())
    number = np.cumsum(new, dtype=np.uint64)
    x = x[order].astype(np.uint64)
    x_bits = np.uint64(int(x.max()).bit_length())
    if (wide := int(number[-1]).bit_length() + int(x_bits)) + int(bits) <= 64:
        key = np.sort((number << x_bits | x) << bits | np.arange(len(x), dtype=np.uint64))
        order, key = order[(key & (np.uint64(1) << bits) - np.uint64(1)).astype(np.int64)], key >> bits
        return order, np.concatenate(([True], key[1:] != key[:-1]))
    inner = np.argsort(number << x_bits | x) if wide <= 64 else np.lexsort((x, number))
    number, x = number[inner], x[inner]
    return order[inner], np.concatenate(([True], (number[1:] != number[:-1]) | (x[1:] != x[:-1])))


def _distinct(h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct pair, sorted, and of each place the number of its pair."""
    order, new = _ranked(h, x)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    return order[new], where


class Asked:
    """The distinct grams of the tokens ``pick`` in the order in which they are asked for.

    That is by owner, context and next token; those of hot contexts come after all others.
    """

    def __init__(self, tokens: Tokens, pick: np.ndarray, reach: int, often: np.ndarray, owners: int, hot: int):
        context, self.whole = tokens.contexts(pick, reach)
        x = tokens.ids[pick]
        self.first, self.where = _distinct(context, x)
        self.context, self.x, self.salts = context[self.first], tokens.numbers[x[self.first]], 1 + often[pick[self.first]] // hot
        self.owner = _owners(self.context, owners)
        if (warm := self.salts > 1).any():
            self.owner[warm] = _context_owners(self.context[warm], self.x[warm] % self.salts[warm].astype(np.uint64), owners)
            order = np.lexsort((self.owner, warm))
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            self.owner, self.context, self.x, self.salts, self.first, self.where = self.owner[order], self.context[order], self.x[order], self.salts[order], self.first[order], back[self.where]
        changes = (self.owner[1:] != self.owner[:-1]) | ((self.salts[1:] > 1) != (self.salts[:-1] > 1))
        self.edges = np.flatnonzero(np.concatenate(([True], changes, [True])))
        self.heads = _heads(self.context, self.edges)

    def blocks(self, bundle: int, train: np.ndarray, q: np.ndarray) -> Iterator[tuple]:
        """A block for each owner, those of hot contexts apart; ``q`` is the probability of ``pick`` so far, or (integers) the counts of these words."""
        counts, q = np.bincount(self.where, weights=train, minlength=len(self.owner)).astype(np.uint64), q[self.first]
        at = np.searchsorted(self.heads, self.edges)
        columns = [(_steps(self.context[self.heads], at), at), (np.diff(np.append(self.heads, len(self.context))).view(np.uint64), at), (self.x, self.edges), (counts, self.edges), (q.astype(np.uint64) if q.dtype.kind == "i" else q.astype("<f4").view("<u4"), self.edges), (self.salts[self.heads].astype(np.uint64), at)]
        for a, payload in zip(self.edges[:-1].tolist(), _blocks(columns), strict=True):
            yield int(self.owner[a]), bundle, "h" if self.salts[a] > 1 else "g", payload


def _owners(keys: np.ndarray, owners: int) -> np.ndarray:
    """Each owner has a range of the hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int32)


def _context_owners(context: np.ndarray, salt: np.ndarray, owners: int) -> np.ndarray:
    """The owners of a hot context's shares."""
    with np.errstate(over="ignore"):
        return _owners(_mixed(context + salt * np.uint64(BASE)), owners)


def _heads(context: np.ndarray, edges: np.ndarray | None = None) -> np.ndarray:
    """Where the grams of each context start, in each of the blocks between ``edges``."""
    new = np.concatenate(([True], context[1:] != context[:-1]))
    if edges is not None:
        new[edges[:-1]] = True
    return np.flatnonzero(new)


def _ask_words(owners: int):
    def ask(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(each(parts), BLOCK, size=64)

    def each(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in parts:
            for bundle, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, hashes, ids, sizes = _unpacked(payload)
                counts = np.bincount(ids, weights=np.repeat(_learned(rows), sizes), minlength=len(hashes)).astype(np.uint64)
                owner = _owners(hashes, owners)
                edges = np.flatnonzero(np.diff(owner, prepend=-1, append=owners))
                for a, said in zip(edges[:-1].tolist(), _blocks([(_steps(hashes, edges), edges), (counts, edges)]), strict=True):
                    yield int(owner[a]), bundle, "w", said

    return ask


def _learned(rows: pa.RecordBatch) -> np.ndarray:
    return ~rows.column("held_out").to_numpy(zero_copy_only=False)


# --- what an owner answers -------------------------------------------------------------


def _by_owner(answers):
    """Gathers the blocks of one owner at a time for ``answers(owner, blocks by kind)``."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        current, blocks = None, {}
        for b in parts:
            for owner, bundle, kind, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if owner != current and current is not None:
                    yield from answers(current, blocks)
                    blocks = {}
                current = owner
                blocks.setdefault(kind, []).append((bundle, payload))
        if current is not None:
            yield from answers(current, blocks)

    return run


def _answer(owners: int, reach: int, limits: Limits):
    each = _by_owner(lambda owner, blocks: _answers(owner, blocks, owners, reach, limits))

    def answer(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(each(parts), REPLY, size=64)

    return answer


def _answers(owner: int, blocks: dict, owners: int, reach: int, limits: Limits) -> Iterator[tuple]:
    if held := blocks.get("w"):
        yield from _word_answers(owner, held, owners)
    for kind in "gh":
        if held := blocks.get(kind):
            grams, where, heads, at, edges = _merged([p for _, p in held], reach, limits.floor)
            sums = None
            if kind == "h":
                said = np.frombuffer(b"".join(p for _, p in blocks["a"]), "<u8,<i8,<i8,<f8")
                said = said[np.argsort(said["f0"])]
                sums = tuple(said[f][np.searchsorted(said["f0"], grams[0])] for f in ("f1", "f2", "f3"))
            n, types, state, follow = judged(*grams, limits, sums)
            heads = where[heads]
            columns = [(n[heads].astype(np.uint64), at), (types[heads].astype(np.uint64), at), ((state + 2 * follow)[heads].astype(np.uint8), at), (grams[2].astype(np.uint64)[where], edges)]
            for (bundle, _), payload in zip(held, _blocks(columns), strict=True):
                yield bundle, kind, owner, payload, 0, 0, 0


def _word_answers(owner: int, held: list[tuple[int, bytes]], owners: int) -> Iterator[tuple]:
    """The count of each word, and its number: the smaller, the more frequent."""
    (keys, edges), (counts, _) = _joined([payload for _, payload in held], 2)
    distinct, where = np.unique(_summed(keys, edges), return_inverse=True)
    total = np.bincount(where, weights=counts).astype(np.int64)
    number = np.empty(len(total), np.uint64)
    number[np.lexsort((distinct, -total))] = np.arange(len(total)) * owners + owner
    said = int(total.sum()), int((total > 0).sum()), int(total.max())
    for (bundle, _), payload in zip(held, _blocks([(total.astype(np.uint64)[where], edges), (number[where], edges)]), strict=True):
        yield bundle, "w", owner, payload, *said
        said = 0, 0, 0


def _merged(payloads: list[bytes], reach: int, floor: int) -> tuple:
    """The distinct grams (context, x, count, q, salts) of all blocks, where each block's are among them, where contexts start in the blocks, and the blocks' edges among these starts and among all grams.

    What is asked of single words has counts for q: probabilities over ``floor``.
    """
    (steps, at), (sizes, _), (x, edges), (counts, _), (q, _), (salts, _) = _joined(payloads, 6)
    sizes = sizes.astype(np.int64)
    context = np.repeat(_summed(steps, at), sizes)
    first, where = _distinct(context, x)
    q = (q[first].astype(np.int64) + 1) / floor if reach == 1 else q[first].astype("<u4").view("<f4").astype(np.float64)
    counts = np.bincount(where, weights=counts).astype(np.int64)
    return (context[first], x[first], counts, q, np.repeat(salts.astype(np.int64), sizes)[first]), where, np.cumsum(sizes) - sizes, at, edges


def _gains(counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(counts > 0, counts * np.log(counts / q), 0.0)


def smoothed(counts: np.ndarray, n: np.ndarray, types: np.ndarray, state: np.ndarray, q: np.ndarray) -> np.ndarray:
    """P(x|s) = (c(sx) + T q(x)) / (n + T) for states s of n occurrences and T distinct next tokens; else q."""
    return np.where(state, (counts + types * q) / np.maximum(n + types, 1), q)


def judged(context: np.ndarray, x: np.ndarray, counts: np.ndarray, q: np.ndarray, salts: np.ndarray, limits: Limits, sums: tuple | None = None) -> tuple[np.ndarray, ...]:
    """n, T, whether its context is a state, and whether longer contexts may be, for each of sorted, distinct grams.

    ``counts`` are training counts, 0 for grams only asked for; ``q`` is the probability by
    the shorter states. A context of n occurrences and T distinct next tokens is a state if
    n >= least_count and the divergence of its counts from q, times n, is at least
    least_gain + T TYPE_GAIN. ``sums`` has each gram's n, T and sum of c log(c / q) where
    others own a part of them.

    A longer context's counts are at most these, so its gain less what its types need is
    at most the sum over x of c(x) log(1 / p(x)) - TYPE_GAIN, where that is positive; and
    unless it occurs less often it is as much a state as this one.
    """
    starts = _heads(context)
    sizes = np.diff(np.append(starts, len(context)))
    if sums is None:
        sums = (np.repeat(np.add.reduceat(v, starts), sizes) for v in (counts, (counts > 0).astype(np.int64), _gains(counts, q)))
        known = True
    else:
        known = False
    n, types, gain = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = gain - np.where(n > 0, n * np.log(n), 0.0)
    state = (n >= limits.least_count) & (gain >= limits.least_gain + TYPE_GAIN * types)
    p = smoothed(counts, n, types, state, q)
    most = np.repeat(np.add.reduceat(np.maximum(0.0, -counts * np.log(p) - TYPE_GAIN), starts), sizes)
    return n, types, state, (n > limits.least_count) & ((most >= limits.least_gain) | (not known))


def _sum_hot(reach: int, limits: Limits):
    """What each owner of a share of hot contexts knows of them: occurrences, distinct next tokens and their gain."""

    def sums(_: int, blocks: dict) -> Iterator[tuple]:
        (context, _x, counts, q, salts), *_ = _merged([p for _, p in blocks["h"]], reach, limits.floor)
        starts = _heads(context)
        columns = (context[starts].astype(np.int64), salts[starts], np.add.reduceat(counts, starts), np.add.reduceat((counts > 0).astype(np.int64), starts), np.add.reduceat(_gains(counts, q), starts))
        yield from zip(*(c.tolist() for c in columns), strict=True)

    return lambda parts: batches(_by_owner(sums)(parts), SUMS)


def _deal_sums(owners: int):
    """Each hot context's sums for all owners of a share of it."""

    def each(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in parts:
            for context, salts, n, types, gain in zip(*(c.to_pylist() for c in b.columns), strict=True):
                context &= (1 << 64) - 1
                for owner in np.unique(_context_owners(np.uint64(context), np.arange(salts, dtype=np.uint64), owners)).tolist():
                    yield owner, 0, "a", struct.pack("<Qqqd", context, n, types, gain)

    def deal(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(each(parts), BLOCK, size=4096)

    return deal


# --- scores ----------------------------------------------------------------------------


def _advance(owners: int, reach: int, limits: Limits):
    """Take in a bundle's replies for ``reach`` words (0: the words themselves).

    Gives a bundle's scored rows ("d"), and its rows with tokens whose longer contexts
    are still to be seen ("z").
    """

    def advance(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(each(parts), BLOCK, size=8)

    def each(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        current, replies = None, {}
        for b in parts:
            for bundle, kind, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bundle != current:
                    current, replies = bundle, {}
                if kind != "z":
                    replies.setdefault(kind, []).append(payload)
                elif reach:
                    yield from _later(bundle, payload, replies, owners, reach, limits)
                else:
                    yield from _first(bundle, payload, replies["w"], limits)

    return advance


def _first(bundle: int, payload: bytes, replies: list[bytes], limits: Limits) -> Iterator[tuple]:
    rows, hashes, local, sizes = _unpacked(payload)
    (count, _), (number, _) = _joined(replies, 2)
    order = np.argsort(number)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    t, count = Tokens(place[local], number[order], sizes), count[order].astype(np.int64)
    known = np.add.reduceat((count > 0).astype(np.int64)[t.ids], t.starts)
    base = np.add.reduceat(np.log10(count + 1)[t.ids], t.starts) - sizes * math.log10(limits.floor)
    rows = pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(sizes), pa.array(known), pa.array(base), rows.column(5)], schema=SCORE)
    yield from _moved(bundle, rows, t, ((count + 1) / limits.floor)[t.ids], np.ones(len(local), bool), np.arange(len(local)), (count < limits.least_count)[t.ids], np.where(count >= limits.hot, count, 0)[t.ids], count)


def _later(bundle: int, payload: bytes, replies: dict[str, list[bytes]], owners: int, reach: int, limits: Limits) -> Iterator[tuple]:
    rows, kept = _opened(payload)
    t, pick, few, often, q = _kept(kept)
    asked = Asked(t, pick, reach, t.before(often), owners, limits.hot)
    q = q[asked.first]
    q = (q + 1) / limits.floor if q.dtype.kind == "i" else q.astype(np.float64)
    (n, _), (types, _), (flags, _), (counts, _) = _joined(replies.get("g", []) + replies.get("h", []), 4)
    counts, sizes = counts.astype(np.int64), np.diff(np.append(asked.heads, len(counts)))
    n, types, flags = (np.repeat(v.astype(np.int64), sizes) for v in (n, types, flags))
    p, follow = smoothed(counts, n, types, flags & 1 == 1, q), flags & 2 == 2
    few[pick] |= (counts < limits.least_count)[asked.where]
    often[pick] = np.where(counts >= limits.hot, counts, 0)[asked.where] if counts.max() >= limits.hot else 0
    yield from _moved(bundle, rows, t, p[asked.where], follow[asked.where] & ~asked.whole, pick, few, often)


def _moved(bundle: int, rows: pa.RecordBatch, t: Tokens, p: np.ndarray, follow: np.ndarray, pick: np.ndarray, few: np.ndarray, often: np.ndarray, counts: np.ndarray | None = None) -> Iterator[tuple]:
    """Adds up the tokens that are settled; the rest, with the texts they are in, goes on.

    ``few``: tokens whose gram so far is too rare to be a context of the token after.
    ``counts``: those of the words, which tell p in less room.
    """
    follow = follow & ~t.before(few)[pick]
    over = np.flatnonzero(~follow)
    score = rows.column("score").to_numpy() + np.bincount(t.text[pick[over]], weights=np.log10(p[over]), minlength=len(t.sizes))
    rows = rows.set_column(5, "score", pa.array(score))
    going = pick[follow]
    stays = np.zeros(len(t.sizes), bool)
    stays[t.text[going]] = True
    if not stays.all():
        yield 0, bundle, "d", _sealed(rows.filter(pa.array(~stays)))
    if stays.any():
        here = slice(None) if stays.all() else np.flatnonzero(stays[t.text])
        marks = np.zeros(len(t.ids), np.uint8)
        marks[going] = 1
        heavy, ids = np.flatnonzero(often[here]), t.ids[here]
        used = np.bincount(ids, minlength=len(t.numbers)) > 0
        arrays = {"size": t.sizes[stays], "id": (np.cumsum(used) - 1)[ids].astype("<u4"), "num": np.diff(t.numbers[used], prepend=np.uint64(0)), "mark": np.packbits(marks[here]), "few": np.packbits(few[here]), "at": heavy.astype("<i8"), "n": often[here][heavy].astype("<i8")}
        if counts is None:
            arrays["q"] = p[follow].astype("<f4")
        else:
            arrays["cnt"] = counts[used]
        yield 0, bundle, "z", _closed(rows.filter(pa.array(stays)), arrays)


def _kept(kept: dict[str, np.ndarray]) -> tuple[Tokens, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bundle's tokens, those still followed, which grams are too rare, counts of frequent ones, and what those followed have so far."""
    t = Tokens(kept["id"].astype(np.int64), np.cumsum(kept["num"], dtype=np.uint64), kept["size"])
    n = len(t.ids)
    pick, often = np.flatnonzero(np.unpackbits(kept["mark"], count=n)), np.zeros(n, np.int64)
    often[kept["at"]] = kept["n"]
    q = kept["q"] if "q" in kept else kept["cnt"][t.ids[pick]]
    return t, pick, np.unpackbits(kept["few"], count=n).astype(bool), often, q


def _ask(owners: int, reach: int, limits: Limits):
    """What a bundle's remaining tokens ask of contexts of ``reach`` words."""

    def ask(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(each(parts), BLOCK, size=64)

    def each(parts: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in parts:
            for bundle, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, kept = _opened(payload)
                t, pick, _, often, q = _kept(kept)
                yield from Asked(t, pick, reach, t.before(often), owners, limits.hot).blocks(bundle, _learned(rows)[t.text[pick]], q)

    return ask


def _unsealed(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        for payload in b.column(0).to_pylist():
            with pa.ipc.open_stream(payload) as r:
                yield from r


def score(docs: DataFrame, bundle_bytes: int = 4 << 20, least_count: int = LEAST_COUNT, least_gain: float = LEAST_GAIN, hot: int = HOT) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text), learning from those not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one word
    counts, log10) and score (the tree's log10 probability of the tokens; a word that no
    training text has gets what add-one counts give it). Null and empty texts are their
    end alone; texts of any length are scored whole; repeated rows count and score each;
    an empty table gives no rows; extra columns are dropped. Words and contexts are
    told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark, 256)
    packed, old = _written(docs.select("doc_id", held_out(F.col("doc_id")).alias("held"), "text").mapInArrow(_pack(bundle_bytes), "bundle long, payload binary"), "lm-bundles")
    small_batches(spark, 16)
    n = packed.select("bundle").count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    owners = most_owners = max(parts, -(-n // 4))
    tasks = most_tasks = max(1, min(n, max(4 * parts, n // 16)))
    block, reply = "owner int, bundle long, kind string, payload binary", "bundle long, kind string, owner int, payload binary, tokens long, distinct long, most long"

    def at_owners(blocks: DataFrame, owners: int) -> DataFrame:
        return blocks.repartitionById(owners, F.col("owner")).sortWithinPartitions("owner")

    replies, path = _written(at_owners(packed.mapInArrow(_ask_words(owners), block), owners).mapInArrow(_answer(owners, 0, Limits()), reply), "lm-replies")
    tokens, distinct, most = replies.agg(*(F.coalesce(f(c), F.lit(0)) for f, c in ((F.sum, "tokens"), (F.sum, "distinct"), (F.max, "most")))).first()
    limits = Limits(tokens + distinct + 1, least_count, least_gain, hot)
    texts, old, roots, reach = packed, [old, path], [], 0
    del packed
    while True:
        both = replies.select("bundle", "kind", "owner", "payload").unionByName(texts.select("bundle", F.lit("z").alias("kind"), F.lit(0).alias("owner"), "payload"))
        ordered = both.repartition(tasks, "bundle").sortWithinPartitions("bundle", "kind", "owner").select("bundle", "kind", "payload")
        moved = ordered.mapInArrow(_advance(owners, reach, limits), block)
        roots.append(new_dir(spark, "lm-moved"))
        moved.select("bundle", "kind", "payload").write.options(**PLAIN).partitionBy("kind").parquet(roots[-1])
        del both, ordered, moved, replies
        for folder in old:
            remove(spark, folder)
        settle(spark)
        old, reach = [f"{roots[-1]}/kind=z"], reach + 1 if reach < STEPS else 2 * reach
        if not exists(spark, old[0]):
            break
        texts = spark.read.schema("bundle long, payload binary").parquet(old[0])
        # Later rounds have little left: as many tasks and owners as that needs.
        left = folder_bytes(spark, old[0])
        owners, tasks = max(1, min(most_owners, left >> 20)), max(1, min(most_tasks, left >> 20))
        asked = texts.mapInArrow(_ask(owners, reach, limits), block)
        if most >= hot:
            sums = at_owners(asked.where("kind = 'h'"), owners).mapInArrow(_sum_hot(reach, limits), "context long, salts int, n long, types long, gain double")
            sums = sums.groupBy("context").agg(F.max("salts").alias("salts"), F.sum("n").alias("n"), F.sum("types").alias("types"), F.sum("gain").alias("gain"))
            asked = asked.unionByName(sums.mapInArrow(_deal_sums(owners), block))
        replies = at_owners(asked, owners).mapInArrow(_answer(owners, reach, limits), reply)
        if reach <= 3:  # the largest rounds: what was asked needn't be on disk beside what follows
            replies, path = _written(replies, "lm-replies")
            old.append(path)
            asked = None
            settle(spark)
    done = [f"{root}/kind=d" for root in roots]
    done = [folder for folder in done if exists(spark, folder)] or roots[:1]
    scored = spark.read.schema("payload binary").parquet(*done).mapInArrow(_unsealed, STATE)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def _written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written and read back, and the folder it lies in."""
    path = new_dir(df.sparkSession, name)
    df.write.options(**PLAIN).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
