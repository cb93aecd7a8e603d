"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two texts link when the Jaccard similarity of their word-shingle sets reaches a
threshold. Tokens (shingle hashes) are put in one global order: rare ones by hash, then
frequent ones by hash. A text's prefix is as long as any partner must reach into, plus
l - 1 tokens; a pair must then share min(l, l') prefix tokens. Each text takes the l that
its postings say is cheapest. Candidates are verified on the whole sets.

Texts that share rare prefix tokens only meet pair by pair. Those that share a frequent
one meet in groups, of which no pairs are made: see ``_grouped_links``. How many texts a
token may be in to be rare comes from the histogram of the postings.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import fresh, lean, materialise, scratch, settle, small_batches, stable_rows

SHINGLE = 4
PERCENT = 85
#: Prefixes are lengthened by up to LEVELS - 1 tokens.
LEVELS = 4
#: Pairs that rare tokens make, for each posting; a token in no more texts than LEAST_FREQUENT is rare anyway.
PAIRS, LEAST_FREQUENT = 0.25, 8
SALTS = 64
#: A set's outline has this many bits, one for each element's hash.
OUTLINE = 1024
#: So many tokens beyond the longest prefix are looked at, in case some are frequent.
SPARE = 16
#: A group's common tokens are those that one in COMMON of its texts has; so many of its texts share a task.
COMMON, SHARE = 8, 4096
#: A group of at most SHARE texts and LIGHT set elements is joined in the memory of one task;
LIGHT = 1 << 21
#: there, tokens in more texts than LOCAL at most are frequent, and rare ones make so many pairs for each posting.
LOCAL, LOCAL_PAIRS = 32, 4

SETS = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("outline", pa.binary()), ("head", pa.binary())])
WHOLE = pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("codes", pa.binary())])


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; a text of fewer words is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(size, len(words))
    with np.errstate(over="ignore"):
        code = np.full(len(h) - width + 1, np.uint64(width))
        for k in range(width):
            code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : len(h) - width + 1 + k]
        code = (code ^ (code >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        code ^= code >> np.uint64(29)
    return np.unique(code)


def least_overlap(n: int, percent: int = PERCENT) -> int:
    """A partner of a set of ``n`` shares at least so many."""
    return -(-percent * n // 100)


def prefix_length(n: int, level: int, percent: int = PERCENT) -> int:
    return min(n, n - least_overlap(n, percent) + level)


def _outline(codes: np.ndarray) -> bytes:
    bits = np.zeros(OUTLINE, bool)
    bits[(codes & np.uint64(OUTLINE - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _head_length(n: int, percent: int) -> int:
    return prefix_length(n, LEVELS + SPARE, percent)


def _sets(size: int, percent: int):
    """Of every text its set's size, digest, outline and least hashes: enough for the longest prefix, and some more."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for uid, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True):
                s = shingles(text, size)
                rows.append((uid, doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), _outline(s), s[: _head_length(len(s), percent)].tobytes()))
            yield from _batch(rows, SETS)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _codes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _tokens(wanted=None):
    """Rows of token, uid, i (its place in the set by hash), n and m (how many tokens of the text are given) for uid, n and sorted hashes.

    A bitmap ``wanted`` leaves out tokens it doesn't have.
    """

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            uids, ns = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int32)
            raw = b.column(2).to_pylist()
            sizes = np.array([len(v) // 8 for v in raw], np.int64)
            if not sizes.sum():
                continue
            token = _codes(b"".join(raw)).astype(np.int64)
            place = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
            text = np.repeat(np.arange(len(sizes)), sizes)
            if wanted is not None:
                have = wanted.value.has(token)
                token, place, text = token[have], place[have], text[have]
            for at in range(0, len(token), 200_000):
                part = slice(at, at + 200_000)
                t = text[part]
                yield pa.RecordBatch.from_arrays([pa.array(token[part]), pa.array(uids[t]), pa.array(place[part]), pa.array(ns[t]), pa.array(sizes[t].astype(np.int32))], names=["token", "uid", "i", "n", "m"])

    return run


class Bitmap:
    """Hashed keys, 16 bits for each if there is room: false positives only, about one in sixteen then."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = _slots(keys, len(self.words) * 64)
        return (self.words[at >> 6] >> (at & 63)) & 1 == 1


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(bits - 1)).astype(np.int64)


def _bitmap(keys: DataFrame, most_bits: int = 27):
    """A broadcast bitmap of a written column of integers, of up to 2 ** ``most_bits`` bits; None for more keys than those.

    With less than 16 bits for a key it lets more through, two of three at most.
    """
    n, name = keys.count(), keys.columns[0]
    if n > 1 << most_bits:
        return None
    bits = min(1 << most_bits, 1 << max(10, (16 * n - 1).bit_length()))

    def slots(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(bits // 64, np.int64)
        for b in parts:
            at = _slots(b.column(0).to_numpy(), bits)
            np.bitwise_or.at(words, at >> 6, np.int64(1) << (at & 63))
        found = np.flatnonzero(words)
        for at in range(0, len(found), 100_000):
            part = found[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(words[part])], names=["w", "b"])

    words = np.zeros(bits // 64, np.int64)
    for r in keys.select(F.col(name).cast("long")).mapInArrow(slots, "w int, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        words[r["w"]] = r["b"]
    return keys.sparkSession.sparkContext.broadcast(Bitmap(words))


TOKENS = "token long, uid long, i int, n int, m int"


def _by_salt(left: DataFrame, right: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, unique by ``key``, when ``left`` may hold a key very often.

    The key is salted, and ``right`` is repeated for those salts that ``left`` has.
    """
    salted = left.withColumn("__s", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    keys = salted.select(key, "__s").distinct()
    spread = keys.join(right, key)
    return salted.join(spread, [key, "__s"], how).drop("__s")


def _whole(texts: DataFrame, uids: DataFrame, size: int) -> DataFrame:
    """uid, n, codes: the whole sets of ``uids``, written; a bitmap thins ``texts`` (uid, text) out before the join."""
    uids = materialise(uids.select("uid").distinct(), "join-uids")
    wanted = _bitmap(uids)
    if wanted is not None:

        def thin(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in parts:
                yield b.filter(pa.array(wanted.value.has(b.column(0).to_numpy())))

        texts = texts.mapInArrow(thin, "uid long, text string")

    def cut(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for uid, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                s = shingles(text, size)
                rows.append((uid, len(s), s.tobytes()))
            yield from _batch(rows, WHOLE)

    return materialise(texts.join(uids, "uid", "left_semi").mapInArrow(lean(cut), "uid long, n long, codes binary"), "join-sets")


def _frequent(counts: DataFrame, postings: int) -> int:
    """The most texts that a rare token is in: all rare tokens' pairs are at most PAIRS for each posting."""
    bits = F.length(F.bin(F.col("df") - 1))  # k for 2 ** (k - 1) < df <= 2 ** k
    pairs, most = 0.0, LEAST_FREQUENT
    for r in counts.groupBy(bits.alias("k")).agg(F.sum(F.expr("df * (df - 1) / 2")).alias("pairs")).orderBy("k").collect():  # a row for each power of two
        pairs += r["pairs"]
        if pairs > PAIRS * postings:
            break
        most = max(most, 1 << r["k"])
    return most


def _candidate_prefixes(sets: DataFrame, copies: DataFrame, texts: DataFrame, size: int, percent: int) -> tuple[DataFrame, int]:
    """token, uid, rank, n, df: the longest prefixes (all levels) of texts, less tokens in one text only; and the most texts a rare token is in."""
    heads = sets.where("n > 0").join(copies, "uid", "left_anti").select("uid", "n", "head")
    counts = materialise(heads.mapInArrow(lean(_tokens()), TOKENS).groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "join-counts")
    settle(sets.sparkSession)
    most = _frequent(counts, heads.agg(F.coalesce(F.sum(F.length("head")), F.lit(0))).first()[0] // 8)
    tokens = heads.mapInArrow(lean(_tokens(_bitmap(counts.select("token")))), TOKENS)
    shared = tokens.join(counts, "token")
    grouped = shared.groupBy("uid").agg(
        F.first("n").alias("n"), F.first("m").alias("m"), F.sort_array(F.collect_list(F.struct("i", "token", (F.col("df") > most).alias("hot")))).alias("t")
    )
    reach = F.least(F.col("n"), F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + LEVELS)
    n_hot = F.size(F.filter("t", lambda x: x["hot"]))
    marked = materialise(grouped.withColumn("reach", reach).withColumn("short", (F.col("m") < F.col("n")) & (F.col("m") - n_hot < F.col("reach"))), "join-texts")
    settle(sets.sparkSession)
    # Enough rare tokens: the prefix is the rare tokens by hash. The ranks count rare tokens only.
    plain = marked.where("NOT short").mapInArrow(lean(_ranked), "token long, uid long, rank int, n int")
    # Else the order needs the whole set, and which of its tokens are frequent.
    whole = _whole(texts, marked.where("short").select("uid"), size)
    hot = materialise(counts.where(F.col("df") > most).select("token"), "join-hot")
    flagged = whole.mapInArrow(lean(_tokens(_bitmap(hot))), TOKENS).join(hot, "token", "left_semi").groupBy("uid").agg(F.collect_set("token").alias("hot"))
    full = whole.join(flagged, "uid", "left").select("uid", "n", "codes", "hot").mapInArrow(lean(_full_prefix(percent)), "token long, uid long, rank int, n int")
    prefixes = materialise(plain.unionByName(full), "join-prefixes")
    again = prefixes.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    return prefixes.join(again, "token"), most


def _ranked(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        rows = []
        for uid, n, t, m, reach in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("uid", "n", "t", "m", "reach")), strict=True):
            hot = sum(x["hot"] for x in t)
            before = 0
            for x in t:
                if x["hot"]:
                    before += 1
                elif x["i"] - before < reach:
                    rows.append((x["token"], uid, x["i"] - before, n))
            if m == n and m - hot < reach:  # all tokens are here: frequent ones follow
                rows += [(x["token"], uid, m - hot + k, n) for k, x in enumerate(x for x in t if x["hot"]) if m - hot + k < reach]
        yield _prefix_batch(rows)


def _prefix_batch(rows: list[tuple]) -> pa.RecordBatch:
    token, uid, rank, n = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(uid, pa.int64()), pa.array(rank, pa.int32()), pa.array(n, pa.int32())], names=["token", "uid", "rank", "n"])


def _full_prefix(percent: int):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for uid, n, raw, hot in zip(*(c.to_pylist() for c in b.columns), strict=True):
                token = _codes(raw).astype(np.int64)
                late = np.isin(token, np.array(hot or [], np.int64))
                order = np.concatenate((token[~late], token[late]))[: prefix_length(n, LEVELS, percent)]
                rows += [(int(t), uid, k, n) for k, t in enumerate(order)]
            yield _prefix_batch(rows)

    return run


def _levels(percent: int, most: int):
    """Choose each text's level and cut its prefix to it.

    Level l costs the postings of its prefix, and the verification of as many texts as
    can share l tokens of it: a l-th of the postings at most. A frequent token makes no
    pairs; it counts like a rare one in ``most`` texts.
    """

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for uid, n, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                best = None
                for level in range(1, LEVELS + 1):
                    p = prefix_length(n, level, percent)
                    postings = sum(min(x["df"], most) - 1 for x in t if x["rank"] < p)
                    cost = postings + postings / level * (4 + n / 100)
                    if best is None or cost < best[0]:
                        best = cost, level, p
                rows += [(x["token"], uid, x["rank"], n, x["df"], best[1]) for x in t if x["rank"] < best[2]]
            yield from _batch(rows, POSTED)

    return run


POSTED = pa.schema([("token", pa.int64()), ("uid", pa.int64()), ("rank", pa.int32()), ("n", pa.int32()), ("df", pa.int64()), ("level", pa.int32())])


def _compatible(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold.

    First by their outlines: each bit that only one has is an element that only one has,
    so sets whose outlines differ in too many bits can't link.
    """
    light = sets.select("uid", "n", "outline")
    drawn = pairs.join(light.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("outline").alias("ob")), "b")
    drawn = drawn.join(light.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("outline").alias("oa")), "a").select("a", "b", "na", "nb", "oa", "ob")

    def alike(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            oa, ob = (np.frombuffer(b"".join(p.column(k).to_pylist()), np.uint64).reshape(p.num_rows, -1) for k in (4, 5))
            apart = np.bitwise_count(oa ^ ob).sum(axis=1).astype(np.int64)
            keep = apart * (100 + percent) <= (100 - percent) * (p.column(2).to_numpy() + p.column(3).to_numpy())
            yield p.select([0, 1]).filter(pa.array(keep))

    pairs = materialise(drawn.mapInArrow(lean(alike), "a long, b long"), "join-pairs")
    picked = _whole(texts, pairs.select(F.col("a").alias("uid")).unionByName(pairs.select(F.col("b").alias("uid"))), size)
    return _near(pairs, picked, [], percent)


def _near(pairs: DataFrame, sets: DataFrame, within: list[str], percent: int) -> DataFrame:
    """The pairs (a, b, and the columns ``within`` of a group) whose sets (uid, n, codes) differ little enough to link, written.

    Two texts of n and n' shingles link when no more than (100 - percent) / (100 + percent)
    of n + n' are in one of them only. That number is the same for the sets themselves and
    for their differences from a third set; n and n' are those of the texts.
    """
    one = sets.select(*within, F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("codes").alias("sb"))
    two = sets.select(*within, F.col("uid").alias("a"), F.col("n").alias("na"), F.col("codes").alias("sa"))
    both = pairs.join(one, [*within, "b"]).join(two, [*within, "a"]).select("a", "b", "na", "nb", "sa", "sb")

    def verify(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            keep = []
            for na, nb, sa, sb in zip(*(p.column(k).to_pylist() for k in range(2, 6)), strict=True):
                x, y = _codes(sa), _codes(sb)
                apart = len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True))
                keep.append((100 + percent) * apart <= (100 - percent) * (na + nb))
            yield p.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.mapInArrow(lean(verify), "a long, b long"), "join-links")


def components(links: DataFrame) -> DataFrame:
    """uid, comp for every vertex of ``links`` (a, b): equal comp where a path connects.

    Each vertex is merged into the neighbour (or itself) of the least hash, drawn anew
    every round, and the graph is contracted, until no edge is left.
    """
    edges = materialise(links.where("a <> b").distinct(), "join-edges")
    label = edges.select(F.col("a").alias("uid")).union(edges.select("b")).distinct().withColumn("comp", F.col("uid"))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        luck = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        ends = edges.select(F.col("a").alias("x"), F.least(luck("a"), luck("b")).alias("to")).union(edges.select(F.col("b").alias("x"), F.least(luck("a"), luck("b")).alias("to")))
        move = materialise(ends.groupBy("x").agg(F.min("to")["v"].alias("y")), "join-moves")
        label = materialise(label.join(move, F.expr("comp = x"), "left").select("uid", F.coalesce("y", "comp").alias("comp")), "join-labels")
        a = edges.join(move.select(F.col("x").alias("a"), F.col("y").alias("ya")), "a")
        both = a.join(move.select(F.col("x").alias("b"), F.col("y").alias("yb")), "b")
        edges = materialise(both.where("ya <> yb").select(F.least("ya", "yb").alias("a"), F.greatest("ya", "yb").alias("b")).distinct(), "join-edges")
    return label


def _rare_pairs(posted: DataFrame, percent: int) -> DataFrame:
    """Pairs that share enough prefix tokens, all of them rare.

    The places of a shared token in both orders bound what a pair can share: no more
    tokens before it than the nearer place, and none after it than the shorter rest.
    """
    left = posted.select("token", F.col("uid").alias("u"), F.col("n").alias("nu"), F.col("rank").alias("ru"), F.col("level").alias("lu"))
    most = F.least("ru", "rank") + F.least(F.col("nu") - F.col("ru"), F.col("n") - F.col("rank"))
    enough = (100 + percent) * most >= percent * (F.col("nu") + F.col("n"))
    met = left.join(posted, "token").where((F.col("u") < F.col("uid")) & _compatible("nu", "n", percent) & enough)
    pairs = met.groupBy(F.col("u").alias("a"), F.col("uid").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("lu", "level")).alias("need"))
    return pairs.where("shared >= need").select("a", "b")


# --- texts that share frequent tokens --------------------------------------------------


def _first_groups(posted: DataFrame, percent: int) -> DataFrame:
    """cl, uid, n: every two texts of compatible sizes that share a token are in one group.

    A token's texts of two neighbouring size bands are a group; groups of a band whose
    tokens have the same text of least hash are one.
    """
    band = F.floor(F.log("n") / math.log(100 / (percent - 0.5)))
    at = posted.select("token", "uid", "n", F.explode(F.array(band, band + 1)).alias("band"))
    lead = at.groupBy("token", "band").agg(F.min(F.struct(F.xxhash64("uid").alias("h"), "uid")).alias("l"), F.count("*").alias("k")).where("k > 1")
    named = lead.select("token", "band", F.xxhash64("band", "l.uid").alias("cl"))
    return at.join(named, ["token", "band"]).select("cl", "uid", "n").distinct()


def _next_groups(hot: DataFrame, sizes: DataFrame) -> DataFrame:
    """cl, uid, n: the texts of each (cl, token) of ``hot`` are in one group of at most half as many as ``cl`` has.

    Tokens that the same texts of a group have give one group, and so do those whose
    texts have the same text of least hash, unless it would be too large.
    """
    told = hot.groupBy("cl", "token").agg(F.min(F.struct(F.xxhash64("uid").alias("h"), "uid"))["uid"].alias("lead"), F.expr("bit_xor(xxhash64(uid, 1))").alias("seal"))
    at = hot.join(told, ["cl", "token"]).select("cl", "uid", "n", "lead", "seal").distinct()
    unions = at.select("cl", "lead", "uid").distinct().groupBy("cl", "lead").agg(F.count("*").alias("u"))
    small = unions.join(sizes.select("cl", "k"), "cl").where(2 * F.col("u") <= F.col("k")).select("cl", "lead", F.lit(True).alias("one"))
    name = F.when(F.col("one"), F.xxhash64("cl", "lead", F.lit(1))).otherwise(F.xxhash64("cl", "seal", F.lit(2)))
    return at.join(small, ["cl", "lead"], "left").select(name.alias("cl"), "uid", "n").distinct()


def within(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all of ``sets`` (sorted, distinct) which link: what ``_grouped_links`` does, in memory."""
    size, label = np.array([len(s) for s in sets], np.int64), np.arange(len(sets))
    links: list[tuple[int, int]] = []
    todo = [np.arange(len(sets))]
    while todo:
        at = todo.pop()
        if len(at) < 2 or (label[at] == label[at[0]]).all():
            continue
        found, hot = _within_once([sets[i] for i in at], size[at], label[at], percent)
        for a, b in found:
            a, b = int(at[a]), int(at[b])
            if label[a] != label[b]:
                links.append((a, b))
                label[label == label[a]] = label[b]
        todo += [at[part] for part in hot]
    return links


def _within_once(sets: list[np.ndarray], n: np.ndarray, label: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """The links of a group that its hub and its rare differences show, and the texts that share a frequent difference."""
    k, up, down = len(sets), 100 + percent, 100 - percent
    distinct, token = np.unique(np.concatenate(sets), return_inverse=True)
    text, f = np.repeat(np.arange(k), n), np.bincount(token)
    middle = np.flatnonzero(2 * f > k)
    place = np.full(len(distinct), -1)
    place[middle] = np.arange(len(middle))
    inside = place[token] >= 0
    lacks = np.ones((k, len(middle)), bool)
    lacks[text[inside], place[token[inside]]] = False
    row, column = np.nonzero(lacks)
    text, token = np.concatenate((text[~inside], row)), np.concatenate((token[~inside], middle[column]))
    order = np.lexsort((token, np.minimum(f, k - f)[token], text))
    text, token, x = text[order], token[order], np.bincount(text, minlength=k)
    g = up * x - down * n
    hub = int(np.argmin(g))
    near, probe = g + g[hub] <= 0, g + g[hub] > 0
    near[hub] = False
    links = [(int(i), hub) for i in np.flatnonzero(near)]
    if not probe.any():
        return links, []
    label = label.copy()
    label[np.isin(label, label[near])] = label[hub]
    shared = np.maximum(np.maximum(1, -(-np.where(probe, g + g[hub], g - g[hub] + 1) // (2 * up))), x - down * n // percent)
    start = np.cumsum(x) - x
    first = np.arange(len(token)) - start[text] <= (x - shared)[text]
    who, what = text[first], token[first]
    order = np.lexsort((who, what))
    who, what = who[order], what[order]
    heads = np.flatnonzero(np.diff(what, prepend=-1))
    if not len(heads):
        return links, []
    df = np.diff(np.append(heads, len(what)))
    useful = (df > 1) & np.logical_or.reduceat(probe[who], heads)
    heads, df = heads[useful], df[useful]
    most = LOCAL
    while most > LEAST_FREQUENT and (df * (df - 1) // 2)[df <= most].sum() > LOCAL_PAIRS * len(what):
        most //= 2
    keys = [np.zeros(0, np.int64)]
    for d in np.unique(df[df <= most]).tolist():
        texts = who[heads[df == d][:, None] + np.arange(d)]
        i, j = np.triu_indices(d, 1)
        a, b = texts[:, i].ravel(), texts[:, j].ravel()
        fits = (probe[a] | probe[b]) & (label[a] != label[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (up * np.abs(x[a] - x[b]) <= down * (n[a] + n[b]))
        keys.append(np.unique(a[fits] * k + b[fits]))
    pairs = np.unique(np.concatenate(keys))
    mark, ends = np.zeros(len(distinct), bool), start + x
    left, at = np.unique(pairs // k, return_index=True)
    for a, lo, hi in zip(left.tolist(), at.tolist(), np.append(at, len(pairs))[1:].tolist(), strict=True):
        own = token[start[a] : ends[a]]
        mark[own] = True
        for b in (pairs[lo:hi] % k).tolist():
            both = int(mark[token[start[b] : ends[b]]].sum())
            if up * (x[a] + x[b] - 2 * both) <= down * (n[a] + n[b]):
                links.append((a, b))
        mark[own] = False
    frequent = zip(heads[df > most].tolist(), df[df > most].tolist(), strict=True)
    return links, _hot_groups([who[h : h + d] for h, d in frequent], k)


def _hot_groups(lists: list[np.ndarray], k: int) -> list[np.ndarray]:
    """``lists`` of texts, each once; those of the same first text are one group unless that has more than half of ``k``."""
    by_lead: dict[int, dict[bytes, np.ndarray]] = {}
    lead = np.random.default_rng(k).permutation(k)
    for texts in lists:
        by_lead.setdefault(int(lead[texts].min()), {})[texts.tobytes()] = texts
    out = []
    for found in by_lead.values():
        union = np.unique(np.concatenate(list(found.values())))
        out += [union] if 2 * len(union) <= k else list(found.values())
    return out


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _light_links(percent: int):
    """The links of groups whose rows (cl, uid, codes) come together."""

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, uids, sets = None, [], []
        for b in parts:
            rows: list[tuple] = []
            for cl, uid, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if cl != group:
                    rows += [(uids[i], uids[j]) for i, j in within(sets, percent)]
                    group, uids, sets = cl, [], []
                uids.append(uid)
                sets.append(_codes(raw))
            yield from _batch(rows, LINKS)
        yield from _batch([(uids[i], uids[j]) for i, j in within(sets, percent)], LINKS)

    return run


def _group_counts(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cl, token and how many sets of the batch have it."""
    for b in parts:
        cl, raw = b.column(0).to_numpy(), b.column(1).to_pylist()
        for c in np.unique(cl):
            token, f = np.unique(np.concatenate([_codes(raw[i]) for i in np.flatnonzero(cl == c)]), return_counts=True)
            for at in range(0, len(token), 200_000):
                part = token[at : at + 200_000].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), c)), pa.array(part), pa.array(f[at : at + 200_000].astype(np.int64))], names=["cl", "token", "f"])


DIFFERENT = pa.schema([("cl", pa.int64()), ("uid", pa.int64()), ("n", pa.int64()), ("x", pa.int64()), ("codes", pa.binary())])


def _differences(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set's difference from its group's middle, the tokens that more than half have; the rarer a difference in the group, the earlier it comes.

    Rows come by group; the group's common tokens (uid null) before its sets.
    """
    group, nothing = None, np.zeros(0, np.uint64)
    for b in parts:
        rows = []
        for cl, k, uid, n, raw, shared, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if cl != group:
                group, common, often, middle = cl, nothing, nothing, nothing
            if uid is None:
                common, often = np.array(shared, np.int64).astype(np.uint64), np.array(f, np.int64)
                order = np.argsort(common)
                common, often = common[order], often[order]
                middle = common[2 * often > k]
                often = np.minimum(often, k - often)
                continue
            x = np.setxor1d(_codes(raw), middle, assume_unique=True)
            at = np.minimum(np.searchsorted(common, x), max(0, len(common) - 1))
            rare = np.where(common[at] == x, often[at], 0) if len(common) else np.zeros(len(x), np.int64)
            rows.append((cl, uid, n, len(x), x[np.lexsort((x, rare))].tobytes()))
        yield from _batch(rows, DIFFERENT)


MET = pa.schema([("cl", pa.int64()), ("token", pa.int64()), ("uid", pa.int64()), ("n", pa.int64()), ("x", pa.int64()), ("probe", pa.bool_())])


def _difference_prefixes(percent: int):
    """The first differences of each text: two texts, one of which isn't linked with the hub, link only if they share one of those.

    With the slack g = (100 + percent) x - (100 - percent) n of a text of n shingles and x
    differences, two texts link if and only if they share (g + g') / 2 (100 + percent)
    differences. The hub has the least slack, h: texts with g + h <= 0 link with it, so of
    any other pair one has g > -h.
    """
    up, down = 100 + percent, 100 - percent

    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            rows = []
            for cl, uid, n, x, raw, g, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                probe = g + h > 0
                shared = max(1, -(-(g + h if probe else g - h + 1) // (2 * up)), x - down * n // percent)
                rows += [(cl, t, uid, n, x, probe) for t in _codes(raw)[: max(0, x - shared + 1)].astype(np.int64).tolist()]
            yield from _batch(rows, MET)

    return run


def _grouped_links(posted: DataFrame, texts: DataFrame, size: int, percent: int) -> list[DataFrame]:
    """Links (a, b) that connect all texts which link and share a token of ``posted`` (token, uid, n).

    The texts of a group are described by their differences from its middle, which are
    few where the texts are near copies. Two texts differ in x + x' less twice the
    differences they share, so those with fewest are linked with one text, the hub,
    without any comparison, and all others must share many differences with a partner:
    a prefix filter on differences, rare ones first, finds candidates. Texts that share
    a difference which is still frequent are a group again; as the middle is what most
    have, it is at most half as large, so this ends.

    A group that fits the memory of a task is dealt out once and joined there, with all
    groups inside it; only larger ones are taken apart with files between.
    """
    members = materialise(_first_groups(posted, percent), "join-members")
    if members.isEmpty():
        return []
    spark, links = posted.sparkSession, []
    whole = _whole(texts, members, size)
    while True:
        light = (F.count("*") <= SHARE) & (F.sum("n") <= LIGHT)
        sizes = materialise(members.groupBy("cl").agg(F.count("*").alias("k"), F.ceil(F.count("*") / SHARE).cast("int").alias("shares"), light.alias("light")).where("k > 1"), "join-sizes")
        dealt = members.join(sizes, "cl").select("cl", "k", "shares", "light", "uid").join(whole, "uid")
        ready = dealt.where("light").select("cl", "uid", "codes").repartition("cl").sortWithinPartitions("cl", "uid")
        links.append(materialise(ready.mapInArrow(lean(_light_links(percent)), "a long, b long"), "join-within"))
        settle(spark)
        sizes = sizes.where("NOT light").drop("light")
        if sizes.isEmpty():
            return links
        rows = materialise(dealt.where("NOT light").select("cl", "k", F.pmod(F.xxhash64("uid"), "shares").cast("int").alias("s"), "uid", "n", "codes"), "join-grouped")
        counts = rows.select("cl", "codes").mapInArrow(lean(_group_counts), "cl long, token long, f long").groupBy("cl", "token").agg(F.sum("f").alias("f"))
        common = counts.join(sizes, "cl").where((F.col("f") > 1) & (F.col("f") * COMMON >= F.col("k"))).groupBy("cl", "k", "shares").agg(F.collect_list("token").alias("common"), F.collect_list("f").alias("f"))
        heads = common.select("cl", "k", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("s"), F.lit(None).cast("long").alias("uid"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("binary").alias("codes"), "common", "f")
        both = rows.withColumn("common", F.lit(None).cast("array<long>")).withColumn("f", F.lit(None).cast("array<long>")).unionByName(heads)
        both = both.repartition("cl", "s").sortWithinPartitions("cl", "s", F.col("uid").asc_nulls_first())
        apart = materialise(both.select("cl", "k", "uid", "n", "codes", "common", "f").mapInArrow(lean(_differences), "cl long, uid long, n long, x long, codes binary"), "join-apart")
        slack = apart.withColumn("g", (100 + percent) * F.col("x") - (100 - percent) * F.col("n"))
        hubs = slack.groupBy("cl").agg(F.min(F.struct("g", "uid")).alias("hub"))
        slack = slack.join(hubs, "cl").withColumn("h", F.col("hub.g"))
        links.append(materialise(slack.where((F.col("g") + F.col("h") <= 0) & (F.col("uid") != F.col("hub.uid"))).select(F.col("uid").alias("a"), F.col("hub.uid").alias("b")), "join-hubs"))
        first = materialise(slack.select("cl", "uid", "n", "x", "codes", "g", "h").mapInArrow(lean(_difference_prefixes(percent)), "cl long, token long, uid long, n long, x long, probe boolean"), "join-differences")
        shared = materialise(first.groupBy("cl", "token").agg(F.count("*").alias("df"), F.max("probe").alias("probed")).where("df > 1 AND probed"), "join-shared")
        most = _frequent(shared, first.count())
        rare = first.join(shared.where(F.col("df") <= most).select("cl", "token"), ["cl", "token"])
        one = rare.where("probe").select("cl", "token", F.col("uid").alias("a"), F.col("n").alias("na"), F.col("x").alias("xa"))
        two = rare.select("cl", "token", F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("x").alias("xb"), "probe")
        fits = (100 + percent) * F.abs(F.col("xa") - F.col("xb")) <= (100 - percent) * (F.col("na") + F.col("nb"))
        pairs = one.join(two, ["cl", "token"]).where((F.col("a") != F.col("b")) & (~F.col("probe") | (F.col("a") < F.col("b"))) & _compatible("na", "nb", percent) & fits)
        pairs = materialise(pairs.select("cl", "a", "b").distinct(), "join-pairs")
        links.append(_near(pairs, apart, ["cl"], percent))
        settle(spark)
        hot = first.join(shared.where(F.col("df") > most).select("cl", "token"), ["cl", "token"])
        members = materialise(_next_groups(hot.select("cl", "token", "uid", "n"), sizes), "join-members")
        if members.isEmpty():
            return links


def link_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, row: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, row and comp for every row of ``docs`` (doc_id, text).

    ``row`` numbers the rows, all different and the same whenever ``docs`` is read;
    without it they get numbers of their own. comp is the number of one row of the
    component, never null: only components have it in common, while unrelated texts
    without id, or of one id, may share a component_id.

    Rows whose shingle sets are equal form one class; classes are joined. component_id is
    the smallest doc_id that links reach, the row's own included. Null, empty and blank
    texts have no shingles and link with nothing; rows without an id link, and their
    component is null if no row of it has one; repeated rows are one class; an empty
    table gives no rows; extra columns are dropped. Sets are compared by 64-bit hashes.
    """
    if row is None:
        docs, row = stable_rows(docs.select("doc_id", "text")), F.monotonically_increasing_id()
    with scratch(docs.sparkSession):
        return materialise(_linked(docs, size, percent, row), "join-rows")


def _linked(docs: DataFrame, size: int, percent: int, row: Column) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark, 256)
    texts = docs.select(row.alias("uid"), "text")
    sets = materialise(docs.select(row.alias("uid"), "doc_id", "text").mapInArrow(lean(_sets(size, percent)), "uid long, doc_id long, n long, sig binary, outline binary, head binary"), "join-all")
    members = sets.select("uid", "doc_id", "n", "sig")
    part = members.where("n > 0").groupBy("sig", F.pmod("uid", F.lit(SALTS)).alias("s")).agg(F.min("uid").alias("uid"), F.min("doc_id").alias("low_id"))
    classes = materialise(part.groupBy("sig").agg(F.min("uid").alias("rep"), F.min("low_id").alias("low_id"), F.collect_list("s").alias("salts")), "join-classes")
    keys = classes.select("sig", "rep", F.explode("salts").alias("s"))
    copies = materialise(members.withColumn("s", F.pmod("uid", F.lit(SALTS))).join(keys, ["sig", "s"]).where("uid <> rep").select("uid"), "join-copies")
    found, most = _candidate_prefixes(sets, copies, texts, size, percent)
    grouped = found.groupBy("uid").agg(F.first("n").alias("n"), F.collect_list(F.struct("token", "rank", "df")).alias("t"))
    posted = materialise(grouped.mapInArrow(lean(_levels(percent, most)), "token long, uid long, rank int, n int, df long, level int"), "join-postings")
    settle(spark)
    links = [_verified(_rare_pairs(posted.where(F.col("df") <= most), percent), sets, texts, size, percent)]
    links += _grouped_links(posted.where(F.col("df") > most), texts, size, percent)
    label = components(reduce(DataFrame.unionByName, links))
    settle(spark)
    ids = classes.select("sig", F.col("rep").alias("uid"), "low_id")
    ids = ids.join(label, "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))
    least = ids.groupBy("comp").agg(F.min("low_id").alias("component"))
    labelled = _by_salt(ids.select("sig", "comp", "uid"), least, "comp", F.col("uid")).select("sig", "comp", "component")
    rows = _by_salt(members.where("n > 0"), labelled, "sig", F.col("uid")).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("uid").alias("row"), "comp")
    alone = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("uid").alias("row"), F.col("uid").alias("comp"))
    return rows.unionByName(alone)


def report(docs: DataFrame) -> DataFrame:
    """The contract's columns of ``link_components``."""
    return link_components(docs).drop("row", "comp")


def keep_one(docs: DataFrame, **options: object) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the smallest doc_id.

    A component without any id keeps one row too. Texts without shingles all stay; of
    repeated rows with that id, one does.
    """
    docs = stable_rows(docs)
    row = fresh(docs, "row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    found = link_components(rows, row=F.col(row), **options)
    linked = found.where("n_shingles > 0").withColumn("key", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    part = linked.groupBy("comp", F.pmod("row", F.lit(SALTS)).alias("s")).agg(F.min("key").alias("key"))
    first = part.groupBy("comp").agg(F.min("key").alias("key"))
    keep = first.select(F.col("key.row").alias(row)).unionByName(found.where("n_shingles = 0").select(F.col("row").alias(row)))
    keep = materialise(keep, "join-kept")
    return rows.join(keep, row, "left_semi").drop(row)
