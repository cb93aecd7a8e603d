"""Sharding by sampled splitters.

Size-weighted samples of the record key are drawn, their quantiles become the
boundaries of many fine ranges, ranges that turn out overfull are subdivided, and
the ordered ranges are cut into shards of near equal bytes. DataFrame functions
only; the driver sees a sample and one total for each range of at most RANGE_ROWS rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logfold.llm.common import literal_array, materialise

MIN = -(1 << 63)
#: Rows of one range, so that no task sorts more than about this many.
RANGE_ROWS = 4 << 20


def shard_documents(docs: DataFrame, n_shards: int = 8, ranges_per_shard: int = 64, draws_per_range: int = 4, snap: float = 0.005, rounds: int = 4, seed: int = 17) -> DataFrame:
    """Assign every row of ``docs`` (doc_id, text) to one of ``n_shards`` shards.

    Law ``bytes``: the sizes (UTF-8 bytes of the text, none for null, plus 1) of the
    shards are near equal. The key is (hash of the text, doc_id, row), so equal texts
    are neighbours and stay in one shard, unless their group is larger than ``snap`` of
    a shard: such a group is cut wherever the sizes ask for it.

    Returns doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard)
    and grown_shard (null under this law). Null texts have size 1 and the checksum of
    no bytes; null ids sort first; repeated rows are separate records; an empty table
    gives no rows; extra columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = materialise(
        docs.select(
            F.col("doc_id"),
            F.xxhash64(text).alias("k"),
            F.coalesce(F.col("doc_id"), F.lit(MIN)).cast("long").alias("i"),
            F.monotonically_increasing_id().alias("t"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        ),
        "shard-keys",
    )
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    wanted = max(1, min(max(n_shards * ranges_per_shard, -(-n // RANGE_ROWS)), n))
    bounds = _quantiles(_draw(keyed, total, n, wanted * draws_per_range, seed), draws_per_range)
    for turn in range(rounds):
        ranged = keyed.withColumn("range", _range_of(bounds))
        sizes = {r["range"]: (r["bytes"], r["rows"]) for r in ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
        over = [r for r, (b, c) in sizes.items() if c > 1 and (b > 2 * total / wanted or c > 2 * n / wanted)]
        if not over or turn == rounds - 1:
            break
        more = _draw(ranged.where(F.col("range").isin(over)), total, n, 4 * wanted * draws_per_range, seed + turn + 1)
        bounds = sorted(set(bounds) | set(_quantiles(more, 2 * draws_per_range)))
    base_bytes, base_rows, b, c = [], [], 0, 0
    for r in range(len(bounds) + 1):
        base_bytes.append(b)
        base_rows.append(c)
        b, c = b + sizes.get(r, (0, 0))[0], c + sizes.get(r, (0, 0))[1]
    inside = Window.partitionBy("range").orderBy("k", "i", "t").rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy("range", "k")
    target = max(total, 1) / n_shards
    ranked = (
        ranged.withColumn("start", F.get(literal_array(base_bytes, "bigint"), F.col("range")) + F.sum("size").over(inside) - F.col("size"))
        .withColumn("at", F.get(literal_array(base_rows, "bigint"), F.col("range")) + F.count("*").over(inside) - 1)
        .withColumn("group_start", F.min("start").over(group))
        .withColumn("group_size", F.sum("size").over(group))
    )
    middle = F.when(F.col("group_size") <= snap * target, F.col("group_start") + F.col("group_size") / 2).otherwise(F.col("start") + F.col("size") / 2)
    placed = materialise(
        ranked.select("doc_id", "size", "text_crc32", "at", F.least(F.floor(middle / target), F.lit(n_shards - 1)).cast("int").alias("shard")), "shard-rows"
    )
    counts = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    first, firsts = 0, []
    for s in range(n_shards):
        firsts.append(first)
        first += counts.get(s, 0)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("at") - F.get(literal_array(firsts, "bigint"), F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _draw(keyed: DataFrame, total: int, n: int, draws: int, seed: int) -> list[tuple[tuple[int, int, int], int]]:
    """About ``draws`` keys in key order, each row drawn in proportion to its size.

    Half of the weight is the row's share of the bytes and half its share of the rows,
    so that a crowd of tiny records is divided as well.
    """
    if not n:
        return []
    weight = (F.col("size") / total + F.lit(1.0) / n) / 2 * draws
    luck = F.pmod(F.xxhash64("t", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    hits = keyed.select("k", "i", "t", F.floor(weight + luck).cast("int").alias("hits")).where("hits > 0")
    return sorted(((r["k"], r["i"], r["t"]), r["hits"]) for r in hits.collect())


def _quantiles(drawn: list[tuple[tuple[int, int, int], int]], every: int) -> list[tuple[int, int, int]]:
    """Each ``every``-th draw; a text with one boundary only is not cut by it."""
    seen, out = 0, []
    for key, hits in drawn:
        if (seen + hits) // every > seen // every:
            out.append(key)
        seen += hits
    return sorted({(k, MIN, MIN) if not i or out[i - 1][0] != k else (k, d, t) for i, (k, d, t) in enumerate(out)})


def _range_of(bounds: list[tuple[int, int, int]]) -> Column:
    """How many of the sorted boundaries are at most the row's key, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = len(bounds).bit_length()
    ks, ids, ts = (literal_array([b[j] for b in bounds], "bigint") for j in range(3))

    def step(low: Column, i: Column) -> Column:
        j = low + F.call_function("shiftright", F.lit(1 << (steps - 1)), i) - 1
        k, d, t = F.get(ks, j), F.get(ids, j), F.get(ts, j)
        at_most = (k < F.col("k")) | ((k == F.col("k")) & ((d < F.col("i")) | ((d == F.col("i")) & (t <= F.col("t")))))
        return F.when(F.coalesce(at_most, F.lit(False)), j + 1).otherwise(low)

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0), step)


def range_of(bounds: list[tuple[int, int, int]], key: tuple[int, int, int]) -> int:
    """The rule of ``_range_of`` in Python, for tests."""
    return bisect_right(bounds, key)
