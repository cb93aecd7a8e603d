"""Mixing sources to target weights along a time-varying curriculum.

Each source's share of the words is filled up to a limit on repeats. Its weight
schedule over training time is integrated to the cumulative demand for words, the
demand is inverted at each document's place in its source's order, and documents are
range-sorted by the training position that results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logfold.llm.common import WORD, literal_array, materialise

WEIGHTS = (5.0, 2.0, 1.0)
#: A source's weight changes linearly over training, from (1 - slope) to (1 + slope) times its mean.
SLOPES = (0.6, 0.0, -0.6)


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, limit: float = 3.0) -> dict[str | None, float]:
    """Words to take of each source: shares of the total by weight, none over ``limit`` times its size.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn. What a
    limit cuts off is shared again by weight among the others until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, open_ = float(sum(sizes.values())), {}, list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > limit * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = limit * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def plan(docs: DataFrame, keep: tuple[str, ...] = (), partitions: int | None = None, **options: object) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): what the mix takes of it, and when.

    Returns doc_id, size (words; null texts have none), source_size, target (of its
    source), taken (words, repeats counted), copies (0 to ``limit``), positions (the
    copies' training positions, 0 to 1) and slots (the copies' places in the mix, gapless
    from 0 over all rows), besides the columns named in ``keep``. A source is passed
    through in an order drawn by a hash of id and text, again and again until its target
    is met; a copy is taken if its middle lies before the target. All copies are
    range-sorted by position, as in ``mixed``, and what a row has is gathered from there.
    The result depends on the rows alone: reruns agree. A null source is a source of its
    own; one without words has target 0 and no copies; repeated rows count each; an empty
    table gives no rows. Sums run over hashed buckets of a source, so a source may hold
    any share of the rows.
    """
    rows = materialise(_placed(docs, keep, **options), "mix-rows")
    copies = rows.where(F.size("positions") > 0).select(*ROW, "doc_id", F.explode("positions").alias("at"))
    n = _ranges(docs.sparkSession, partitions)
    held = dict(map(tuple, copies.groupBy(_range("at", n).alias("range")).count().collect()))  # a row for each range
    bases = [0]
    for k in range(n):
        bases.append(bases[-1] + held.get(k, 0))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in its range
    numbered = _range_sorted(copies, "at", ["doc_id", *ROW], n).select(*ROW, "at", (F.element_at(literal_array(bases, "bigint"), _range("at", n) + 1) + place).alias("slot"))
    mine = numbered.groupBy(*ROW).agg(F.sort_array(F.collect_list(F.struct("at", "slot"))).alias("mine"))
    out = rows.join(mine, [*ROW], "left")
    kept = [F.col(f"kept.{c}").alias(c) for c in keep if c not in ("doc_id",)]
    taken = F.when(F.col("mine").isNull(), 0).otherwise(F.size("mine"))
    each = lambda name, kind: F.coalesce(F.col(f"mine.{name}"), F.array().cast(f"array<{kind}>")).alias(name)
    return out.select("doc_id", "size", "source_size", "target", (taken * F.col("size")).alias("taken"), taken.alias("copies"), each("at", "double").alias("positions"), each("slot", "bigint").alias("slots"), *kept)


#: What tells the rows of a plan apart.
ROW = ("source", "bucket", "rank")


def _placed(docs: DataFrame, keep: tuple[str, ...] = (), weights: tuple[float, ...] = WEIGHTS, slopes: tuple[float, ...] = SLOPES, limit: int = 3, rows_per_bucket: int = 20_000, seed: int = 29) -> DataFrame:
    """The columns of ROW, kept (a struct), doc_id, size, source_size, target and positions of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        F.struct(*keep).alias("kept") if keep else F.lit(None).cast("string").alias("kept"),
        "doc_id",
        _key(F.col("source")).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64("doc_id", text, F.lit(seed)).alias("h"),
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    sizes = {r["source"][1:] if r["source"][0] == "=" else None: r["size"] for r in totals}
    buckets = max(64, -(-sum(r["rows"] for r in totals) // rows_per_bucket))
    keyed = sized.withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)).cast("int"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")).join(_target_rows(spark, sizes, weights, slopes, limit), "source")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rank = F.row_number().over(inside).alias("rank")
    placed = keyed.select("*", F.sum("size").over(inside).alias("upto"), rank).join(bases, ["source", "bucket"])
    middle = F.col("base") + F.col("upto") - F.col("size") / 2
    passes = lambda e: middle + e * F.col("source_size")
    copies = sum((F.when((F.col("target") > 0) & (passes(e) <= F.col("target")), 1).otherwise(0) for e in range(limit)), F.lit(0))
    out = placed.withColumn("copies", copies.cast("int")).withColumn(
        "positions",
        F.when(
            F.col("copies") > 0,
            F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: _invert(passes(e) / F.col("target"), F.col("slope"))),
        ).otherwise(F.array().cast("array<double>")),
    )
    return out.select(*ROW, "kept", "doc_id", "size", "source_size", "target", "positions")


def _ranges(spark: SparkSession, partitions: int | None) -> int:
    return partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))


def _range(at: str, n: int) -> Column:
    """Which of ``n`` equal ranges of the training time a position is in; copies are about evenly dense over it."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(F.col(at) * n))).cast("int")


def _range_sorted(copies: DataFrame, at: str, ties: list[str], n: int) -> DataFrame:
    """``copies`` by position: partition i holds range i, sorted."""
    return copies.repartitionById(n, _range(at, n)).sortWithinPartitions(at, *ties)


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("?"))


def _invert(share: Column, slope: Column) -> Column:
    """The time t at which share = t + slope * (t * t - t), the integral of 1 + slope * (2 t - 1)."""
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * share)
    return F.when(slope == 0, share).otherwise((root - (1 - slope)) / (2 * slope))


def _target_rows(spark: SparkSession, sizes: dict[str | None, int], weights: tuple[float, ...], slopes: tuple[float, ...], limit: float) -> DataFrame:
    goal = targets(sizes, weights, limit)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    rows = [("?" if s is None else f"={s}", int(sizes[s]), float(goal[s]), float(slopes[i % len(slopes)])) for i, s in enumerate(order)]
    kind = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("slope", T.DoubleType())])
    return spark.createDataFrame(rows, kind)


def mixed(docs: DataFrame, partitions: int | None = None, **options: object) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, in training order.

    Partition i holds the positions from i / n to (i + 1) / n, sorted; all columns of
    ``docs`` are kept, without more.
    """
    names, row = docs.columns, "__kept"
    rows = _placed(docs.select(F.struct(*names).alias(row), "doc_id", "text", "source"), (row,), **options)
    each = rows.where(F.size("positions") > 0).select(F.col(f"kept.{row}").alias(row), F.explode("positions").alias("__at"), *(F.col(c).alias(f"__{c}") for c in ROW))
    return _range_sorted(each, "__at", [f"{row}.doc_id", *(f"__{c}" for c in ROW)], _ranges(docs.sparkSession, partitions)).select(f"{row}.*")
