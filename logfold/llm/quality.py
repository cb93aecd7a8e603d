"""Quality rules and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into buckets. One multinomial is counted over
all documents, one over the trusted ones; a document's verdict is the mean log ratio
of its n-grams against a fixed threshold. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import SPACE, bounded_labels, held, literal_array, words

SYMBOLS = r"[^#*$%&|<>]+"


def measures(docs: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words.

    Null and empty texts have zeros and no words; a text of any length is taken whole;
    repeated rows give repeated results; extra columns are dropped.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    first = docs.select(
        "doc_id",
        words(F.col("text")).alias("w"),
        F.char_length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    ).select(
        "doc_id",
        "w",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    return _repeats(first)


def _repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words that 3-word windows found twice or more cover.

    Each window is one long: the high bits of its hash, then its position, in as few
    bits as the text needs. After a sort, repeated windows are neighbours; equal hashes
    are confirmed on the words. The positions found cover min(3, distance to the next).
    """
    n = F.size("w")
    mask = F.when(n >= 3, F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(n + F.lit(1))).cast("int")) - 1).otherwise(F.lit(0).cast("long"))
    w = F.col("w")
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    coded = df.withColumn("mask", mask).withColumn(
        "packed",
        F.when(
            n >= 3,
            F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: window(i).bitwiseAND(F.bitwise_not(F.col("mask"))).bitwiseOR(i.cast("long")))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    p, m = F.col("packed"), F.col("mask")
    high = lambda v: v.bitwiseAND(F.bitwise_not(m))
    low = lambda v: v.bitwiseAND(m).cast("int")
    same = lambda a, b: (high(a) == high(b)) & (F.get(w, low(a)) == F.get(w, low(b))) & (F.get(w, low(a) + 1) == F.get(w, low(b) + 1)) & (F.get(w, low(a) + 2) == F.get(w, low(b) + 2))
    twin = F.filter(p, lambda v, j: F.coalesce(same(v, F.get(p, j + 1)), F.lit(False)) | F.coalesce((j > 0) & same(v, F.get(p, j - 1)), F.lit(False)))
    found = coded.withColumn("at", F.sort_array(F.transform(twin, low)))
    at = F.col("at")
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size(at) - 1),
        F.lit(0).cast("long"),
        lambda s, j: s + F.least(F.lit(3), F.coalesce(F.get(at, j + 1) - F.get(at, j), F.lit(3))),
    )
    return found.withColumn("n_repeat_words", held(F.when(F.size(at) > 0, covered).otherwise(F.lit(0).cast("long")))).drop("mask", "packed", "at")


def _unigram(word: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _bigram(a: Column, b: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(a, b), F.lit(buckets)).cast("int") + buckets


def bucket_weights(docs: DataFrame, trusted: DataFrame, buckets: int, prior: float) -> list[float]:
    """log(target / raw) of each of the 2 * ``buckets`` buckets, unigrams then bigrams.

    ``trusted`` (doc_id) is bounded and broadcast. The raw counts cover all words of all
    documents; the target is smoothed by ``prior`` draws from the raw distribution.
    """
    marked = docs.select("doc_id", words(F.col("text")).alias("w")).join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("hit"))), "doc_id", "left")
    n = F.size("w")
    grams = F.concat(
        F.transform("w", lambda x: _unigram(x, buckets)),
        F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: _bigram(F.get(F.col("w"), i), F.get(F.col("w"), i + 1), buckets))).otherwise(F.array().cast("array<int>")),
    )
    counts = marked.select("hit", F.explode(grams).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.count("hit").alias("target"))
    raw, target = [0] * (2 * buckets), [0] * (2 * buckets)
    for r in counts.collect():
        raw[r["b"]], target[r["b"]] = r["raw"], r["target"]
    out = []
    for lo in (0, buckets):
        n_raw, n_target = sum(raw[lo : lo + buckets]), sum(target[lo : lo + buckets])
        for r, t in zip(raw[lo : lo + buckets], target[lo : lo + buckets], strict=True):
            p = (r + 1) / (n_raw + buckets)
            out.append(math.log((t + prior * p) / (n_target + prior) / p) if n_target else 0.0)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 14, prior: float = 20_000.0, threshold: float = -0.12, trusted_bound: int = 20_000, min_words: int = 50) -> DataFrame:
    """Base rules, score and verdict for every row of ``docs`` (doc_id, text).

    The trusted target is what ``labels`` marks with quality 1, at most ``trusted_bound``
    labelled ids; the raw corpus is all of ``docs``. ``score`` is the mean log ratio over
    the text's n-grams (0 without words). ``kept`` is false where a base rule failed
    (fewer than ``min_words`` words, or over half of them in repeated windows), else
    whether score >= ``threshold``. Without trusted documents every ratio is 0 and all
    that pass the base rules stay. Null ids keep their row and are never trusted.
    """
    trusted = bounded_labels(labels, "quality", trusted_bound).where("label = 1").select("doc_id")
    weights = literal_array(bucket_weights(docs, trusted, buckets, prior))
    w, n = F.col("w"), F.size("w")
    total = F.aggregate(w, F.lit(0.0), lambda s, x: s + F.get(weights, _unigram(x, buckets))) + F.when(
        n >= 2, F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(0.0), lambda s, i: s + F.get(weights, _bigram(F.get(w, i), F.get(w, i + 1), buckets)))
    ).otherwise(F.lit(0.0))
    scored = measures(docs).withColumn("score", total / F.greatest(2 * n - 1, F.lit(1)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("score") >= threshold)).alias("kept"),
        "score",
    )
