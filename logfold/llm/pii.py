"""Personal data by weak supervision.

Patterns propose spans; regex, gazetteer, context, boundary and format labelers vote on
each; expectation-maximisation over the counts of vote patterns estimates how reliable
the labelers are; a logistic span classifier over the votes, the span's shape and the
words and characters around it is trained on the posteriors. Spans of the base patterns
stay, whatever the vote; proposals beyond them are added if the classifier accepts them.
DataFrame functions only: the driver sees at most 3 ** 5 vote patterns and FEATURES ** 2
sums for each kind.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import literal_array, materialise

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "boundary", "format")

# The base patterns, with possessive repeats so that long runs take linear time. A match
# starts where a run starts or where the last match ended, as a leftmost search would.
# A card's run is looked at from its start, and only if it can hold 14 digits.
LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){13})[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider proposals: written-out at signs, dots in brackets, digits in groups by other marks,
# and telephone numbers without a plus.
DOT = r"(?:\x20?[(\[{](?:\.|dot)[)\]}]\x20?)"
WIDE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++\x20?[(\[{{]at[)\]}}]\x20?[A-Za-z0-9-]++(?:(?:\.|{DOT})[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}{DOT}[0-9]{{1,3}}(?:\.|{DOT})[0-9]{{1,3}}(?:\.|{DOT})[0-9]{{1,3}}(?![0-9])",
    "card": r"(?<![0-9][./_]?)[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}(?![./_]?[0-9])",
    "phone": r"(?<![+0-9.-])(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|00[1-9][0-9]{0,2}(?:[\x20-][0-9]{2,5}){2,4})(?![0-9])",
}
# What the gazetteer and context labelers know.
TOP_DOMAINS = "com org net edu gov info io co de fr es eu uk us ch at it nl be ca au test example invalid local".split()
CUES = {
    "email": "mail|contact|write to|address|kontakt|schreib|courriel|écri|correo|escrib",
    "ip": "ip|host|server|address|login|addr|rechner|serveur|servidor",
    "card": "card|visa|credit|paid|pay|karte|kredit|carte|tarjeta|pago",
    "phone": "phone|tel|call|fax|mobile|cell|anruf|ruf|appel|llama|móvil",
}
COUNTER_CUES = {"email": "example|beispiel", "ip": "version|release|section|v\\.", "card": "isbn|order|invoice|serial|id", "phone": "isbn|order|invoice|serial|version"}


def _yes(test: Column, otherwise: Column | None = None) -> Column:
    return F.when(test, F.lit("+")).otherwise(F.lit("-") if otherwise is None else otherwise)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    digits, n = _digits(m), F.char_length(_digits(m))

    def add(s: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return s + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of the kind's base pattern is a base span."""
    n = F.char_length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda part: F.coalesce(F.when(part.rlike(r"^0*[0-9]{1,3}$"), F.right(part, F.lit(3)).cast("int")), F.lit(999)) <= 255)
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _plain(kind: str, m: Column) -> Column:
    """A wide proposal as the base pattern would have it."""
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(m, r"\x20?[(\[{]at[)\]}]\x20?", "@"), DOT, ".")
    if kind == "ip":
        return F.regexp_replace(m, DOT, ".")
    if kind == "card":
        return F.regexp_replace(m, "[./_]", "-")
    return F.concat(F.lit("+"), F.when(m.startswith("00"), F.substr(_digits(m), F.lit(3))).otherwise(F.concat(F.lit("1"), _digits(m))))


def _votes(kind: str, m: Column, before: Column, after: Column) -> Column:
    """A string of +, - and 0 (abstains), a letter for each labeler."""
    n, ahead = F.char_length(_digits(m)), F.lower(before)
    first = _digits(m)
    gazetteer = {
        "email": lambda: _yes(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS)),
        "ip": lambda: _yes(~m.rlike(r"^0*(0|127|2[2-9][0-9])\.")),
        "card": lambda: _yes(first.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)")),
        "phone": lambda: _yes(m.rlike(r"^\+?(1|[2-9][0-9]{0,2})?[\x20(.-]*[2-9]"), F.lit("0")),
    }[kind]()
    context = F.when(ahead.rlike(COUNTER_CUES[kind]), "-").when(ahead.rlike(CUES[kind]), "+").otherwise("0")
    boundary = _yes(~before.rlike(r"[\p{L}\p{N}_]$") & ~after.rlike(r"^[\p{L}\p{N}_]"))
    form = {
        "email": lambda: _yes(m.rlike("^[A-Za-z0-9]") & (F.char_length(m) <= 120)),
        "ip": lambda: _yes(~m.rlike(r"(^|\.)0[0-9]")),
        "card": lambda: _yes(n.isin(15, 16)),
        "phone": lambda: _yes(n.between(10, 12)),
    }[kind]()
    return F.concat(_yes(m.rlike(f"^(?:{BASE[kind]})$") & _valid(kind, m)), gazetteer, context, boundary, form)


#: Features of a span: three for each labeler's vote, then classes of its length, digits, neighbours and the word before.
LENGTHS, DIGITS, AROUND, WORDS = 4, 5, 4, 64
OFFSETS = [3 * len(LABELERS) + k for k in (0, LENGTHS, LENGTHS + DIGITS, LENGTHS + DIGITS + AROUND, LENGTHS + DIGITS + 2 * AROUND)]
FEATURES = OFFSETS[-1] + WORDS


def _around(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"^[\p{L}\p{N}_]"), 1).when(c.rlike(r"^\s"), 2).otherwise(3)


def _features(votes: Column, m: Column, before: Column, after: Column) -> Column:
    """The numbers of a span's features: one of each group."""
    n, digits = F.char_length(m), F.char_length(_digits(m))
    last = F.lower(F.regexp_extract(before, r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1))
    groups = [
        F.when(n <= 12, 0).when(n <= 16, 1).when(n <= 24, 2).otherwise(3),
        F.when(digits == 0, 0).when(digits <= 6, 1).when(digits <= 9, 2).when(digits <= 12, 3).otherwise(4),
        _around(F.right(before, F.lit(1))),
        _around(after),
        F.pmod(F.xxhash64(last), F.lit(WORDS)).cast("int"),
    ]
    by_vote = [F.instr(F.lit("+-0"), F.substr(votes, F.lit(j + 1), F.lit(1))) - 1 + 3 * j for j in range(len(LABELERS))]
    return F.array(*(v.cast("int") for v in by_vote), *((g + at).cast("int") for g, at in zip(groups, OFFSETS, strict=True)))


SPAN = "struct<start:int,kind:int,end:int,strict:boolean,votes:string,features:array<int>>"


def _places(m: Column, p: Column) -> Column:
    """Where each match starts: the lengths of the matches and of the pieces between them, added up.

    Appending copies an array, so as many starts as there are groups of them are put
    together for each group, then the groups: n matches take n to the 1.5 steps.
    """
    n = F.size(m)
    width = F.ceil(F.sqrt(n)).cast("int")
    step = lambda s, j: F.struct(
        (s["at"] + F.char_length(F.get(p, j)) + F.char_length(F.get(m, j))).alias("at"), F.array_append(s["out"], s["at"] + F.char_length(F.get(p, j))).alias("out")
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    inside = lambda g: F.aggregate(F.sequence(g * width, F.least(n, (g + 1) * width) - 1), zero, step)
    groups = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), inside)
    add = lambda s, g: F.struct((s["at"] + g["at"]).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))

    def moved(all_groups: Column) -> Column:
        bases = F.aggregate(all_groups, zero, add, lambda s: s["out"])
        return F.transform(F.array(bases), lambda b: F.flatten(F.transform(all_groups, lambda g, i: F.transform(g["out"], lambda x: x + F.get(b, i)))))[0]

    return F.transform(F.array(groups), moved)[0]


def _found(kind: str, wide: bool) -> Column:
    """The matches as an array of SPAN, in code points. Matches and the pieces between them come from the columns m and p."""
    tag = ("w_" if wide else "b_") + kind
    m, p = F.col(f"m_{tag}"), F.col(f"p_{tag}")

    def one(start: Column, j: Column) -> Column:
        it, before, after = F.get(m, j), F.right(F.get(p, j), F.lit(40)), F.substr(F.get(p, j + 1), F.lit(1), F.lit(1))
        plain = _plain(kind, it) if wide else it
        votes = _votes(kind, plain, before, after)
        strict = F.lit(False) if wide else _valid(kind, it)
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start + F.char_length(it)).alias("end"), strict.alias("strict"), votes.alias("votes"), _features(votes, plain, before, after).alias("features"))

    spans = F.transform(_places(m, p), one).cast(f"array<{SPAN}>")
    if not wide:
        spans = F.filter(spans, lambda s: s["strict"])
    return F.when(F.size(m) > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, base spans and wide proposals apart from them, for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tags = [(k, False) for k in KINDS] + [(k, True) for k in WIDE]
    worth = {"email": F.instr(text, "@") > 0, "phone": F.instr(text, "+") > 0, "ip": F.lit(True), "card": F.lit(True)}
    wide_worth = {"email": text.rlike(r"[(\[{]at[)\]}]"), "ip": text.rlike(r"[0-9]\x20?[(\[{]"), "card": text.rlike(r"[0-9]{4}[./_][0-9]{4}"), "phone": F.lit(True)}
    none = F.array().cast("array<string>")
    df = docs.select("doc_id", text.alias("text"))
    text = F.col("text")
    matched = df.select(
        "doc_id",
        "text",
        *(F.when((wide_worth if w else worth)[k], F.regexp_extract_all(text, F.lit((WIDE if w else BASE)[k]), F.lit(0))).otherwise(none).alias(f"m_{'w' if w else 'b'}_{k}") for k, w in tags),
    )
    pieces = matched.select(
        "*", *(F.when(F.size(f"m_{'w' if w else 'b'}_{k}") > 0, F.split(text, (WIDE if w else BASE)[k])).otherwise(none).alias(f"p_{'w' if w else 'b'}_{k}") for k, w in tags)
    )
    spans = pieces.select("doc_id", F.array_sort(F.concat(*(_found(k, False) for k in KINDS))).alias("base"), F.concat(*(_found(k, True) for k in WIDE)).alias("wide"))
    clear = F.when(F.size("wide") > 0, F.filter("wide", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))).otherwise(F.col("wide"))
    return spans.select("doc_id", "base", clear.alias("wide"))


@dataclass
class Reliability:
    """What EM has estimated: the share of true spans, and P(vote | class) of each labeler."""

    prior: float
    table: list[dict[tuple[str, int], float]]

    def posterior(self, votes: str) -> float:
        odds = math.log(self.prior) - math.log(1 - self.prior)
        for j, v in enumerate(votes):
            odds += math.log(self.table[j][v, 1]) - math.log(self.table[j][v, 0])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))


def estimate(counts: dict[str, int], rounds: int = 60) -> Reliability:
    """EM over counted vote patterns, started from the majority; smoothed by one vote each."""
    weight = {v: (1 + v.count("+")) / (2 + v.count("+") + v.count("-")) for v in counts}
    model = Reliability(0.5, [])
    for _ in range(rounds):
        total = sum(counts.values())
        true = sum(counts[v] * weight[v] for v in counts)
        table = []
        for j in range(len(LABELERS)):
            mass = {(vote, c): 1.0 for vote in "+-0" for c in (0, 1)}
            for v, n in counts.items():
                mass[v[j], 1] += n * weight[v]
                mass[v[j], 0] += n * (1 - weight[v])
            table.append({(vote, c): mass[vote, c] / sum(mass[u, c] for u in "+-0") for vote in "+-0" for c in (0, 1)})
        model = Reliability((true + 1) / (total + 2), table)
        weight = {v: model.posterior(v) for v in counts}
    return model


@dataclass
class Classifier:
    """A logistic span classifier: a bias for each kind, and a weight for each of its features."""

    bias: list[float]
    weights: list[float]

    def score(self, kind: Column, features: Column) -> Column:
        w = literal_array(self.weights)
        z = F.aggregate(features, F.get(literal_array(self.bias), kind), lambda s, i: s + F.get(w, kind * FEATURES + i))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))


def train(patterns: DataFrame, goals: dict[tuple[int, str], float], rounds: int = 6, ridge: float = 0.5) -> Classifier:
    """Fit the classifier to the EM posteriors ``goals`` of (kind, votes) by Newton's method.

    ``patterns`` (kind, votes, features, n) are the distinct spans; each round is one
    pass over them, which gives the gradient and the curvature of each pair of features.
    """
    spark, size = patterns.sparkSession, FEATURES + 1
    model = Classifier([0.0] * len(KINDS), [0.0] * (len(KINDS) * FEATURES))
    known = spark.createDataFrame([(k, v, g) for (k, v), g in goals.items()], "kind int, votes string, goal double")
    rows = materialise(patterns.join(F.broadcast(known), ["kind", "votes"]).select("kind", F.array_append("features", F.lit(FEATURES)).alias("on"), "features", "n", "goal"), "pii-patterns")
    for _ in range(rounds):
        p = rows.withColumn("p", model.score(F.col("kind"), F.col("features")))
        one = p.select("kind", "on", F.explode("on").alias("f"), (F.col("n") * (F.col("p") - F.col("goal"))).alias("miss"), (F.col("n") * F.col("p") * (1 - F.col("p"))).alias("bend"))
        sums = one.select("kind", "f", F.explode("on").alias("g"), "miss", "bend").groupBy("kind", "f", "g").agg(F.sum("miss").alias("miss"), F.sum("bend").alias("bend"))
        grad, bend = np.zeros((len(KINDS), size)), np.zeros((len(KINDS), size, size))
        for r in sums.collect():
            bend[r["kind"], r["f"], r["g"]] = r["bend"]
            if r["f"] == r["g"]:
                grad[r["kind"], r["f"]] = r["miss"]
        held = np.full(size, ridge)
        held[FEATURES] = ridge / 100
        weights = np.hstack((np.array(model.weights).reshape(len(KINDS), FEATURES), np.array(model.bias)[:, None]))
        for k in range(len(KINDS)):
            move = np.linalg.solve(bend[k] + np.diag(held), grad[k] + held * weights[k])
            weights[k] -= move * min(1.0, 5.0 / max(1e-9, np.abs(move).max()))
        model = Classifier(weights[:, FEATURES].tolist(), weights[:, :FEATURES].ravel().tolist())
    return model


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, base and added spans (start, kind, end) for every row of ``docs`` (doc_id, text).

    Positions are code points, the end exclusive. Null and empty texts have no spans;
    texts of any length are read whole; repeated rows give repeated results; an empty
    table gives no rows; extra columns are dropped. A proposal beyond the base patterns
    is added if it is one when written plainly and the classifier's score is at least
    ``threshold``.
    """
    rows = materialise(proposals(docs), "pii-spans")
    patterns = rows.select(F.explode(F.concat("base", "wide")).alias("s")).groupBy("s.kind", "s.votes", "s.features").agg(F.count("*").alias("n"))
    every = patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    goals = {}
    for k in range(len(KINDS)):
        if counts := {r["votes"]: r["n"] for r in every if r["kind"] == k}:
            model = estimate(counts)
            goals |= {(k, v): model.posterior(v) for v in counts}
    if not goals:
        return rows.select("doc_id", "base", F.col("wide").alias("added"))
    model = train(patterns, goals)
    added = F.filter("wide", lambda s: s["votes"].startswith("+") & (model.score(s["kind"], s["features"]) >= threshold))
    return rows.select("doc_id", "base", F.when(F.size("wide") > 0, added).otherwise(F.col("wide")).alias("added"))


def _joined(spans: Column) -> Column:
    names = F.split(F.lit(",".join(KINDS)), ",")
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``find``."""
    spans = find(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return spans.select(
        "doc_id",
        *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"),
    )
