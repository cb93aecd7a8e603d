"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer maps words to classes (insult, threat, target, negation, reported
speech) with weights; insults are mined from labelled documents, the closed classes are
fixed. Target, negation and report transducers are composed over each clause, and the
composition emits weighted events for what it matched. A logistic model over a text's
events, not over its isolated words, gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logfold.llm.common import batches, bounded_labels, lean, materialise, small_batches

# The closed word classes.
TARGETS = "you your yours yourself they them he him she her u ur du dich dir ihr euch sie tu toi te vous ti usted ustedes vosotros ellos".split()
NEGATIONS = "not no never neither nor isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás tampoco".split()
REPORTS = "said says say told called calls wrote quoted claimed sagte sagt schrieb meinte nannte dit disait écrit appelle dijo dice escribió llamó".split()
THREATS = "kill hurt destroy murder stab shoot töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()

#: Letters, with apostrophes between them.
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[.,;:!?|()\"\n]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, BREAK = range(7)
EVENTS = ("insult", "insult_targeted", "insult_negated", "insult_reported", "threat", "threat_targeted", "threat_negated", "threat_reported")
STEMS = range(4, 8)
#: What a text is judged by: all insults, all threats, then each event by itself.
SHARED = 2
FEATURES = SHARED + len(EVENTS)


@dataclass(frozen=True)
class Transducer:
    """Deterministic: (state, class) gives the next state and a mark put on the class."""

    start: int
    arcs: dict[tuple[int, int], tuple[int, str]]

    def step(self, state: int, kind: int) -> tuple[int, str]:
        return self.arcs.get((state, kind), (max(0, state - 1), ""))


def _scope(opener: int, length: int, mark: str) -> Transducer:
    """Marks insults and threats within ``length`` words after ``opener``, inside the clause."""
    arcs: dict[tuple[int, int], tuple[int, str]] = {}
    for state in range(length + 1):
        arcs[state, opener] = (length, "")
        arcs[state, BREAK] = (0, "")
        if state:
            arcs[state, INSULT] = arcs[state, THREAT] = (state - 1, mark)
    return Transducer(0, arcs)


class Grammar:
    """The composition of the scope transducers, its states made as they are reached."""

    def __init__(self, negation: int = 3, report: int = 12, target: int = 6):
        self.parts = (_scope(NEGATION, negation, "negated"), _scope(REPORT, report, "reported"), _scope(TARGET, target, "targeted"))
        self.start = tuple(p.start for p in self.parts)
        self.made: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], int]] = {}

    def step(self, state: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
        """The next state, and the number of the event emitted or -1."""
        got = self.made.get((state, kind))
        if got is None:
            moves = [p.step(s, kind) for p, s in zip(self.parts, state, strict=True)]
            event = -1
            if kind in (INSULT, THREAT):
                name = "insult" if kind == INSULT else "threat"
                mark = next((m for _, m in moves if m), "")
                event = EVENTS.index(f"{name}_{mark}" if mark else name)
            got = self.made[state, kind] = (tuple(s for s, _ in moves), event)
        return got

    def events(self, classes: Iterable[tuple[int, float]]) -> list[float]:
        """Summed weights of the events along (class, weight) pairs."""
        out, state = [0.0] * len(EVENTS), self.start
        for kind, weight in classes:
            state, event = self.step(state, kind)
            if event >= 0:
                out[event] += weight
        return out


@dataclass
class Lexicon:
    """Words, and stems that longer words begin with, with their weights as insults."""

    words: dict[str, float]
    stems: dict[str, float]
    closed: dict[str, int] = field(default_factory=dict)
    seen: dict[str, tuple[int, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for kind, names in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):
            self.closed.update(dict.fromkeys(names, kind))

    def of(self, word: str) -> tuple[int, float]:
        got = self.seen.get(word)
        if got is None:
            weight = self.words.get(word, 0.0)
            for k in STEMS:
                if len(word) > k:
                    weight = max(weight, self.stems.get(word[:k], 0.0))
            kind = INSULT if weight else self.closed.get(word, OTHER)
            if len(self.seen) >= 200_000:
                self.seen.clear()
            got = self.seen[word] = (kind, weight or 1.0)
        return got


@dataclass
class Model:
    lexicon: Lexicon
    weights: list[float]
    bias: float
    grammar: Grammar = field(default_factory=Grammar)

    def features(self, text: str) -> list[float]:
        folded, of = text.lower(), self.lexicon.of
        if not any(of(w)[0] in (INSULT, THREAT) for w in set(WORD.findall(folded))):
            return [0.0] * FEATURES
        classes = (of(t) if t[0].isalpha() else (BREAK, 0.0) for t in TOKEN.findall(folded))
        events = self.grammar.events(classes)
        half = len(EVENTS) // 2
        return [math.log1p(v) for v in (sum(events[:half]), sum(events[half:]), *events)]

    def score(self, text: str) -> float:
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _texts(column: pa.Array) -> Iterator[str]:
    """The texts of a column; nulls are empty, bytes that are no UTF-8 are replaced."""
    for raw in column.cast(pa.binary()).to_pylist():
        yield (raw or b"").decode("utf-8", "replace")


def held_out(doc_id: F.Column) -> F.Column:
    """Rows from which no label is learned; rows without id have no label."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, bound: int = 25_000, lexicon_bound: int = 5_000) -> Model:
    """Learn the lexicon, then the event weights, from at most ``bound`` labelled rows.

    Only ids that are not held out are labelled here. A word or stem enters the lexicon
    if its documents have over twice the odds of being toxic that all have, and far more
    often are than chance allows, given how many are tried; of stems found in the same documents the longest stays.
    """
    small_batches(docs.sparkSession)
    marks = F.broadcast(bounded_labels(labels.where(~held_out(F.col("doc_id"))), "toxic", bound))
    known = materialise(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text").join(marks, "doc_id").select("text", "label"), "toxic-labelled")
    counted = known.mapInArrow(lean(_count), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = materialise(counted.where("toxic + clean >= 3"), "toxic-features")
    total = known.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    n_toxic, n_clean = total[0], total[1] - total[0]
    if not n_toxic or not n_clean:
        return Model(Lexicon({}, {}), PRIOR[:-1], PRIOR[-1])
    base = n_toxic / (n_toxic + n_clean)
    tried = max(1, counted.count())
    a, b = F.col("toxic"), F.col("clean")
    gain = 2 * (a * F.log(a / ((a + b) * base)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - base)))).otherwise(0.0))
    strong = counted.where(a > 0).withColumn("gain", gain).where((a * n_clean > 2 * b * n_toxic) & (F.col("gain") > 2 * math.log(tried) + 4))
    rows = strong.orderBy(F.desc("gain"), "feature").limit(lexicon_bound).collect()
    lexicon = _lexicon([(r["feature"], r["toxic"], r["clean"]) for r in rows], n_toxic, n_clean)
    model = Model(lexicon, [0.0] * FEATURES, 0.0)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def featured(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, out = shared.value, Counter()
        for p in parts:
            for text, label in zip(_texts(p.column(0)), p.column(1).to_pylist(), strict=True):
                out[tuple(round(v, 1) for v in m.features(text)), label] += 1
        kind = pa.schema([("x", pa.list_(pa.float64())), ("label", pa.int32()), ("n", pa.int64())])
        yield from batches(((list(x), y, n) for (x, y), n in out.items()), kind)

    data = known.mapInArrow(lean(featured), "x array<double>, label int, n long").groupBy("x", "label").agg(F.sum("n").alias("n")).orderBy("x", "label").collect()
    x, y, n = np.array([r["x"] for r in data], float), np.array([r["label"] for r in data], float), np.array([r["n"] for r in data], float)
    weights, bias = _logistic(x, y, n)
    return Model(lexicon, weights, bias)


def _count(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of words ("=word") and of stems that are not whole words, by label."""
    seen = (Counter(), Counter())
    for p in parts:
        for text, label in zip(_texts(p.column(0)), p.column(1).to_pylist(), strict=True):
            found = set(WORD.findall(text.lower()))
            seen[label > 0].update({"=" + w for w in found if len(w) <= 40} | {w[:k] for w in found for k in STEMS if len(w) > k})
    kind = pa.schema([("feature", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])
    yield from batches(((f, seen[1][f], seen[0][f]) for f in seen[0] | seen[1]), kind)


def _lexicon(rows: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> Lexicon:
    weight = {f: math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1)) for f, a, b in rows}
    count = {f: a for f, a, _ in rows}
    stems = {f: w for f, w in weight.items() if f[0] != "="}
    for f in sorted(stems, key=len):
        longer = [g for g in stems if len(g) == len(f) + 1 and g.startswith(f)]
        if any(count[g] >= 0.98 * count[f] for g in longer):
            del stems[f]
    words = {f[1:]: w for f, w in weight.items() if f[0] == "="}
    # a stem that one whole word accounts for is that word
    for f in [f for f in stems if any(w.startswith(f) and count["=" + w] >= 0.98 * count[f] for w in words)]:
        del stems[f]
    return Lexicon({w: max(0.1, v) for w, v in words.items()}, {f: max(0.1, v) for f, v in stems.items()})


#: Where the weights start from and are drawn to: two shared ones, those of single events, the bias.
PRIOR = [1.0] * SHARED + [0.0] * len(EVENTS) + [-2.0]
RIDGE = [0.02] * SHARED + [1.0] * len(EVENTS) + [0.02]


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[list[float], float]:
    """Weighted ridge logistic regression by Newton's method.

    The ridge is stronger for single events, so that an event which the labels don't show
    is judged by what all events of its kind have in common.
    """
    a = np.hstack([x, np.ones((len(x), 1))])
    prior, ridge = np.array(PRIOR), np.array(RIDGE)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (n * (p - y)) + ridge * (w - prior)
        hess = (a * (n * p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 5.0 / max(1e-9, float(np.abs(move).max())))
        if np.abs(move).max() < 1e-8:
            break
    return [float(v) for v in w[:-1]], float(w[-1])


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) for every row of ``docs``.

    Null and empty texts score as texts without events; long texts are read whole;
    repeated rows give repeated results; other columns are neither read nor returned.
    Without labels of both kinds the events keep their prior weights.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels))
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lean(_scorer(shared)), "doc_id long, held_out boolean, score double, predicted int")


def _scorer(shared):
    def run(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for p in parts:
            scores = [model.score(t) for t in _texts(p.column(2))]
            yield pa.RecordBatch.from_arrays(
                [p.column(0), p.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"]
            )

    return run


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is under ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    small_batches(docs.sparkSession)

    def civil(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for p in parts:
            texts = _texts(p.column(p.schema.get_field_index("text")))
            yield p.filter(pa.array([model.score(t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(lean(civil), docs.schema)
