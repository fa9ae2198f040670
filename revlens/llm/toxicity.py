"""Toxicity by maximum-scoring segments.

Every token scores its own log-odds between toxic and clean training documents, less a constant that keeps the mean below zero. The log-odds come from a
hierarchy of Dirichlet priors: the toxic share of a prefix of four letters is drawn towards the share of all tokens, that of a longer prefix towards the shorter
one's, the token's towards its longest prefix's, each with the weight of PRIOR documents; so a rare or unseen (inflected) word leans on its relatives, and clean
evidence counts as toxic evidence does. Counts are of documents, in BINS hashed cells, which bounds what is broadcast. A linear scan finds every maximal segment of a
document's token scores. A segment's score is judged against what chance gives in a text of that length: the best segments of clean texts that nothing was
counted in follow an extreme-value law, P(best > x) = 1 - exp(-K n exp(-lambda x)) for n tokens, whose lambda and K are fitted by maximum likelihood. How surprising
the best segment is under that law (-ln P, which grades texts without a significant passage, too) and the evidence of the other significant ones add up; their sum goes through a logistic calibration, fitted to the
same rows with both labels, to a score from 0 to 1: a stronger passage never lowers it.

Training reads at most about ROWS_PER_CLASS rows of each label, by a hash of doc_id; only those labels are broadcast. Of rows of one label that agree in all of
SIGNATURE minhashes of their five-word shingles one is learned from: near copies would pass for many documents that share their words (two
texts of similarity s agree with probability s^4, so texts that merely share a passage hardly ever do). Scores cover all rows.
Defined results: null or empty text has no segment and gets the lowest score; a document with several labels counts as toxic
if one says so; null labels are ignored; without both labels to learn from every score is the share of toxic ones (0 without labels); a null
doc_id is held out and never labelled; repeated rows score alike; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize
from .langid import FOLDS, SAMPLE_TASKS, held_out, sampled

ROWS_PER_CLASS = 10_000
#: Hashed cells of features.
BINS = 1 << 20
PREFIXES = (4, 5, 6)
#: Documents that a prior weighs, and what is taken off every token's log-odds so that the mean score of clean text is below zero: the pair of the nine tried by `cross_validate`
#: (PRIORS x PENALTIES) with the least log loss over the training rows of a tenth of the scale; held-out rows have no part in it.
PRIOR = 20.0
PENALTY = 1.0
PRIORS, PENALTIES = (5.0, 20.0, 80.0), (0.5, 1.0, 1.5)
SIGNATURE = 4
#: Score of the places that maximal_segments isn't told about.
REST = -0.3
_TOKEN = re.compile(r"[^\W\d_]+")
_MEMO = 500_000


def tokens(text: bytes) -> Iterator[str]:
    plain = text.decode("utf-8", "replace").lower()
    return (m[0] for m in _TOKEN.finditer(plain))


def features(token: str) -> list[int]:
    """Cells of the token's prefixes, the shortest first, and of the token itself."""
    names = [*(f"{token[:n]}*" for n in PREFIXES if len(token) >= n), token]
    return [xxhash.xxh64_intdigest(x) % BINS for x in names]


class _Segments:
    """Maximal scoring segments (Ruzzo and Tompa), fed with the positive scores in order. Each candidate points to the nearest one before it that starts
    lower, so the search for a left neighbour skips what lies between and all of them together take linear time."""

    def __init__(self):
        self.kept: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum upto, nearest candidate that starts lower

    def add(self, place: int, before: float, upto: float) -> None:
        kept, first = self.kept, place
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= before:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= upto:
                kept.append((first, place, before, upto, j))
                return
            first, _, before, _, down = kept[j]
            del kept[j:]
            j = down

    def found(self) -> list[tuple[int, int, float]]:
        return [(a, b, upto - before) for a, b, before, upto, _ in self.kept]


def maximal_segments(scores: Iterable[tuple[int, float]], rest: float = REST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence that has `rest` (negative) everywhere but at the given places: (first, last, score), in order."""
    segments, total, at = _Segments(), 0.0, -1
    for place, score in scores:
        total += rest * (place - at - 1)
        at = place
        before, total = total, total + score
        if score > 0:
            segments.add(place, before, total)
    return segments.found()


@dataclass
class Model:
    clean: np.ndarray = field(default_factory=lambda: np.zeros(BINS, np.int32))  # documents that hold a feature of the cell
    toxic: np.ndarray = field(default_factory=lambda: np.zeros(BINS, np.int32))
    share: float = 0.5  # toxic share of all (document, token) pairs
    rate: float = 1.0  # lambda
    chance: float = 1.0  # K
    logistic: tuple[float, float] = (0.0, 0.0)
    base: float | None = 0.0  # the score of all texts if nothing could be learned
    prior: float = PRIOR
    penalty: float = PENALTY

    def token_score(self, token: str) -> float:
        expected = self.share
        for cell in features(token):
            toxic = float(self.toxic[cell])
            expected = (toxic + self.prior * expected) / (toxic + float(self.clean[cell]) + self.prior)
        return _logit(expected) - _logit(self.share) - self.penalty

    def segments(self, text: bytes, memo: dict[str, float]) -> tuple[list[tuple[int, int, float]], int]:
        """Maximal segments (first token, last token, score) and the number of tokens."""
        segments, total, n, known = _Segments(), 0.0, 0, memo.get
        for token in tokens(text):
            score = known(token)
            if score is None:
                if len(memo) >= _MEMO:
                    memo.clear()
                score = memo[token] = self.token_score(token)
            before = total
            total += score
            if score > 0:
                segments.add(n, before, total)
            n += 1
        return segments.found(), n

    def significant(self, found: list[tuple[int, int, float]], n: int) -> list[tuple[int, int, float]]:
        """Of a text's segments those that chance does not explain, as (first token, last token, evidence). Evidence is -ln E for E expected by chance."""
        if self.base is not None:
            return []
        floor = math.log(self.chance * max(n, 1))
        told = ((a, b, self.rate * s - floor) for a, b, s in found)
        return [(a, b, e) for a, b, e in told if e > 0]

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        """-ln P of the best segment under the law of chance plus the other significant ones' evidence, on a scale that dampens long documents."""
        best = max((s for *_, s in found), default=0.0)
        expected = self.chance * n * math.exp(-self.rate * best)
        surprise = -math.log(-math.expm1(-expected)) if expected > 1e-300 else self.rate * best - math.log(self.chance * max(n, 1))
        others = sorted((e for *_, e in self.significant(found, n)), reverse=True)[1:]
        return math.log1p(surprise + sum(others)) if n else 0.0

    def score(self, evidence: float) -> float:
        if self.base is not None:
            return self.base
        a, b = self.logistic
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * evidence))))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, clean, toxic) of the task's documents; cell BINS counts (document, token) pairs."""
    counts = np.zeros((2, BINS + 1), np.int64)
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held = set(tokens(text.as_py()))
            counts[label, list({cell for token in held for cell in features(token)})] += 1
            counts[label, BINS] += len(held)
    seen = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(counts[0, seen]), pa.array(counts[1, seen])], names=["cell", "clean", "toxic"])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds SIGNATURE minhashes of a text's five-word shingles as one value."""
    seeds = np.random.default_rng(23).integers(1 << 62, size=SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        out = []
        for text in batch.column(1):
            words = text.as_py().lower().split()
            h = np.fromiter({xxhash.xxh3_64_intdigest(b" ".join(words[k : k + 5])) for k in range(max(1, len(words) - 4))}, np.uint64)
            least = np.array([(mixed ^ mixed >> np.uint64(31)).min() for mixed in (h * seed for seed in seeds)])
            out.append(xxhash.xxh3_64_intdigest(least.tobytes()) >> 1)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=["toxic", "text", "fold", "signature"])


def fit_extremes(best: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """lambda and K by maximum likelihood, from the best segment scores of clean texts and their lengths. For a lambda the best K is in closed form, and
    the profile likelihood's slope falls with lambda, so bisection finds its zero (within 0.001 and 20)."""
    if not len(best):
        return 1.0, 1.0
    low, high = 1e-3, 20.0
    for _ in range(60):
        rate = (low + high) / 2
        weight = lengths * np.exp(-rate * best)
        slope = 1 / rate - best.mean() + (weight * best).sum() / weight.sum()
        low, high = (rate, high) if slope > 0 else (low, rate)
    return low, float(len(best) / (lengths * np.exp(-low * best)).sum())


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Ridge logistic regression on one column by Newton steps. Its weight can't be negative: if the rows say so, the column says nothing."""
    table, w = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(table @ w, -30, 30)))
        slope = table.T @ (p - y) + 1e-2 * w
        bend = (table * (p * (1 - p))[:, None]).T @ table + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(bend, slope)
    return (float(w[0]), float(w[1])) if w[1] >= 0 else (_logit((y.sum() + 1) / (len(y) + 2)), 0.0)


def training_rows(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> DataFrame:
    """toxic, text, fold (1 to FOLDS - 1): the bounded sample of labelled rows, near copies of a label once; written. Rows of the fold that is held out are not looked at."""
    known = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = sampled(known, "toxic", rows_per_class, 7)
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS).cast("int")
    rows = docs.select("doc_id", as_bytes().alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text", fold.alias("fold"))
    signed = rows.mapInArrow(_signatures, "toxic int, text binary, fold int, signature long")
    # Of near copies one in the last fold goes before others, as it did when only that fold was told apart.
    rows = signed.groupBy("toxic", "signature").agg(F.min(F.struct(F.col("fold") == FOLDS - 1, F.xxhash64("text"), "fold", "text")).alias("r")).select("toxic", "r.text", "r.fold")
    return materialize(rows.repartition(SAMPLE_TASKS), "toxicity-sample")


def _measured(model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """model: a broadcast. Rows (toxic, text) -> toxic, n (tokens), best (segment's score), evidence."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = model.value, {}
        for batch in batches:
            found = [m.segments(t.as_py(), memo) for t in batch.column(1)]
            best = [max((s for *_, s in segments), default=0.0) for segments, _ in found]
            columns = [batch.column(0), pa.array([n for _, n in found], pa.int64()), pa.array(best, pa.float64()), pa.array([m.evidence(*one) for one in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "n", "best", "evidence"])

    return measure


def _measure(rows: DataFrame, model: Model) -> pa.Table:
    """Four numbers for each row of the bounded sample."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    return rows.select("toxic", "text").mapInArrow(_measured(shared), "toxic int, n long, best double, evidence double").toArrow()


def _counted(rows: DataFrame) -> np.ndarray:
    """Documents (clean, toxic) of each cell; the last column counts (document, token) pairs."""
    counted = rows.select("toxic", "text").mapInArrow(_feature_counts, "cell int, clean long, toxic long")
    table = counted.groupBy("cell").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()  # BINS + 1 rows at most
    counts = np.zeros((2, BINS + 1), np.int64)
    cells = table["cell"].to_numpy()
    counts[0, cells], counts[1, cells] = table["clean"].to_numpy(), table["toxic"].to_numpy()
    return counts


def _fitted(counts: np.ndarray, calibration: DataFrame, prior: float, penalty: float) -> Model:
    clean, toxic = counts[:, BINS].tolist()
    if not clean or not toxic:
        return Model(base=1.0 if toxic else 0.0)
    model = Model(counts[0, :BINS].astype(np.int32), counts[1, :BINS].astype(np.int32), toxic / (clean + toxic), base=None, prior=prior, penalty=penalty)
    told = _measure(calibration, model)
    names = ("toxic", "n", "best")
    label, n, best = (told[c].to_numpy().astype(float) for c in names)
    chance = (label == 0) & (n > 0)
    model.rate, model.chance = fit_extremes(best[chance], n[chance])
    told = _measure(calibration, model)
    x, y = told["evidence"].to_numpy(), told["toxic"].to_numpy().astype(float)
    # With too few rows to calibrate, evidence beyond chance decides.
    model.logistic = _fit_logistic(x, y) if len(set(y.tolist())) == 2 else (-2.0, 2.0)
    return model


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, prior: float = PRIOR, penalty: float = PENALTY) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Tokens are counted in the folds but the last, which calibrates."""
    rows = training_rows(docs, labels, rows_per_class)
    return _fitted(_counted(rows.filter(F.col("fold") < FOLDS - 1)), rows.filter(F.col("fold") == FOLDS - 1), prior, penalty)


def cross_validate(docs: DataFrame, labels: DataFrame, priors: Sequence[float] = PRIORS, penalties: Sequence[float] = PENALTIES, rows_per_class: int = ROWS_PER_CLASS) -> list[tuple[float, float, float]]:
    """(mean log loss, prior, penalty), the best first. Each training fold is scored once by models that count in two others and are calibrated on the third; held-out rows are not read."""
    rows = training_rows(docs, labels, rows_per_class)
    folds, losses = range(1, FOLDS), defaultdict(list)
    each = {f: _counted(rows.filter(F.col("fold") == f)) for f in folds}
    for f in folds:
        calibrating = f % (FOLDS - 1) + 1
        counts = sum(each[g] for g in folds if g not in (f, calibrating))
        for prior in priors:
            for penalty in penalties:
                model = _fitted(counts, rows.filter(F.col("fold") == calibrating), prior, penalty)
                told = _measure(rows.filter(F.col("fold") == f), model)
                for toxic, x in zip(told["toxic"].to_pylist(), told["evidence"].to_pylist(), strict=True):
                    p = min(max(model.score(x), 1e-6), 1 - 1e-6)
                    losses[prior, penalty].append(-math.log(p if toxic else 1 - p))
    return sorted((sum(v) / len(v), *k) for k, v in losses.items())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, score, predicted, passages: array<struct<first, last, evidence>> (token places)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("evidence", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, memo = shared.value, {}
        for batch in batches:
            segments = [m.segments(t.as_py(), memo) for t in batch.column(2)]
            scores = [m.score(m.evidence(*one)) for one in segments]
            found = [m.significant(*one) for one in segments]
            out = [
                pa.array(scores, pa.float64()),
                pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                pa.array([[dict(zip(("first", "last", "evidence"), p, strict=True)) for p in s] for s in found], passage),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], names=["doc_id", "held_out", "score", "predicted", "passages"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), as_bytes().alias("text"))
    return slim.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int, passages array<struct<first: long, last: long, evidence: double>>")
