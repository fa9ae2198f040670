"""Language identification with error-correcting output codes.

Each language has a codeword; for each bit a binary classifier over hashed byte n-grams (smoothed log-odds, naive Bayes)
tells on which side of the code a text lies. Decoding is loss-weighted: a language's distance is the logistic loss of
every bit against its codeword, weighed by how reliable that bit was on training texts of that language. The margins are scaled by the
factor (of SCALES) under which the training texts' own losses are least. The nearest codeword wins; a runner-up about as near marks
the text as ambiguous.

Training reads at most about ROWS_PER_LANGUAGE rows of each language, chosen by a hash of doc_id; everything else covers all rows.
Defined results: null text, or text without a letter, is `und` with score 0; so is every text if there is nothing to
learn from; a null doc_id is held out; rows with null lang aren't learned from; repeated rows are predicted alike; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, materialize

ROWS_PER_LANGUAGE = 3000
BINS = 1 << 15
#: The sample is written once, in so many parts, and read by both training passes.
SAMPLE_TASKS = 16
ORDERS = (2, 3, 4)
UNKNOWN = "und"
FOLDS = 5
#: Distances of the two nearest codewords that differ by less are called ambiguous: the runner-up is more than 0.6 times as likely.
MARGIN = 0.5
#: Factors of the margins that training chooses from.
SCALES = (1.0, 2.0, 4.0, 8.0, 12.0, 16.0, 24.0, 32.0)
_PIECE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that nothing is learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sampled(rows: DataFrame, label: str, per_label: int, salt: int) -> DataFrame:
    """About per_label rows of each label, by a hash of doc_id; the labels are few and their counts come from two narrow columns."""
    counts = rows.groupBy(label).count().collect()
    unit = F.pmod(F.xxhash64(F.lit(salt), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    chosen = F.lit(False)
    for r in counts:
        chosen = chosen | ((F.col(label) == F.lit(r[label])) & (unit < min(1.0, per_label / r["count"])))
    return rows.filter(chosen)


def ngram_bins(text: bytes) -> np.ndarray | None:
    """Counts of the hashed n-grams of a text's letters; None without letters. Words are parted by one space."""
    plain = text.decode("utf-8", "replace")
    if not _LETTER.search(plain):
        return None
    counts, at, joint = np.zeros(BINS, np.int64), 0, b" "
    while at < len(plain):  # a piece at a time, so that the arrays stay small; each begins with the bytes that n-grams across its start need
        end = min(at + _PIECE, len(plain))
        words = _OTHER.sub(" ", plain[at:end].lower()).encode()
        at = end
        fresh = joint + (words.lstrip(b" ") if joint.endswith(b" ") else words)
        if at == len(plain):
            fresh = fresh.rstrip(b" ") + b" "
        head, joint = len(joint), fresh[-(max(ORDERS) - 1) :]
        b = np.frombuffer(fresh, np.uint8).astype(np.uint32)
        for order in ORDERS:
            first = max(0, head - order + 1) if head > 1 else 0  # those before were counted with the last piece
            n = len(b) - order + 1 - first
            if n <= 0:
                continue
            h = np.full(n, order, np.uint32)
            for j in range(order):
                h = (h ^ b[first + j : first + n + j]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            counts += np.bincount(h & np.uint32(BINS - 1), minlength=BINS)
    return counts


def codewords(languages: int) -> np.ndarray:
    """languages x bits of -1 and 1. Up to 7 languages: every split into two sides (the first language always on one); beyond, seeded
    random splits, 12 bits a doubling, without equal codewords."""
    if languages == 1:
        return np.ones((1, 1))
    if languages <= 7:
        sides = [(1, *s) for s in product((1, -1), repeat=languages - 1) if -1 in s]
        return np.array(sides, float).T
    rng = np.random.default_rng(11)
    bits = 12 * int(np.ceil(np.log2(languages)))
    while True:
        code = rng.choice([-1.0, 1.0], (languages, bits))
        if len(np.unique(code, axis=0)) == languages and (np.abs(code.sum(axis=0)) < languages).all():
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BINS x bits, log-odds
    reliable: np.ndarray  # languages x bits, rows sum to the number of bits
    scale: float = 1.0
    margin: float = MARGIN

    def means(self, counts: np.ndarray) -> np.ndarray:
        """Mean log-odds of the text's n-grams, for each bit."""
        return (counts @ self.weights) / max(int(counts.sum()), 1)

    def sides(self, counts: np.ndarray) -> np.ndarray:
        """Signed margins of the bits."""
        return np.clip(self.scale * self.means(counts), -8, 8)

    def distances(self, counts: np.ndarray) -> np.ndarray:
        return (self.reliable * np.log1p(np.exp(-self.code * self.sides(counts)))).sum(axis=1)

    def predict(self, counts: np.ndarray | None) -> tuple[str, float, bool]:
        """language, score, ambiguous"""
        if counts is None or not self.languages:
            return UNKNOWN, 0.0, True
        d = self.distances(counts)
        best = int(d.argmin())
        p = np.exp(d.min() - d)
        second = np.partition(d, 1)[1] if len(d) > 1 else np.inf
        return self.languages[best], float(1 / p.sum()), bool(second - d[best] < self.margin)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each language of the task: its n-gram counts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = ngram_bins(text.as_py())
            if counts is not None:
                sums[lang] = sums[lang] + counts if lang in sums else counts
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["lang", "counts"])


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, margin: float = MARGIN) -> Model:
    """docs: doc_id, text, lang. The labels are languages: their counts, one row each, come to the driver."""
    spark = docs.sparkSession
    rows = sampled(docs.filter(~held_out() & F.col("lang").isNotNull()).select("doc_id", "lang", "text"), "lang", rows_per_language, 6)
    rows = materialize(rows.select("lang", as_bytes().alias("text")).repartition(SAMPLE_TASKS), "language-sample")
    sums: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(_counted, "lang string, counts binary").collect():  # as many rows as tasks times languages
        part = np.frombuffer(bytes(r["counts"]), np.int64)
        sums[r["lang"]] = sums.get(r["lang"], 0) + part
    languages = sorted(sums)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((BINS, 1)), np.ones((0, 1)))
    code = codewords(len(languages))
    share = np.array([(sums[x] + 0.5) / (sums[x].sum() + 0.5 * BINS) for x in languages])  # each language weighs the same
    weights = np.zeros((BINS, code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        one, other = share[code[:, bit] > 0], share[code[:, bit] < 0]
        if len(one) and len(other):
            weights[:, bit] = np.log(one.mean(axis=0)) - np.log(other.mean(axis=0))
    model = Model(languages, code, weights, np.ones_like(code), margin=margin)
    shared = spark.sparkContext.broadcast(model)

    def right_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        right, seen, losses = np.zeros_like(m.code), np.zeros(len(m.languages)), np.zeros(len(SCALES))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = ngram_bins(text.as_py())
                if counts is not None:
                    k = m.languages.index(lang)
                    side = m.code[k] * m.means(counts)
                    right[k] += side > 0
                    seen[k] += 1
                    losses += [np.log1p(np.exp(-np.clip(s * side, -8, 8))).sum() for s in SCALES]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (right, seen, losses)], names=["right", "seen", "losses"])

    right, seen, losses = np.zeros_like(code), np.zeros(len(languages)), np.zeros(len(SCALES))
    for r in rows.mapInArrow(right_bits, "right binary, seen binary, losses binary").collect():
        right += np.frombuffer(bytes(r["right"])).reshape(code.shape)
        seen += np.frombuffer(bytes(r["seen"]))
        losses += np.frombuffer(bytes(r["losses"]))
    model.scale = SCALES[int(losses.argmin())]
    accuracy = (right + 1) / (seen[:, None] + 2)
    model.reliable = accuracy * code.shape[1] / accuracy.sum(axis=1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shared.value.predict(ngram_bins(x.as_py())) for x in batch.column(2)]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), as_bytes().alias("text"))
    return slim.mapInArrow(label, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
