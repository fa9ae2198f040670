"""op7's scores against a plain scorer; the extreme-value fit; the scan's time."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np

from revlens.llm import toxicity

from .conftest import doc, prose


def _plain_segments(scores):
    """All maximal segments by recursion on the best one (the first, the shortest of ties)."""
    best, sums = (0.0, 0, 0), np.concatenate([[0.0], np.cumsum(scores)])
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            if sums[b] - sums[a] > best[0] + 1e-9:
                best = (sums[b] - sums[a], a, b)
    s, a, b = best
    if not s:
        return []
    return _plain_segments(scores[:a]) + [(a, b - 1, s)] + [(x + b, y + b, z) for x, y, z in _plain_segments(scores[b:])]


def _parts(word):
    return [*(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n), word]


def test_scores_equal_a_plain_scorer(spark, make_docs):
    r, rows, labels = random.Random(9), [], []
    for k in range(300):
        words = [w.strip(",.").lower() for w in prose(k, r.randint(5, 40)).split()]
        if k % 3 == 0:
            words[r.randrange(len(words))] = r.choice(["vexor", "vexoring", "grumt"])
        rows.append(doc(k, " ".join(words)))
        labels.append((k, int(k % 3 == 0)))
    docs = make_docs(rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    learned = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5 in (1, 2, 3)]
    counts, pairs = (Counter(), Counter()), [0, 0]
    for k in learned:
        held = set(rows[k][1].split())
        counts[labels[k][1]].update({f for w in held for f in _parts(w)})
        pairs[labels[k][1]] += len(held)
    assert abs(model.share - pairs[1] / sum(pairs)) < 1e-12
    root = pairs[1] / sum(pairs)

    def token(word):
        p = root
        for f in _parts(word):
            p = (counts[1][f] + toxicity.PRIOR * p) / (counts[0][f] + counts[1][f] + toxicity.PRIOR)
        return math.log(p / (1 - p)) - math.log(root / (1 - root)) - toxicity.PENALTY

    a, b = model.logistic
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    significant = 0
    for k, text, *_ in rows:
        words = text.split()
        scores = [token(w) for w in words]
        assert all(abs(model.token_score(w) - s) < 1e-9 for w, s in zip(words, scores, strict=True))
        told = [(x, y, model.rate * s - math.log(model.chance * len(words))) for x, y, s in _plain_segments(scores)]
        told = [t for t in told if t[2] > 0]
        significant += len(told)
        assert [(p["first"], p["last"], round(p["evidence"], 6)) for p in got[k]["passages"]] == [(x, y, round(e, 6)) for x, y, e in told]
        best = max((s for *_, s in _plain_segments(scores)), default=0)
        x = -math.log(-math.expm1(-model.chance * len(words) * math.exp(-model.rate * best))) + sum(sorted((t[2] for t in told), reverse=True)[1:])
        assert abs(got[k]["score"] - 1 / (1 + math.exp(-(a + b * math.log1p(x))))) < 1e-6
    assert significant > 50 and b > 0


def test_held_out_labels_are_not_read(spark, make_docs):
    """Labels of the held-out fold turned around change neither the model nor the choice of its settings."""
    rows = [doc(k, prose(k, 12) + (" vexor" if k % 4 == 0 else "")) for k in range(200)]
    labels = [(k, int(k % 4 == 0)) for k in range(200)]
    turned = [(k, 1 - v if zlib.crc32(str(k).encode()) % 5 == 0 else v) for k, v in labels]
    assert turned != labels
    docs, (one, two) = make_docs(rows), (spark.createDataFrame(x, "doc_id long, toxic int") for x in (labels, turned))
    a, b = toxicity.train(docs, one), toxicity.train(docs, two)
    assert np.allclose([*a.logistic, a.rate, a.chance, a.share], [*b.logistic, b.rate, b.chance, b.share], rtol=1e-9) and (a.toxic == b.toxic).all() and (a.clean == b.clean).all()
    grid = ((5.0, 20.0), (1.0,))
    chosen = toxicity.cross_validate(docs, one, *grid)
    again = toxicity.cross_validate(docs, two, *grid)
    assert np.allclose(chosen, again, rtol=1e-9) and len(chosen) == 2 and chosen[0][0] <= chosen[1][0] < 1


def test_a_stronger_passage_never_lowers_the_score():
    model = toxicity.Model(base=None, rate=1.1, chance=0.05, logistic=toxicity._fit_logistic(np.array([0.1, 2.0, 2.5, 0.2]), np.array([0, 1, 1, 0])))
    assert model.logistic[1] > 0 == toxicity._fit_logistic(np.array([2.0, 0.1]), np.array([0, 1]))[1]
    scores = [model.score(model.evidence([(0, 3, s)] if s else [], 100)) for s in np.arange(0, 900, 0.5)]
    assert all(x <= y for x, y in zip(scores, scores[1:], strict=False)) and len(set(scores[:40])) == 40
    assert model.evidence([], 0) == 0.0


def test_extremes_are_recovered():
    rng = np.random.default_rng(3)
    lengths = rng.integers(50, 500, 20000)
    best = (np.log(0.02 * lengths) - np.log(rng.exponential(size=20000))) / 1.7
    rate, chance = toxicity.fit_extremes(best, lengths)
    assert abs(rate - 1.7) < 0.05 and abs(chance - 0.02) < 0.003
    assert toxicity.fit_extremes(best[:0], lengths[:0]) == (1.0, 1.0)
    for few in ([0.0], [0.0, 0.0], [2.5]):
        rate, chance = toxicity.fit_extremes(np.array(few), np.full(len(few), 10))
        assert 0 < rate <= 20 and 0 < chance < 1e30


def test_scan_takes_linear_time():
    falling = [(k, 0.5 if k % 2 else -0.6) for k in range(300_000)]  # every candidate starts lower than those before it
    began = time.perf_counter()
    assert len(toxicity.maximal_segments(falling)) == 150_000
    assert time.perf_counter() - began < 5
