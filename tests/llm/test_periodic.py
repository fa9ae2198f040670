"""Runs against a scan of every lag and start."""

import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from revlens.llm import periodic, queries

from . import brute
from .conftest import doc, prose


def plain(words):
    """All runs: maximal stretches that repeat after q words, of max(24, 3q) words at least, with no shorter period."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - s + q
            if length >= max(24, 3 * q) and not any(all(words[j] == words[j + p] for j in range(s, s + length - p)) for p in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(r, n, letters, times):
    words = [r.randrange(letters) for _ in range(n)]
    for _ in range(times):
        s = r.randrange(max(1, n - 20))
        p, e = r.randint(1, max(1, (n - s) // 2)), r.randint(s, n)
        for i in range(s + p, e):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_every_run(seed):
    r = random.Random(seed)
    for _ in range(120):
        words = planted(r, r.randint(0, 260), r.choice([1, 2, 3, 40]), r.randint(0, 4))
        assert [tuple(x) for x in periodic.find(np.array(words, np.int64))] == plain(words)


def test_long_periods_and_long_texts():
    r = random.Random(1)
    block = [r.randrange(5000) for _ in range(7001)]
    runs = periodic.find(np.array(block * 20 + [6000] + [1, 2] * 40, np.int64))
    assert [tuple(x) for x in runs] == [(0, 7001 * 20, 7001), (7001 * 20 + 1, 80, 2)]
    a, b = [0, 1], [0]
    while len(a) < 60_000:
        a, b = a + b, a
    assert len(periodic.find(np.array(a, np.int64))) > 1000  # the Fibonacci word is as full of runs as a text can be
    assert [tuple(x) for x in periodic.find(np.zeros(500_000, np.int64))] == [(0, 500_000, 1)]


def digests(doc_id, text):
    words = brute.words(text)
    h, n = crc32(str(doc_id).encode()), len(brute.words(text))
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(listed), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_plain_version(spark, make_docs, edge_rows, tmp_path):
    rows = [r for r in edge_rows if len(r[1] or "") < 50_000] + [doc(100 + k, prose(k, 20 + 3 * k)) for k in range(150)]
    rows += [doc(300, "go stop " * 40 + "end"), doc(301, prose(1, 30) + " a" * 30 + " b" * 24 + " c" * 23), doc(302, "x y z " * 8 + "x y"), doc(303, (prose(5, 11) + " ") * 3 + prose(6, 9))]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    wanted = [digests(r[0], r[1]) for r in rows]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert sum(r[1] > 0 for r in wanted) > 10


def test_collapsed_rows(make_docs, edge_rows):
    rows = [doc(1, "a b " * 20 + "tail  end"), doc(2, "no  runs\n here"), doc(3, None), doc(4, "z " * 24)]
    back = periodic.collapse_runs(make_docs(rows))
    assert back.columns == make_docs(rows).columns
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {1: "a b tail end", 2: "no  runs\n here", 3: None, 4: "z"}
    found = periodic.find_runs(make_docs(edge_rows), ["doc_id", "text", "row"])
    assert found.columns == ["doc_id", "text", "row", "periodic"] and found.count() == len(edge_rows)
    long = {r["doc_id"]: r["periodic"] for r in found.collect()}[9]
    assert long["n_words"] == 60_000
    assert periodic.find_runs(make_docs([])).count() == 0
