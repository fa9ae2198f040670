"""Ranked search against a plain ranking of all documents, whatever the thresholds cut."""

import math
import random
from collections import Counter

import pytest

from revlens.llm import ranked

from .brute import ITEM_WORD, LOWER
from .conftest import WORDS, doc, prose


def terms(text):
    return ITEM_WORD.findall((text or "").translate(LOWER))


def plain(rows, items, k):
    docs = [(r[0], Counter(t), len(t)) for r in rows if (t := terms(r[1]))]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df, out, asked = Counter(t for _, c, _ in docs for t in c), [], {}
    for item, text in dict.fromkeys(items):
        asked.setdefault(item, Counter()).update(terms(text))
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    for item, query in asked.items():
        scored = []
        for doc_id, counts, n in docs:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(q * weight[t] * (10**9 * counts[t] // (1000 * counts[t] + 12 * m)) for t, q in query.items() if t in counts)
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scored)[:k], 1)]
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    """Words of every frequency, a word that almost every row has, copies in hundreds, and a row that is mostly one rare word."""
    r = random.Random(5)
    rare = [f"w{k}" for k in range(400)]
    rows = [doc(k, " ".join([*(r.choice(WORDS) for _ in range(r.randint(1, 60))), *(rare[int(400 * r.random() ** 3)] for _ in range(r.randint(0, 25))), "common"])) for k in range(500)]
    return rows + [doc(600 + k, "Copies of one text about w7 and w9, common") for k in range(300)] + [doc(2000, "w3 " * 5000), doc(2001, None), doc(2002, "")]


@pytest.fixture(scope="module")
def items():
    r = random.Random(6)
    texts = [" ".join([*(r.choice(WORDS) for _ in range(r.randint(0, 12))), *(f"w{r.randrange(420)}" for _ in range(r.randint(0, 8)))]) for _ in range(30)]
    return [*enumerate(texts), (100, "common"), (101, "w7 w7 W7 w9 copies"), (102, "nobody has this"), (103, ""), (104, None), (105, "the, THE the common w3"), (105, "w399 w398"), (0, texts[0])]


@pytest.mark.parametrize("k", [1, 20])
def test_equals_plain_ranking(spark, make_docs, corpus, items, k):
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(ranked.search(make_docs(corpus), queries, k)) == sorted(plain(corpus, items, k), key=repr)


def test_blocks_of_queries_give_the_same(spark, make_docs, corpus, items, monkeypatch):
    queries = spark.createDataFrame(items[:12], "item_id long, text string")
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 40)
    assert rows_of(ranked.search(make_docs(corpus), queries)) == sorted(plain(corpus, items[:12], 20), key=repr)


def test_edges(spark, make_docs, edge_rows):
    queries = [(1, prose(2, 12)), (None, prose(9, 5)), (2, "ǅ ſ 😀 word"), (3, "a\x00b")]
    asked = spark.createDataFrame(queries, "item_id long, text string")
    got = [tuple(r) for r in ranked.search(make_docs(edge_rows), asked).collect()]
    assert sorted(got, key=repr) == sorted(plain(edge_rows, queries, 20), key=repr)
    assert sorted(r[1] for r in got if r[0] == 1) == list(range(1, 1 + sum(r[0] == 1 for r in got)))
    assert ranked.search(make_docs([]), asked).count() == 0 == ranked.search(make_docs(edge_rows), asked.limit(0)).count()
    assert ranked.search(make_docs([doc(1, ""), doc(2, None)]), asked).count() == 0
    named = spark.createDataFrame([("x", "lamp"), ("y", "river")], "item_id string, text string")
    assert {r["item_id"] for r in ranked.search(make_docs(edge_rows), named).collect()} == {"x", "y"}


def test_thresholds_spare_most_postings(spark, make_docs, corpus, monkeypatch):
    """The lists of frequent words are read down to the threshold only, and few documents are left to look up."""
    kept, made = ranked.materialize, {}

    def spy(df, name):
        made[name] = kept(df, name)
        return made[name]

    monkeypatch.setattr(ranked, "materialize", spy)
    queries = spark.createDataFrame([(1, "common w11 w12 w13"), (2, "common the w5")], "item_id long, text string")
    ranked.search(make_docs(corpus), queries).count()
    postings, sums, candidates = (made[f"search-{x}"].count() for x in ("postings", "sums", "candidates"))
    assert candidates <= sums < postings / 2
