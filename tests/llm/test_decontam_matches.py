"""op9's shard search against plain loops, items that repeat themselves, and long items in several blocks."""

import hashlib
import random
import tracemalloc

from revlens.llm import decontam

from . import brute
from .conftest import doc, prose


def _block(items):
    return decontam.TestSuffixes([decontam.Item(n, 0, decontam.split_words(x.encode())) for n, x in items])


def _longest(items, words):
    best = 0
    for text in (x.split() for _, x in items):
        for i in range(len(text)):
            for j in range(len(words)):
                n = 0
                while i + n < len(text) and j + n < len(words) and text[i + n] == words[j + n]:
                    n += 1
                if n >= min(13, len(text)):
                    best = max(best, n)
    return best


def test_shards_against_plain_loops():
    r = random.Random(1)
    for _ in range(120):
        vocabulary = [f"w{k}" for k in range(r.choice([1, 2, 3, 8, 50]))]

        def text(n):
            return " ".join(r.choice(vocabulary) for _ in range(n))

        items = [(str(k), text(r.choice([0, 1, 2, 5, 12, 13, 14, 20, 40]))) for k in range(r.randint(0, 6))]
        docs = []
        for _ in range(r.randint(1, 5)):
            parts = [text(r.randint(0, 30))]
            for _ in range(r.randint(0, 2) if items else 0):
                words = r.choice(items)[1].split()
                at = r.randint(0, max(0, len(words) - 1))
                parts.append(" ".join(words[at : at + r.randint(1, 40)]))
            docs.append(" ".join([*parts, text(r.randint(0, 10))]))
        found = decontam._found(_block(items), [x.encode() for x in docs])
        wanted = brute.contamination(list(enumerate(docs)), items)
        got = [(k, n, sum(b - a for a, b in s.tolist()), len(i), hashlib.sha256(",".join(i).encode()).hexdigest()) for k, (n, s, i) in enumerate(zip(found.words.tolist(), found.spans, found.items, strict=True))]
        assert got == [w[:5] for w in wanted]
        for text_, spans, matches in zip(docs, found.spans, found.matches, strict=True):
            words, covered = text_.split(), set()
            for m in matches:
                place = range(m["doc_word"], m["doc_word"] + m["n_words"])
                assert [words[p] for p in place] == dict(items)[m["item"]].split()[m["item_word"] : m["item_word"] + m["n_words"]]
                covered |= set(place)
            assert covered == {p for a, b in spans.tolist() for p in range(a, b)}
            assert max((m["n_words"] for m in matches), default=0) == _longest(items, words)


def test_an_item_that_repeats_itself_stays_small():
    block = _block([("a", "x " * 200)])
    tracemalloc.start()
    found = decontam._found(block, [b"x " * 20_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.spans[0].tolist() == [[0, 20_000]] and found.items == [["a"]] and max(m["n_words"] for m in found.matches[0]) == 200
    assert peak < 60 << 20


def test_long_items_in_several_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 60)
    items = [(1, prose(5, 400)), (2, prose(6, 20)), (3, None), (4, "word"), (5, prose(7, 61))]
    cut = prose(5, 400).split()
    rows = [doc(k, " ".join([prose(50 + k, 30), *cut[37 * k : 37 * k + 90], prose(80 + k, 20)])) for k in range(8)]
    rows += [doc(None, rows[0][1]), doc(30, rows[0][1]), doc(30, rows[0][1]), doc(20, None), doc(21, prose(7, 61))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.find_contamination(make_docs(rows), bench).collect()
    got = sorted((str(r["doc_id"]), r["decon"]["n_words"], r["decon"]["n_hit"], r["decon"]["items"], r["decon"]["contaminated"]) for r in found)
    wanted = brute.contamination(rows, items)
    assert [(a, b, c, len(d), e) for a, b, c, d, e in got] == sorted((str(w[0]), w[1], w[2], w[3], w[5]) for w in wanted)
    for r in found:
        words = next(x[1] for x in rows if x[0] == r["doc_id"])
        words = decontam.split_words((words or "").encode())
        for m in r["decon"]["matches"]:
            text = decontam.split_words(dict(items)[int(m["item"])].encode())
            assert words[m["doc_word"] :][: m["n_words"]] == text[m["item_word"] :][: m["n_words"]]
