"""The index of grams gives what looking into every text gives."""

import random

import numpy as np
from pyspark.sql import functions as F

from revlens import schemas
from revlens.operators import anchoring, changes, quotes

from .cases import frame, make_case
from .test_changes import rows_of


def texts(r, n):
    words = ["alpha", "béta", "gamma_1", "x", "=", "return", "ünïcode", "(self)", "if", "else:", "→", "def", "value", "0"]
    return "\n".join(" ".join(r.choice(words) for _ in range(r.randint(0, 14))) for _ in range(n)) + "\n"


def test_marks_are_found_wherever_a_quote_stands(monkeypatch):
    r = random.Random(3)
    data = texts(r, 400).encode()
    whole = set(quotes.marks(data).tolist())
    for _ in range(300):
        at = r.randrange(len(data) - quotes.MARKED)
        own = quotes.marks(data[at : at + r.randint(quotes.MARKED, 120)])
        assert len(own) and set(own.tolist()) <= whole
    monkeypatch.setattr(quotes, "_PIECE", 64)  # pieces overlap by a window, so their marks are those of the whole
    assert set(quotes.marks(data).tolist()) == whole
    assert not len(quotes.marks(b"")) and not len(quotes.marks(b"short"))
    assert quotes._grams(b"abcd", 4).tolist() == [int.from_bytes(b"abcd", "big")] and len(np.unique(quotes.marks(b"a" * 5000))) == 1


def test_equals_looking_into_every_text(spark):
    r = random.Random(7)
    before = {f"f{k}.py": texts(r, 12) for k in range(12)}
    after = {p: "\n".join(line for line in t.split("\n") if r.random() > 0.2) + "\nnew = 1\n" for p, t in before.items()} | {"blank.py": "\n\n", "doc.md": "text"}
    cases = frame(spark, [make_case("one", before, after), make_case("two", before, dict(list(after.items())[:5]))])
    lines = [x for t in before.values() for x in t.split("\n")]
    said = [r.choice(lines)[: r.randint(0, 90)] for _ in range(25)] + ["", "x", "new", "NEW =   1", "nowhere to be found in any of these files, however long", "béta", "→", "ünïcode", "12 + | new = 1", "a" * 200]
    said += [x for x in before["f0.py"].split("\n") if len(x) > 10 and x not in after["f0.py"]][:2]
    rows, n = [], 0
    for quote in said:
        for case in ("one", "two", "three"):
            for file in ("f0.py", "f1.py", "f7.py", "blank.py", "doc.md", "missing.py"):
                rows.append((case, n, file, r.choice([None, 0, 1, 2, 5, 900]), 1, "x", 0.5, "m", "detect", "t", quote))
                n += 1
    claims = spark.createDataFrame(rows, schemas.CLAIMS)
    for form in (cases, changes.split(cases)):
        for deletions in (False, True):
            wanted = anchoring.anchor(claims, form, with_deletions=deletions)
            got = quotes.anchor_shared(claims, form, with_deletions=deletions)
            assert got.columns == wanted.columns and rows_of(got) == rows_of(wanted)
    found = {r["verdict"] for r in wanted.collect()}
    assert found == {"anchored", "snapped", "ambiguous", "deleted-line", "unchecked", "unsupported"}, found
    assert quotes.anchor_shared(claims.limit(0), cases).count() == 0


def test_every_quote_at_every_place(spark):
    r = random.Random(11)
    before = {f"f{k}.py": texts(r, 9) for k in range(4)}
    after = {p: "\n".join(t.split("\n")[2:]) + "\nnew = 1\n" for p, t in before.items()} | {"blank.py": "\n\n"}
    cases = frame(spark, [make_case("one", before, after), make_case("two", before, dict(list(after.items())[:2]))])
    lines = [x for t in before.values() for x in t.split("\n")]
    said = [r.choice(lines)[: r.randint(0, 90)] for _ in range(15)] + [None, "", "x", "new = 1", "new = 1", "nowhere to be found", before["f0.py"].split("\n")[0]]
    asked = spark.createDataFrame(list(enumerate(said)), "ord long, quote string")
    at = [(c, f, line) for c in ("one", "two", "three") for f in ("f0.py", "f3.py", "blank.py", "missing.py") for line in (None, 1, 2, 9)] + [("one", "f0.py", 1)]
    places = spark.createDataFrame(at, "case_id string, file string, line int")
    claims = places.crossJoin(asked).select("case_id", "ord", "file", "line", "quote")
    for form in (cases, changes.split(cases)):
        for deletions in (False, True):
            got = quotes.anchor_every(places, asked, form, with_deletions=deletions)
            assert rows_of(got) == rows_of(anchoring.anchor(claims, form, with_deletions=deletions).select(got.columns))
    # Claims come to be behind the last exchange.
    above, crossed, _ = got._jdf.queryExecution().executedPlan().toString().partition("BroadcastNestedLoopJoin")
    assert crossed and "Exchange" not in above


def test_few_texts_are_looked_into(spark):
    texts_ = spark.createDataFrame([(str(k), "t.py", f"document number {k} speaks of nothing but its own number, which is {k * 7919}") for k in range(500)], "case_id string, file string, text string")
    asked = spark.createDataFrame([("speaks of nothing but its own number, which is 39595",), ("document number 77 speaks of nothing",), ("nobody says this anywhere in the five hundred texts",), ("7919",)], "quote string")
    got = quotes.candidates(asked, texts_)
    assert {r["case_id"] for r in got.filter(F.col("quote").startswith("document number 77")).collect()} >= {"77"}
    assert not got.filter(F.col("quote").startswith("nobody")).count()
    true = texts_.crossJoin(asked).filter(F.col("text").contains(F.col("quote"))).select("quote", "case_id", "file")
    assert true.join(got, ["quote", "case_id", "file"], "left_anti").count() == 0
