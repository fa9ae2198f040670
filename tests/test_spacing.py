"""Greedy spacing over blocks, and greedy matching in rounds, against their one-after-another versions."""

import random

import pytest

from revlens import schemas
from revlens.operators import claims as reduce, matching


def plain_sites(rows, radius):
    """rows: (case, ord, file, line, confidence) -> ords kept, by case and file."""
    kept = {}
    out = set()
    for case, n, file, line, conf in sorted(rows, key=lambda r: (-(r[4] or 0), r[3] or 0, r[1])):
        near = kept.setdefault((case, file), [])
        if line is None or all(abs(line - x) > radius for x in near):
            out.add((case, n))
            if line is not None:
                near.append(line)
    return out


def plain_gaps(published, extra, radius, scope):
    taken = {}
    key = lambda case, file: (case, file) if scope == "case" else file
    for case, _, file, line, _ in published:
        if line is not None:
            taken.setdefault(key(case, file), []).append(line)
    out = set()
    for case, n, file, line, _ in sorted(extra, key=lambda r: (r[1], r[0], r[3] or 0)):
        near = taken.setdefault(key(case, file), [])
        if line is None or all(abs(line - x) > radius for x in near):
            out.add((case, n))
            if line is not None:
                near.append(line)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(c, n, f, line, line, "x", conf, "m", "detect", "", "") for c, n, f, line, conf in rows], schemas.CLAIMS)


def some(r, n, lines, start=0):
    levels = [None, 0.9, 0.9, 0.9, *(r.random() for _ in range(4))]
    return [(r.choice("abc"), start + k, r.choice(["f.py", "g.py", None]), None if r.random() < 0.03 else r.randint(-5, lines), r.choice(levels)) for k in range(n)]


@pytest.mark.parametrize(("seed", "lines", "block"), [(1, 60, 0), (2, 900, 16), (3, 300, 7), (4, 40, 1)])
def test_sites_and_gaps(spark, seed, lines, block):
    r = random.Random(seed)
    rows, extra = some(r, 400, lines), some(r, 300, lines, 1000)
    named = [x for x in rows if x[2]]
    for radius in (0, 5):
        got = {(x["case_id"], x["ord"]) for x in reduce.one_per_site(frame(spark, named), radius, block).collect()}
        assert got == plain_sites(named, radius)
        for scope in ("case", "global"):
            one, two = [x for x in named if x[1] % 5 == 0], [x for x in extra if x[2]]
            filled = {(x["case_id"], x["ord"]) for x in reduce.fill_gaps(frame(spark, one), frame(spark, two), radius, scope, block).collect()}
            assert filled == plain_gaps(one, two, radius, scope)
    assert reduce.one_per_site(frame(spark, []), 5).count() == 0 == reduce.fill_gaps(frame(spark, []), frame(spark, [])).count()


def test_a_long_file_of_equal_claims(spark):
    """Each decision waits for the one before it, through all blocks of the file."""
    rows = [("a", k, "f.py", 2 * k, 0.9) for k in range(1500)]
    got = sorted(x["line"] for x in reduce.one_per_site(frame(spark, rows), 5, 512).collect())
    assert got == list(range(0, 3000, 6))


def plain_match(pairs):
    ranks, labels, out = set(), set(), set()
    for rung, case, rank, label, distance in sorted(pairs, key=lambda p: (p[0], p[1], p[4], p[2], p[3])):
        if (rung, case, rank) not in ranks and (rung, case, label) not in labels:
            ranks.add((rung, case, rank))
            labels.add((rung, case, label))
            out.add((rung, case, rank, label, distance))
    return out


@pytest.mark.parametrize(("folded", "rounds"), [(200, 12), (0, 30), (0, 2), (40, 3)])
def test_matching_in_rounds(spark, folded, rounds):
    r = random.Random(folded + rounds)
    pairs = {(rung, case, r.randint(1, 25), r.randint(0, 25)) for rung in ("type", "location") for case in "abc" for _ in range(60 if case == "a" else 8)}
    rows = [(*p, r.randint(0, 3)) for p in pairs] + [("type", "chain", k // 2, (k + 1) // 2, k) for k in range(80)]
    got = {tuple(x) for x in matching.assign(spark.createDataFrame(rows, "rung string, case_id string, rank int, label_ord int, distance int"), folded, rounds).select("rung", "case_id", "rank", "label_ord", "distance").collect()}
    assert got == plain_match(rows)


def test_one_case_of_very_many_findings(spark):
    """A hundred thousand findings, each near three labels, in one case; rounds of joins decide, no task has the case."""
    rows = spark.range(100_000).selectExpr("'type' AS rung", "'big' AS case_id", "cast(id AS int) AS rank", "explode(array(id, id + 1, id + 2)) AS l", "xxhash64(id) AS h")
    pairs = rows.selectExpr("rung", "case_id", "rank", "cast(l AS int) AS label_ord", "cast(pmod(xxhash64(h, l), 1000) AS int) AS distance")
    got = {tuple(x) for x in matching.assign(pairs).select("rung", "case_id", "rank", "label_ord", "distance").collect()}
    assert got == plain_match([tuple(x) for x in pairs.collect()])


def test_every_case_has_a_row(spark):
    found = spark.createDataFrame([("a", 1, "f", 5, 5, "x"), ("a", 2, "f", 50, 50, "x"), ("b", 1, "f", 1, 1, "x")], "case_id string, rank int, file string, line int, end_line int, type string")
    labels = spark.createDataFrame([("a", 0, "x", "fam", [("f", 6, 6)]), ("c", 0, "x", "fam", [("f", 1, 1)])], "case_id string, label_ord int, type string, family string, spans array<struct<file: string, start_line: int, end_line: int>>")
    cases = spark.createDataFrame([(c,) for c in "abcd"], "case_id string")
    got = {r["case_id"]: (len(r["matches"]), r["unmatched_findings"], r["unmatched_labels"]) for r in matching.match_all(cases, found, labels, 10, {"location": "none"}).collect()}
    assert got == {"a": (1, [2], []), "b": (0, [1], []), "c": (0, [], [0]), "d": (0, [], [])}
