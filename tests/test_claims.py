import random

from pyspark.sql import functions as F

from revlens import kinds
from revlens.operators import claims as C
from revlens.operators import matching, spans

from .cases import claims


def _lines(df):
    return sorted((r["case_id"], r["file"], r["line"]) for r in df.collect())


def test_kinds():
    rows = kinds.kinds()
    assert len(rows) == 76 and len({k for k, *_ in rows}) == 76 and len(kinds.catalogue()) == 74
    assert [sum(s == level for _, _, s, _ in rows) for level in kinds.LEVELS] == [22, 40, 14]
    assert len({f for _, f, _, _ in rows}) == 17


def test_unknown_kind_has_no_family_and_medium_severity(spark):
    r = kinds.with_kind(spark.createDataFrame([("no_such_kind",)], "type string")).first()
    assert r["family"] is None and r["severity"] == "MEDIUM"


def test_one_per_site_is_greedy(spark):
    df = claims(spark, [("a", "f", 10, "x", 0.5, ""), ("a", "f", 14, "y", 0.9, ""), ("a", "f", 19, "z", 0.8, ""), ("a", "f", 20, "w", 0.7, ""), ("a", "g", 14, "x", 0.1, ""), ("b", "f", 14, "x", 0.1, ""), ("a", "f", None, "n", 0.2, ""), ("a", "f", None, "n", 0.2, "")])
    assert [(r["case_id"], r["file"], r["line"]) for r in C.one_per_site(df).orderBy("ord").collect()] == [("a", "f", 14), ("a", "f", 20), ("a", "g", 14), ("b", "f", 14), ("a", "f", None), ("a", "f", None)]


def test_one_per_site_against_a_plain_loop(spark):
    r = random.Random(1)
    rows = [(r.choice("ab"), r.choice("fg"), r.randint(1, 60), "x", r.choice([0.1, 0.5, 0.9]), "") for _ in range(200)]
    kept = []
    for n, (c, f, line, _, conf, _) in sorted(enumerate(rows), key=lambda x: (-x[1][4], x[1][2], x[0])):
        if not any(k[0] == c and k[1] == f and abs(k[2] - line) <= 5 for k in kept):
            kept.append((c, f, line))
    assert _lines(C.one_per_site(claims(spark, rows))) == sorted(kept)


def test_fill_gaps_within_and_across_cases(spark):
    published = claims(spark, [("a", "f", 10, "x", 0.9, "")])
    extra = claims(spark, [("a", "f", 12, "r", 0.9, ""), ("a", "f", 20, "r", 0.9, ""), ("a", "f", 22, "r", 0.9, ""), ("b", "f", 11, "r", 0.9, "")])
    assert _lines(C.fill_gaps(published, extra)) == [("a", "f", 20), ("b", "f", 11)]
    assert _lines(C.fill_gaps(published, extra, scope="global")) == [("a", "f", 20)]


def test_best_cap_agree_fresh(spark):
    df = claims(spark, [("a", "f", 1, "x", 0.5, ""), ("a", "f", 1, "y", 0.9, ""), ("a", "f", 2, "z", 0.9, ""), ("a", "g", 1, "x", 0.3, "")])
    best = C.best_per_line(df)
    assert sorted(r["type"] for r in best.collect()) == ["x", "y", "z"]
    assert [r["type"] for r in C.cap(best, 2).orderBy("ord").collect()] == ["y", "z"]
    assert C.cap(best, 0).count() == 3 and C.cap(best, 0, room=True).count() == 0 and C.cap(best, 9).count() == 3
    verdict = spark.createDataFrame([("a", "f", 1, "y", "established", 1), ("a", "f", 2, "z", "established", 1), ("a", "f", 2, "z", "unsettled", 2)], "case_id string, file string, line int, type string, verdict string, ord int")
    assert [r["type"] for r in C.agreed(df, verdict).collect()] == ["y"]
    assert [r["type"] for r in C.agreed(df, verdict, verdict.filter("type = 'z'")).collect()] == []
    assert _lines(C.fresh(df, df.filter("type = 'z'"))) == [("a", "f", 1), ("a", "g", 1)]
    assert C.above_floor(df, 0.6).count() == 2
    again = C.appended(df, df)
    assert [r["ord"] for r in again.orderBy("ord").collect()] == list(range(8))


def test_targets_only_after_a_claim(spark):
    files = spark.createDataFrame([("a", "x.py", "head", ""), ("a", "y.py", "head", ""), ("a", "z.md", "head", ""), ("b", "x.py", "head", "")], "case_id string, path string, side string, text string")
    left = C.targets(files, claims(spark, [("a", "x.py", 1, "t", 0.5, "")]))
    assert [(r["case_id"], r["path"]) for r in left.collect()] == [("a", "y.py")]


def _labels(spark, rows):
    """rows: (case, type, in_scope, required, [(file, a, b)...])"""
    out = []
    for n, (case, kind, scope, need, places) in enumerate(rows):
        fam = dict((k, f) for k, f, *_ in kinds.kinds()).get(kind)
        out.append((case, f"{case}-f{n}", n, kind, fam, scope, need, scope and need, "t", places))
    return spark.createDataFrame(out, "case_id string, finding_id string, label_ord int, type string, family string, in_scope boolean, required boolean, scored boolean, title string, spans array<struct<file: string, start_line: int, end_line: int>>")


def test_match_rungs_and_scores(spark):
    found = matching.ranked(claims(spark, [("a", "f", 10, "xss", 0.9, ""), ("a", "f", 12, "sql_injection", 0.8, ""), ("a", "f", 50, "xss", 0.7, ""), ("a", "h", 5, "nobody", 0.7, ""), ("b", "f", 1, "null_deref", 0.2, "")]))
    labels = _labels(spark, [("a", "sql_injection", True, True, [("f", 10, 10)]), ("a", "xss", True, False, [("z", 1, 1), ("f", 44, 45)]), ("a", "other", True, True, [("h", 5, 5)]), ("b", "xss", False, True, [("f", 11, 12)]), ("b", "xss", True, True, [("q", 1, 1)])])
    scores = {r["rung"]: r for r in matching.score(found, labels, matching.match(found, labels)).collect()}
    loc = scores["location"]
    assert (loc["predictions"], loc["tp"], loc["neutral_optional"], loc["neutral_out_scope"], loc["fp"], loc["fn"]) == (5, 2, 1, 1, 1, 1)
    exact = scores["type"]
    assert (exact["tp"], exact["neutral_optional"], exact["fp"], exact["fn"]) == (1, 1, 3, 2)
    assert scores["family"]["tp"] == 1  # unknown families agree with none
    assert loc["precision"] == 2 / 3 and loc["recall"] == 2 / 3


def test_tolerance_boundary_and_one_to_one(spark):
    found = matching.ranked(claims(spark, [("a", "f", 10, "x", 0.9, ""), ("a", "f", 13, "x", 0.5, "")]))
    labels = _labels(spark, [("a", "x", True, True, [("f", 14, 20)])])
    one = {"location": "none"}
    assert matching.match(found, labels, 3, one).count() == 1
    assert [(r["rank"], r["distance"]) for r in matching.match(found, labels, 4, one).collect()] == [(2, 1)]
    assert matching.match(found, labels, 0, one).count() == 0
    assert matching.match(found, labels, None, one).count() == 1


def _maximum(edges):
    match = {}

    def grow(p, seen):
        for q in edges.get(p, ()):
            if q not in seen:
                seen.add(q)
                if q not in match or grow(match[q], seen):
                    match[q] = p
                    return True
        return False

    return sum(grow(p, set()) for p in edges)


def test_greedy_is_maximal_and_at_least_half_of_maximum(spark):
    r = random.Random(5)
    rows = [(f"c{r.randint(0, 9)}", "f", r.randint(1, 80), "x", r.random(), "") for _ in range(60)]
    labels = [(f"c{r.randint(0, 9)}", "x", True, True, [("f", n, n + r.randint(0, 3))]) for n in (r.randint(1, 80) for _ in range(60))]
    found, keys = matching.ranked(claims(spark, rows)).cache(), _labels(spark, labels).cache()
    pairs = matching.admissible_pairs(found, keys, 4).collect()
    got = matching.match(found, keys, 4, {"location": "none"}).collect()
    assert len({(m["case_id"], m["rank"]) for m in got}) == len(got) == len({(m["case_id"], m["label_ord"]) for m in got})
    edges = {}
    for p in pairs:
        edges.setdefault((p["case_id"], p["rank"]), []).append((p["case_id"], p["label_ord"]))
    best = _maximum(edges)
    assert best / 2 <= len(got) <= best
    free = {(m["case_id"], m["rank"]) for m in got}, {(m["case_id"], m["label_ord"]) for m in got}
    assert all((p["case_id"], p["rank"]) in free[0] or (p["case_id"], p["label_ord"]) in free[1] for p in pairs)


def test_spans(spark):
    df = spark.createDataFrame([(("f", 1, 3), ("f", 6, 9)), (("f", 1, 7), ("f", 6, 9)), (("f", 1, 3), ("g", 1, 3))], "a struct<file: string, start_line: int, end_line: int>, b struct<file: string, start_line: int, end_line: int>")
    assert [r[0] for r in df.select(spans.distance(F.col("a"), F.col("b"))).collect()] == [3, 0, None]
    assert df.select(spans.span_lines(F.col("a"))).first()[0] == [1, 2, 3]
    bad = df.select(spans.checked(F.struct(F.lit("f").alias("file"), F.lit(5).alias("start_line"), F.lit(2).alias("end_line"))))
    try:
        bad.collect()
        raise AssertionError("no error")
    except Exception as e:
        assert "not a range of lines" in str(e)


def test_unknown_cases(spark):
    found = claims(spark, [("zz", "f", 1, "x", 0.5, "")])
    cases = spark.createDataFrame([("a",)], "case_id string")
    try:
        matching.require_known(found, cases)
        raise AssertionError("no error")
    except ValueError as e:
        assert "zz" in str(e)
