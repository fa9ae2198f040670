"""Cases that have their files keep them in their row: what is asked about files neither meets contents by digest nor is exchanged; contents that many cases share are dealt over tasks."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from revlens.operators import anchoring, changes, diff, packs, symbols, workspace
from revlens.plans import reports
from revlens.sources import tables
from revlens.sources.scratch import kept
from tests.cases import claims, frame, make_case

LIB = "_one = 1\nTWO = 2\n\n\ndef f():\n    return _one\n"
BEFORE = {"lib.py": LIB, "a.py": "x = 1\ny = 2\nz = 3\n", "gone.py": "g = 1\n"}
AFTER = {"lib.py": LIB, "a.py": "x = 1\nTWO_TOO = 2\n_new = 3\nz = 3\n", "n.py": "fresh = 1"}


def _cases(spark, n=6):
    return frame(spark, [make_case(f"c{k}", BEFORE, AFTER) for k in range(n)])


def _plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_files_are_read_where_they_stand(spark):
    stored = changes.split(_cases(spark))
    for rows in (changes.files_of(stored), changes.listing(stored), diff.added_rows(stored), diff._met_in_row(stored.rows)):
        assert "Exchange" not in _plan(rows)
    joined = changes.Changes(stored.cases, stored.files, stored.blobs)
    for read in (diff.base_revision, lambda c: diff.file_views(c, True), lambda c: anchoring.shown_texts(c, True), diff.added_rows):
        assert sorted(map(repr, read(stored).collect())) == sorted(map(repr, read(joined).collect()))


def test_texts_and_facts_of_small_cases_stay_in_their_row(spark, monkeypatch):
    twice = "_new = TWO_TOO = 2\nold = 2\n\n\ndef _lone():\n    return None\n\n\nclass __C:\n    _new = 7\n"
    more = [make_case("twins", BEFORE, AFTER | {"a.py": twice, "z.py": "".join(f"N{k} = 2\r\n" for k in range(20)), "bad.py": "def (", "_x.txt": "q"}), make_case("none", {"d.md": "x"}, {"d.md": "y"})]
    stored = changes.split(_cases(spark, 2).unionByName(frame(spark, more)))
    assert "Exchange" not in _plan(packs._met_in_row(stored.rows, True, True))
    reads = (symbols.facts, *(lambda c, f=f, d=d: packs.packs(c, f, d) for f in (False, True) for d in (False, True)))
    in_row = [sorted(map(repr, read(stored).collect())) for read in reads]
    assert len(in_row[0]) > 12 and any("equals (as 2)" in x for x in in_row[0])
    joined = changes.Changes(stored.cases, stored.files, stored.blobs)
    assert in_row == [sorted(map(repr, read(joined).collect())) for read in reads]
    monkeypatch.setattr(diff, "LONG", 500)  # some of the cases are small
    assert in_row == [sorted(map(repr, read(stored).collect())) for read in reads]


def test_long_diffs_of_cases_with_files(spark, monkeypatch):
    stored = changes.split(_cases(spark))
    short = [sorted(map(repr, read(stored).collect())) for read in (diff.base_revision, lambda c: diff.file_views(c, True))]
    monkeypatch.setattr(diff, "LONG", -1)
    assert short == [sorted(map(repr, read(stored).collect())) for read in (diff.base_revision, lambda c: diff.file_views(c, True))]


@pytest.mark.parametrize("hot", [2, 100_000])
def test_a_shared_content_is_dealt(spark, monkeypatch, hot):
    monkeypatch.setattr(symbols, "HOT", hot)
    rows = symbols.symbols(changes.files_of(_cases(spark)))
    got = Counter((r["case_id"], r["path"], r["name"], r["role"], r["walk_ord"]) for r in rows.collect())
    assert got == Counter((f"c{k}", p, n, role, walk) for k in range(6) for p, t in AFTER.items() for n, role, _, _, walk, *_ in symbols.symbols_of(t) if role not in symbols.ABOUT)
    assert ("_part" in _plan(rows)) == (hot == 2)


def test_one_pass_over_a_section():
    out = diff._Rows()
    lines = ["diff --git a/old b.py b/ new b.py ", "--- a/x.py", "@@ -3 +0,0 @@", "-a\r", "--- a/y.py", "@@ not a hunk", "@@ -9,0 +5,2 @@", "+b", "", "+c", "rename to late.py"]
    assert diff._read(lines, 10, out) == ("y.py", "late.py", False, False)
    assert list(zip(*out.columns, strict=True)) == [(13, 1, "-", "a", 3, 1, 1, 0), (17, 2, "+", "b", 9, 5, 5, 2), (18, 2, " ", "", 9, 6, 5, 2)]


def test_names_are_read_when_they_are_asked_for(monkeypatch):
    read, plain = [], workspace.names_of
    monkeypatch.setattr(workspace, "names_of", lambda head: read.extend(head) or plain(head))
    space = workspace.Workspace({"b.py": "def f():\n    return g\n", "a.py": "g = f()\nf()\n", "c.py": "other = 1\n", "d.txt": "f"}, {}, {})
    assert space.read_file("a.py", 1, 1) and not read
    assert space.find_definition("f") == "b.py:1: def f():" and space.find_usages("f") == "a.py:1: g = f()\na.py:2: f()" and space.find_definition("g") == "a.py:1: g = f()"
    assert sorted(read) == ["a.py", "b.py", "d.txt"]


def test_columns_ride_along_with_a_diff(spark, monkeypatch):
    cases = _cases(spark, 2)
    short = sorted(map(repr, diff.parse_diff(cases, "pr_title").collect()))
    assert len(short) == 2 and "A change" in short[0] and "Exchange" not in _plan(diff.parse_diff(cases.filter("length(diff) < 9999"), "pr_title")).partition("Union")[0]
    monkeypatch.setattr(diff, "LONG", -1)
    assert short == sorted(map(repr, diff.parse_diff(cases, "pr_title").collect()))


def test_findings_and_labels_meet_in_their_case(spark):
    told = dict(title="t", in_scope=True, required=True, equivalent_locations=None, cross_file=False, pure_deletion=False, rationale="")
    found = [{"finding_id": f"l{n}", "type": "xss", "file": "a.py", "start_line": at, "end_line": at} | told for n, at in enumerate((2, 90))]
    names = "finding_id type file start_line end_line equivalent_locations in_scope required title cross_file pure_deletion rationale".split()
    found = [tuple(f[n] for n in names) for f in found]
    cases = frame(spark, [make_case("c", BEFORE, AFTER, findings=found), make_case("quiet", BEFORE, AFTER, findings=found[1:]), make_case("none", BEFORE, AFTER), make_case("open", BEFORE, AFTER, labelled=False)])
    said = claims(spark, [("c", "a.py", 40, "xss", 0.9, ""), ("c", "a.py", 3, "sql_injection", 0.4, ""), ("open", "a.py", 1, "xss", 0.5, ""), ("gone", "a.py", 1, "xss", 0.5, "")])
    rows = reports.entries(cases, said, tables.load_labels(cases), 4)
    assert not re.search(r"hashpartitioning\(case_id#\d+, (rank|label_ord)#", _plan(rows))
    got = {r["case_id"]: ([(f["line"], f["verdict"], f["assigned_to"] and (f["assigned_to"]["finding_id"], f["assigned_to"]["same_type"])) for f in r["findings"]], [m["finding_id"] for m in r["missed"]]) for r in rows.collect()}
    assert got == {"c": ([(3, "true_positive", ("l0", False)), (40, "false_alarm", None)], ["l1"]), "quiet": ([], ["l1"]), "none": ([], []), "open": ([(1, "unscored", None)], [])}


def test_kept_tables_are_packed(spark):
    files = kept(spark.range(3), "three").inputFiles()
    assert files and all(".zstd." in f for f in files)
