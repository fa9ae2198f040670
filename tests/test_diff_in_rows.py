"""Diffs are read inside their row: nothing is sorted, windowed or exchanged but the sections of long diffs."""

from __future__ import annotations

from revlens.operators import diff

TEXT = (
    "top\ndiff --git a/a.py b/b.py\nrename from a.py\nrename to b.py\n--- a/a.py\n+++ b/b.py\n@@ -1,3 +1,3 @@ f\n same\n-gone\n-x = 1\r\n\\ No newline at end of file\n+ x = 1\n+new\n--- a/late.py\n"
    "@@ -9,0 +9 @@\n+more\ndiff --git a/b.py b/b.py\n--- a/b.py\n+++ b/b.py\n@@ -1,2 +1 @@\n--- a/kept.py\n \ndiff --git a/g.py b/g.py\ndeleted file mode 100644\n--- a/g.py\n+++ /dev/null\n@@ -1 +0,0 @@\n-y\n"
)


def _cases(spark):
    return spark.createDataFrame([("one", TEXT), ("empty", ""), ("none", None)], "case_id string, diff string")


def test_no_window_and_no_exchange_of_short_diffs(spark):
    for read in (diff.file_diffs, diff.parse_diff):
        plan = read(_cases(spark).filter("case_id IS NOT NULL"))._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort " not in plan


def test_long_and_short_diffs_read_alike(spark, monkeypatch):
    def rows(read):
        return sorted(map(repr, read(_cases(spark)).collect()))

    short = [rows(r) for r in (diff.file_diffs, diff.parse_diff, diff.removed_lines)]
    monkeypatch.setattr(diff, "LONG", -1)
    assert short == [rows(r) for r in (diff.file_diffs, diff.parse_diff, diff.removed_lines)]
    one = diff.parse_diff(_cases(spark).filter("case_id = 'one'")).first()
    assert one["changed_files"] == ["b.py"] and one["deleted_files"] == ["g.py"] and one["added_lines"] == {"b.py": [2, 3, 9]}
    gone = diff.removed_lines(_cases(spark)).orderBy("i").collect()
    assert [(r["path"], r["text"]) for r in gone] == [("b.py", "gone"), ("b.py", "-- a/kept.py"), ("g.py", "y")]
