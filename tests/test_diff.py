import random



from revlens.operators import diff

from .cases import file_diff, frame, make_case


def test_base_and_added_lines_over_random_edits(spark):
    r, cases, before = random.Random(3), [], {}
    for k in range(12):
        words = ["a", "b", "", "-- x", "++ y", "  c", "d\t", "@@ no"]
        old = {f"f{j}.py": "\n".join(r.choice(words) for _ in range(r.randint(1, 25))) + "\n" for j in range(4)}
        new = {}
        for path, text in old.items():
            rows = text.split("\n")
            for _ in range(r.randint(0, 4)):
                at = r.randrange(len(rows))
                rows[at:at] = [r.choice(words) for _ in range(r.randint(0, 2))]
                if len(rows) > 3 and r.random() < 0.6:
                    del rows[r.randrange(len(rows) - 1)]
            if r.random() < 0.85:
                new[path] = "\n".join(rows)
        new["added.py"] = "x = 1\n"
        before[f"c{k}"] = old
        cases.append(make_case(f"c{k}", old, new))
    df = frame(spark, cases).cache()
    got = {}
    for row in diff.base_revision(df).collect():
        got.setdefault(row["case_id"], {})[row["path"]] = row["text"]
    assert got == before
    parsed = {r["case_id"]: r for r in diff.parse_diff(df).collect()}
    for c in cases:
        p = parsed[c["case_id"]]
        assert p["changed_files"] == c["changed_files"] and p["deleted_files"] == c["deleted_files"]
        head = c["head_files"]
        texts = {path: [head[path].split("\n")[n - 1] for n in lines] for path, lines in p["added_lines"].items()}
        wanted = {}
        for line_path, line in _plus(c["diff"]):
            wanted.setdefault(line_path, []).append(line)
        assert texts == wanted


def _plus(text):
    path, left = None, 0
    for line in text.split("\n"):
        if line.startswith("diff --git"):
            path, left = line.split(" b/")[1], 0
        elif line.startswith("@@"):
            old, new = line.split()[1:3]
            left = [int((x.split(",") + ["1"])[1]) for x in (old, new)]
        elif left and (left[0] > 0 or left[1] > 0):
            left = [left[0] - (line[:1] != "+"), left[1] - (line[:1] != "-")]
            if line[:1] == "+":
                yield path, line[1:]


def test_rename_and_no_newline_marker(spark):
    text = (
        "diff --git a/old.py b/new.py\nsimilarity index 90%\nrename from old.py\nrename to new.py\n--- a/old.py\n+++ b/new.py\n"
        "@@ -1,2 +1,3 @@\n a\n-b\n\\ No newline at end of file\n+b\n+c\n\\ No newline at end of file\n"
    )
    case = make_case("r", {}, {}) | {"diff": text, "head_files": {"new.py": "a\nb\nc"}, "changed_files": ["new.py"]}
    df = frame(spark, [case])
    row = diff.parse_diff(df).first()
    assert row["changed_files"] == ["new.py"] and row["added_lines"] == {"new.py": [2, 3]}
    assert {(r["path"], r["text"]) for r in diff.base_revision(df).collect()} == {("old.py", "a\nb")}
    assert diff.removed_lines(df).count() == 0  # b came back


def test_removed_lines_are_a_multiset_difference(spark):
    case = make_case("m", {"a.py": "x\ny\nx\nz\nw"}, {"a.py": "y\n  x\nw\nq"})
    rows = diff.removed_lines(frame(spark, [case])).orderBy("i").collect()
    assert sorted(r["text"] for r in rows) == ["x", "z"]


def test_excerpt_shows_deleted_lines_in_place(spark):
    old = "\n".join(f"line {n}" for n in range(1, 40))
    new = old.replace("line 20\n", "").replace("line 30", "line thirty")
    df = frame(spark, [make_case("e", {"a.py": old}, {"a.py": new})])
    claim = spark.createDataFrame([("e", 1, "a.py", 20), ("e", 2, "none.py", 3)], "case_id string, ord long, file string, line int")
    rows = {r["ord"]: r["rows"] for r in diff.excerpts(df, claim, 2, with_deletions=True).collect()}
    assert rows[2] == []
    assert rows[1] == ["   18   | line 18", "   19   | line 19", "      - | line 20", "   20   | line 21", "   21   | line 22", "   22   | line 23"]
    assert file_diff("a", None, "x").startswith("diff --git")


def test_a_long_diff_is_read_by_many_tasks(spark):
    """Sections, not cases, are dealt to tasks: line numbers run on through the whole diff, and what stands before the first file is block 0."""
    files = 200
    text = "a preface\n" + "".join(f"diff --git a/f{k}.py b/f{k}.py\n--- a/f{k}.py\n+++ b/f{k}.py\n@@ -1,2 +1,2 @@\n same\n-old {k}\n+new {k}\n" for k in range(files))
    cases = spark.createDataFrame([("one", text), ("empty", ""), ("none", None)], "case_id string, diff string")
    plan = diff.file_diffs(cases)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rows = {(r["case_id"], r["block"]): r for r in plan.collect()}
    assert set(rows) == {("one", k) for k in range(files + 1)} | {("empty", 0), ("none", 0)}
    lines = text.split("\n")
    for k in range(files):
        body = rows["one", k + 1]["rows"]
        assert rows["one", k + 1]["path"] == f"f{k}.py" and [(r["mark"], r["text"]) for r in body] == [(" ", "same"), ("-", f"old {k}"), ("+", f"new {k}")]
        assert all(lines[r["i"]] == r["mark"] + r["text"] for r in body)
    assert rows["one", 0]["rows"] == [] and rows["one", 0]["path"] is None
    tasks = diff.sections(cases.filter("case_id = 'one'")).repartition(4, "case_id", "block").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert min(tasks) > 20
