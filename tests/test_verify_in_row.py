"""Claims of small cases meet their files in one exchange: what is asked, looked up and settled there is what joins by file give."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from revlens.operators import changes, diff, workspace
from revlens.plans import stages
from tests.cases import claims, frame, make_case

LINES = ["x = 1", "y = 2", "", "  z = f(x)", "| odd", "x = 1", "-- w", "long = 'a  b'", "tab\tbed\r"]


def _cases(spark, n=12):
    rng = random.Random(11)
    text = lambda: "\n".join(rng.choices(LINES, k=rng.randrange(1, 30)))
    made = []
    for k in range(n):
        before, after = {"a.py": text(), "l.py": text(), "b.md": text(), "gone.py": text(), "same.py": "s"}, {"a.py": text(), "l.py": text(), "b.md": text(), "same.py": "s", "new.py": text()}
        made.append(make_case(f"c{k}", before, after))
    moved = "diff --git a/old.py b/to.py\nrename from old.py\nrename to to.py\n--- a/old.py\n+++ b/to.py\n@@ -1,2 +1,2 @@\n-was = 1\n+is_ = 1\n kept = 2"
    made.append(make_case("moved", {}, {}) | {"diff": moved, "head_files": {"to.py": "is_ = 1\nkept = 2\nrest = 3"}, "context_files": {"to.py": "hidden", "c.py": "c = 1"}, "changed_files": ["to.py"], "added_lines": {"to.py": [1]}})
    made.append(make_case("empty", {"a.py": "x"}, {"a.py": ""}) | {"diff": ""})
    return frame(spark, made)


class _Looker:
    """Looks at a file of each side and for a name, then cites lines of what it was asked and shown."""

    def chat(self, messages, tools=None, schema=None, **_):
        seen = [m["content"] for m in messages if m["role"] == "tool"]
        if schema is None:
            calls = [("read_file", {"path": "a.py"}), ("read_base", {"path": "a.py", "start": 2}), ("find_definition", {"name": "x"}), ("list_files", {})]
            return {"message": {"tool_calls": [{"function": {"name": n, "arguments": a}} for n, a in calls[len(seen) :][:1]]}}
        asked = messages[1]["content"].split("\n")
        shown = [x.partition(" | ") for x in asked if " | " in x]
        cited = [(f, int(x[0][:5].strip() or 3) + 2, x[2]) for f in ("./a.py", "gone.py", "old.py", "to.py", "new.py") for x in shown]
        said = {"needed": "", "evidence": [{"file": f, "line": n, "quote": q} for f, n, q in cited], "reason": str(len("".join(seen))), "verdict": ("established", "contradicted", "unsettled")[len(asked) % 3]}
        return {"message": {"content": json.dumps(said)}}


def _claims(spark):
    rng = random.Random(13)
    ids = [f"c{k}" for k in range(0, 12, 2)] + ["moved", "empty", "stranger"]
    rows = [(c, f, rng.randrange(1, 35), rng.choice(["xss", "unknown_kind"]), 0.5, "q") for c in ids for f in ("a.py", "b.md", "new.py", "to.py", "gone.py", "nowhere.py") for _ in range(2)]
    return claims(spark, rows).withColumn("line", F.when(F.col("ord") % 11 > 0, F.col("line"))).withColumn("message", F.when(F.col("ord") % 3 > 0, F.col("message")))


def test_verdicts_in_the_row_are_those_by_joins(spark, monkeypatch):
    stored, said = changes.split(_cases(spark).cache()), _claims(spark).cache()
    joined = changes.Changes(stored.cases, stored.files, stored.blobs)
    for named in (True, False):
        judge = lambda c, named=named: stages.verify(c, said, lambda: _Looker().chat, named, radius=3)["verdicts"]
        want = judge(joined)
        rows = sorted(map(repr, want.collect()))
        assert len(rows) == 96 and len({r["verdict"] for r in want.collect()}) == 3 and want.filter("exists(evidence_checked, x -> x)").count() > 10
        for parts, long in ((64, diff.LONG), (1, diff.LONG), (5, 300)):
            with monkeypatch.context() as m:
                m.setattr(workspace, "CLAIMS_OF_ROW", parts)
                m.setattr(diff, "LONG", long)
                assert sorted(map(repr, judge(stored).select(*want.columns).collect())) == rows, (named, parts, long)


def test_a_case_meets_its_claims_in_one_exchange(spark):
    rows, said = _cases(spark, 3), _claims(spark).withColumn("definition", F.lit("d"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = workspace.with_excerpts(workspace.beside_files(rows, said), 3)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(case_id") == plan.count("Exchange") == 2


def test_files_before_the_change_and_excerpts_of_one_case(spark):
    cases = _cases(spark)
    want = sorted((r["case_id"], r["path"], r["text"]) for r in diff.base_revision(cases).collect())
    rows = cases.collect()
    assert sorted((c["case_id"], p, t) for c in rows for p, t in diff.base_of(c["diff"], c["context_files"] | c["head_files"])) == want
    said = _claims(spark).filter("case_id <> 'stranger'")
    by_id = {c["case_id"]: c for c in rows}
    for r in diff.excerpts(cases, said, 3, with_deletions=True).collect():
        c = by_id[r["case_id"]]
        gone = [x for x in diff._gone_from(c["diff"]) if x[0] == r["file"]]
        shown = diff.excerpt_of(c["head_files"][r["file"]], c["added_lines"].get(r["file"]), gone, r["line"], 3) if r["file"] in c["head_files"] and r["file"].endswith(".py") else []
        assert shown == r["rows"]


def test_sites_are_chosen_when_they_are_asked_for(spark, monkeypatch):
    found = []
    monkeypatch.setattr(stages.reduce, "one_per_site", lambda rows: found.append(rows) or rows)
    got = stages.verify(_cases(spark, 1), _claims(spark), lambda: _Looker().chat)
    assert got["verdicts"].count() > 0 and not found
    assert got["predictions"] is got["predictions"] is got["established"] and len(found) == 1
