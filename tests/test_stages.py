"""Stages end to end with stub clients, sources against local servers, reports, comments, streams."""

import gzip
import io
import json
import os
import tarfile
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from revlens import schemas
from revlens.functions.answers import render_answer
from revlens.operators.spans import label_table
from revlens.plans import reports, stages
from revlens.sources import forge, model, tables, trees
from revlens.streaming.cases import case_stream, review_stream

from .cases import claims, frame, make_case

OLD = {"a.py": "def f(x):\n    if x is None:\n        return 0\n    return x.y\n", "b.py": "import a\n"}
NEW = {"a.py": "def f(x):\n    return x.y\n\n\ndef g():\n    return 1\n", "b.py": "import a\nTOKEN = 1\n", "settings.py": "MAX_ROWS = 0\n"}
KEY = [{"finding_id": "PR-1-f1", "type": "null_deref", "file": "a.py", "start_line": 2, "end_line": 2, "equivalent_locations": [], "in_scope": True, "required": True, "title": "t", "cross_file": False, "pure_deletion": True, "rationale": ""}]


class Finder:
    """A client that reports one claim a case, and on a continuation one more."""

    name = "finder"

    def complete(self, system, user, schema=None):
        if "# FILE a.py" not in user:
            return model.Response(text='{"findings": []}')
        more = "STILL TO REVIEW" in user
        claim = {"file": "settings.py" if more else "a.py", "line": 1 if more else 2, "type": "unsafe_default" if more else "null_deref", "title": "it can be None", "confidence": 0.8, "quote": "MAX_ROWS = 0" if more else "return x.y"}
        return model.Response(text=render_answer([claim]), prompt_tokens=10, duration_ms=5)

    def chat(self, messages, **_):
        said = {"needed": "", "evidence": [{"file": "a.py", "line": 2, "quote": "return x.y"}], "reason": "r", "verdict": "established"}
        return {"message": {"content": json.dumps(said)}}


@pytest.fixture(scope="module")
def cases(spark):
    rows = [make_case("PR-1", OLD, NEW, findings=[tuple(KEY[0].values())]), make_case("PR-2", {"x.md": "a"}, {"x.md": "b"}, is_defective=False)]
    return frame(spark, rows).cache()


def test_review_end_to_end(spark, cases):
    first = stages.detect(cases, Finder)
    assert [(r["file"], r["line"], r["detector"]) for r in first["predictions"].collect()] == [("a.py", 2, "model")]
    assert stages.anchor_counts(first["anchors"]).first()["verdict"] == "anchored"
    again = stages.detect(cases, model.SilentStub, stored=first["responses"])
    assert again["predictions"].count() == 1  # the stored answer was used
    more = stages.continue_review(cases, first["predictions"], Finder)
    assert [(r["file"], r["ord"]) for r in more["predictions"].orderBy("ord").collect()] == [("a.py", 0), ("settings.py", 1)]
    assert stages.continue_review(cases, first["predictions"], Finder, max_findings=1)["predictions"].count() == 1
    found = more["predictions"].cache()
    checked = stages.verify(cases, found, lambda: Finder().chat)
    assert sorted((r["file"], r["verdict"]) for r in checked["verdicts"].collect()) == [("a.py", "established"), ("settings.py", "established")]
    counts = stages.verdict_counts(checked["verdicts"]).first()
    assert counts["established"] == 2 and counts["errors"] == 0
    silent = stages.verify(cases, found, lambda: model.SilentStub().chat, named=False, stored=checked["verdicts"])
    assert silent["predictions"].count() == 2  # nothing was asked again
    rule = stages.rules(cases)
    published = stages.publish(found.filter("file = 'a.py'"), checked["verdicts"].withColumn("ord", F.lit(1)), rule_findings=rule)
    assert [(r["file"], r["line"], r["stage"]) for r in published.orderBy("ord").collect()] == [("a.py", 2, "detect"), ("settings.py", 1, "rules")]
    labels = label_table(cases)
    scores = {r["rung"]: r["f1"] for r in reports.scorecard(published, labels).collect()}
    assert scores["location"] == scores["type"] == 2 / 3
    rows = reports.entries(cases, published, labels)
    told = {r["case_id"]: r for r in rows.collect()}
    assert [f["verdict"] for f in told["PR-1"]["findings"]] == ["true_positive", "false_alarm"] and told["PR-2"]["findings"] == []
    assert "  1. a.py:2" in {r["case_id"]: r["text"] for r in reports.text_report(rows).collect()}["PR-1"]
    head = [json.loads(r["json"]) for r in reports.json_report(rows, reports.scorecard(published, labels), {"repository": "r"}).collect() if r["case_id"] is None][0]
    assert head["findings"] == 2 and head["scores"]["location"]["tp"] == 1
    comment = {r["case_id"]: r["body"] for r in reports.comments(cases, published, "run1", "m").collect()}
    assert comment["PR-1"].startswith(reports.HEADING) and "| 1 | MEDIUM | `null_deref` | `a.py:2` | it can be None |" in comment["PR-1"] and reports.NO_SOURCE in comment["PR-2"]


def test_ingest(spark):
    before, after = {"a.py": "x = 1\n", "k.py": "k"}, {"a.py": "x = 2\n", "k.py": "k", "n.py": "n"}
    text = make_case("z", before, after)["diff"]
    pulls = spark.createDataFrame([(7, "T", None, (("abc123",), ("br",)), (("def",), ("main",)), (("http://u",),)), (8, "U", "d", (("abc123",), ("br",)), (("def",), ("main",)), (("http://u",),))], "id long, title string, description string, source struct<commit: struct<hash: string>, branch: struct<name: string>>, destination struct<commit: struct<hash: string>, branch: struct<name: string>>, links struct<html: struct<href: string>>")
    diffs = spark.createDataFrame([(7, text), (8, text)], "pull_id long, diff string")
    tree = spark.createDataFrame([("abc123", p, t) for p, t in after.items()], "commit string, path string, text string")
    from revlens import schemas

    keys = spark.createDataFrame([(7, "abc123ff", True, [tuple(KEY[0].values())]), (9, "x", False, [])], f"pull_id long, head_commit string, is_defective boolean, findings array<{schemas.FINDING}>")
    rows = {r["case_id"]: r for r in stages.ingest(pulls, diffs, tree, keys).collect()}
    assert rows["PR-7"]["labelled"] and rows["PR-7"]["findings"][0]["finding_id"] == "PR-7-f1" and not rows["PR-8"]["labelled"]
    assert rows["PR-7"]["head_files"] == {"a.py": "x = 2\n", "n.py": "n"} and rows["PR-7"]["context_files"] == {"k.py": "k"} and rows["PR-7"]["added_lines"] == {"a.py": [1], "n.py": [1]}
    assert [r["pull_id"] for r in stages.unknown_keys(keys, pulls).collect()] == [9]
    for bad, why in ((keys.withColumn("head_commit", F.lit("other")), "answer key is for"), (keys, "not in the tree")):
        with pytest.raises(Exception, match=why):
            stages.ingest(pulls, diffs, tree if why[0] == "a" else tree.filter("path <> 'n.py'"), bad).collect()


def test_tables(spark, cases, tmp_path):
    path = str(tmp_path / "cases.jsonl")
    tables.write_rows(cases, path, ["case_id"])
    back = tables.load_cases(spark, path)
    assert sorted(r["case_id"] for r in back.collect()) == ["PR-1", "PR-2"] and back.filter("case_id = 'PR-1'").first()["added_lines"] == cases.filter("case_id = 'PR-1'").first()["added_lines"]
    (tmp_path / "p.jsonl").write_text('{"case_id": "PR-1", "file": "a.py", "start_line": 3, "type": "xss"}\n\n{"case_id": "PR-1", "file": "a.py", "line": 4, "end_line": 6, "confidence": 0.5}\n')
    assert [(r["line"], r["end_line"], r["confidence"], r["message"]) for r in tables.load_predictions(spark, str(tmp_path / "p.jsonl")).orderBy("line").collect()] == [(3, 3, 1.0, ""), (4, 6, 0.5, "")]
    (tmp_path / "bad.jsonl").write_text('{"case_id": "a"}\n\n{nope\n')
    assert [n for _, n in tables.check_jsonl(spark, str(tmp_path / "bad.jsonl"))] == [3]
    assert tables.read_rows(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    with pytest.raises(FileNotFoundError):
        tables.load_cases(spark, str(tmp_path / "none"))
    (tmp_path / "key.json").write_text(json.dumps({"pull_requests": {"7": {"head_commit": "abc", "is_defective": True, "findings": KEY}}}))
    assert [(r["pull_id"], r["findings"][0]["type"]) for r in tables.load_answer_key(spark, str(tmp_path / "key.json")).collect()] == [(7, "null_deref")]
    assert tables.load_answer_key(spark, str(tmp_path / "no.json")).count() == 0
    tables.write_manifest(tmp_path / "run", {"repository": "r", "complete": True})
    manifest = tables.read_manifest(tmp_path / "run")
    assert tables.recorded_cases_file(manifest) == "data/r/cases.jsonl" and tables.complete(manifest) and not tables.complete(manifest, {"complete": True, "errors": 1})
    assert tables.claims_file(tmp_path / "run").endswith("predictions.jsonl") and tables.run_dir(str(tmp_path)) == str(tmp_path) and tables.run_dir("q") == "runs/q"
    with pytest.raises(ValueError):
        tables.same_run({"verified_run": "a"}, {"verified_run": "b"})
    (tmp_path / ".env").write_text("export REVLENS_A='x'\n# no\nREVLENS_B=y\n")
    os.environ["REVLENS_B"] = "wins"
    assert tables.settings(tmp_path / ".env") == {"REVLENS_A": "x", "REVLENS_B": "wins"}


def _archive(files):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(f"top/{name}")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return gzip.compress(out.getvalue())


def test_trees(spark, tmp_path):
    (tmp_path / "abc.tar.gz").write_bytes(_archive({"a/b.py": "é".encode(), "bin": b"\xff\xfe"}))
    assert [(r["commit"], r["path"], r["text"]) for r in trees.read_trees(spark, str(tmp_path)).collect()] == [("abc", "a/b.py", "é")]


@pytest.fixture
def server():
    """Answers from a queue of (status, headers, body); keeps what was asked."""
    answers, asked = [], []

    class Handler(BaseHTTPRequestHandler):
        def _do(self):
            size = int(self.headers.get("Content-Length") or 0)
            asked.append((self.command, self.path, json.loads(self.rfile.read(size) or "null")))
            status, headers, body = answers.pop(0) if len(answers) > 1 else answers[0]
            data = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = _do

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", answers, asked
    http.shutdown()


def test_forge(spark, server, tmp_path):
    url, answers, asked = server
    client = forge.ForgeClient(url, "u", "s", str(tmp_path), wait=0.001)
    answers += [(429, {"Retry-After": "0"}, {}), (503, {}, {}), (200, {}, {"values": [{"id": 5}], "next": f"{url}/more"}), (200, {}, {"values": [{"id": 2}]})]
    assert [p["id"] for p in client.pull_requests("w", "r")] == [2, 5] and len(asked) == 4
    answers[:] = [(500, {}, {})]
    asked.clear()
    with pytest.raises(forge.ForgeError) as e:
        client.post_comment("w", "r", 1, "x")
    assert e.value.status == 500 and len(asked) == 1  # a POST is not repeated
    answers[:] = [(200, {}, b"the diff")]
    pull = {"id": 3, "source": {"commit": {"hash": "a"}}, "destination": {"commit": {"hash": "b"}}}
    asked.clear()
    assert client.diff("w", "r", pull) == client.diff("w", "r", pull) == "the diff" and len(asked) == 1
    answers[:] = [(200, {}, {"values": [{"id": 9, "content": {"raw": f"{reports.HEADING}\nold"}}, {"id": 8, "content": {"raw": "hi"}}]}), (200, {}, {"id": 9})]
    assert forge.upsert(client, "w", "r", 1, f"{reports.HEADING}\nnew", reports.is_ours) == ("updated", 9)
    answers[:] = [(200, {}, {"values": [{"id": 4, "title": "t", "source": {"commit": {"hash": "h"}}}]})]
    spark.dataSource.register(forge.PullRequestSource)
    rows = spark.read.format("pull_requests").option("url", url).option("workspace", "w").option("repositories", "a,b").load().collect()
    assert sorted((r["repository"], r["id"], r["source"]["commit"]["hash"]) for r in rows) == [("a", 4, "h"), ("b", 4, "h")]
    with pytest.raises(forge.ForgeError):
        forge.ForgeClient(url, "", "")


def test_model_server(spark, server):
    url, answers, asked = server
    chat = model.ChatServer("m", url, wait=0.001)
    answers += [(500, {}, {}), (200, {}, {"message": {"content": "{}"}, "prompt_eval_count": 3, "eval_count": 1})]
    got = chat.complete("s", "u", {"type": "object"})
    assert (got.text, got.error, got.prompt_tokens) == ("{}", "", 3) and asked[-1][2]["format"] == {"type": "object"} and "think" not in asked[-1][2]
    answers[:] = [(500, {}, {})]
    assert "HTTPError 500" in chat.complete("s", "u").error and "HTTPError 500" in chat.chat([])["error"]
    answers[:] = [(200, {}, {"models": [{"name": "m", "digest": "d", "details": {"quantization_level": "q4"}}]})]
    assert chat.health() == "" and chat.build() == {"digest": "d", "quantization": "q4"} and "not among the models" in model.ChatServer("z", url).health()
    packs = spark.createDataFrame([("a", "s", "u")], "case_id string, system string, user string")
    assert model.told(packs, model.pack_asker(lambda: model.ChatServer("m", "http://127.0.0.1:1", wait=0.001, retries=0), {}), schemas.RESPONSES).first()["error"]
    assert model.resolve_client(dry_run=True) is None and model.resolve_client("silent").name == "silent"
    with pytest.raises(ValueError):
        model.resolve_client()


def test_comment_plan(spark, cases):
    wanted = reports.comments(cases.withColumn("pull_request", F.struct(F.when(F.col("case_id") == "PR-1", 1).otherwise(2).cast("long").alias("id"))), claims(spark, [("PR-1", "a.py", 2, "xss", 0.9, "")]).withColumn("ord", F.lit(0)), "r")
    body = {r["pull_id"]: r["body"] for r in wanted.collect()}
    kind = "pull_id long, id long, raw string, inline boolean, deleted boolean"
    old = spark.createDataFrame([(1, 5, body[1] + " \n", False, False), (2, 6, reports.HEADING, True, False), (2, 7, "other", None, None)], kind)
    assert {r["pull_id"]: (r["action"], r["comment_id"]) for r in reports.comment_plan(wanted, old).collect()} == {1: ("unchanged", 5), 2: ("create", None)}
    heads = spark.createDataFrame([(1, "a" * 12), (2, "ffff")], "pull_id long, current string")
    plan = reports.comment_plan(wanted, old, heads)
    assert {r["pull_id"]: r["action"] for r in plan.collect()} == {1: "unchanged", 2: "moved"}
    assert [r["action"] for r in reports.apply_plan(plan.orderBy("pull_id"), None, "w", "r")] == ["unchanged", "moved"]
    assert {r["action"]: r["pulls"] for r in reports.action_counts(plan).collect()} == {"unchanged": 1, "moved": 1}


def test_stream(spark, cases, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    tables.write_rows(cases.filter("case_id = 'PR-1'"), str(folder), ["case_id"])
    for _ in range(2):
        review_stream(case_stream(spark, str(folder)), out, str(tmp_path / "ck")).awaitTermination()
        assert [r["file"] for r in spark.read.parquet(out).collect()] == ["settings.py"]
    cases.filter("case_id = 'PR-2'").coalesce(1).write.mode("append").json(str(folder))
    review_stream(case_stream(spark, str(folder)), out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_commands(spark, cases, tmp_path, capsys):
    from revlens.__main__ import main

    path, out = str(tmp_path / "cases.jsonl"), str(tmp_path / "runs")
    tables.write_rows(cases, path, ["case_id"])

    def run(*argv):
        return main([*argv, "--out", out], spark)

    assert run("detect", "--cases", path, "--stub", "silent", "--id", "d") == 0
    assert run("rules", "--cases", path, "--id", "r") == 0
    assert run("verify", "--run", "d", "--stub", "silent", "--id", "v1") == 0
    assert run("publish", "--run", "v1", "--rules", "r", "--id", "p") == 0
    assert tables.read_manifest(f"{out}/p")["published"] == {"from_model": 0, "from_rules": 1, "already_covered": 0, "below_floor": 0}
    assert run("report", "--run", "p", "--id", "rep") == 0
    assert run("comment", "--run", "p", "--id", "c") == 0
    assert "Findings: 1" in capsys.readouterr().out
    assert [x["action"] for x in tables.read_manifest(f"{out}/c")["log"]] == ["create", "create"]
    assert (tmp_path / "runs" / "rep" / "report.txt").exists()
