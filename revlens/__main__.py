"""python -m revlens COMMAND: the stages over run folders (runs/<id>: tables as JSON lines, and config.json).

fetch, detect, continue, verify, rules, publish, report, comment. Model calls and comments happen only where the options ask for them.
"""

from __future__ import annotations

import argparse
import hashlib
import os
import sys
from collections.abc import Sequence
from uuid import uuid4

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .operators.claims import above_floor
from .operators.matching import require_known
from .operators import workspace
from .operators.packs import packs, system_prompt
from .plans import reports, stages
from .session import session
from .sources import forge, model, tables
from .sources.answerlog import logged
from .sources.comments import CALLS_A_MINUTE
from .sources.scratch import drop_kept, kept


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="revlens", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, **options: dict) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        p.add_argument("--id", help="name of the new run (default: the command)")
        p.add_argument("--out", default=tables.RUNS)
        for flag, how in options.items():
            p.add_argument("--" + flag.replace("_", "-"), **how)
        return p

    server = {
        "model": {}, "base_url": {"default": "http://localhost:11434"}, "stub": {"choices": sorted(model.STUBS)}, "dry_run": {"action": "store_true"}, "num_ctx": {"type": int, "default": 16384},
        "temperature": {"type": float, "default": 0.0}, "seed": {"type": int, "default": 7}, "timeout": {"type": float, "default": 300.0},
    }
    run = {"run": {"required": True}}
    command("fetch", repo={"required": True}, workspace={"required": True}, url={"required": True}, web_url={}, state={"default": "OPEN"}, answer_key={})
    command("detect", cases={}, repo={}, max_findings={"type": int, "default": 6}, resume={}, limit={"type": int, "default": 0}, case={"action": "append"}, **server)
    command("continue", max_findings={"type": int, "default": 6}, **run, **server)
    command("verify", max_tool_calls={"type": int, "default": 4}, radius={"type": int, "default": 12}, judge_location={"action": "store_true"}, limit={"type": int, "default": 0}, resume={}, **run, **(server | {"timeout": {"type": float, "default": 600.0}}))
    command("rules", cases={}, repo={})
    command("publish", agree={}, rules={}, radius={"type": int, "default": 5}, min_confidence={"type": float, "default": 0.6}, **run)
    command("report", tolerance={"type": int, "default": 10}, **run)
    command("comment", post={"action": "store_true"}, workspace={}, url={}, calls_a_minute={"type": float, "default": CALLS_A_MINUTE}, case={"action": "append"}, **run)
    return top


class Runs:
    """Reading and writing run folders."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args
        self.folder = f"{args.out}/{args.id or args.command}"

    def save(self, manifest: dict, **parts: DataFrame) -> None:
        for name, rows in parts.items():
            tables.write_rows(rows, f"{self.folder}/{name}.jsonl")
        tables.write_manifest(self.folder, tables.provenance() | manifest)
        print(f"{self.args.command}: {self.folder}")

    def begin(self, manifest: dict) -> None:
        """The manifest of a run that has not ended: what a resumed one is compared with."""
        tables.write_manifest(self.folder, tables.provenance() | manifest | {"complete": False})

    def log(self, run: str | None = None) -> str:
        """The answers that a run has so far, batch by batch."""
        return f"{tables.run_dir(run, self.args.out) if run else self.folder}/answers"

    def symbols(self) -> str:
        """What was ever parsed, by content, for all runs of this folder."""
        return f"{self.args.out}/symbols"

    @staticmethod
    def conditions(client, prompt: str) -> dict:
        """What answers depend on. A server is asked first whether it has the model, so that a run does not begin without it."""
        if problem := getattr(client, "health", str)():
            raise SystemExit(problem)
        found = {"prompt": hashlib.sha256(prompt.encode()).hexdigest()[:16]}
        build = getattr(client, "build", dict)()
        return found | ({"model_build": "/".join(str(build[k]) for k in sorted(build))} if build else {})

    def manifest(self, run: str) -> dict:
        return tables.read_manifest(tables.run_dir(run, self.args.out))

    def table(self, run: str, name: str, schema: str) -> DataFrame:
        return tables.read_rows(self.spark, f"{tables.run_dir(run, self.args.out)}/{name}.jsonl", schema)

    def claims(self, run: str) -> DataFrame:
        folder = tables.run_dir(run, self.args.out)
        return tables.read_rows(self.spark, tables.claims_file(folder), schemas.CLAIMS)

    def cases_path(self) -> str:
        return self.args.cases or tables.cases_file(self.args.repo)

    def malformed(self) -> list[tuple[str, int]]:
        """After a failure: lines of the cases file that are no JSON, by number."""
        path = getattr(self.args, "cases", None)
        return tables.check_jsonl(self.spark, path) if path and tables.path_exists(self.spark, path) else []

    def client(self):
        a = self.args
        return model.resolve_client(a.stub, a.model, a.dry_run, **({} if a.stub or a.dry_run else {"base_url": a.base_url, "context_tokens": a.num_ctx, "temperature": a.temperature, "seed": a.seed, "timeout": a.timeout}))


def fetch(r: Runs) -> int:
    """What a pull request's two commits fix is kept (by commit) beside the cases and not fetched again; each new one is fetched by a task of its own."""
    a, s = r.args, r.spark
    store = f"{tables.DATA}/{a.repo}/fetched"
    pulls = kept(forge.read_pulls(s, a.url, a.workspace, a.repo, a.state), "pulls")
    ends = forge.pull_ends(pulls)
    new = ends.join(s.read.parquet(store).select(*forge.ENDS).distinct(), list(forge.ENDS), "left_anti") if tables.path_exists(s, store) else ends
    forge.pull_files(new, a.url, a.workspace, a.web_url).write.mode("append").parquet(store)
    files = s.read.parquet(store).join(ends, list(forge.ENDS), "left_semi")
    keys = tables.load_answer_key(s, a.answer_key or tables.answer_key_file(a.repo))
    for row in stages.unknown_keys(keys, pulls).collect():
        print(f"only the answer key has pull request {row['pull_id']}", file=sys.stderr)
    diffs = files.filter("path IS NULL").select("pull_id", F.col("text").alias("diff")).dropDuplicates(["pull_id"])
    trees = files.filter("path IS NOT NULL").select("commit", "path", "text").dropDuplicates(["commit", "path"])
    cases = stages.ingest(pulls, diffs, trees, keys)
    tables.write_rows(cases, tables.cases_file(a.repo), ["case_id"])
    print(tables.cases_file(a.repo), stages.case_counts(tables.load_cases(s, tables.cases_file(a.repo))).first().asDict())
    return 0


def detect(r: Runs) -> int:
    a, client = r.args, r.client()
    cases = tables.load_cases(r.spark, r.cases_path())
    manifest = {"repository": a.repo, "cases_file": r.cases_path(), "model": a.model, "complete": client is not None}
    if client is None:
        r.save(manifest, packs=packs(cases, with_facts=True, with_deletions=True))
        return 0
    manifest |= r.conditions(client, system_prompt())
    stored = None
    if a.resume:
        tables.same_conditions(r.manifest(a.resume), manifest)
        stored = kept(r.table(a.resume, "responses", schemas.RESPONSES).unionByName(logged(r.spark, r.log(a.resume), schemas.RESPONSES)).dropDuplicates(["case_id", "error"]), "stored")
    r.begin(manifest)
    got = stages.detect(cases, lambda: client, a.max_findings, stored, detector=client.name, case_ids=a.case, limit=a.limit, log=r.log(), store=r.symbols())
    totals = stages.budget(got["packs"], got["responses"]).first().asDict()
    r.save(manifest | {"budget": totals, "call_failures": totals["failures"]}, packs=got["packs"], responses=got["responses"], rejects=got["rejects"], predictions=got["claims"], predictions_anchored=got["predictions"], out_of_scope=got["scope"].filter("NOT kept"), anchors=got["anchors"])
    return int(totals["failures"] > 0)


def continue_review(r: Runs) -> int:
    a, client, before = r.args, r.client(), r.manifest(r.args.run)
    if client is None:
        return 0
    conditions = r.conditions(client, system_prompt())
    r.begin(before | conditions)
    got = stages.continue_review(tables.cases_of(r.spark, before), r.claims(a.run), lambda: client, a.max_findings, detector=client.name, log=r.log())
    totals = stages.continue_counts(got).first().asDict()
    r.save(before | {"continued_run": a.run, "continuation": totals, "call_failures": (before.get("call_failures") or 0) + totals["failures"]}, predictions=got["predictions"], responses=got["responses"])
    return int(totals["failures"] > 0)


def verify(r: Runs) -> int:
    a, client, before = r.args, r.client(), r.manifest(r.args.run)
    if client is None:
        return 0
    conditions = r.conditions(client, workspace.SYSTEM + workspace.GUIDE)
    stored = None
    if a.resume:
        tables.same_conditions(r.manifest(a.resume).get("verifier", {}), conditions)
        stored = kept(r.table(a.resume, "verdicts", f"{schemas.VERDICTS}, ord long"), "stored")
    r.begin(before | {"verified_run": a.run, "verifier": conditions})
    got = stages.verify(tables.cases_of(r.spark, before), r.claims(a.run), lambda: client.chat, not a.judge_location, None, a.radius, a.max_tool_calls, stored, a.limit, log=r.log())
    totals = stages.verdict_counts(got["verdicts"]).first().asDict()
    r.save(before | {"verified_run": a.run, "verifier": conditions, "verdicts": totals, "errors": totals["errors"]}, verdicts=got["verdicts"], predictions=got["predictions"])
    return int(totals["errors"] > 0)


def rules(r: Runs) -> int:
    found = stages.rules(tables.load_cases(r.spark, r.cases_path()), store=r.symbols())
    r.save({"repository": r.args.repo, "cases_file": r.cases_path(), "complete": True}, predictions=found)
    return 0


def publish(r: Runs) -> int:
    a = r.args
    runs = [a.run, *([a.agree] if a.agree else [])]
    manifests = [r.manifest(x) for x in runs]
    if a.agree:
        tables.same_run(*manifests)
    verdicts = [r.table(x, "verdicts", f"{schemas.VERDICTS}, ord long") for x in runs]
    extra = r.claims(a.rules) if a.rules else r.spark.createDataFrame([], schemas.CLAIMS)
    claims = r.claims(manifests[0]["verified_run"])
    every = kept(stages.publish(claims, *verdicts, rule_findings=extra, radius=a.radius, min_confidence=0.0), "published")
    totals = stages.publish_counts(every, extra, a.min_confidence).first().asDict()
    r.save(manifests[0] | {"published_from": runs, "complete": tables.complete(*manifests), "published": totals}, predictions=above_floor(every, a.min_confidence))
    return 0


def report(r: Runs) -> int:
    a, manifest = r.args, r.manifest(r.args.run)
    cases, found = tables.cases_of(r.spark, manifest), r.claims(a.run)
    require_known(found, cases)
    labels = tables.load_labels(cases)
    rows, scores = reports.entries(cases, found, labels, a.tolerance), reports.scorecard(found, labels, a.tolerance)
    reports.json_report(rows, scores, manifest, a.tolerance).orderBy(F.col("case_id").asc_nulls_first()).coalesce(1).select("json").write.mode("overwrite").text(f"{r.folder}/report.json")
    header = reports.text_header(rows, scores, manifest, a.tolerance).withColumn("n", F.lit(""))
    body = reports.text_report(rows).select("text", F.col("case_id").alias("n"))
    header.unionByName(body).orderBy("n").coalesce(1).select("text").write.mode("overwrite").text(f"{r.folder}/report.txt")
    print(header.first()["text"])
    return 0


def comment(r: Runs) -> int:
    """One comment a case: planned, written as previews (comments.txt/case_id=...), and with --post made on the forge. A case without pull request has none; of a run
    that is not complete the silent cases get none, since nobody may have looked."""
    a, manifest = r.args, r.manifest(r.args.run)
    cases, found = tables.cases_of(r.spark, manifest), r.claims(a.run)
    require_known(found, cases)
    if a.case:
        cases = cases.filter(F.col("case_id").isin(*a.case))
    wanted = reports.comments(cases, found, a.run, manifest.get("model"))
    existing = r.spark.createDataFrame([], "pull_id long, id long, raw string, inline boolean, deleted boolean")
    plan = kept(reports.comment_plan(wanted, existing, None, tables.complete(manifest)), "comments")
    plan.filter("pull_id IS NOT NULL").select("case_id", "body").repartition("case_id").write.mode("overwrite").partitionBy("case_id").text(f"{r.folder}/comments.txt")
    log = reports.apply_plan(plan, a.url, a.workspace, manifest.get("repository"), a.post, f"{r.folder}/posts/{uuid4().hex}", calls_a_minute=a.calls_a_minute)
    r.save({"posted": a.post, "log": log}, comments=plan)
    for row in reports.action_counts(r.spark.createDataFrame([(x["action"],) for x in log], "action string")).collect():
        print(f"{row['pulls']} {row['action']}")
    return int(any(x["action"] == "failed" for x in log))


COMMANDS = {"fetch": fetch, "detect": detect, "continue": continue_review, "verify": verify, "rules": rules, "publish": publish, "report": report, "comment": comment}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    own = spark is None
    runs = Runs(spark or session(master=os.environ.get("SPARK_MASTER", "local[*]")), args)
    try:
        return COMMANDS[args.command](runs)
    except PySparkException as e:
        for path, line in runs.malformed():
            print(f"{path}:{line}: this line is malformed", file=sys.stderr)
        raise e
    finally:
        if own:  # what a command makes is in its run's folder; a caller's session may still read tables between stages
            drop_kept(runs.spark)


if __name__ == "__main__":
    sys.exit(main())
