"""Operators on changes, bound to the orders of a star schema: an order is a pull request whose files are made from its items.

settings.py holds a line an item, some of them switched off by the change (in every fifth case the file was called old_settings.py before); some cases add
new_conf/config.py, delete gone.py, or weaken test_t.py and move a line of it; lib.py is left as it is. What follows for each case can be said in SQL from
the items alone, without a diff, which is how the oracles say it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import schemas
from .functions import answers, text
from .operators import anchoring, changes, claims as reduce, diff, matching, packs, quotes, rules as content, spans, symbols
from .plans import reports, stages
from .queries import _kind, order_findings, order_labels, table
from .sources import model, tables
from .sources.scratch import kept

LIB = "def f():\n    return MAX_1\n"


#: An order's key, and what its items are numbered by.
_ITEM_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey", "l_extendedprice")


def _item_texts() -> list[Column]:
    """old, new and off of an item."""
    name, off = F.concat(F.lit("MAX_"), F.col("l_partkey").cast("string"), F.lit(" = ")), F.col("l_partkey") % 3 == 0
    number = F.floor("l_quantity").cast("string")
    return [F.concat(name, number).alias("old"), F.concat(name, F.when(off, "0").otherwise(number)).alias("new"), off.alias("off")]


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, line (from 1), p, old and new text, off (whether the change touches it) of each item."""
    order = Window.partitionBy(_ITEM_ORDER[0]).orderBy(*_ITEM_ORDER[1:])
    rows = table(spark, sf_dir, "lineitem").withColumn("line", F.row_number().over(order)).select("*", *_item_texts())
    return rows.select(F.col("l_orderkey").alias("k"), "line", F.col("l_partkey").alias("p"), "old", "new", "off", F.col("l_suppkey").alias("s"), F.col("l_discount").alias("d"), F.col("l_quantity").alias("q"))


def change_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and the columns of a case; written, as cases are read from a file."""
    return kept(_made_cases(spark, sf_dir), "cases")


def stored_changes(spark: SparkSession, sf_dir: str) -> changes.Changes:
    """The same cases with their files by content."""
    return changes.split(change_cases(spark, sf_dir))


def _made_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An order's items are sorted where they are gathered, as order_items numbers them; what is printed of each is made before.
    items = table(spark, sf_dir, "lineitem").select(*_ITEM_ORDER).repartition("l_orderkey").select("*", *_item_texts())
    printed = F.when(F.col("off"), F.concat(F.lit("-"), "old", F.lit("\n+"), "new")).otherwise(F.concat(F.lit(" "), "old"))
    item = F.struct(*_ITEM_ORDER[1:], "new", "off", printed.alias("printed"))
    by_order = items.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    k, n = F.col("k").cast("string"), F.size("items")
    body = F.array_join("items.printed", "\n")
    renamed, adds, deletes, weakens = F.col("k") % 5 == 0, F.col("k") % 4 == 1, F.col("k") % 4 == 2, F.col("k") % 3 == 0
    settings = F.when(renamed, F.concat_ws("\n", F.lit("diff --git a/old_settings.py b/settings.py\nsimilarity index 60%\nrename from old_settings.py\nrename to settings.py\n--- a/old_settings.py\n+++ b/settings.py"), _hunk(n, n), body)).otherwise(
        F.concat_ws("\n", F.lit("diff --git a/settings.py b/settings.py\n--- a/settings.py\n+++ b/settings.py"), _hunk(n, n), body)
    )
    config = F.concat(F.lit('ALLOWED_HOSTS = "a'), k, F.lit(',b"\nAPI_TOKEN = "tok'), k, F.lit('xyz"\n_unused_'), k, F.lit(" = "), (F.col("k") % 50).cast("string"))
    new_file = F.concat_ws("\n", F.lit("diff --git a/new_conf/config.py b/new_conf/config.py\nnew file mode 100644\n--- /dev/null\n+++ b/new_conf/config.py"), _hunk(0, 3), F.concat(F.lit("+"), F.replace(config, F.lit("\n"), F.lit("\n+"))))
    gone = F.concat_ws("\n", F.lit("diff --git a/gone.py b/gone.py\ndeleted file mode 100644\n--- a/gone.py\n+++ /dev/null"), _hunk(2, 0), F.concat(F.lit("-def gone():\n-    return "), k))
    checked = F.concat(F.lit("    assert "), k)
    test = F.concat_ws(
        "\n", F.lit("diff --git a/test_t.py b/test_t.py\n--- a/test_t.py\n+++ b/test_t.py"), _hunk(5, 3),
        F.concat(F.lit(" def test_a():\n-    assert 1\n-    assert 2\n-"), checked, F.lit("\n     x = 1\n+"), checked),
    )
    head = F.map_from_entries(
        F.array_compact(
            F.array(
                F.when(adds, F.struct(F.lit("new_conf/config.py").alias("path"), config.alias("text"))),
                F.struct(F.lit("settings.py").alias("path"), F.array_join("items.new", "\n").alias("text")),
                F.when(weakens, F.struct(F.lit("test_t.py").alias("path"), F.concat(F.lit("def test_a():\n    x = 1\n"), checked).alias("text"))),
            )
        )
    )
    off_lines = F.array_compact(F.transform("items", lambda x, at: F.when(x["off"], at + 1)))
    numbers = lambda *xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    added = F.map_from_entries(
        F.array_compact(
            F.array(
                F.when(adds, F.struct(F.lit("new_conf/config.py").alias("path"), numbers(1, 2, 3).alias("lines"))),
                F.when(F.size(off_lines) > 0, F.struct(F.lit("settings.py").alias("path"), off_lines.alias("lines"))),
                F.when(weakens, F.struct(F.lit("test_t.py").alias("path"), numbers(3).alias("lines"))),
            )
        )
    )
    return by_order.select(
        "k",
        k.alias("case_id"),
        (F.col("k") % 2 == 0).alias("labelled"),
        F.concat(F.lit("Change "), k).alias("pr_title"),
        F.when(F.col("k") % 3 == 1, "It tidies up.").otherwise("").alias("pr_description"),
        F.map_keys(head).alias("changed_files"),
        F.when(deletes, F.array(F.lit("gone.py"))).otherwise(F.array().cast("array<string>")).alias("deleted_files"),
        added.alias("added_lines"),
        head.alias("head_files"),
        F.create_map(F.lit("lib.py"), F.lit(LIB)).alias("context_files"),
        F.concat_ws("\n", F.when(deletes, gone), F.when(adds, new_file), settings, F.when(weakens, test)).alias("diff"),
        F.concat(F.lit("abc"), k).alias("head_commit"),
        F.struct(F.col("k").alias("id"), F.concat(F.lit("http://forge/"), k).alias("url"), F.lit("b").alias("source_branch"), F.lit("main").alias("destination_branch")).alias("pull_request"),
    )


def _hunk(old: Column | int, new: Column | int) -> Column:
    def side(n) -> Column:
        n = F.lit(n) if isinstance(n, int) else n
        return F.concat(F.when(n == 0, "0,").otherwise("1,"), n.cast("string"))

    return F.concat(F.lit("@@ -"), side(old), F.lit(" +"), side(new), F.lit(" @@"))


def item_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item is a claim about its line of settings.py; every seventh names lib.py, which the change leaves alone."""
    rows = order_items(spark, sf_dir)
    file = F.when(F.col("p") % 7 == 0, "lib.py").otherwise("settings.py")
    ord_ = F.col("line").cast("long")
    return rows.select(
        F.col("k").cast("string").alias("case_id"), ord_.alias("ord"), file.alias("file"), F.col("line").cast("int").alias("line"), F.col("line").cast("int").alias("end_line"), _kind(F.col("p")).alias("type"),
        F.col("d").alias("confidence"), F.lit("m").alias("detector"), F.lit("detect").alias("stage"), F.concat(F.lit("about | "), F.col("old")).alias("message"), F.col("old").alias("quote"),
    )


def _sha(column) -> Column:
    return F.sha2((F.col(column) if isinstance(column, str) else column).cast("binary"), 256)


def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed and deleted files, and added lines, read from the diff: renames, new files and deletions included."""
    def rows(what: str, path: Column, line: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), path.alias("path"), line.alias("line"))

    whole = lambda what, paths: F.transform(paths, lambda p: rows(what, p, F.lit(0)))
    added = F.flatten(F.transform(F.map_entries("added_lines"), lambda e: F.transform(e["value"], lambda n: rows("added", e["key"], n))))
    parsed = diff.parse_diff(change_cases(spark, sf_dir))
    return parsed.select("case_id", F.inline_outer(F.concat(whole("changed", F.col("changed_files")), whole("deleted", F.col("deleted_files")), added))).filter("path IS NOT NULL")


def restored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file of the revision before the change."""
    return diff.base_revision(stored_changes(spark, sf_dir)).select("case_id", "path", _sha("text").alias("text_sha256"))


def deleted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted lines that did not come back, at their place on the new side."""
    return diff.removed_lines(change_cases(spark, sf_dir)).select("case_id", "path", "new_no", "text")


def case_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four content rules, in their order."""
    return content.run_rules(stored_changes(spark, sf_dir)).select("case_id", "ord", "file", "line", "type", "quote", "detector", "message")


def claim_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line to each side of a claim, deleted rows at their place."""
    rows = diff.excerpts(stored_changes(spark, sf_dir), item_claims(spark, sf_dir), 1, with_deletions=True)
    return rows.select("case_id", "ord", F.size("rows").alias("n_rows"), _sha(F.array_join("rows", "\n")).alias("rows_sha256"))


def case_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model is shown of a case, without the facts."""
    return packs.packs(stored_changes(spark, sf_dir), with_deletions=True).select("case_id", "code_lines", _sha("user").alias("user_sha256"), "estimated_prompt_tokens")


def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of what a model is shown of a case."""
    return packs.packs(stored_changes(spark, sf_dir), with_facts=True, with_deletions=True).select("case_id", "code_lines", _sha("user").alias("user_sha256"), "estimated_prompt_tokens")


def name_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unused private names and equal literals, as far as the change defines them."""
    return symbols.facts(stored_changes(spark, sf_dir)).select("case_id", "ord", "subject", "statement")


def look_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions, uses, text search and a listing over all files of the cases."""
    whole = stored_changes(spark, sf_dir)
    files = changes.files_of(whole)
    listed = symbols.list_files(changes.listing(whole), "new_conf/").select(F.lit("file").alias("what"), "case_id", "path", F.lit(0).alias("line"), F.lit("").alias("text"))
    names = symbols.find_names(whole, defined=("test_a", "MAX_3"), used=("MAX_1",)).select("what", "case_id", "path", "line", "text")
    return listed.unionByName(names).unionByName(symbols.search(files, "= 0").select(F.lit("text").alias("what"), "case_id", "path", "line", "text"))


def claim_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims held to the files that their change touches; every ninth case changes no code."""
    cases = change_cases(spark, sf_dir)
    none = F.col("k") % 9 == 0
    cases = cases.withColumn("head_files", F.when(none, F.create_map(F.lit("readme.md"), F.lit("x"))).otherwise(F.col("head_files")))
    return anchoring.scope(item_claims(spark, sf_dir), cases).select("case_id", "ord", "kept", "detail")


def claim_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims quote the old text of their line: it may be there, elsewhere, deleted, or in a file that is not shown."""
    found = anchoring.anchor(item_claims(spark, sf_dir), stored_changes(spark, sf_dir), with_deletions=True)
    return found.select("case_id", "ord", "verdict", "claimed_line", "line", "detail")


def remaining_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed code files that a first read (the first item of each other case) left without a claim."""
    first = item_claims(spark, sf_dir).filter("ord = 1").filter(F.col("case_id").cast("long") % 2 == 0)
    return reduce.targets(changes.listing(stored_changes(spark, sf_dir)), first).select("case_id", "path")


def continued_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second read's claims: within the remaining files, the first of each line, behind those there are."""
    cases, claimed = change_cases(spark, sf_dir), item_claims(spark, sf_dir)
    first = claimed.filter("file = 'lib.py'")
    place = F.when(F.col("ord") % 2 == 0, "settings.py").otherwise("test_t.py")
    second = claimed.withColumn("file", place).withColumn("line", F.ceil(F.col("line") / 2).cast("int"))
    fresh = reduce.fresh(reduce.within(second, reduce.targets(changes.listing(cases), first)), first)
    return reduce.appended(first, fresh).select("case_id", "ord", "file", "line", "type")


def settled_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's verdict cites its old text at a line up to some lines off: it stands if the text is there before or after the change."""
    rows = order_items(spark, sf_dir)
    evidence = F.array(F.struct(F.lit("./settings.py").alias("file"), (F.col("line") + F.col("s") % 6).cast("int").alias("line"), F.col("old").alias("quote")))
    verdict = F.element_at(F.array(*[F.lit(v) for v in answers.VERDICTS]), (F.col("p") % 3 + 1).cast("int"))
    said = rows.select(F.col("k").cast("string").alias("case_id"), F.col("line").cast("long").alias("ord"), verdict.alias("verdict"), F.when(F.col("p") % 5 > 0, evidence).otherwise(F.slice(evidence, 1, 0)).alias("evidence"))
    return anchoring.settle(said, stored_changes(spark, sf_dir)).select("case_id", "ord", "claimed_verdict", "verdict", F.to_json("evidence_checked").alias("checked"))


def verdict_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as verdicts of a model: some unreadable, some with a verdict that there is not, some with odd evidence."""
    events = table(spark, sf_dir, "events")
    line = F.get_json_object("props", "$.k")
    verdict = F.element_at(F.array(*[F.lit(v) for v in (*answers.VERDICTS, "maybe")]), (F.col("event_id") % 4 + 1).cast("int"))
    told = F.concat(F.lit('{"needed": "n", "evidence": [{"file": "a.py", "line": '), line, F.lit(', "quote": "'), "event_type", F.lit('"}, 7], "reason": "'), "event_type", F.lit('", "verdict": "'), verdict, F.lit('"}'))
    said = F.when(F.col("event_id") % 7 == 0, "{").when(F.col("event_id") % 7 == 1, "[1]").otherwise(told)
    rows = answers.parse_verdicts(events.select("event_id", said.alias("text")))
    one = F.get("evidence", F.lit(0))
    return rows.select("event_id", "verdict", "reason", F.size("evidence").alias("n_evidence"), F.coalesce(one["line"], F.lit(-1)).alias("line"), F.coalesce(one["quote"], F.lit("")).alias("quote"))


def case_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comment under each pull request; every other case has no findings, and every fourth changes no code."""
    cases = change_cases(spark, sf_dir).withColumn("head_files", F.when(F.col("k") % 4 == 3, F.create_map(F.lit("readme.md"), F.lit("x"))).otherwise(F.col("head_files")))
    found = item_claims(spark, sf_dir).filter(F.col("case_id").cast("long") % 2 == 0)
    return reports.comments(cases, found, "run", "model").select("case_id", "pull_id", "findings", _sha("body").alias("body_sha256"))


def report_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report: each finding with its verdict and the label it reached, and the labels that none did."""
    cases = change_cases(spark, sf_dir)
    rows = reports.entries(cases, order_findings(spark, sf_dir), order_labels(spark, sf_dir), 4)
    found = rows.select("case_id", F.posexplode("findings").alias("n", "f")).select(
        "case_id", F.lit("finding").alias("what"), F.col("f.file").alias("file"), F.col("f.line").alias("line"), F.col("f.type").alias("type"), F.col("f.verdict").alias("verdict"), F.coalesce("f.assigned_to.finding_id", F.lit("")).alias("label"),
        F.coalesce("f.assigned_to.same_type", F.lit(False)).alias("same_type"), F.coalesce("f.assigned_to.same_family", F.lit(False)).alias("same_family"), F.col("f.severity").alias("severity"),
    )
    missed = rows.select("case_id", F.explode("missed").alias("m")).select(
        "case_id", F.lit("missed").alias("what"), F.col("m.file").alias("file"), F.col("m.lines")[0].alias("line"), F.col("m.type").alias("type"), F.lit("").alias("verdict"), F.col("m.finding_id").alias("label"),
        F.lit(False).alias("same_type"), F.lit(False).alias("same_family"), F.lit("").alias("severity"),
    )
    return found.unionByName(missed)


def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each finding stands in its case's report."""
    labels = order_labels(spark, sf_dir).limit(0)
    rows = reports.entries(change_cases(spark, sf_dir), item_claims(spark, sf_dir), labels)
    return rows.select("case_id", F.posexplode("findings").alias("pos", "f")).select("case_id", "pos", "f.file", "f.line", "f.type")


def overlaid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of cases that have settings.py on both sides: the changed one counts."""
    before = F.create_map(F.lit("settings.py"), F.lit("old"), F.lit("notes.txt"), F.lit("n"))
    cases = change_cases(spark, sf_dir).withColumn("context_files", before).withColumn("head_files", F.map_filter("head_files", lambda p, _: p == "settings.py"))
    return changes.files_of(changes.split(cases)).select("case_id", "path", "side", _sha("text").alias("text_sha256"))


def example_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in added lines; every other new_conf/config.py is called an example, in which none is looked for."""
    name = F.when(F.col("k") % 8 == 1, "new_conf/config.py.example").otherwise("new_conf/config.py")
    renamed = lambda p, _: F.when(p == "new_conf/config.py", name).otherwise(p)
    cases = change_cases(spark, sf_dir).withColumn("head_files", F.transform_keys("head_files", renamed)).withColumn("added_lines", F.transform_keys("added_lines", renamed))
    return content.run_rules(changes.split(cases), ("secret.literal",)).select("case_id", "file", "line")


class FirstNewRow:
    """A model that accuses the first new row of settings.py, a file that it was not shown, and a row that nobody wrote."""

    name = "stub"

    def complete(self, system: str, user: str, schema: dict | None = None) -> model.Response:
        row = re.search(r"# FILE settings\.py\n\n```\n(?:.*\n)*? *(\d+) \+ \| (.*)", user)
        claims = [{"file": "lib.py", "line": 1, "type": "xss", "title": "t", "confidence": 0.9, "quote": "def f():"}, {"file": "settings.py", "line": 1, "type": "xss", "title": "t", "confidence": 0.8, "quote": "no such row"}]
        if row:
            claims.append({"file": "settings.py", "line": int(row[1]), "type": "unsafe_default", "title": "t", "confidence": 0.7, "quote": row[2]})
        # A claim of a line that another one names would be the weaker of the two.
        return model.Response(text=answers.render_answer(claims if not row or row[1] != "1" else [claims[0], claims[2]]))

    def chat(self, messages: list[dict], tools: list | None = None, schema: dict | None = None, **_: object) -> dict:
        """Reads settings.py once, then judges by the number in its first row, which it cites."""
        seen = [m["content"] for m in messages if m["role"] == "tool"]
        if schema is None and not seen:
            return {"message": {"tool_calls": [{"function": {"name": "read_file", "arguments": {"path": "settings.py"}}}]}}
        if schema is None:
            return {"message": {"content": "seen"}}
        first = seen[0].split("\n")[1].partition(" | ")[2]
        name = first.partition(" = ")[0]
        said = {"needed": "", "evidence": [{"file": "settings.py", "line": 1, "quote": first}], "reason": name, "verdict": "contradicted" if int(name.removeprefix("MAX_")) % 2 else "established"}
        return {"message": {"content": json.dumps(said)}}


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage with a stub for a model: packs, answers, the strongest claims, scope, anchors."""
    got = stages.detect(stored_changes(spark, sf_dir), FirstNewRow, detector="stub")
    return got["predictions"].select("case_id", "file", "line", "type", "confidence", "detector", "stage", "quote")


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stage with the same stub: each case's first claim is asked about, with a look at the repository."""
    first = item_claims(spark, sf_dir).filter("ord = 1")
    got = stages.verify(stored_changes(spark, sf_dir), first, lambda: FirstNewRow().chat)
    return got["verdicts"].select("case_id", "ord", "claimed_verdict", "verdict", "tool_calls", "reason")


def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.entries(change_cases(spark, sf_dir), order_findings(spark, sf_dir), order_labels(spark, sf_dir), 4)
    return reports.summary(rows)


def _answer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pull_id, head_commit, is_defective, findings of even orders: an item is a finding, as good at the line before its own if it isn't the first."""
    equal = F.when(F.col("line") > 1, F.array(F.struct(F.lit("settings.py").alias("file"), (F.col("line") - 1).cast("int").alias("start_line"), F.col("line").cast("int").alias("end_line"))))
    finding = F.struct(
        F.lit(None).cast("string").alias("finding_id"), _kind(F.col("s")).alias("type"), F.lit("settings.py").alias("file"), F.col("line").cast("int").alias("start_line"), F.when(F.col("p") % 2 == 0, F.col("line").cast("int")).alias("end_line"),
        equal.alias("equivalent_locations"), F.when(F.col("p") % 3 > 0, F.col("d") < 0.08).alias("in_scope"), F.when(F.col("p") % 5 > 0, F.col("q") < 45).alias("required"), F.lit("t").alias("title"),
        F.lit(False).alias("cross_file"), F.lit(False).alias("pure_deletion"), F.lit("").alias("rationale"),
    )
    rows = order_items(spark, sf_dir).filter(F.col("k") % 2 == 0).groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", finding.alias("f")))), lambda x: x["f"]).alias("findings"))
    return rows.select(F.col("k").alias("pull_id"), F.concat(F.lit("abc"), F.col("k").cast("string"), F.lit("ff")).alias("head_commit"), F.lit(True).alias("is_defective"), "findings")


def ingested(spark: SparkSession, sf_dir: str) -> changes.Changes:
    """Cases made of pull requests, diffs, snapshots and an answer key."""
    made = change_cases(spark, sf_dir)
    end = lambda commit, branch: F.struct(F.struct(commit.alias("hash")).alias("commit"), F.struct(F.lit(branch).alias("name")).alias("branch"))
    pulls = made.select(
        F.col("k").alias("id"), F.col("pr_title").alias("title"), F.lit(None).cast("string").alias("description"), end(F.col("head_commit"), "b").alias("source"), end(F.lit("base"), "main").alias("destination"),
        F.struct(F.struct(F.concat(F.lit("http://forge/"), "case_id").alias("href")).alias("html")).alias("links"),
    )
    trees = changes.files_of(made.withColumn("case_id", F.col("head_commit"))).select(F.col("case_id").alias("commit"), "path", "text")  # each case has a commit of its own
    return stages.ingest_changes(pulls, made.select(F.col("k").alias("pull_id"), "diff"), trees, _answer_keys(spark, sf_dir))


def ingested_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ingested(spark, sf_dir)
    paths = lambda side: F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("path")))), ",").alias(side)
    listed = changes.listing(got).groupBy("case_id").agg(paths("head"), paths("context"))
    return got.cases.join(listed, "case_id").select(
        "case_id", "labelled", "is_defective", F.array_join("changed_files", ",").alias("changed"), F.array_join("deleted_files", ",").alias("deleted"), "head", "context", F.size("findings").cast("long").alias("n_findings"),
        F.coalesce(F.get("findings", F.lit(0))["finding_id"], F.lit("")).alias("first_finding"), "head_commit", "base_commit", F.col("pull_request.url").alias("url"),
    )


def ingested_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each content of the ingested repositories once, with how many cases and paths have it."""
    got = ingested(spark, sf_dir)
    used = got.files.groupBy("sha").agg(F.count_distinct("case_id").alias("n_cases"), F.size(F.collect_set("path")).cast("long").alias("n_paths"))
    return got.blobs.join(used, "sha").select("sha", F.octet_length("text").cast("long").alias("n_bytes"), "n_cases", "n_paths")


def parsed_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What parsing each content of code once gives: its top-level statements and its names, by role."""
    got = stored_changes(spark, sf_dir)
    rows = symbols.blob_symbols(changes.blobs_of(changes.files_of(got).filter(F.col("path").endswith(".py"))))
    return rows.filter("role <> 'file'").groupBy("sha", "role").agg(F.count("*").alias("n"), F.size(F.collect_set("name")).cast("long").alias("n_names"))


def constants_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed files that hold nothing but constants: settings.py of three items or more; new_conf/config.py has a name in lower case."""
    return symbols.constants_modules(stored_changes(spark, sf_dir))


def ingested_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer key as a table of labels, with their families, scope, equivalent places, and whether the change touches the own one."""
    cases = ingested(spark, sf_dir).cases
    rows = spans.label_table(cases).join(cases.select("case_id", "added_lines"), "case_id")
    touched = spans.touches(F.col("spans")[0], F.col("added_lines"))
    return rows.select("case_id", "finding_id", "label_ord", "type", F.coalesce("family", F.lit("-")).alias("family"), "scored", touched.alias("touched"), F.posexplode("spans").alias("span_ord", "s")).select(
        "case_id", "finding_id", "label_ord", "type", "family", "scored", "touched", "span_ord", "s.file", "s.start_line", "s.end_line"
    )


def read_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a predictions file with gaps: a line or a start, no end, no confidence, a title for a message."""
    items = table(spark, sf_dir, "lineitem")
    some = lambda what, n: F.when(F.col("l_partkey") % n > 0, what)
    line = F.col("l_linenumber").cast("int")
    rows = items.select(
        F.col("l_orderkey").cast("string").alias("case_id"), F.lit("a.py").alias("file"), some(line, 2).alias("line"), F.when(F.col("l_partkey") % 2 == 0, line + 10).alias("start_line"), some(line + 20, 3).alias("end_line"), some(_kind(F.col("l_suppkey")), 5).alias("type"),
        some(F.col("l_discount"), 7).alias("confidence"), F.lit(None).cast("string").alias("detector"), F.lit(None).cast("string").alias("stage"), some(F.col("l_shipdate").cast("string"), 4).alias("message"), F.lit("title").alias("title"), F.lit(None).cast("string").alias("quote"),
        (F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("ord"),
    )
    return tables.as_predictions(rows).select("case_id", "ord", "file", "line", "end_line", "type", "confidence", "detector", "message")


def case_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with fields left out, read with their defaults."""
    rows = change_cases(spark, sf_dir).drop("k")
    some = F.col("case_id").cast("long") % 2 == 0
    kind = {f.name: f.dataType for f in spark.createDataFrame([], schemas.CASES).schema}
    full = rows.select(*[F.when(some | F.lit(n == "case_id"), F.col(n)).cast(kind[n]).alias(n) if n in rows.columns else F.lit(None).cast(kind[n]).alias(n) for n in kind])
    out = tables.with_defaults(full)
    return out.select("case_id", "labelled", "pr_title", F.size("changed_files").alias("n_changed"), F.size("added_lines").alias("n_added"), F.size("context_files").alias("n_context"), F.size("findings").alias("n_findings"), (F.length("diff") > 0).alias("has_diff"), "base_commit")


def stranger_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of cases that are not there (orders below a price), and pull requests that only the answer key has."""
    known = table(spark, sf_dir, "orders").filter("o_totalprice > 20000").select(F.col("o_orderkey").cast("string").alias("case_id"))
    strangers = matching.unknown_cases(item_claims(spark, sf_dir), known).select(F.lit("finding").alias("what"), F.col("case_id").cast("long").alias("id"))
    keys = stages.unknown_keys(_answer_keys(spark, sf_dir), known.select(F.col("case_id").cast("long").alias("id")))
    return strangers.unionByName(keys.select(F.lit("key").alias("what"), F.col("pull_id").alias("id")))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that both verifiers established, above the floor; no two lines of a case are within a radius of 0, and rule findings fill lines without a claim."""
    claims = kept(item_claims(spark, sf_dir), "item-claims")  # read by both verifiers, too
    one = claims.select(*reduce.KEY, F.when(F.col("confidence") > 0.02, "established").otherwise("unsettled").alias("verdict"), "ord")
    two = claims.select(*reduce.KEY, F.when(F.col("line") % 4 > 0, "established").otherwise("contradicted").alias("verdict"), "ord")
    rules = stages.rules(change_cases(spark, sf_dir))
    out = stages.publish(claims, one, two, rule_findings=rules, radius=0, min_confidence=0.05)
    return out.select("case_id", "ord", "file", "line", "type", "stage")


def publish_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = kept(item_claims(spark, sf_dir), "item-claims")
    rules = kept(stages.rules(change_cases(spark, sf_dir)), "rules")  # published, and counted
    every = stages.publish(claims, claims.select(*reduce.KEY, F.lit("established").alias("verdict"), "ord"), rule_findings=rules, radius=0, min_confidence=0.0)
    return stages.publish_counts(every, rules, 0.05)


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over parts: paths, places, cells, shortened and hashed texts, clamped numbers, ratios."""
    parts = table(spark, sf_dir, "part")
    ends = F.element_at(F.array(*[F.lit(x) for x in ("./src\\test_a.py", " lib/a_test.py", "x/conftest.py", "a.md", "test_a.txt")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    path = text.clean_path(ends)
    long = F.concat_ws(" |\t", F.lit("  "), "p_name", "p_brand", F.repeat("p_type", (F.col("p_partkey") % 8).cast("int")))
    return parts.select(
        "p_partkey", path.alias("path"), text.basename(path).alias("base"), text.is_code(path).alias("is_code"), text.is_test_file(path).alias("is_test"), text.location(path, F.col("p_size"), F.when(F.col("p_size") % 2 == 0, F.col("p_size") + 2)).alias("location"),
        text.cell(long).alias("cell"), text.short(long).alias("short"), text.digest(F.col("p_name")).alias("digest"), text.clamp(F.col("p_retailprice") / 1500 - 0.3).alias("clamped"), text.ratio(F.col("p_size"), F.col("p_size") % 3).alias("ratio"),
        F.size(text.source_lines(F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("\n", "p_name", "p_type")))).alias("n_lines"),
    )


def quote_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark passages as quotes, claimed at line 1 of every document: the passages are the stated query set, set against all rows."""
    none = F.create_map().cast("map<string, array<int>>")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), none.alias("added_lines"), F.lit("").alias("diff"), F.create_map(F.lit("t.py"), F.col("text")).alias("head_files"))
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("text").alias("quote"))
    places = docs.select("case_id", F.lit("t.py").alias("file"), F.lit(1).alias("line"))
    return quotes.anchor_every(places, passages, docs).select(F.col("case_id").cast("long").alias("doc_id"), F.col("ord").alias("item_id"), "verdict", "line")


def quoted_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quoted value of a line with what stands before it, as a line of its own: the rule looks at line ends, and nothing of the line is left out."""
    lines = diff.lines_of_files(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.lit("t.py").alias("path"), F.lit("head").alias("side"), "text"))
    parts = lines.withColumn("whole", F.col("text")).select("case_id", "path", "line_no", "whole", F.posexplode(F.regexp_extract_all("text", F.lit(r'(?s)[^"]*"[^"]*"|.+'), F.lit(0))).alias("nth", "text"))
    return content.secret_lines(parts).select(F.col("case_id").cast("long").alias("doc_id"), "line_no", "nth", _sha("text").alias("part_sha256"), _sha("whole").alias("line_sha256"))


QUERIES = (
    diff_files, restored_files, deleted_rows, case_rules, claim_excerpts, case_texts, full_texts, name_facts, look_ups, claim_scope, claim_anchors, remaining_files, continued_claims, settled_verdicts, verdict_parse, case_comments,
    report_entries, report_order, overlaid_files, example_files, detected, verified, report_summary, ingested_cases, ingested_contents, parsed_contents, constants_files, ingested_labels, read_predictions, case_defaults, stranger_cases, published, publish_totals, text_functions, quote_places, quoted_secrets,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
