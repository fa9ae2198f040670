"""The library's operators bound to the tables of a star schema, each over whole tables.

No table there is a change, so columns stand in: an order is a case, its items are findings and labels, users' events are claims,
and lines of documents are lines of files. Each binding gives every row a unique order, so that ties are decided alike everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kinds
from .functions import answers, text
from .operators import claims as reduce, diff, matching, packs, rules as content, spans, symbols
from .plans import reports, stages
from .sources.scratch import kept

#: Kinds that stand in for values, by remainder.
KINDS = ("xss", "sql_injection", "null_deref", "no_such_kind")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kind(number) -> F.Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), (number % len(KINDS) + 1).cast("int"))


def event_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a case, an event type a file, hours since 2020 the line, the value a confidence."""
    hours = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2020-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("case_id"), F.col("event_type").alias("file"), hours.cast("int").alias("line"), F.col("value").alias("confidence"), F.col("event_id").alias("ord")
    )


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item is a finding."""
    line = (F.col("l_linenumber") * 3).cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("case_id"), F.col("l_returnflag").alias("file"), line.alias("line"), line.alias("end_line"), _kind(F.col("l_partkey")).alias("type"), F.col("l_discount").alias("confidence"),
        F.lit("d").alias("detector"), F.lit("detect").alias("stage"), F.col("l_linestatus").alias("message"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def order_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order has three labels, each in two places that follow from its customer and key."""
    rows = table(spark, sf_dir, "orders")
    start = lambda n: (F.pmod(F.col("o_custkey") * n + F.col("o_orderkey"), F.lit(22)) + 1).cast("int")
    place = lambda file, n, more: F.struct(F.lit(file).alias("file"), start(n).alias("start_line"), (start(n) + more).alias("end_line"))
    labels = F.array(*[F.struct(F.lit(n).alias("n"), F.array(place(a, n, n), place(b, n + 5, 0)).alias("spans")) for n, (a, b) in enumerate((("A", "N"), ("N", "R"), ("R", "A")))])
    kind = _kind(F.col("o_custkey") + F.col("n"))
    scope, need = (F.col("o_orderkey") + F.col("n")) % 5 > 0, (F.col("o_custkey") + F.col("n")) % 4 > 0
    return rows.select("o_orderkey", "o_custkey", F.inline(labels)).select(
        F.col("o_orderkey").cast("string").alias("case_id"), F.concat_ws("-f", "o_orderkey", "n").alias("finding_id"), F.col("n").alias("label_ord"), kind.alias("type"), kinds.family(kind).alias("family"), scope.alias("in_scope"), need.alias("required"),
        (scope & need).alias("scored"), F.lit("t").alias("title"), F.transform("spans", spans.checked).alias("spans"),
    )


def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scorecard(order_findings(spark, sf_dir), order_labels(spark, sf_dir), 4)


def band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.ranked(order_findings(spark, sf_dir))
    return matching.match(found, order_labels(spark, sf_dir), 4).select("rung", "case_id", "rank", "label_ord", "distance")


def site_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.one_per_site(event_claims(spark, sf_dir)).select("case_id", "file", "line", "ord")


def argmax_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.best_per_line(event_claims(spark, sf_dir)).select("case_id", "file", "line", "ord")


def cap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review keeps the six most confident findings of a change."""
    return reduce.cap(event_claims(spark, sf_dir), 6).select("case_id", "ord")


def proximity_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases are published, other events fill the gaps; all types are one file."""
    rows = event_claims(spark, sf_dir)
    one = F.lit("f")
    published, extra = rows.filter("file = 'purchase'"), rows.filter("file <> 'purchase'")
    return reduce.fill_gaps(published.withColumn("file", one), extra.withColumn("file", one)).select("case_id", "line", "ord")


def gap_fill_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same across cases, a file being a user and type."""
    rows = event_claims(spark, sf_dir).withColumn("file", F.concat_ws("/", F.col("case_id"), F.col("ord") % 2)).withColumn("case_id", (F.col("ord") % 7).cast("string"))
    return reduce.fill_gaps(rows.filter("confidence > 50"), rows.filter("confidence <= 50"), scope="global").select("file", "line", "ord")


def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two verifiers by return flag and line status."""
    items = table(spark, sf_dir, "lineitem").withColumn("type", _kind(F.col("l_partkey")))
    key = [F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("file"), F.col("l_linenumber").alias("line"), "type"]
    ord_ = F.col("l_partkey") * 10000 + F.col("l_suppkey")
    claimed = items.select(*key, ord_.alias("ord"))
    one = items.select(*key, F.when(F.col("l_discount") > 0.03, "established").otherwise("unsettled").alias("verdict"), ord_.alias("ord"))
    two = items.filter("l_quantity > 5").select(*key, F.when(F.col("l_tax") > 0.02, "established").otherwise("contradicted").alias("verdict"), ord_.alias("ord"))
    return reduce.agreed(claimed, one, two).select("case_id", "file", "line", "type", "ord")


def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _document_files(spark, sf_dir)
    return diff.lines_of_files(files).select(F.col("case_id").cast("long").alias("doc_id"), "line_no", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def _document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), F.lit("t.py").alias("path"), F.lit("head").alias("side"), "text")


def moved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the first half of a document are deleted, those of the second half added: a multiset difference."""
    rows = table(spark, sf_dir, "documents").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n")).withColumn("half", F.floor(F.size("lines") / 2).cast("int"))
    body = F.concat(
        F.lit("diff --git a/t.py b/t.py\n--- a/t.py\n+++ b/t.py\n@@ -1,"), F.col("half").cast("string"), F.lit(" +1,"), (F.size("lines") - F.col("half")).cast("string"), F.lit(" @@\n"),
        F.array_join(F.transform("lines", lambda x, i: F.concat(F.when(i < F.col("half"), "-").otherwise("+"), x)), "\n"),
    )
    cases = rows.select(F.col("doc_id").cast("string").alias("case_id"), body.alias("diff"))
    gone = diff.removed_lines(cases)
    return gone.select(F.col("case_id").cast("long").alias("doc_id"), (F.col("i") - 4).alias("at"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines like `MAX_<brand> = <size or 0>`, made of parts."""
    parts = table(spark, sf_dir, "part")
    brand = F.upper(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"))
    stem = F.element_at(F.array(*[F.lit(x) for x in ("MAX_", "verify_", "NAME_", "  retry_", "        limit_")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", "_ids", "_hosts")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    value = (
        F.when(F.col("p_size") % 4 == 0, "0")
        .when(F.col("p_size") % 4 == 1, F.concat(F.lit('"'), F.col("p_type"), F.lit(","), F.col("p_size").cast("string"), F.lit('"')))
        .when(F.col("p_size") % 4 == 2, "None  # off")
        .otherwise(F.col("p_size").cast("string"))
    )
    return parts.select(F.col("p_partkey").alias("line_no"), F.concat(stem, brand, tail, F.lit(" = "), value).alias("text"))


def off_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.off_values(content.assignments(_settings(spark, sf_dir))).select("line_no", "name", "value")


def string_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.string_lists(content.assignments(_settings(spark, sf_dir))).select("line_no", "name", "value")


def weakened_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of an order are lines of a test; those returned are deleted, open ones added; even part keys assert."""
    items = table(spark, sf_dir, "lineitem")
    line = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("    assert p"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("    asserted = "), F.col("l_partkey").cast("string")))
    rows = items.select(F.col("l_orderkey").cast("string").alias("case_id"), F.lit("test_t.py").alias("path"), F.col("l_linenumber").alias("line_no"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("i"), line.alias("text"), "l_returnflag")
    out = content.weakened(rows.filter("l_returnflag <> 'N'"), rows.filter("l_returnflag = 'N'"))
    return out.select("case_id", "line_no", "text", "gone", "new")


def contract_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's properties as an answer: a number is the line, every third answer is broken."""
    events = table(spark, sf_dir, "events")
    line = F.get_json_object("props", "$.k")
    said = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"findings": [{"file": "'), "event_type", F.lit('", "line": '), line, F.lit(', "type": "xss", "title": "t", "confidence": '), F.col("event_id") % 5, F.lit("}]}")))
    found, rejects = answers.parse_answers(events.select(F.col("event_id").cast("string").alias("case_id"), said.alias("text")))
    good = found.select(F.col("case_id").cast("long").alias("event_id"), F.lit("claim").alias("stage"), "file", "line", "confidence")
    bad = rejects.select(F.col("case_id").cast("long").alias("event_id"), "stage", F.lit("").alias("file"), F.lit(0).alias("line"), F.lit(0.0).alias("confidence"))
    return good.unionByName(bad)


def severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(_kind(F.col("l_partkey")).alias("type"))
    return reports.severity_counts(rows)


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are what is wanted; labels are stored answers, toxic ones failed."""
    wanted = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("case_id"), "turn")
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.when(F.col("toxic") == 1, "failed").otherwise("").alias("error"))
    return reduce.unanswered(wanted, stored)


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    asked = turns.select(text.estimated_tokens(F.coalesce("text", F.lit(""))).alias("estimated_prompt_tokens"), F.col("turn").alias("code_lines"))
    told = turns.select(F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("prompt_tokens"), F.col("turn").alias("duration_ms"), F.when(F.col("role") == "user", "").otherwise("e").alias("error"))
    return stages.budget(asked, told)


def verdict_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    said = F.when(F.col("l_returnflag") == "A", "established").when(F.col("l_returnflag") == "R", "contradicted").otherwise("unsettled")
    stands = F.when(F.col("l_linestatus") == "F", said).otherwise("unsettled")
    return stages.verdict_counts(items.select(stands.alias("verdict"), said.alias("claimed_verdict"), F.when(F.col("l_quantity") > 49, "e").alias("error")))


def label_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_labels(spark, sf_dir).select("case_id", "label_ord", F.posexplode("spans").alias("span_ord", "s"))
    return rows.select("case_id", "label_ord", "span_ord", "s.file", "s.start_line", "s.end_line")


def comment_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders want a comment with their priority; customers' orders with other status have one already."""
    orders = table(spark, sf_dir, "orders")
    body = F.concat(F.lit(f"{reports.HEADING}\n"), "o_orderpriority")
    wanted = orders.select(F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_orderkey").alias("pull_id"), body.alias("body"), F.lit("abc").alias("head_commit"))
    old = F.when(F.col("o_orderkey") % 4 == 0, body).when(F.col("o_orderkey") % 4 == 1, F.lit("someone else's")).otherwise(F.lit(f"{reports.HEADING}\nold"))
    existing = orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("pull_id"), F.col("o_custkey").alias("id"), old.alias("raw"), (F.col("o_orderkey") % 5 == 0).alias("inline"), F.lit(False).alias("deleted"))
    heads = orders.select(F.col("o_orderkey").alias("pull_id"), F.when(F.col("o_orderkey") % 6 == 0, "zzz").otherwise("abcdef").alias("current"))
    return reports.comment_plan(wanted, existing, heads).select("pull_id", "action", F.coalesce("comment_id", F.lit(-1).cast("long")).alias("comment_id"))


def normalised_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a gutter, as a model would copy them."""
    line = F.format_string("%5d + |   %s\t %s", F.col("p_partkey"), F.upper("p_name"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.normalise(line).alias("line"))


def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a case with one changed settings file (its items) and one unchanged file; written, as cases are read from a file."""
    return kept(_made_cases(spark, sf_dir), "cases")


def _made_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("MAX_"), F.col("l_partkey").cast("string"), F.lit(" = "), F.floor("l_quantity").cast("string")).alias("t"), F.col("l_partkey").alias("p")))).alias("rows")
    )
    new = F.array_join(F.transform("rows", lambda x: F.when(x["p"] % 3 == 0, F.regexp_replace(x["t"], " = .*$", " = 0")).otherwise(x["t"])), "\n")
    changed = F.transform(F.filter(F.transform("rows", lambda x, i: F.struct((i + 1).cast("int").alias("n"), x["p"].alias("p"))), lambda y: y["p"] % 3 == 0), lambda y: y["n"])
    n = F.size("rows").cast("string")
    hunk = F.concat(
        F.lit("diff --git a/settings.py b/settings.py\n--- a/settings.py\n+++ b/settings.py\n@@ -1,"), n, F.lit(" +1,"), n, F.lit(" @@\n"),
        F.array_join(F.transform("rows", lambda x: F.when(x["p"] % 3 == 0, F.concat(F.lit("-"), x["t"], F.lit("\n+"), F.regexp_replace(x["t"], " = .*$", " = 0"))).otherwise(F.concat(F.lit(" "), x["t"]))), "\n"),
    )
    return items.select(
        F.col("l_orderkey").cast("string").alias("case_id"), F.lit(True).alias("labelled"), F.lit("t").alias("pr_title"), F.lit("").alias("pr_description"), F.array(F.lit("settings.py")).alias("changed_files"), changed.alias("lines"),
        F.create_map(F.lit("settings.py"), new).alias("head_files"), F.create_map(F.lit("lib.py"), F.lit("def f():\n    return MAX_1\n")).alias("context_files"), hunk.alias("diff"),
        F.array_join(F.transform("rows", lambda x: x["t"]), "\n").alias("before"), F.lit("abc").alias("head_commit"),
    ).withColumn("added_lines", F.when(F.size("lines") > 0, F.create_map(F.lit("settings.py"), F.col("lines"))).otherwise(F.create_map().cast("map<string, array<int>>"))).drop("lines")


def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content.run_rules(test_cases(spark, sf_dir)).select("case_id", "file", "line", "type", "quote")


def parse_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = diff.parse_diff(test_cases(spark, sf_dir))
    return parsed.select("case_id", F.explode("added_lines").alias("path", "lines")).select("case_id", "path", F.explode("lines").alias("line"))


def base_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.base_revision(test_cases(spark, sf_dir)).select("case_id", "path", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def symbol_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.symbols(diff.files_of(test_cases(spark, sf_dir))).groupBy("case_id", "role").agg(F.count("*").alias("uses"))


def case_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.packs(test_cases(spark, sf_dir), with_facts=True, with_deletions=True).select("case_id", "code_lines", "estimated_prompt_tokens")


QUERIES = (
    scorecard, band_match, site_dedupe, argmax_per_line, cap_topk, proximity_gap_fill, gap_fill_global, agreement, lines_explode, moved_lines, off_values, string_lists, weakened_tests,
    contract_parse, severity_rollup, resume_anti, budget, verdict_pivot, label_spans, comment_plan, normalised_lines, rule_findings, parse_diff, base_revision, symbol_uses, case_packs,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import case_queries

    return {f.__name__: f for f in QUERIES} | case_queries.queries()
