"""The stages, each a transform of DataFrames; model and forge access are arguments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..definitions import definition_table
from ..functions.answers import claims_of, parse_answers, parse_verdicts, response_schema, verdict_schema
from ..operators import anchoring, claims as reduce, diff, packs as texts, rules as content, workspace
from ..operators.changes import Cases, Changes, blobs_of, digest, files_of, listing, nested, only, split, with_maps
from ..sources.answerlog import Asker, answered
from ..sources.model import pack_asker, told, told_beside
from ..sources.scratch import kept

CLAIM = ["case_id", "ord", "file", "line", "end_line", "type", "confidence", "detector", "stage", "message", "quote"]
CASE_COLUMNS = [
    "case_id", "labelled", "is_defective", "pr_title", "pr_description", "changed_files", "deleted_files", "added_lines", "head_files", "context_files", "diff", "findings", "base_commit", "head_commit", "pull_request",
]
Keep = Callable[[DataFrame, str], DataFrame]


def ingest(pulls: DataFrame, diffs: DataFrame, trees: DataFrame, keys: DataFrame) -> DataFrame:
    """ingest_changes in the form of a cases file."""
    rows = nested(ingest_changes(pulls, diffs, trees, keys))
    return rows.select(*CASE_COLUMNS)


def ingest_changes(pulls: DataFrame, diffs: DataFrame, trees: DataFrame, keys: DataFrame, keep: Keep = kept) -> Changes:
    """pulls, diffs (pull_id, diff), trees (commit, path, text), keys (pull_id, ...) -> cases, their files and each content once. Fails if a pull request has no diff, a key was
    written for another commit, or a changed file is in no tree. A tree is stored once however many pull requests start from it, and nothing gathers a repository in one row."""
    source = F.col("source.commit.hash")
    named = diffs.select("pull_id", "diff", F.col("diff").alias("_diff"), F.concat(F.lit("PR-"), F.col("pull_id").cast("string")).alias("case_id"))
    # A diff is read where it stands, before it meets its pull request.
    read = diff.parse_diff(named, "pull_id", "_diff").drop("case_id").withColumnRenamed("_diff", "diff").withColumn("_read", F.lit(True))
    joined = pulls.withColumn("pull_id", F.col("id")).join(read, "pull_id", "left").join(
        keys.select("pull_id", F.col("head_commit").alias("key_commit"), "is_defective", "findings"), "pull_id", "left"
    )
    unread = F.raise_error(F.format_string("pull request %d: it has no diff", "id")).cast("boolean")
    joined = joined.filter(F.when(F.col("_read"), F.lit(True)).otherwise(unread)).drop("_read")
    moved = F.col("key_commit").isNotNull() & ~F.startswith("key_commit", source)
    checked = joined.withColumn("_ok", F.when(moved, F.raise_error(F.format_string("pull request %d: the answer key is for %s, the source is now %s", "id", "key_commit", source)).cast("boolean")).otherwise(True)).filter("_ok")
    base = checked.withColumn("case_id", F.concat(F.lit("PR-"), F.col("id").cast("string"))).withColumn("commit", source)
    base = keep(base, "pulls")
    wanted = trees.join(base.select("commit").distinct(), "commit", "left_semi")
    stored = keep(wanted.withColumn("sha", digest(F.col("text"))), "trees")
    changed = base.select("case_id", F.explode("changed_files").alias("path")).withColumn("side", F.lit("head"))
    files = base.select("case_id", "commit").join(stored.select("commit", "path", "sha"), "commit").join(changed, ["case_id", "path"], "left")
    files = keep(files.select("case_id", "path", F.coalesce("side", F.lit("context")).alias("side"), "sha"), "files")
    lost = changed.join(files.select("case_id", "path"), ["case_id", "path"], "left_anti").groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("_lost"))
    message = F.concat(F.col("case_id"), F.lit(": changed but not in the tree: "), F.col("_lost"))
    out = base.join(lost, "case_id", "left").withColumn("_ok", F.when(F.col("_lost").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True)).filter("_ok")
    numbered = F.transform("findings", lambda f, k: f.withField("finding_id", F.concat("case_id", F.lit("-f"), (k + 1).cast("string"))))
    cases = out.select(
        "case_id",
        F.col("key_commit").isNotNull().alias("labelled"),
        F.coalesce("is_defective", F.lit(False)).alias("is_defective"),
        F.coalesce("title", F.lit("")).alias("pr_title"),
        F.coalesce("description", F.lit("")).alias("pr_description"),
        "changed_files",
        "deleted_files",
        "added_lines",
        "diff",
        F.coalesce(numbered, F.array().cast(keys.schema["findings"].dataType)).alias("findings"),
        F.col("destination.commit.hash").alias("base_commit"),
        F.col("commit").alias("head_commit"),
        F.struct(F.col("id"), F.col("links.html.href").alias("url"), F.col("source.branch.name").alias("source_branch"), F.col("destination.branch.name").alias("destination_branch")).alias("pull_request"),
    )
    return Changes(cases, files, blobs_of(stored))


def unknown_keys(keys: DataFrame, pulls: DataFrame) -> DataFrame:
    """Pull requests that only the answer key has, in numeric order."""
    return keys.select("pull_id").join(pulls.select(F.col("id").alias("pull_id")), "pull_id", "left_anti").orderBy("pull_id")


def _as_claims(parsed: DataFrame, detector: str, stage: str, *more: str) -> DataFrame:
    return parsed.select(
        "case_id", "ord", "file", "line", F.col("line").alias("end_line"), "type", "confidence", F.lit(detector).alias("detector"), F.lit(stage).alias("stage"), F.col("title").alias("message"), "quote", *more
    )


def held_to_change(claims: DataFrame, cases: Cases, with_deletions: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claims in scope and anchored, scope decisions, anchor decisions)"""
    scoped = anchoring.scope(claims, cases)
    decided = anchoring.anchor(scoped.filter("kept").drop("kept", "detail"), cases, with_deletions=with_deletions)
    return _held(decided), scoped, decided


def _held(decided: DataFrame) -> DataFrame:
    return anchoring.anchored_only(decided).withColumn("end_line", F.col("line")).select(*CLAIM)


def detect(cases: Cases, make_client: Callable[[], object], max_findings: int = 6, stored: DataFrame | None = None, keep: Keep = kept, detector: str = "model", case_ids: list[str] | None = None, limit: int = 0, log: str | None = None, store: str | None = None) -> dict[str, DataFrame]:
    """packs -> answers (only those that `stored` lacks) -> claims. The order is fixed: one a line, then the strongest, then scope, then anchor, so claims out of scope use
    up places. With a `log` folder answers are kept there as they come, and those it holds are not asked for again. With a `store` of symbols only contents that it lacks are parsed."""
    if case_ids:
        cases = only(cases, cases.select("case_id").filter(F.col("case_id").isin(*case_ids)))
    if limit > 0:
        cases = only(cases, keep(cases.select("case_id").orderBy("case_id").limit(limit), "chosen"))
    asker = pack_asker(make_client, response_schema(), texts.system_prompt())
    if with_maps(cases) is not None and stored is None and log is None and store is None:
        return _detect_in_row(cases, asker, max_findings, keep, detector)
    asked = texts.packs(cases, with_facts=True, with_deletions=True, store=store)
    wanted = asked if stored is None else reduce.unanswered(asked, stored)
    answers = _asked(wanted, asker, schemas.RESPONSES, keep, log, ["case_id"])
    if stored is not None:
        answers = answers.unionByName(stored.filter(F.coalesce("error", F.lit("")) == "").join(cases.select("case_id"), "case_id", "left_semi"))
    parsed, rejects = parse_answers(answers)
    strongest = _strongest(parsed, detector, max_findings)
    held, scoped, decided = held_to_change(keep(strongest, "claims"), cases)
    return {"packs": asked, "responses": answers, "rejects": rejects, "claims": strongest, "scope": scoped, "anchors": decided, "predictions": keep(held, "predictions")}


def _strongest(parsed: DataFrame, detector: str, max_findings: int) -> DataFrame:
    """Both choices are made where a case's claims are, after one exchange."""
    return reduce.cap(reduce.best_per_line(_as_claims(parsed, detector, "detect").repartition("case_id")), max_findings)


#: What stays beside a small case's answer, for its claims to be held to.
_BESIDE = ("changed_files", "head_files", "all_gone")


def _detect_in_row(cases: Cases, asker: Asker, max_findings: int, keep: Keep, detector: str) -> dict[str, DataFrame]:
    """detect of cases that have their files. The files of small ones stay beside the answer, so claims are read, chosen and held to the change in one pass over the answers, and nothing is
    exchanged; those of large ones are joined with their files."""
    asked = texts.packs(cases, with_facts=True, with_deletions=True, beside=_BESIDE)
    answers = keep(told_beside(asked, asker, schemas.RESPONSES, _BESIDE), "responses")
    responses = answers.drop(*_BESIDE)
    parsed, rejects = parse_answers(responses)
    chosen = reduce.chosen(claims_of(F.col("text")), max_findings)
    met = anchoring.met_in_row(answers.filter("all_gone IS NOT NULL"), chosen)
    scoped = anchoring.scope_in_row(_as_claims(met, detector, "detect", "changed_files", "_code", "_shown"))
    decided = anchoring.anchor_in_row(scoped.filter("kept"), CLAIM)
    held, scoped = _held(decided), scoped.drop("changed_files", "_code", "_shown")
    if not (large := answers.filter("all_gone IS NULL").select("case_id", "text")).isEmpty():
        rest = held_to_change(keep(_strongest(parse_answers(large)[0], detector, max_findings), "claims"), only(cases, large.select("case_id")))
        held, scoped, decided = (a.unionByName(b) for a, b in zip((held, scoped, decided), rest, strict=True))
    return {
        "packs": asked.drop(*_BESIDE), "responses": responses, "rejects": rejects, "claims": _strongest(parsed, detector, max_findings), "scope": scoped, "anchors": decided, "predictions": keep(held, "predictions")
    }


def _asked(wanted: DataFrame, ask: Asker, schema: str, keep: Keep, log: str | None, keys: list[str]) -> DataFrame:
    return keep(told(wanted, ask, schema), "responses") if log is None else answered(wanted, ask, schema, log, keys)


def continue_review(cases: Cases, claims: DataFrame, make_client: Callable[[], object], max_findings: int = 6, keep: Keep = kept, detector: str = "model", log: str | None = None) -> dict[str, DataFrame]:
    """Asks again about changed code files that a first read left without a claim, and adds what is new as far as there is room."""
    remaining = reduce.targets(listing(cases), claims)
    asked = texts.continuation_packs(texts.packs(cases, with_facts=True, with_deletions=True), claims, remaining)
    answers = _asked(asked, pack_asker(make_client, response_schema(), texts.system_prompt()), schemas.RESPONSES, keep, log, ["case_id"])
    parsed, rejects = parse_answers(answers)
    found = reduce.best_per_line(reduce.within(_as_claims(parsed, detector, "continue"), remaining))
    new = reduce.fresh(found, claims)
    if max_findings > 0:
        counts = claims.groupBy("case_id").agg(F.count("*").alias("_have"))
        order = F.row_number().over(_by_strength())
        new = new.join(counts, "case_id", "left").withColumn("_nth", order).filter(F.col("_nth") + F.coalesce("_have", F.lit(0)) <= max_findings).drop("_nth", "_have")
    held, scoped, decided = held_to_change(keep(new, "new-claims"), cases)
    added = keep(held, "added")
    return {"packs": asked, "responses": answers, "rejects": rejects, "added": added, "scope": scoped, "anchors": decided, "predictions": keep(reduce.appended(claims.select(*CLAIM), added), "predictions")}


def _by_strength():
    return Window.partitionBy("case_id").orderBy(F.col("confidence").desc(), "ord")


class _Parts(dict[str, DataFrame]):
    """Parts of a stage, and those that write tables while they are made, which is when they are first asked for."""

    def __init__(self, made: dict[str, DataFrame], **later: Callable[[], DataFrame]):
        super().__init__(made)
        self.later = later

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.later[name]()
        return self[name]


def verify(cases: Cases, claims: DataFrame, make_chat: Callable[[], Callable[..., dict]], named: bool = True, definitions: DataFrame | None = None, radius: int = 12, max_calls: int = 4, stored: DataFrame | None = None, limit: int = 0, keep: Keep = kept, log: str | None = None) -> dict[str, DataFrame]:
    """Each claim by itself, with tools; a decisive verdict needs evidence that exists. Stored verdicts are reused unless they failed. Claims of small cases that have their files meet these in one
    exchange, and are asked about and settled there; others meet files, base and evidence by joins, as do all with a `log`."""
    rows = with_maps(cases) if log is None else None
    known = claims if rows is not None and limit <= 0 else claims.join(cases.select("case_id"), "case_id", "left_semi")
    if limit > 0:
        known = known.orderBy("case_id", "ord").limit(limit)
    if stored is not None:
        good = stored.filter(F.coalesce("error", F.lit("")) == "").select(*reduce.KEY).distinct()
        known = known.join(good, reduce.KEY, "left_anti")
    said = definitions if definitions is not None else definition_table(cases.sparkSession)
    if rows is None:
        verdicts = _judged_by_join(cases, known, make_chat, said, named, radius, max_calls, keep, log)
    else:
        verdicts = _judged_in_row(rows.filter(diff.is_small()), known, make_chat, said, named, radius, max_calls, keep)
        large = keep(rows.filter(~diff.is_small()), "large-cases")
        if not large.isEmpty():
            rest = known.join(large.select("case_id"), "case_id", "left_semi")
            verdicts = verdicts.unionByName(_judged_by_join(split(large), rest, make_chat, said, named, radius, max_calls, keep, None))
    if stored is not None:
        verdicts = verdicts.unionByName(stored.filter(F.coalesce("error", F.lit("")) == ""), allowMissingColumns=True)
    established = claims.join(reduce.last_verdicts(verdicts).filter("verdict = 'established'").select(*reduce.KEY), reduce.KEY, "left_semi")
    return _Parts({"verdicts": verdicts, "established": established}, predictions=lambda: reduce.one_per_site(established))


def _judged_by_join(cases: Cases, known: DataFrame, make_chat: Callable[[], Callable[..., dict]], said: DataFrame, named: bool, radius: int, max_calls: int, keep: Keep, log: str | None) -> DataFrame:
    rows = diff.excerpts(cases, known, radius, with_deletions=True)
    asked = texts.questions(rows.join(F.broadcast(said), "type", "left"), named)
    base = diff.base_revision(cases) if log is None else keep(diff.base_revision(cases), "base")
    answers = _asked(asked, workspace.verdict_asker(files_of(cases), base, diff.added_of(cases), make_chat, verdict_schema(), max_calls), workspace.ANSWERS, keep, log, ["case_id", "ord"])
    joined = known.select("case_id", "ord", "file", "line", "type", F.col("message").alias("title")).join(answers, ["case_id", "ord"])
    return keep(anchoring.settle(parse_verdicts(joined), cases).drop("text"), "settled")


def _judged_in_row(rows: DataFrame, known: DataFrame, make_chat: Callable[[], Callable[..., dict]], said: DataFrame, named: bool, radius: int, max_calls: int, keep: Keep) -> DataFrame:
    """As _judged_by_join, of small cases with their files."""
    told = known.select("case_id", "ord", "file", "line", "type", "message").join(F.broadcast(said), "type", "left")
    met = workspace.with_excerpts(workspace.beside_files(rows, told), radius)
    asks = F.transform(F.arrays_zip("claims", "excerpts"), lambda x: F.struct(x["claims"]["ord"].alias("ord"), texts.question(x["claims"], x["excerpts"], named).alias("user")))
    answered_ = workspace.interviewed(met.withColumn("asks", asks), make_chat, verdict_schema(), max_calls)
    kind = "array<struct<path: string, text: string>>"
    there = F.concat(*[F.coalesce(x.cast(kind), F.array().cast(kind)) for x in (F.map_entries("head_files"), F.map_entries(_hidden("context_files", "head_files")), F.col("base"))])
    one = answered_.select("case_id", F.inline(F.arrays_zip("claims", "answers")), there.alias("_texts"))
    claim = [F.col(f"claims.{c}").alias(n) for c, n in (("ord", "ord"), ("file", "file"), ("line", "line"), ("type", "type"), ("message", "title"))]
    parsed = parse_verdicts(one.select("case_id", *claim, *[f"answers.{c}" for c in ("text", "tool_calls", "steps", "error")], "_texts"))
    return keep(anchoring.settle_in_row(parsed).drop("text"), "settled")


def _hidden(context: str, head: str) -> Column:
    """The context files that no changed file hides."""
    none = F.create_map().cast("map<string, string>")
    return F.map_filter(context, lambda k, _: ~F.map_contains_key(F.coalesce(head, none), k))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    """One row: how many verdicts, and claimed verdicts, of each sort; zero where there are none."""
    sorts = ("established", "contradicted", "unsettled")
    return verdicts.agg(
        *[F.count_if(F.col("verdict") == v).alias(v) for v in sorts], *[F.count_if(F.col("claimed_verdict") == v).alias(f"claimed_{v}") for v in sorts], F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors")
    )


def rules(cases: Cases, chosen: tuple[str, ...] = tuple(content.RULES), store: str | None = None) -> DataFrame:
    return content.run_rules(cases, chosen, store).select("case_id", "ord", "file", "line", "end_line", "type", "confidence", "detector", "stage", "message", "quote")


def publish(claims: DataFrame, *verdicts: DataFrame, rule_findings: DataFrame | None = None, radius: int = 5, min_confidence: float = 0.6, scope: str = "case") -> DataFrame:
    """What every verifier established, one a site; rule findings where nothing is published; then the floor. Columns of CLAIM; `ord` runs within a case."""
    published = kept(reduce.one_per_site(kept(reduce.agreed(claims, *verdicts).select(*CLAIM), "agreed"), radius), "one-a-site")
    out = published.withColumn("_from", F.lit(0))
    if rule_findings is not None:
        extra = reduce.fill_gaps(published, kept(rule_findings.select(*CLAIM), "rule-findings"), radius, scope)
        out = out.unionByName(extra.withColumn("_from", F.lit(1)))
    order = Window.partitionBy("case_id").orderBy("_from", "ord")
    return reduce.above_floor(out, min_confidence).withColumn("ord", F.row_number().over(order).cast("long")).select(*CLAIM)


def publish_counts(before_floor: DataFrame, rule_findings: DataFrame, min_confidence: float = 0.6) -> DataFrame:
    """One row: from_model, from_rules, already_covered, below_floor."""
    rule = F.col("stage") == "rules"
    parts = before_floor.agg(
        F.count_if(~rule).alias("from_model"), F.count_if(rule).alias("from_rules"), F.count_if(F.coalesce("confidence", F.lit(1.0)) < min_confidence).alias("below_floor")
    )
    return parts.join(rule_findings.agg(F.count("*").alias("_all"))).select("from_model", "from_rules", (F.col("_all") - F.col("from_rules")).alias("already_covered"), "below_floor")


def continue_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """One row about a continuation: cases asked, failed calls, rejects, claims added, out of scope, unsupported."""
    rows = [
        parts["packs"].agg(F.count("*").alias("asked")), parts["responses"].agg(F.count_if(F.coalesce("error", F.lit("")) != "").alias("failures")), parts["rejects"].agg(F.count("*").alias("rejects")),
        parts["added"].agg(F.count("*").alias("added")), parts["scope"].agg(F.count_if(~F.col("kept")).alias("out_of_scope")), parts["anchors"].agg(F.count_if(F.col("verdict") == "unsupported").alias("unsupported")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.join(r)
    return out


def case_counts(cases: DataFrame) -> DataFrame:
    return cases.agg(F.count("*").alias("cases"), F.count_if("labelled").alias("labelled"), F.count_if("is_defective").alias("defective"))


def anchor_counts(decided: DataFrame) -> DataFrame:
    return decided.groupBy("verdict").agg(F.count("*").alias("claims"))


def budget(packs: DataFrame, responses: DataFrame) -> DataFrame:
    """One row: mean and max estimated tokens and code lines; mean, median, max of measured tokens and latency where they were measured."""
    p = packs.agg(
        F.avg("estimated_prompt_tokens").alias("mean_estimated"), F.max("estimated_prompt_tokens").alias("max_estimated"), F.avg("code_lines").alias("mean_code_lines"), F.max("code_lines").alias("max_code_lines")
    )
    tokens, took = F.when(F.col("prompt_tokens") > 0, F.col("prompt_tokens")), F.when(F.col("duration_ms") > 0, F.col("duration_ms"))
    r = responses.agg(
        F.avg(tokens).alias("mean_tokens"), F.median(tokens).alias("median_tokens"), F.max(tokens).alias("max_tokens"), F.avg(took).alias("mean_ms"), F.max(took).alias("max_ms"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("failures")
    )
    return p.join(r)

