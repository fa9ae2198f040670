"""Holding claims to their change: scope by file, anchor by quote. Both are joins on (case, file)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_path, let, normalise, normalised_text
from .changes import Cases, files_of, touches_code, with_maps
from .diff import base_revision, last_line, lines_of_text, shown_files

MIN_QUOTE = 4
SLACK = 3


def scope(claims: DataFrame, cases: Cases) -> DataFrame:
    """claims with `kept` and `detail`: a claim must be about a file that its change touches, and the change must touch code."""
    rows = with_maps(cases)
    if rows is None:
        facts = cases.select("case_id", "changed_files").join(touches_code(cases).withColumnRenamed("code", "_code"), "case_id", "left")
    else:
        facts = rows.select("case_id", "changed_files", F.exists(F.map_keys("head_files"), lambda p: p.endswith(".py")).alias("_code"))
    return _scoped(claims.join(facts, "case_id", "left")).drop("_code", "changed_files")


def _scoped(claims: DataFrame) -> DataFrame:
    """claims with changed_files and _code (is code changed?) of their case -> the same with kept and detail."""
    inside = F.coalesce(F.array_contains("changed_files", F.col("file")), F.lit(False))
    code = F.coalesce("_code", F.lit(False))
    detail = F.when(~code, "no code file is changed").when(~inside, F.concat(F.lit("unchanged file: "), "file")).otherwise("")
    return claims.withColumn("kept", code & inside).withColumn("detail", detail)


def shown_texts(cases: Cases, with_deletions: bool = False) -> DataFrame:
    """One row a file that is shown: case_id, file, _said (its normalised lines, from 1 on without a gap), _top (how many), _lost (deleted lines: i, at, said)."""
    files = shown_files(cases, with_deletions)
    return files.select("case_id", F.col("path").alias("file"), *_said_of(F.col("lines"), F.col("last"), F.col("gone") if with_deletions else None))


def _said_of(lines: Column, last: Column, gone: Column | None) -> list[Column]:
    """_said, _top and _lost of a file."""
    top = F.greatest(last, F.lit(0))
    said = F.array_join(F.transform(F.slice(lines, F.lit(1), top), normalise), "\n")
    return [said.alias("_said"), top.alias("_top"), _lost_of(gone).alias("_lost")]


def _lost_of(gone: Column | None) -> Column:
    none = F.array().cast("array<struct<i: int, at: int, said: string>>")
    if gone is None:
        return none
    rows = F.transform(gone, lambda r: F.struct(r["i"].alias("i"), r["new_no"].alias("at"), normalise(r["text"]).alias("said")))
    return F.coalesce(F.sort_array(rows), none)


def met_in_row(rows: DataFrame, claims: Column) -> DataFrame:
    """rows: case_id, changed_files, head_files, all_gone (array of GONE) of small cases; claims: an array of theirs -> one row a claim: case_id, its fields, changed_files, _code, and _shown (what
    shown_texts has of its file, or null). Nothing is joined: a claim stands beside its case's files."""

    def shown(e: Column, gone: Column) -> Column:
        own = F.filter(gone, lambda r: r["path"] == e["key"])
        made = lambda *said: F.struct(e["key"].alias("path"), *said)
        by_line = let(lines_of_text(e["value"]), lambda lines: let(last_line(lines), lambda last: made(*_said_of(lines, last, own))))
        top = lambda text: F.when(text == "", 0).otherwise(F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"))) + 1)
        whole = let(normalised_text(F.coalesce(e["value"], F.lit(""))), lambda text: made(text.alias("_said"), top(text).alias("_top"), _lost_of(own).alias("_lost")))
        return F.when(e["value"].contains("| "), by_line).otherwise(whole)

    head = F.coalesce("head_files", F.create_map().cast("map<string, string>"))
    claimed = F.filter(F.map_entries(head), lambda e: e["key"].endswith(".py") & F.exists("_claims", lambda c: c["file"] == e["key"]))
    code = F.exists(F.map_keys(head), lambda p: p.endswith(".py"))
    cases = rows.withColumn("_claims", claims).select("case_id", "_claims", "changed_files", code.alias("_code"), F.transform(claimed, lambda e: shown(e, F.col("all_gone"))).alias("_files"))
    one = cases.select("case_id", F.inline_outer("_claims"), "changed_files", "_code", "_files").filter("ord IS NOT NULL")
    return one.withColumn("_shown", F.get(F.filter("_files", lambda s: s["path"] == F.col("file")), F.lit(0))).drop("_files")


def scope_in_row(met: DataFrame) -> DataFrame:
    """scope of the claims of met_in_row, which keep what they have met."""
    return _scoped(met)


def anchor_in_row(scoped: DataFrame, columns: list[str], min_quote: int = MIN_QUOTE) -> DataFrame:
    """anchor (with deletions) of claims of met_in_row."""
    quoted = scoped.select(*columns, normalise(F.coalesce("quote", F.lit(""))).alias("_quote"), *[F.col("_shown")[c].alias(c) for c in ("_said", "_top", "_lost")])
    return _anchored(quoted, columns, min_quote)


def quote_hits(quoted: DataFrame, min_quote: int = MIN_QUOTE) -> DataFrame:
    """Rows with _quote and a file's text, with _found (lines that hold the quote) and _gone (the place of the first deleted line that does)."""
    return quoted.withColumns(hits_of(F.col("_quote"), min_quote))


def hits_of(quote: Column, min_quote: int) -> dict[str, Column]:
    """_found and _gone of a quote in the file of the row."""
    known = F.char_length(quote) >= min_quote
    # A quote holds no line feed, so one search through the file's text tells whether any line has it; only then are the lines looked at.
    found = F.when(known & F.col("_said").contains(quote), F.array_compact(F.transform(F.split("_said", "\n"), lambda x, k: F.when(x.contains(quote), k + 1))))
    lost = F.when(known & (F.size("_lost") > 0), F.get(F.filter("_lost", lambda x: x["said"].contains(quote)), F.lit(0)))
    return {"_found": found, "_gone": lost["at"]}


def anchor(claims: DataFrame, cases: Cases, min_quote: int = MIN_QUOTE, with_deletions: bool = False) -> DataFrame:
    """claims (case_id, ord, file, line, quote) with claimed_line, line, verdict and detail.

    anchored: the quote is the line named; snapped: it is exactly one other line; ambiguous: several; deleted-line: a line that the change
    deleted (if those are shown); unchecked: too short, or the file isn't shown; unsupported: nowhere. A claim meets its file as one row, and its quote is looked for
    inside it; quotes.anchor_shared and anchor_every are for few quotes that are claimed of many files.
    """
    shown = shown_texts(cases, with_deletions)
    quoted = claims.withColumn("_quote", normalise(F.coalesce("quote", F.lit("")))).join(shown, ["case_id", "file"], "left")
    return _anchored(quoted, claims.columns, min_quote)


def _anchored(quoted: DataFrame, columns: list[str], min_quote: int) -> DataFrame:
    there = F.when(F.col("line").between(1, F.col("_top")), F.split_part("_said", F.lit("\n"), F.greatest(F.col("line"), F.lit(1))))
    told = F.struct("_quote", "_top", there.alias("_there"), *[c.alias(n) for n, c in hits_of(F.col("_quote"), min_quote).items()])
    # No filter on a verdict goes back through a generator, where it would look for the quote several times more.
    return decided(quoted.select(*columns, F.inline_outer(F.array(told))), columns, min_quote)


def decided(rows: DataFrame, columns: list[str], min_quote: int = MIN_QUOTE) -> DataFrame:
    """rows: claims with _quote, _there (the line named), _top (null: not shown), _found, _gone."""
    there, quote, known = F.col("_there"), F.col("_quote"), F.char_length("_quote") >= min_quote
    here = F.coalesce(known & (there != "") & (there.contains(quote) | quote.contains(there)), F.lit(False))
    out = rows.withColumns({"_here": here, "_hits": F.size("_found"), "_hit": F.get("_found", F.lit(0)), "_shown": F.when(F.col("_top") > 0, F.lit(True))})
    short, unseen = F.char_length("_quote") < min_quote, F.col("_shown").isNull()
    verdict = (
        F.when(short | unseen, "unchecked")
        .when(F.col("_here"), "anchored")
        .when(F.col("_hits") == 1, "snapped")
        .when(F.col("_hits") > 1, "ambiguous")
        .when(F.col("_gone").isNotNull(), "deleted-line")
        .otherwise("unsupported")
    )
    out = out.withColumn("verdict", verdict)
    detail = (
        F.when(short, "less was quoted than identifies a line")
        .when(unseen, "nothing of that file was shown")
        .when(F.col("verdict") == "snapped", F.concat(F.lit("moved to line "), F.col("_hit"), F.lit(", the one that holds the quote")))
        .when(F.col("verdict") == "ambiguous", F.concat(F.col("_hits"), F.lit(" lines hold the quote")))
        .when(F.col("verdict") == "deleted-line", F.concat(F.lit("quoted from what the change deletes, before line "), F.col("_gone")))
        .when(F.col("verdict") == "unsupported", "no line shown holds the quote")
        .otherwise("")
    )
    line = F.when(F.col("verdict") == "snapped", F.col("_hit")).when(F.col("verdict") == "deleted-line", F.col("_gone")).otherwise(F.col("line"))
    return out.withColumn("claimed_line", F.col("line")).withColumn("detail", detail).withColumn("line", line).select(*[c for c in columns if c != "line"], "line", "verdict", "claimed_line", "detail")


def anchored_only(decided: DataFrame) -> DataFrame:
    return decided.filter("verdict <> 'unsupported'")


def cited(evidence: DataFrame, cases: Cases, slack: int = SLACK) -> DataFrame:
    """evidence (case_id, claim, nth, file, line, quote) with `found`: is the quote, or a line that it contains, within `slack` lines of the line
    named, after the change or before it?"""
    items = evidence.withColumn("_quote", normalise(F.coalesce("quote", F.lit("")))).withColumn("path", clean_path(F.coalesce("file", F.lit(""))))
    texts = files_of(cases).select("case_id", "path", "text").unionByName(base_revision(cases))
    named = items.filter(F.char_length("_quote") >= MIN_QUOTE).select("case_id", "claim", "nth", "path", "line", "_quote")
    found = named.join(texts, ["case_id", "path"]).filter(_holds(F.col("text"), F.col("line"), F.col("_quote"), slack)).select("case_id", "claim", "nth").distinct().withColumn("found", F.lit(True))
    return items.join(found, ["case_id", "claim", "nth"], "left").withColumn("found", F.coalesce("found", F.lit(False))).drop("_quote", "path")


def _holds(text: Column, line: Column, quote: Column, slack: int) -> Column:
    """Is the quote, or a line that it contains, within `slack` lines of the line named?"""
    first = F.greatest(line - slack, F.lit(1))
    near = F.slice(F.split(text, "\n"), first, F.greatest(line + slack - first + 1, F.lit(0)))
    return F.exists(F.transform(near, normalise), lambda x: x.contains(quote) | ((x != "") & quote.contains(x)))


def settle_in_row(verdicts: DataFrame, slack: int = SLACK) -> DataFrame:
    """settle of verdicts that stand beside `_texts`, the path and text of their case's files after the change and before it: nothing is joined."""

    def checked(e: Column) -> Column:
        hit = lambda path, quote: F.exists("_texts", lambda t: (t["path"] == path) & F.coalesce(_holds(t["text"], e["line"], quote, slack), F.lit(False)))
        place = clean_path(F.coalesce(e["file"], F.lit("")))
        return let(normalise(F.coalesce(e["quote"], F.lit(""))), lambda quote: let(place, lambda path: (F.char_length(quote) >= MIN_QUOTE) & hit(path, quote)))

    return _settled(verdicts.withColumn("evidence_checked", F.transform("evidence", checked)).drop("_texts"))


def settle(verdicts: DataFrame, cases: Cases) -> DataFrame:
    """verdicts (case_id, ord, verdict, evidence) with claimed_verdict, evidence_checked, and verdict `unsettled` unless some evidence exists."""
    items = verdicts.select("case_id", F.col("ord").alias("claim"), F.posexplode("evidence").alias("nth", "e")).select("case_id", "claim", "nth", "e.file", "e.line", "e.quote")
    checked = cited(items, cases).groupBy("case_id", F.col("claim").alias("ord")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nth", "found"))), lambda x: x["found"]).alias("evidence_checked")
    )
    out = verdicts.join(checked, ["case_id", "ord"], "left").withColumn("evidence_checked", F.coalesce("evidence_checked", F.array().cast("array<boolean>")))
    return _settled(out)


def _settled(out: DataFrame) -> DataFrame:
    stands = (F.col("verdict") == "unsettled") | F.exists("evidence_checked", lambda x: x)
    return out.withColumn("claimed_verdict", F.col("verdict")).withColumn("verdict", F.when(stands, F.col("verdict")).otherwise("unsettled"))

