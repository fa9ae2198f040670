"""The texts that a model is asked with, assembled by sorted collection of rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..definitions import definitions
from ..functions.text import estimated_tokens, strip
from ..sources.scratch import kept
from .changes import Cases, split, with_maps
from .diff import GONE, READ_ROWS, _gone_from, file_views, gone_arrays, is_small, printed_lines
from .symbols import OF_CASE, entries, facts, facts_of_row, symbols_of_cases, values

DELETED = "How to read the listings: `+` is a new row, `-` one that is gone (shown at its old place, without a number), all others are as before."
FACTS = "Names that the change introduces, looked up in every file. What is said here is measured; whether it matters is for you to judge."
SYSTEM = (
    "You review one change. Report only defects that the change introduces in the files shown. Copy the line you accuse into `quote` as it is printed, "
    "and choose `type` from the kinds listed. If nothing is wrong, return an empty `findings` list."
)
LINE_FEED = "\n"


def system_prompt() -> str:
    return LINE_FEED.join([SYSTEM, "", "Kinds:", *(f"- `{kind}`: {text}" for kind, text in definitions().items())])


def _joined(*parts: Column) -> Column:
    return F.array_join(F.flatten(F.array(*parts)), LINE_FEED)


def _rows(*texts: str | Column) -> Column:
    return F.array(*[F.lit(t) if isinstance(t, str) else t for t in texts])


def packs(cases: Cases, with_facts: bool = False, with_deletions: bool = False, store: str | None = None, beside: Sequence[str] = ()) -> DataFrame:
    """case_id, code_lines (numbered rows shown), system, user, estimated_prompt_tokens: one call a case. Small cases that have their files become texts in their row; others are put
    together by joins, as are all whose symbols come from a store. beside: columns of small cases (or `all_gone`, their deleted lines as GONE) that stay beside their texts, null of others."""
    rows = with_maps(cases)
    if rows is None or (with_facts and store is not None):
        return _texts(_met_by_join(cases, with_facts, with_deletions, store))
    short, large = _texts(_met_in_row(rows.filter(is_small()), with_facts, with_deletions, beside), beside), rows.filter(~is_small())
    if with_facts:
        # The joins read them many times, and all cases to find them.
        large = kept(large.select("case_id", "pr_title", "pr_description", "added_lines", "head_files", "context_files", "diff"), "large-cases")
        if large.isEmpty():
            return short
    return short.unionByName(_texts(_met_by_join(split(large), with_facts, with_deletions, None)), allowMissingColumns=True)


def _block(path: Column, printed: Column) -> Column:
    """A file as it is shown."""
    return F.flatten(F.array(_rows(F.concat(F.lit("# FILE "), path), "", "```"), F.transform(printed, lambda r: r["row"]), _rows("```", "")))


def _shown(printed: Column) -> Column:
    """How many numbered rows are printed."""
    return F.size(F.filter(printed, lambda r: r["line_no"].isNotNull()))


def _fact(x: Column) -> Column:
    return F.concat(F.lit("- `"), x["subject"], F.lit("`: "), x["statement"])


def _met_in_row(rows: DataFrame, with_facts: bool, with_deletions: bool, beside: Sequence[str] = ()) -> DataFrame:
    """case_id, pr_title, pr_description, body (rows, or null), code_lines, gone, facts (rows, or null), and columns beside, of cases with files and short diffs. A case is read once, in one process."""
    carried = ["case_id", "pr_title", "pr_description", *(["added_lines"] if with_facts else [])]
    carried += [c for c in beside if c != "all_gone" and c not in carried]
    read = rows.select(*dict.fromkeys([*carried, "diff", "head_files", "added_lines", *(["context_files"] if with_facts else [])]))
    made = ["body array<string>, code_lines long, gone long", *([f"all_gone array<{GONE}>"] if "all_gone" in beside else []), *([OF_CASE] if with_facts else [])]
    schema = StructType([*(read.schema[c] for c in carried), *StructType.fromDDL(", ".join(made))])
    names = schema.names

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, READ_ROWS):
                batch = whole.slice(at, READ_ROWS)
                head, added = entries(batch.column("head_files")), entries(batch.column("added_lines"))
                lost = [_gone_from(text) if with_deletions else [] for text in values(batch.column("diff"))]
                shown = zip(*map(_shown_code, head, added, lost), strict=True)
                columns = [batch.column(c) for c in carried] + [pa.array(c, kind) for c, kind in zip(shown, (pa.list_(pa.string()), pa.int64(), pa.int64()), strict=True)]
                columns += [gone_arrays(lost)] if "all_gone" in beside else []
                columns += [symbols_of_cases(head, entries(batch.column("context_files")), added)] if with_facts else []
                yield pa.RecordBatch.from_arrays(columns, names=names)

    said = F.transform(facts_of_row(), _fact) if with_facts else F.lit(None).cast("array<string>")
    return read.mapInArrow(tell, schema).select("case_id", "pr_title", "pr_description", "body", "code_lines", "gone", said.alias("facts"), *beside)


def _shown_code(head: list[tuple], added: list[tuple], lost: list[tuple]) -> tuple[list[str], int, int]:
    """body, code_lines and gone of a case by the entries of its maps and its deleted lines."""
    new, body, numbers, gone = dict(added), [], 0, 0
    for path, text in sorted((p, t) for p, t in head if p.endswith(".py")):
        rows, numbered = printed_lines(text, new.get(path), [x for x in lost if x[0] == path])
        body += [f"# FILE {path}", "", "```", *rows, "```", ""]
        numbers, gone = numbers + numbered, gone + len(rows) - numbered
    return [LINE_FEED.join(body)] if body else [], numbers, gone


def _met_by_join(cases: Cases, with_facts: bool, with_deletions: bool, store: str | None) -> DataFrame:
    """As _met_in_row."""
    shown, printed = _shown(F.col("printed")), F.col("printed")
    blocks = file_views(cases, with_deletions).select("case_id", "path", shown.alias("shown"), (F.size(printed) - shown).alias("gone"), _block(F.col("path"), printed).alias("block"))
    bodies = blocks.groupBy("case_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("path", "block"))), lambda x: x["block"])).alias("body"),
        F.sum("shown").alias("code_lines"),
        F.sum("gone").alias("gone"),
    )
    out = cases.select("case_id", "pr_title", "pr_description").join(bodies, "case_id", "left")
    if not with_facts:
        return out.withColumn("facts", F.lit(None).cast("array<string>"))
    said = facts(cases, store=store).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "subject", "statement"))), _fact).alias("facts"))
    return out.join(said, "case_id", "left")


def _texts(met: DataFrame, beside: Sequence[str] = ()) -> DataFrame:
    none = F.array().cast("array<string>")
    title, text = strip(F.coalesce("pr_title", F.lit(""))), strip(F.coalesce("pr_description", F.lit("")))
    head = F.flatten(
        F.array(
            _rows("# Pull request", "", F.when(title == "", "(no title)").otherwise(title)),
            F.when(text == "", none).otherwise(_rows("", F.left(text, F.lit(1500)))),
            _rows(""),
            F.when(F.coalesce("gone", F.lit(0)) > 0, _rows(DELETED, "")).otherwise(none),
        )
    )
    tail = F.when(F.size("facts") > 0, F.flatten(F.array(_rows("# NEW NAMES ELSEWHERE", "", FACTS, ""), F.col("facts"), _rows("")))).otherwise(none)
    out = met.withColumn("user", _joined(head, F.coalesce("body", none), tail)).withColumn("system", F.lit(system_prompt()))
    return out.select("case_id", F.coalesce("code_lines", F.lit(0)).alias("code_lines"), "system", "user", estimated_tokens(F.col("system"), F.col("user")).alias("estimated_prompt_tokens"), *beside)


def continuation_packs(first: DataFrame, claims: DataFrame, remaining: DataFrame) -> DataFrame:
    """packs of a first read, claims and remaining files (case_id, path) -> packs with a trailer that says what is recorded and what is left, for cases with something
    left."""
    message = F.coalesce(F.nullif("message", F.lit("")), F.lit(""))
    done = claims.groupBy("case_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- `"), "file", F.lit("`:"), F.col("line").cast("string"), F.lit(" "), "type", F.lit(" -- "), message).alias("row")))), lambda x: x["row"]).alias("done")
    )
    left = remaining.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_set("path")), lambda p: F.concat(F.lit("- `"), p, F.lit("`"))).alias("left"))
    both = first.join(left, "case_id").join(done, "case_id")
    trailer = F.flatten(
        F.array(
            _rows("# FOUND SO FAR", "", "This is the second look at the change. The first one led to:", ""),
            F.col("done"),
            _rows("", "# STILL TO REVIEW", "", "Nothing was said about:", ""),
            F.col("left"),
            _rows("", "Look at the files of the second list, and answer in the same form. What the first list has needs no repeating; `findings` may stay empty."),
        )
    )
    out = both.withColumn("user", F.concat("user", F.lit("\n"), F.array_join(trailer, LINE_FEED)))
    return out.withColumn("estimated_prompt_tokens", estimated_tokens(F.col("system"), F.col("user"))).select(*first.columns)


def questions(claims: DataFrame, named: bool = True) -> DataFrame:
    """claims with `rows` (an excerpt) and `definition` -> the same with `user`: the claim put by its kind (named) or only by its own sentence; a claim without a
    sentence is always put by its kind."""
    return claims.withColumn("user", question({c: F.col(c) for c in ("message", "file", "line", "type", "definition")}, F.col("rows"), named))


def question(claim: Mapping[str, Column] | Column, rows: Column, named: bool) -> Column:
    """What is asked about a claim (columns, or a struct) with the rows of its excerpt."""
    sentence = strip(F.coalesce(F.nullif(claim["message"], F.lit("")), F.lit("")))
    rows = F.when(F.size(rows) > 0, rows).otherwise(_rows("(the file is not among those shown)"))
    place = F.concat(F.lit("`"), claim["file"], F.lit("`, line "), claim["line"].cast("string"), F.lit(": "), sentence)
    kind = F.concat(F.lit("It is said to be `"), claim["type"], F.lit("`: "), F.coalesce(claim["definition"], F.lit("")))
    ask_kind = "Is it so, and is it this change that makes it so? Name what would settle it, find that in the code, and give your verdict."
    ask_place = "Is the sentence true of this place, and is it this change that makes it true? Other faults don't count. Name what would settle it, find that in the code, and give your verdict."
    by_kind = _joined(_rows("# CLAIM", "", place, "", kind, "", "# CODE THERE", "", "```"), rows, _rows("```", "", ask_kind))
    by_place = _joined(_rows("# CLAIM", "", place, "", "# CODE THERE", "", "```"), rows, _rows("```", "", ask_place))
    return by_kind if named else F.when(sentence == "", by_kind).otherwise(by_place)
