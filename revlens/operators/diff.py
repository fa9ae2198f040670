"""Unified diffs as rows: one tokenizer for every use.

Hunk lengths are counted, so a deleted line that starts with `-- ` is content, and a trailing empty string is not; `\\ No newline`
lines are skipped. A diff is cut into the sections of its files inside its row, and a section is read inside its row; those of long diffs are dealt to many tasks first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.text import let, numbered, removed, strip
from .changes import Cases, files_of, with_maps

_FILE = "diff --git "
_HUNK_LINE = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", re.ASCII)
_OWN = re.compile("diff --git [^\r\x85\u2028\u2029]*? b/([^\r\x85\u2028\u2029]*)[\r\x85\u2028\u2029]?\\Z")
#: Fixed value: what Unicode calls white space, which is what functions.text.strip takes off.
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: a diff of more bytes is long. Its sections are dealt to tasks, where a short one is read where it stands.
LONG = 1 << 16
#: A body line of a file's diff.
ROW = "struct<i: int, hunk: bigint, mark: string, text: string, old_no: int, new_no: int, new_start: int, new_len: int>"
#: What a section says: the names of its file, what became of it, and its body lines in order.
FILE = f"struct<block: int, old_path: string, path: string, is_new: boolean, is_deleted: boolean, rows: array<{ROW}>>"
#: A deleted line that did not come back.
GONE = "struct<path: string, new_no: int, i: int, text: string>"
_ARROW_ROW = pa.struct([("i", pa.int32()), ("hunk", pa.int64()), ("mark", pa.string()), ("text", pa.string()), *((n, pa.int32()) for n in ("old_no", "new_no", "new_start", "new_len"))])
_ARROW_FILE = pa.struct([("block", pa.int32()), ("old_path", pa.string()), ("path", pa.string()), ("is_new", pa.bool_()), ("is_deleted", pa.bool_()), ("rows", pa.list_(pa.field("element", _ARROW_ROW)))])
_ARROW_GONE = pa.struct([("path", pa.string()), ("new_no", pa.int32()), ("i", pa.int32()), ("text", pa.string())])
#: Fixed value: diffs that are read at once.
READ_ROWS = 512


def sections(cases: Cases) -> DataFrame:
    """cases (case_id, diff) -> case_id, block, start (the section's first line in the diff, from 0), part (its lines): one row a file that the diff names, and one with block 0 if
    lines stand before the first. Linear in the diff; an empty or missing one is a single empty line of block 0."""
    return cases.select("case_id", F.inline(_sections()))


def _sections() -> Column:
    """The sections of the column `diff`: an array of (block, start, part)."""

    def cut(lines: Column, begins: Column) -> Column:
        def section(block: Column, start: Column) -> Column:
            # begins[block] is where the next section begins
            end = F.coalesce(F.get(begins, block), F.size(lines))
            return F.struct(block.alias("block"), start.alias("start"), F.slice(lines, start + 1, end - start).alias("part"))

        top = F.filter(F.array(section(F.lit(0), F.lit(0))), lambda s: F.size(s["part"]) > 0)
        return F.concat(top, F.transform(begins, lambda start, k: section(k + 1, start)))

    begins = lambda lines: F.array_compact(F.transform(lines, lambda x, k: F.when(x.startswith(_FILE), k)))
    return let(F.split(F.coalesce("diff", F.lit("")), "\n"), lambda lines: let(begins(lines), lambda at: cut(lines, at)))


def _read(lines: list[str], start: int, out: _Rows, every: bool = True) -> tuple[str | None, str | None, bool, bool]:
    """A section's lines, the first of which is line `start` of the diff -> old_path, path, is_new, is_deleted; its rows (without `every` those that are new or gone) are added to `out`. One pass."""
    add = out.add
    own = moved_from = moved_to = minus = None
    new = deleted = False
    nth = old_no = new_no = first = old_left = new_left = length = 0
    for i, x in enumerate(lines, start):
        if x.endswith("\r"):
            x = x[:-1]
        mark = x[:1] or " "
        if nth and mark in " +-":
            if old_left > 0 or new_left > 0:
                if every or mark != " ":
                    add(i, nth, mark, x[1:], old_no, new_no, first, length)
            elif mark == "-" and x.startswith("--- a/"):
                minus = _later(minus, x[6:])
            if mark != "+":
                old_no, old_left = old_no + 1, old_left - 1
            if mark != "-":
                new_no, new_left = new_no + 1, new_left - 1
        elif mark == "@":
            if head := _HUNK_LINE.match(x):
                nth, old_no, new_no = nth + 1, int(head[1]), int(head[3])
                old_left, new_left = (1 if n is None else int(n) for n in head.group(2, 4))
                length = new_left
                # A hunk without new lines starts behind the line that it names.
                first = new_no = new_no + 1 if length == 0 else max(new_no, 1)
        elif mark not in "-drn":
            continue  # no line that is read below begins so
        elif x.startswith("--- a/"):
            minus = _later(minus, x[6:])
        elif x.startswith(_FILE):
            named = _OWN.match(x)
            own = _later(own, named[1] if named else "")
        elif x.startswith("rename from "):
            moved_from = _later(moved_from, x[12:])
        elif x.startswith("rename to "):
            moved_to = _later(moved_to, x[10:])
        elif x.startswith("new file mode"):
            new = True
        elif x.startswith("deleted file mode"):
            deleted = True
    old = moved_from if moved_from is not None else minus if minus is not None else own
    return old, own if moved_to is None else moved_to, new, deleted


def _later(said: str | None, text: str) -> str:
    """Of two names the one that comes later in order."""
    text = text.strip(_SPACE)
    return text if said is None else max(said, text)


class _Rows:
    """The rows of sections as columns of ROW, which become one Arrow array."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in range(8)]
        self.n = 0

    def add(self, *row: object) -> None:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)
        self.n += 1


def _file_arrays(sections: Iterable[tuple[int, int, list[str]]]) -> pa.StructArray:
    """(block, start, part) of sections -> the structs of FILE."""
    rows, ends, files = _Rows(), [0], []
    for block, start, part in sections:
        files.append((block, *_read(part, start, rows)))
        ends.append(rows.n)
    nested = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(rows.columns, _ARROW_ROW, strict=True)], fields=list(_ARROW_ROW))
    columns = list(zip(*files, strict=True)) if files else [()] * 5
    plain = [pa.array(c, f.type) for c, f in zip(columns, list(_ARROW_FILE)[:5], strict=True)]
    return pa.StructArray.from_arrays([*plain, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nested, type=_ARROW_FILE.field("rows").type)], fields=list(_ARROW_FILE))


def _cut(text: str | None) -> list[tuple[int, int, list[str]]]:
    """As `_sections`, of one diff."""
    lines = (text or "").split("\n")
    begins = [k for k, x in enumerate(lines) if x.startswith(_FILE)]
    top = [(0, 0, lines[: begins[0]] if begins else lines)]
    return [*(top if top[0][2] else []), *((n, a, lines[a:b]) for n, (a, b) in enumerate(zip(begins, [*begins[1:], len(lines)], strict=False), 1))]


def _read_cases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with `diff` -> the other columns and `files`, an array of FILE."""
    for whole in batches:
        for at in range(0, whole.num_rows, READ_ROWS):
            batch = whole.slice(at, READ_ROWS)
            cut = [_cut(text) for text in batch.column("diff").to_pylist()]
            files = _file_arrays(chain.from_iterable(cut))
            listed = pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, cut))], pa.int32()), files, type=pa.list_(pa.field("element", files.type)))
            names = [n for n in batch.schema.names if n != "diff"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], listed], names=[*names, "files"])


def base_of(text: str | None, files: dict[str, str | None]) -> list[tuple[str, str | None]]:
    """As base_revision, of one case: path and text of every file before the change, by its diff and its files."""
    out, touched = [], set()
    for block, start, part in _cut(text):
        if block == 0:
            continue
        rows = _Rows()
        old_path, path, is_new, is_deleted = _read(part, start, rows)
        touched.add(path)
        found = list(zip(*rows.columns, strict=True))
        if is_new or not (found or (not is_deleted and files.get(path) is not None)):
            continue
        if is_deleted:
            out.append((path, "\n".join(x[3] for x in found if x[2] == "-")))
        elif old_path is not None:
            out.append((old_path, "\n".join(_reversed(found, files.get(path)))))
    return out + [(p, t) for p, t in files.items() if p not in touched]


def _reversed(rows: list[tuple], text: str | None) -> list[str]:
    """A file's lines with its hunks taken back."""
    lines, out, follows = [] if text is None else text.split("\n"), [], 1
    for first, length, hunk in sorted({(x[6], x[7], x[1]) for x in rows}):
        out += lines[follows - 1 : max(first, follows) - 1]
        out += [x[3] for x in rows if x[1] == hunk and x[2] != "+"]
        follows = first + length
    return out + lines[follows - 1 :]


def excerpt_of(text: str | None, added: Iterable[int] | None, gone: Iterable[tuple], line: int | None, radius: int) -> list[str]:
    """As excerpts, of one claim of a file that is shown: its printed rows within the radius of a line."""
    if line is None:
        return []
    rows, last = printed_lines(text, added)
    near = [(n, 1, 0, rows[n - 1]) for n in range(max(line - radius, 1), min(line + radius, last) + 1)]
    near += [(at, 0, i, f"      - | {x}") for _, at, i, x in gone if abs(min(at - 1, last) - line) <= radius]
    return [row for *_, row in sorted(near)]


class _Moved:
    """The added and deleted rows of a file's section, as _Rows takes them; it is given no others."""

    def __init__(self) -> None:
        self.gone: list[tuple] = []
        self.came: list[str] = []

    def add(self, i: int, hunk: int, mark: str, text: str, old_no: int, new_no: int, *_: int) -> None:
        if mark == "-":
            self.gone.append((new_no, i, text))
        else:
            self.came.append(text)


def _gone_from(text: str | None) -> list[tuple]:
    """path, new_no, i, text of the deleted lines of a diff that did not come back in the same file. Only lines whose text both went and came are counted."""
    files = []
    for _, start, part in _cut(text):
        rows = _Moved()
        files.append((_read(part, start, rows, every=False)[1], rows))
    came: dict[tuple, int] = {}
    for path, rows in files:
        for x in rows.came:
            key = (path, x.strip(_SPACE))
            came[key] = came.get(key, 0) + 1
    if not came:
        return [(path, *row) for path, rows in files for row in rows.gone]
    out = []
    for path, rows in files:
        for new_no, i, x in rows.gone:
            key = (path, x.strip(_SPACE))
            if left := came.get(key, 0):
                came[key] = left - 1
            else:
                out.append((path, new_no, i, x))
    return out


def _read_gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with `diff` -> the other columns and `gone`, an array of GONE."""
    for whole in batches:
        for at in range(0, whole.num_rows, READ_ROWS):
            batch = whole.slice(at, READ_ROWS)
            listed = gone_arrays([_gone_from(text) for text in batch.column("diff").to_pylist()])
            names = [n for n in batch.schema.names if n != "diff"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], listed], names=[*names, "gone"])


def gone_arrays(found: list[list[tuple]]) -> pa.ListArray:
    """What _gone_from gives for each case -> arrays of GONE."""
    columns = list(zip(*chain.from_iterable(found), strict=True)) or [()] * _ARROW_GONE.num_fields
    rows = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW_GONE, strict=True)], fields=list(_ARROW_GONE))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, found))], pa.int32()), rows, type=pa.list_(pa.field("element", _ARROW_GONE)))


def printed_lines(text: str | None, added: Iterable[int] | None, gone: Iterable[tuple] = ()) -> tuple[list[str], int]:
    """The rows that file_views prints of a file, and how many of them are numbered, by its text, its new lines and what _gone_from gives for it."""
    lines = [x[:-1] if x.endswith("\r") else x for x in (text or "").split("\n")]
    while lines and not lines[-1].strip(_SPACE):
        lines.pop()
    new = frozenset(added or ())
    rows = [f"{n:5d}{' + | ' if n in new else '   | '}{x}" for n, x in enumerate(lines, 1)]
    if lost := sorted((at, i, x) for _, at, i, x in gone):
        merged = sorted([*((n, 1, 0, row) for n, row in enumerate(rows, 1)), *((at, 0, i, f"      - | {x}") for at, i, x in lost)])
        return [row for *_, row in merged], len(rows)
    return rows, len(rows)


def _read_sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows case_id, block, start, part -> case_id, f."""
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            files = _file_arrays(zip(*(one.column(n).to_pylist() for n in ("block", "start", "part")), strict=True))
            yield pa.RecordBatch.from_arrays([one.column("case_id"), files], names=["case_id", "f"])


def _typed(rows: DataFrame, names: Iterable[str], more: str) -> StructType:
    """The named columns and those of a DDL string."""
    return StructType([*(rows.schema[n] for n in names), *StructType.fromDDL(more)])


def _short(cases: Cases, short: bool) -> DataFrame:
    """case_id and diff of the cases with short diffs, or of the others."""
    return cases.select("case_id", "diff").filter(_is_short() if short else ~_is_short())


def is_small() -> Column:
    """A case with a short diff whose files are no longer than LONG together."""
    size = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.octet_length(t), F.lit(0)))
    return _is_short() & (F.coalesce(size("head_files"), F.lit(0)) + F.coalesce(size("context_files"), F.lit(0)) <= LONG)


def _is_short() -> Column:
    return F.coalesce(F.octet_length("diff"), F.lit(0)) <= LONG


def _case_files(cases: DataFrame, *more: str) -> DataFrame:
    """case_id, files (an array of FILE), and more columns: each case in its row."""
    rows = cases.select("case_id", "diff", *more)
    return rows.mapInArrow(_read_cases, _typed(rows, ("case_id", *more), f"files array<{FILE}>"))


def _case_gone(cases: DataFrame, *more: str) -> DataFrame:
    """case_id, gone (an array of GONE), and more columns: each case in its row."""
    rows = cases.select("case_id", "diff", *more)
    return rows.mapInArrow(_read_gone, _typed(rows, ("case_id", *more), f"gone array<{GONE}>"))


def _long_files(cases: Cases) -> DataFrame:
    """file_diffs of long diffs: their sections are dealt to tasks."""
    dealt = sections(_short(cases, False)).repartition("case_id", "block")
    return dealt.mapInArrow(_read_sections, _typed(dealt, ["case_id"], f"f {FILE}")).select("case_id", "f.*")


def file_diffs(cases: Cases) -> DataFrame:
    """cases (case_id, diff) -> case_id, block, old_path, path, is_new, is_deleted, rows (ROW, in order): one row a file that the diff names, and one with block 0 for what
    stands before the first. Everything else about diffs follows from this. A section is read inside its row; those of diffs longer than LONG are dealt to tasks by (case_id, block),
    the others stay where they are. No state crosses a section, since a hunk belongs to the file that was named last."""
    # Arrays that are long to make are opened by the outer form here and below: for the plain one Spark adds a filter on the array's size, for which it makes the array once more.
    return _case_files(_short(cases, True)).select("case_id", F.inline_outer("files")).unionByName(_long_files(cases))


def diff_lines(cases: Cases) -> DataFrame:
    """cases (case_id, diff) -> case_id, block, old_path, path, is_new, is_deleted, and the fields of ROW: one row a content line. new_no of a deleted line is the
    new-side line that it stood in front of."""
    return file_diffs(cases).select("case_id", "block", "old_path", "path", "is_new", "is_deleted", F.inline_outer("rows")).filter("i IS NOT NULL")


def parse_diff(cases: Cases, *more: str) -> DataFrame:
    """cases (case_id, diff, and more columns, which ride along) -> case_id, changed_files, deleted_files (sorted), added_lines (path -> sorted new-side lines), and the more."""
    rows = cases.select("case_id", "diff", *more)
    short = _case_files(rows.filter(_is_short()), *more).select("case_id", *_changed(F.col("files")), *more)
    told = F.struct("block", "path", "is_deleted", F.filter("rows", lambda r: r["mark"] == "+").alias("rows"))
    long = _long_files(cases).groupBy("case_id").agg(F.collect_list(told).alias("files")).select("case_id", *_changed(F.col("files")))
    return short.unionByName(long.join(rows.filter(~_is_short()).select("case_id", *more), "case_id") if more else long)


def _changed(files: Column) -> list[Column]:
    """changed_files, deleted_files and added_lines of a case's files."""
    named = F.filter(files, lambda f: f["block"] > 0)
    paths = lambda keep: F.array_sort(F.array_distinct(F.transform(F.filter(named, keep), lambda f: f["path"])))
    added = F.transform(named, lambda f: F.struct(f["path"].alias("path"), F.transform(F.filter(f["rows"], lambda r: r["mark"] == "+"), lambda r: r["new_no"]).alias("lines")))

    def by_path(added: Column) -> Column:
        every = F.transform(added, lambda f: f["path"])
        joined = F.transform(F.array_distinct(every), lambda p: F.struct(p.alias("path"), F.flatten(F.transform(F.filter(added, lambda f: f["path"] == p), lambda f: f["lines"])).alias("lines")))
        return F.when(F.size(F.array_distinct(every)) == F.size(every), added).otherwise(joined)

    entries = F.filter(F.transform(let(added, by_path), lambda f: F.struct(f["path"].alias("path"), F.array_sort(F.array_distinct(f["lines"])).alias("lines"))), lambda f: F.size(f["lines"]) > 0)
    return [paths(lambda f: ~f["is_deleted"]).alias("changed_files"), paths(lambda f: f["is_deleted"]).alias("deleted_files"), F.map_from_entries(F.array_sort(entries)).alias("added_lines")]


def removed_lines(cases: Cases) -> DataFrame:
    """Deleted lines that did not come back in the same file: case_id, path, new_no, i, text. A multiset difference on the stripped text: the k-th deletion of a text is
    cancelled if k additions of it exist."""
    short = _case_gone(_short(cases, True)).select("case_id", F.inline_outer("gone")).filter("i IS NOT NULL")
    rows = _long_files(cases).select("case_id", "path", F.inline("rows")).filter("mark <> ' '").withColumn("key", strip(F.col("text")))
    same = Window.partitionBy("case_id", "path", "key")
    gone = F.col("mark") == "-"
    rows = rows.withColumn("back", F.count_if(~gone).over(same)).withColumn("nth", F.count_if(gone).over(same.orderBy("i")))
    return short.unionByName(rows.filter(gone & (F.col("nth") > F.col("back"))).select("case_id", "path", "new_no", "i", "text"))


def added_of(cases: Cases) -> DataFrame:
    """case_id, path, line_no of each added line."""
    return cases.select("case_id", F.explode("added_lines").alias("path", "lines")).select("case_id", "path", F.explode("lines").alias("line_no"))


def lines_of_files(files: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """files -> case_id, path, side, line_no from 1, text (a trailing carriage return off), and is_added if `added` is given."""
    rows = files.select("case_id", "path", "side", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "text")).select(
        "case_id", "path", "side", (F.col("at") + 1).alias("line_no"), F.regexp_replace("text", r"\r\z", "").alias("text")
    )
    if added is None:
        return rows
    marks = added.select("case_id", "path", "line_no").distinct().withColumn("is_added", F.lit(True))
    return rows.join(marks, ["case_id", "path", "line_no"], "left").withColumn("is_added", F.coalesce("is_added", F.lit(False)))


def added_rows(cases: Cases) -> DataFrame:
    """case_id, path, line_no, text of the added lines of the changed files."""
    head = _head(cases)
    numbers = F.array_intersect(F.sequence(F.lit(1), F.size("lines")), "added")
    return head.select("case_id", "path", "lines", F.explode(numbers).alias("line_no")).select("case_id", "path", "line_no", F.element_at("lines", F.col("line_no")).alias("text"))


def _head(cases: Cases) -> DataFrame:
    """case_id, path, lines (a trailing carriage return off), added (line numbers) of the changed files; within the case's row if it has them."""
    rows = with_maps(cases)
    if rows is None:
        files = files_of(cases, "head").join(cases.select("case_id", F.explode("added_lines").alias("path", "added")), ["case_id", "path"], "left")
    else:
        files = _head_of_row(rows)
    return files.select("case_id", "path", *_lines_and_added())


def _head_of_row(rows: DataFrame, *more: str) -> DataFrame:
    """case_id, path, text, added, and more columns, of the changed files."""
    return rows.select("case_id", "added_lines", *more, F.explode("head_files").alias("path", "text")).select("case_id", "path", "text", F.element_at("added_lines", F.col("path")).alias("added"), *more)


def _lines_and_added() -> list[Column]:
    return [lines_of_text(F.col("text")).alias("lines"), _added(F.col("added")).alias("added")]


def lines_of_text(text: Column) -> Column:
    """The lines of a file, trailing carriage returns off."""
    text = F.coalesce(text, F.lit(""))
    return F.split(F.when(text.contains("\r"), F.regexp_replace(text, r"\r(?=\n|\z)", "")).otherwise(text), "\n")


def _added(lines: Column) -> Column:
    return F.coalesce(lines, F.array().cast("array<int>"))


def base_revision(cases: Cases) -> DataFrame:
    """The repository before the change, by reversing the diff onto head: case_id, path, text. Lines outside hunks come from head, the old side of each
    hunk from the diff. A file is put together inside its row: that of its case, if the case has its files and its diff is short, else after one join by file."""
    rows = with_maps(cases)
    both = _met_by_join(cases) if rows is None else _met_in_row(rows.filter(_is_short())).unionByName(_met_by_join(rows.filter(~_is_short())))
    of_hunk = lambda h: F.transform(F.filter("rows", lambda r: (r["hunk"] == h) & (r["mark"] != "+")), lambda r: r["text"])
    starts = F.array_sort(F.array_distinct(F.transform("rows", lambda r: F.struct(r["new_start"].alias("a"), r["new_len"].alias("n"), r["hunk"].alias("h")))))
    hunks = F.transform(starts, lambda h: F.struct(h["a"].alias("a"), h["n"].alias("n"), of_hunk(h["h"]).alias("old")))
    deleted = F.array_join(F.transform(F.filter("rows", lambda r: r["mark"] == "-"), lambda r: r["text"]), "\n")
    lines = F.coalesce(F.split("text", "\n"), F.array().cast("array<string>"))
    both = both.withColumns({"hunks": F.when(F.col("is_deleted"), F.slice(hunks, 1, 0)).otherwise(hunks), "has_rows": F.size("rows") > 0, "deleted": F.when(F.col("is_deleted"), deleted), "lines": lines})

    def follows(h: Column) -> Column:
        """The first line of head behind a hunk; line 1 without one."""
        return F.coalesce(h["a"] + h["n"], F.lit(1))

    def piece(h: Column, j: Column) -> Column:
        start = follows(F.get("hunks", j - 1))
        return F.concat(F.slice("lines", start, F.greatest(h["a"] - start, F.lit(0))), h["old"])

    rest = F.slice("lines", follows(F.get("hunks", F.size("hunks") - 1)), F.greatest(F.size("lines"), F.lit(0)))
    rebuilt = F.array_join(F.concat(F.flatten(F.transform("hunks", piece)), rest), "\n")
    there = F.col("touched").isNull() | (~F.col("is_new") & (F.col("has_rows") | (~F.col("is_deleted") & F.col("text").isNotNull())))
    text = F.when(F.col("touched").isNull(), F.col("text")).when(F.col("is_deleted"), F.col("deleted")).otherwise(rebuilt)
    path = F.when(F.coalesce("is_deleted", F.lit(True)), F.col("path")).otherwise(F.col("old_path"))
    return both.filter(there).select("case_id", path.alias("path"), text.alias("text"))


def _met_in_row(rows: DataFrame) -> DataFrame:
    """case_id, path, text of every file and every file of the diff, with old_path, is_new, is_deleted, rows, touched of the latter, made of the case's own row."""
    none = F.create_map().cast("map<string, string>")
    maps = {m: F.coalesce(m, none) for m in ("head_files", "context_files")}
    cases = _case_files(rows.withColumns(maps), "head_files", "context_files").withColumn("files", F.filter("files", lambda f: f["block"] > 0))
    text = lambda path: F.when(F.map_contains_key("head_files", path), F.element_at("head_files", path)).otherwise(F.element_at("context_files", path))
    one = lambda path, text, f: F.struct(path.alias("path"), text.alias("text"), f.alias("f"))
    paths, nothing = F.transform("files", lambda f: f["path"]), F.lit(None).cast(FILE)
    there = F.concat(F.map_entries("head_files"), F.map_entries(F.map_filter("context_files", lambda k, _: ~F.map_contains_key("head_files", k))))
    untouched = F.transform(F.filter(there, lambda e: ~F.array_contains(paths, e["key"])), lambda e: one(e["key"], e["value"], nothing))
    met = cases.select("case_id", F.inline(F.concat(F.transform("files", lambda f: one(f["path"], text(f["path"]), f)), untouched)))
    return met.select("case_id", "path", "text", *[F.col(f"f.{c}").alias(c) for c in ("old_path", "is_new", "is_deleted", "rows")], F.when(F.col("f").isNotNull(), F.lit(True)).alias("touched"))


def _met_by_join(cases: Cases) -> DataFrame:
    """As _met_in_row."""
    head = files_of(cases).select("case_id", "path", "text")
    # What meets head is the old side of each hunk and one of its other rows, which tells its place.
    told = F.filter("rows", lambda r, k: (r["mark"] != "+") | (k == 0) | (r["hunk"] != F.get("rows", k - 1)["hunk"]))
    changed = file_diffs(cases).filter("block > 0").select("case_id", "path", "old_path", "is_new", "is_deleted", told.alias("rows"), F.lit(True).alias("touched"))
    return head.join(changed, ["case_id", "path"], "full").select("case_id", "path", "text", "old_path", "is_new", "is_deleted", "rows", "touched")


def file_views(cases: Cases, with_deletions: bool = False) -> DataFrame:
    """What a reader of the changed code files sees, one row a file: case_id, path, printed: array of (at, sub, nth, line_no (null for deleted lines), text, row), in order.
    Trailing blank lines are dropped; a deleted line stands before the line whose place it had, after the end if there is none."""
    code = shown_files(cases, with_deletions)
    return code.select("case_id", "path", _listing(F.col("lines"), F.col("added"), F.col("last"), F.transform("gone", _gone) if with_deletions else None).alias("printed"))


def shown_files(cases: Cases, with_deletions: bool = False) -> DataFrame:
    """What file_views prints: case_id, path, lines, added, last (the last line that isn't blank), and with deletions gone (array of GONE, in no order, or null)."""
    rows = with_maps(cases)
    if with_deletions and rows is not None:
        in_row = _case_gone(rows.filter(_is_short()), "head_files", "added_lines").withColumnRenamed("gone", "all_gone")
        code = _head_of_row(in_row, "all_gone").filter(F.col("path").endswith(".py"))
        gone = F.filter("all_gone", lambda r: r["path"] == F.col("path"))
        files = code.select("case_id", "path", *_lines_and_added(), gone.alias("gone")).unionByName(_joined_files(rows.filter(~_is_short())))
    else:
        files = _joined_files(cases) if with_deletions else _head(cases).filter(F.col("path").endswith(".py"))
    return files.withColumn("last", last_line(F.col("lines")))


def _gone(r: Column) -> Column:
    """A deleted line as it is printed."""
    return F.struct(r["new_no"].alias("at"), F.lit(0).alias("sub"), r["i"].alias("nth"), F.lit(None).cast("int").alias("line_no"), r["text"].alias("text"), removed(r["text"]).alias("row"))


def _joined_files(cases: Cases) -> DataFrame:
    code = _head(cases).filter(F.col("path").endswith(".py"))
    gone = removed_lines(cases).groupBy("case_id", "path").agg(F.collect_list(F.struct("path", "new_no", "i", "text")).alias("gone"))
    return code.join(gone, ["case_id", "path"], "left")


def last_line(lines: Column) -> Column:
    """The last line that isn't blank."""
    return F.array_max(F.transform(lines, lambda x, k: F.when(x.rlike(r"(?U)\S"), k + 1).otherwise(0)))


def _listing(lines: Column, added: Column, last: Column, gone: Column | None) -> Column:
    """What is printed of a file."""

    def one(text: Column, k: Column) -> Column:
        row = numbered(k + 1, F.array_contains(added, k + 1), text)
        return F.struct((k + 1).alias("at"), F.lit(1).alias("sub"), F.lit(0).alias("nth"), (k + 1).alias("line_no"), text.alias("text"), row.alias("row"))

    rows = F.transform(F.slice(lines, 1, F.greatest(last, F.lit(0))), one)
    return rows if gone is None else F.when(F.size(gone) > 0, F.array_sort(F.concat(rows, gone))).otherwise(rows)


def printed_rows(cases: Cases, with_deletions: bool = False) -> DataFrame:
    """file_views as rows: case_id, path, at, sub, nth, line_no, text, row."""
    return file_views(cases, with_deletions).select("case_id", "path", F.inline("printed"))


def excerpts(cases: Cases, claims: DataFrame, radius: int = 12, with_deletions: bool = False) -> DataFrame:
    """claims (case_id, ord, file, line) -> the same with `rows`: printed rows whose number, or for deleted lines the one printed last before them, is
    within the radius; empty if the file isn't shown. Claims meet the file's row, not its lines."""
    views = file_views(cases, with_deletions).withColumnRenamed("path", "file")
    joined = claims.join(views, ["case_id", "file"], "left")
    # A deleted line that stands before line n was printed after the last number below n, which is n - 1 or the file's last line.
    last = F.coalesce(F.array_max(F.transform("printed", lambda r: r["line_no"])), F.lit(0))
    near = F.filter("printed", lambda r: F.abs(F.coalesce(r["line_no"], F.least(r["at"] - 1, last)) - F.col("line")) <= radius)
    rows = F.coalesce(F.transform(near, lambda r: r["row"]), F.array().cast("array<string>"))
    return joined.withColumn("rows", rows).select(*claims.columns, "rows")
