"""Scalar expressions over paths, lines and labels, all inside Catalyst.

Patterns carry (?dU): `.` and `$` follow the line feed only, and classes follow Unicode, as the rules they implement expect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(column: Column) -> Column:
    """White space of any kind off both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+\z", "")


def collapse(column: Column) -> Column:
    """White space of any kind as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(column, r"(?U)\s+", " "))


def normalise(column: Column) -> Column:
    """A code line as it is compared with a quote: no gutter, one level of escapes off, single spaces, lower case."""
    bare = F.when(column.contains("| "), F.regexp_replace(column, r"(?mdU)^\s*\d*\s*[+-]?\s*\| ", "")).otherwise(column)
    return F.lower(collapse(F.replace(bare, F.lit("\\\\"), F.lit("\\"))))


def normalised_text(whole: Column) -> Column:
    """normalise of each line of a text without gutters (`| `), joined again, up to the last line that isn't blank. The text is taken whole, which costs a part of what its lines do."""
    flat = F.regexp_replace(F.replace(whole, F.lit("\\\\"), F.lit("\\")), r"(?U)[\s&&[^\n]]+", " ")
    return F.lower(F.rtrim(F.ltrim(F.regexp_replace(flat, " ?\n ?", "\n")), F.lit(" \n")))


def clean_path(column: Column) -> Column:
    """Trimmed, forward slashes, no leading './'."""
    return F.regexp_replace(F.translate(strip(column), "\\", "/"), r"^\./", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_code(path: Column) -> Column:
    return path.endswith(".py")


def is_test_file(path: Column) -> Column:
    name = basename(path)
    return name.startswith("test_") | name.endswith("_test.py") | (name == "conftest.py")


def clamp(number: Column) -> Column:
    """To [0, 1]; what can't be read is 0; NaN orders above all numbers, so it is 1."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)), F.lit(0.0))


def estimated_tokens(*texts: Column) -> Column:
    return F.floor(sum((F.char_length(t) for t in texts[1:]), F.char_length(texts[0])) / 4).cast("long")


def digest(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(16))


def lines_of(start: Column, end: Column) -> Column:
    """`7` or `7-9`"""
    return F.when(end > start, F.concat_ws("-", start.cast("string"), end.cast("string"))).otherwise(start.cast("string"))


def location(file: Column, line: Column, end: Column) -> Column:
    return F.concat(file, F.lit(":"), lines_of(line, F.coalesce(end, line)))


def cell(text: Column) -> Column:
    """One table cell: a single line, without a bar that would end it."""
    return F.replace(collapse(F.coalesce(text, F.lit(""))), F.lit("|"), F.lit("\\|"))


def short(text: Column, limit: int = 140) -> Column:
    flat = collapse(F.coalesce(text, F.lit("")))
    return F.when(F.char_length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…"))).otherwise(flat)


def numbered(line_no: Column, added: Column, text: Column) -> Column:
    """`   12 + | text`"""
    number = line_no.cast("string")  # a format costs several times as much
    return F.concat(F.when(line_no < 100_000, F.lpad(number, 5, " ")).otherwise(number), F.when(added, " + | ").otherwise("   | "), text)


def removed(text: Column) -> Column:
    return F.concat(F.lit("      - | "), text)


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def source_lines(text: Column) -> Column:
    """A missing file is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")
