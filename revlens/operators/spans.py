"""Closed ranges of lines in one file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """Lines between two spans: 0 if they touch or overlap, null across files."""
    gap = F.greatest(F.lit(0), b["start_line"] - a["end_line"], a["start_line"] - b["end_line"])
    return F.when(a["file"] == b["file"], gap)


def span_lines(span: Column) -> Column:
    return F.sequence(span["start_line"], span["end_line"])


def is_valid(span: Column) -> Column:
    return (span["start_line"] >= 1) & (span["end_line"] >= span["start_line"])


def checked(span: Column) -> Column:
    """The span, or a failed job if it is no range of lines."""
    message = F.concat(F.lit("not a range of lines: "), F.to_json(span))
    return F.when(is_valid(span), span).otherwise(F.raise_error(message).cast("struct<file: string, start_line: int, end_line: int>"))


def touches(span: Column, added: Column) -> Column:
    """Does any added line of the span's file lie inside? added: map of file to lines."""
    lines = F.coalesce(F.try_element_at(added, span["file"]), F.array().cast("array<int>"))
    return F.exists(lines, lambda n: n.between(span["start_line"], span["end_line"]))


def label_table(cases: DataFrame) -> DataFrame:
    """The answer key as one row a label; spans[0] is its own place, the others are as good."""
    from ..kinds import family

    f = F.col("f")
    own = F.struct(f["file"].alias("file"), f["start_line"].alias("start_line"), F.coalesce(f["end_line"], f["start_line"]).alias("end_line"))
    spans = F.concat(F.array(own), F.coalesce(f["equivalent_locations"], F.array().cast("array<struct<file: string, start_line: int, end_line: int>>")))
    in_scope, required = F.coalesce(f["in_scope"], F.lit(True)), F.coalesce(f["required"], F.lit(True))
    return cases.select("case_id", F.posexplode("findings").alias("label_ord", "f")).select(
        "case_id",
        f["finding_id"].alias("finding_id"),
        "label_ord",
        f["type"].alias("type"),
        family(f["type"]).alias("family"),
        in_scope.alias("in_scope"),
        required.alias("required"),
        (in_scope & required).alias("scored"),
        F.coalesce(f["title"], F.lit("")).alias("title"),
        F.transform(spans, checked).alias("spans"),
    )
