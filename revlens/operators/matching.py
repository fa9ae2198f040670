"""Findings against labels: admissible pairs in a band of lines, one-to-one assignment, scores.

Pairs are an equi-join on (case, file) with the band as residual. The assignment takes the nearest pair first. Cases of few pairs are folded inside
Catalyst, a row each. Larger ones go in rounds of joins: a pair that is the first of both its finding's and its label's pairs is what the sequential order would take, too, since
nothing before it could have used up either; it is taken, the pairs of its two ends go, and the rest plays the next round. What ROUNDS leave are chains of pairs each of which waits for the next; they
are followed in order, a case in a task. All rungs of agreement share the one join.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ratio
from ..kinds import family
from ..sources.scratch import kept

#: Pairs of a case that are folded in one row, and rounds that larger cases play.
FOLDED, ROUNDS = 200, 12
#: rung -> what of the kind must agree
RUNGS = {"location": "none", "family": "family", "type": "exact"}


def ranked(findings: DataFrame) -> DataFrame:
    """findings with `rank` in their case: most confident first, then by place, kind and detector."""
    order = (F.col("confidence").desc_nulls_last(), "file", "line", "end_line", "type", "detector", "ord")
    return findings.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(*order)))


def agreement(mode: str, kind: Column, kind_family: Column, label_kind: Column, label_family: Column) -> Column:
    """Whether the kinds agree; an unknown family agrees with none."""
    if mode == "exact":
        return kind == label_kind
    if mode == "family":
        return F.coalesce(kind_family == label_family, F.lit(False))
    if mode == "none":
        return F.lit(True)
    raise ValueError(f"no such mode: {mode}")


def admissible_pairs(findings: DataFrame, labels: DataFrame, tolerance: int | None = 10) -> DataFrame:
    """case_id, rank, label_ord, distance and both kinds for each pair in one file within `tolerance` lines (None: any distance). A
    label with equivalent places is as near as its nearest one."""
    places = labels.select(
        "case_id", "label_ord", F.col("type").alias("label_type"), F.col("family").alias("label_family"), F.explode("spans").alias("s")
    ).select("case_id", "label_ord", "label_type", "label_family", F.col("s.file").alias("file"), F.col("s.start_line").alias("s1"), F.col("s.end_line").alias("e1"))
    gap = F.greatest(F.lit(0), F.col("s1") - F.col("end_line"), F.col("line") - F.col("e1"))
    near = findings.select("case_id", "file", "line", "end_line", "type", "rank").join(places, ["case_id", "file"]).withColumn("gap", gap)
    if tolerance is not None:
        near = near.filter(F.col("gap") <= tolerance)
    return near.groupBy("case_id", "rank", "type", "label_ord", "label_type", "label_family").agg(F.min("gap").alias("distance"))


PAIR = "rung string, case_id string, rank int, label_ord int, distance int"
_CASE = ["rung", "case_id"]


def assign(pairs: DataFrame, folded: int = FOLDED, rounds: int = ROUNDS) -> DataFrame:
    """pairs (rung, case_id, rank, label_ord, distance) -> one-to-one matches: the nearest pair first, ties to the better rank, then the
    earlier label."""
    typed = kept(pairs.select(*_CASE, *[F.col(c).cast("int").alias(c) for c in ("rank", "label_ord", "distance")]), "pairs")
    sizes = kept(typed.groupBy(*_CASE).agg(F.count("*").alias("n")).filter(F.col("n") > folded).select(*_CASE), "large-cases")
    if sizes.isEmpty():
        return _fold(typed)
    large = kept(typed.join(sizes, _CASE, "left_semi"), "large-pairs")
    return _fold(typed.join(sizes, _CASE, "left_anti")).unionByName(_in_rounds(large, rounds))


def _fold(pairs: DataFrame) -> DataFrame:
    """The sequential assignment of a case's sorted pairs, in one row."""
    sorted_pairs = F.array_sort(F.collect_list(F.struct("distance", "rank", "label_ord")))
    start = F.struct(
        F.array().cast("array<int>").alias("ranks"), F.array().cast("array<int>").alias("labels"), F.array().cast("array<struct<distance: int, rank: int, label_ord: int>>").alias("taken")
    )

    def step(acc: Column, pair: Column) -> Column:
        free = ~F.array_contains(acc["ranks"], pair["rank"]) & ~F.array_contains(acc["labels"], pair["label_ord"])
        more = F.struct(
            F.array_append(acc["ranks"], pair["rank"]).alias("ranks"),
            F.array_append(acc["labels"], pair["label_ord"]).alias("labels"),
            F.array_append(acc["taken"], pair).alias("taken"),
        )
        return F.when(free, more).otherwise(acc)

    folded = pairs.groupBy(*_CASE).agg(F.aggregate(sorted_pairs, start, step, lambda acc: acc["taken"]).alias("taken"))
    return folded.select(*_CASE, F.inline("taken")).select(*_CASE, "rank", "label_ord", "distance")


def _in_rounds(open_: DataFrame, rounds: int) -> DataFrame:
    matched = []
    order = F.struct("distance", "rank", "label_ord")
    for _ in range(rounds):
        if open_.isEmpty():
            break
        of_rank = open_.groupBy(*_CASE, "rank").agg(F.min(order).alias("first"))
        of_label = open_.groupBy(*_CASE, "label_ord").agg(F.min(order).alias("first"))
        # The first pair of a finding that is also the first one of its label.
        taken = of_rank.select(*_CASE, "first").join(of_label.select(*_CASE, "first"), [*_CASE, "first"]).select(*_CASE, "first.rank", "first.label_ord", "first.distance")
        matched.append(kept(taken, "matched"))
        open_ = kept(open_.join(matched[-1].select(*_CASE, "rank"), [*_CASE, "rank"], "left_anti").join(matched[-1].select(*_CASE, "label_ord"), [*_CASE, "label_ord"], "left_anti"), "open-pairs")
    out = open_.groupBy(*_CASE).applyInPandas(_followed, PAIR)
    for part in matched:
        out = out.unionByName(part)
    return out


def _followed(frame: pd.DataFrame) -> pd.DataFrame:
    """The sequential assignment of one case's pairs."""
    ranks, labels, taken = set(), set(), []
    for row in frame.sort_values(["distance", "rank", "label_ord"])[["rung", "case_id", "rank", "label_ord", "distance"]].itertuples(index=False):
        if row.rank not in ranks and row.label_ord not in labels:
            ranks.add(row.rank)
            labels.add(row.label_ord)
            taken.append(row)
    return pd.DataFrame(taken, columns=["rung", "case_id", "rank", "label_ord", "distance"])


def match_all(cases: DataFrame, findings: DataFrame, labels: DataFrame, tolerance: int | None = 10, rungs: dict[str, str] | None = None) -> DataFrame:
    """One row a rung and case, those without findings, labels or pairs too: rung, case_id, matches (rank, label_ord, distance), unmatched_findings (ranks), unmatched_labels."""
    rungs = RUNGS if rungs is None else rungs
    found = match(findings, labels, tolerance, rungs)
    every = cases.select("case_id", F.explode(F.array(*[F.lit(r) for r in rungs])).alias("rung"))
    told = found.groupBy(*_CASE).agg(F.array_sort(F.collect_list(F.struct("rank", "label_ord", "distance"))).alias("matches"))
    ranks = findings.groupBy("case_id").agg(F.collect_list(F.col("rank").cast("int")).alias("ranks"))
    ords = labels.groupBy("case_id").agg(F.collect_list(F.col("label_ord").cast("int")).alias("ords"))
    none, empty = F.array().cast("array<int>"), F.array().cast("array<struct<rank: int, label_ord: int, distance: int>>")
    out = every.join(told, _CASE, "left").join(ranks, "case_id", "left").join(ords, "case_id", "left").withColumn("matches", F.coalesce("matches", empty))
    left = lambda all_, name: F.array_sort(F.array_except(F.coalesce(all_, none), F.transform("matches", lambda m: m[name])))
    return out.select(*_CASE, "matches", left("ranks", "rank").alias("unmatched_findings"), left("ords", "label_ord").alias("unmatched_labels"))


def match(findings: DataFrame, labels: DataFrame, tolerance: int | None = 10, rungs: dict[str, str] = RUNGS) -> DataFrame:
    """findings (with rank) and labels -> rung, case_id, rank, label_ord, distance."""
    pairs = admissible_pairs(findings, labels, tolerance).withColumn("type_family", family(F.col("type")))
    parts = F.array(
        *[
            F.when(agreement(mode, F.col("type"), F.col("type_family"), F.col("label_type"), F.col("label_family")), F.lit(rung))
            for rung, mode in rungs.items()
        ]
    )
    return assign(pairs.withColumn("rung", F.explode(F.array_compact(parts))))


def score(findings: DataFrame, labels: DataFrame, matches: DataFrame, rungs: dict[str, str] = RUNGS) -> DataFrame:
    """One row a rung: predictions, tp, neutral_optional, neutral_out_scope, fp, fn, precision, recall, f1 (unrounded)."""
    names = F.array(*[F.lit(r) for r in rungs])
    spread = findings.select("case_id", "rank").withColumn("rung", F.explode(names))
    with_match = spread.join(matches.select("rung", "case_id", "rank", "label_ord"), ["rung", "case_id", "rank"], "left").join(
        labels.select("case_id", "label_ord", "in_scope", "required"), ["case_id", "label_ord"], "left"
    )
    matched = F.col("label_ord").isNotNull()
    counts = with_match.groupBy("rung").agg(
        F.count("*").alias("predictions"),
        F.count_if(matched & F.col("in_scope") & F.col("required")).alias("tp"),
        F.count_if(matched & F.col("in_scope") & ~F.col("required")).alias("neutral_optional"),
        F.count_if(matched & ~F.col("in_scope")).alias("neutral_out_scope"),
        F.count_if(~matched).alias("fp"),
    )
    wanted = labels.filter("in_scope AND required").select("case_id", "label_ord").withColumn("rung", F.explode(names))
    missed = wanted.join(matches.select("rung", "case_id", "label_ord"), ["rung", "case_id", "label_ord"], "left_anti").groupBy("rung").agg(F.count("*").alias("fn"))
    every = findings.sparkSession.createDataFrame([(r,) for r in rungs], "rung string")
    full = every.join(counts, "rung", "left").join(missed, "rung", "left").na.fill(0)
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return full.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def unknown_cases(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """Case ids that findings name and no case has."""
    return findings.select("case_id").distinct().join(cases.select("case_id"), "case_id", "left_anti")


def require_known(findings: DataFrame, cases: DataFrame) -> None:
    strangers = [r["case_id"] for r in unknown_cases(findings, cases).orderBy("case_id").limit(5).collect()]
    if strangers:
        raise ValueError(f"findings of unknown cases: {', '.join(strangers)}")
