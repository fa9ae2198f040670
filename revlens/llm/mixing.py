"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source gets a share of all words in proportion to its weight; a source that would be repeated more than
``max_epochs`` times is clamped there and the excess goes to the others by weight. With targets min(cap, level * weight)
the water level is the largest value of (total - caps of the k fullest) / (weights of the rest), so one sorted pass over
the sources finds it. A target is spent as whole repetitions of every document and one more of some documents: those
that come first in a seeded order until the rest of the target is reached. The order is never sorted as a whole:
a histogram of the leading digits of each document's key, kept per source, finds the one cell in which the quota ends, and
only that cell is ordered, to find the last document that is taken once more. This cut-off, one row a source, goes to all documents, so that
whatever else they carry (whole texts in `mixed_docs`) never meets in a window.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source without words
gets target 0; equal keys are ordered by doc_id (null last), then size; repeated rows are separate documents, but rows that agree in doc_id and size are taken alike;
an empty table gives an empty result. Other columns of the input are ignored by `mix_sources`, whatever their names, and kept by
`mixed_docs`, which replaces `size`, `source_size`, `target`, `repeats` and `taken`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, packed, unpacked

#: Leading hex digits of the order key that make a histogram cell: 4096 cells a source.
CELL_DIGITS = 3
ADDED = ("size", "source_size", "target", "repeats", "taken")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size) -> the same with weight and target. One row a source, so the two sorts are over sources only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    cyclic = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weighed = (
        ranked.withColumn("weight", F.element_at(cyclic, (F.col("rank") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * float(max_epochs))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
    )
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    filled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def _plan(slim: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    """slim (source, size, key, doc_id; written) -> of, source_size, target, whole, and the cut-off: last_cell (null: nobody is taken once more) and
    `last`, the order key of the last document of that cell that is taken once more (null: none of it)."""
    cell = F.substring("key", 1, CELL_DIGITS)
    cells = materialize(
        slim.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("cell_size")), "mix-cells"
    )
    sizes = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    quotas = (
        source_targets(sizes, weights, max_epochs)
        .withColumn("whole", whole.cast("long"))
        .withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    ends = (
        cells.withColumnRenamed("source", "of")
        .withColumn("upto", F.sum("cell_size").over(Window.partitionBy("of").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("from", F.col("upto") - F.col("cell_size"))
    )
    # The cell in which the quota ends; cells before it are taken as a whole, cells after it not at all.
    found = materialize(
        quotas.join(ends, F.col("source").eqNullSafe(F.col("of")) & (F.col("from") < F.col("quota")), "left")
        .groupBy("source", "source_size", "target", "whole", "quota")
        .agg(F.max(F.struct("from", "cell")).alias("last"))
        .select(F.col("source").alias("of"), "source_size", "target", "whole", "quota", F.col("last.cell").alias("last_cell"), F.col("last.from").alias("last_from")),
        "mix-quotas",
    )
    ordered = slim.withColumn("cell", cell).join(found, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("last_cell")))
    order = Window.partitionBy("of", "cell").orderBy("key", F.col("doc_id").asc_nulls_last(), "size")
    upto = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    taken = ordered.withColumn("upto", upto).filter(F.col("last_from") + F.col("upto") - F.col("size") / 2 < F.col("quota"))
    last = taken.groupBy(F.col("of").alias("of_last")).agg(F.max(_order_key()).alias("last"))
    return materialize(found.join(last, F.col("of").eqNullSafe(F.col("of_last")), "left").drop("of_last", "quota", "last_from"), "mix-plan")


def _order_key():
    """A struct that sorts like the seeded order."""
    return F.struct("key", F.col("doc_id").isNull().alias("unnamed"), "doc_id", "size")


def _slim(docs: DataFrame, seed: int, *more) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return materialize(docs.select("doc_id", "source", size, F.substring(key, 1, 16).alias("key"), *more), "mix-sizes")


def _planned(slim: DataFrame, weights: Sequence[float], max_epochs: int) -> DataFrame:
    cell = F.substring("key", 1, CELL_DIGITS)
    planned = slim.join(_plan(slim, weights, max_epochs), F.col("source").eqNullSafe(F.col("of")))
    extra = (cell < F.col("last_cell")) | ((cell == F.col("last_cell")) & (_order_key() <= F.col("last")))
    return planned.withColumn("repeats", F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")).withColumn("taken", F.col("repeats") * F.col("size"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """docs (doc_id, text, source) -> doc_id, source, size, source_size, target, repeats, taken = repeats * size."""
    return _planned(_slim(docs, seed), weights, max_epochs).select("doc_id", "source", *ADDED)


def mixed_docs(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """docs, all columns, with the mix's decision about each: size, source_size, target, repeats, taken."""
    kept = [c for c in docs.columns if c not in ADDED]
    return _planned(_slim(docs, seed, packed(docs).alias("d")), weights, max_epochs).select(*unpacked("d", kept), *ADDED)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: each row as often as `repeats` says, with `epoch` from 1; rows that the mix leaves out are gone."""
    times = F.when(F.col("repeats") > 0, F.sequence(F.lit(1).cast("long"), F.col("repeats")))
    return mixed.withColumn("epoch", F.explode(times))
