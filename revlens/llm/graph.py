"""Connected components by alternating large-star and small-star steps, as joins and aggregates over links.

Every step groups by a node with a map-side minimum and joins the minimum back; no node's links meet in one
task unless the join is free to split them. Steps are written to the shared folder, so that a lost executor costs one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, join_back, materialize


def _state(links: DataFrame) -> tuple[int, int, int]:
    row = links.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("s"),
        F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x"),
    ).first()
    return row["n"], int(row["s"]), row["x"]


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return join_back(both, least, ["a"]).filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """links: a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = join_back(links, least, ["a"]).filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b: long, no nulls) -> node, component: the smallest node reachable, for every node that has a link to a smaller one."""
    now = materialize(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "links"
    )
    state = _state(now)
    while state[0]:
        last, now = now, materialize(_small_star(_large_star(now)), "stars")
        drop_table(last)
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
