"""Reducing claims: one a line, the strongest few, one a site, agreed ones, and rule findings that fill gaps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.text import let
from ..sources.scratch import kept

KEY = ["case_id", "file", "line", "type"]


def best_per_line(claims: DataFrame) -> DataFrame:
    """The most confident claim of each (case, file, line), the first of equals."""
    order = Window.partitionBy("case_id", "file", "line").orderBy(F.col("confidence").desc(), "ord")
    return claims.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def cap(claims: DataFrame, limit: int, room: bool = False) -> DataFrame:
    """The `limit` most confident claims of each case. limit 0 means all; with `room`, 0 means none."""
    if limit <= 0:
        return claims.filter(F.lit(False)) if room else claims
    order = Window.partitionBy("case_id").orderBy(F.col("confidence").desc(), "ord")
    return claims.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") <= limit).drop("_nth")


def chosen(claims: Column, limit: int) -> Column:
    """best_per_line and cap of the claims of a case in its row: an array of structs with ord, file, line and confidence -> those that stay, the strongest first."""
    ranked = F.sort_array(F.transform(claims, lambda c: F.struct((-c["confidence"]).alias("weak"), c["ord"].alias("ord"), c.alias("claim"))))
    places = lambda xs: F.transform(xs, lambda x: F.struct(x["claim"]["file"].alias("file"), x["claim"]["line"].alias("line")))
    first = lambda xs, at: F.filter(xs, lambda x, k: F.array_position(at, F.get(at, k)) == k + 1)
    stay = let(ranked, lambda xs: let(places(xs), lambda at: first(xs, at)))
    return F.transform(F.slice(stay, 1, limit) if limit > 0 else stay, lambda x: x["claim"])


#: Lines of a block, which one task takes at a time; a file of more lines is dealt over as many tasks as it has blocks.
BLOCK_LINES = 1 << 16
OPEN, DROPPED, KEPT = 0, 1, 2


def _judged(lines: Sequence[int], order: Sequence[int], states: list[int], halo: Sequence[bool], radius: int) -> list[int]:
    """States of a block's points (one a line, ascending) once all that follows from them is drawn. order: the points that wait, the strongest first. A point is dropped if a stronger
    kept one is within the radius, kept if every stronger one there is dropped, and stays open if it depends on an open one of the halo, which another block judges."""
    place = [0] * len(lines)
    for nth, k in enumerate(order):
        place[k] = nth
    for k in order:
        if halo[k] or states[k] != OPEN:
            continue
        state = KEPT
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(lines) and abs(lines[j] - lines[k]) <= radius and state != DROPPED:
                if states[j] == KEPT:
                    state = DROPPED
                elif states[j] == OPEN and place[j] < place[k]:
                    state = OPEN
                j += step
        states[k] = state
    return states


def _blocks_judged(keys: Sequence[str], order: Sequence[str], radius: int, schema: str):
    """Rows of points sorted by keys, block and line -> the rows that are no halo, with their states."""

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _grouped(batches, [*keys, "block"]):
            ids = frame.groupby([*keys, "block"], sort=False, dropna=False).ngroup().to_numpy()
            lines, states, halo = frame["line"].tolist(), frame["state"].tolist(), frame["halo"].tolist()
            # A point that waits has its whole order; those that were kept beforehand have none.
            rank = frame[list(order)].reset_index(drop=True).sort_values(list(order), na_position="last", kind="stable").index.to_numpy()
            by_rank = np.empty(len(frame), np.int64)
            by_rank[rank] = np.arange(len(frame))
            starts = np.flatnonzero(np.diff(ids, prepend=-1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(frame)], strict=True):
                waiting = [k for k in range(b - a) if states[a + k] == OPEN]
                waiting.sort(key=lambda k, a=a: by_rank[a + k])
                states[a:b] = _judged(lines[a:b], waiting, states[a:b], halo[a:b], radius)
            out = frame.assign(state=states)[~frame["halo"].to_numpy(bool)]
            yield pa.RecordBatch.from_pandas(out[[*keys, "line", *order, "state"]], schema=arrow, preserve_index=False)

    return judge


def _grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows in frames that hold whole groups."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        frame = batch.to_pandas(integer_object_nulls=True)
        if not len(frame):
            continue
        last = frame[keys].iloc[-1]
        same = (frame[keys].eq(last) | (frame[keys].isna() & last.isna())).all(axis=1).to_numpy()
        start = len(frame) - int(np.argmin(same[::-1])) if not same.all() else 0
        if start:
            yield pd.concat([*held, frame.iloc[:start]], ignore_index=True)
            held = []
        elif held and not (held[-1][keys].iloc[-1].eq(last) | (held[-1][keys].iloc[-1].isna() & last.isna())).all():
            yield pd.concat(held, ignore_index=True)
            held = []
        held.append(frame.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _spaced(points: DataFrame, keys: list[str], order: list[str], radius: int, block_lines: int = 0) -> DataFrame:
    """points (keys, line, order, state), one a line -> the same rows, each kept or dropped: greedily, in order, a point is kept if none that is kept is within the radius.

    A block of lines is judged in one task, in linear time. What is near its edge is judged along with the neighbouring block: each has the other's edge as a halo, and where a decision depends on an open
    one of the halo it waits for the next round. So a file of one block takes one round, and a longer one as many as a chain of decisions crosses blocks."""
    width = max(block_lines or BLOCK_LINES, radius + 1)
    kinds = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "line", *order, "state"))
    while True:
        own = F.floor(F.col("line") / F.lit(width)).cast("long")
        near = F.array_distinct(F.array(own, F.floor((F.col("line") - radius) / F.lit(width)).cast("long"), F.floor((F.col("line") + radius) / F.lit(width)).cast("long")))
        dealt = points.select("*", own.alias("own"), F.explode(near).alias("block")).withColumn("halo", F.col("block") != F.col("own")).drop("own")
        sorted_ = dealt.repartition(*keys, "block").sortWithinPartitions(*keys, "block", "line")
        points = kept(sorted_.mapInArrow(_blocks_judged(keys, order, radius, schema), schema), "spaced")
        if points.filter(F.col("state") == OPEN).isEmpty():
            return points


def one_per_site(claims: DataFrame, radius: int = 5, block_lines: int = 0) -> DataFrame:
    """Of claims of one case and file within `radius` lines of each other, the most confident stays (ties: the smaller line, then the earlier
    one). Claims without a line never merge. Of a line only the strongest claim can stay, so the others are gone before lines meet."""
    keys = ["case_id", "file"]
    order = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("weak"), F.col("line").cast("long").alias("at"), F.col("ord").cast("long").alias("nth"))
    lines = claims.filter("line IS NOT NULL").groupBy(*keys, F.col("line").cast("long").alias("line")).agg(F.min(order).alias("first"))
    points = lines.select(*keys, "line", "first.*", F.lit(OPEN).alias("state"))
    stays = _spaced(points, keys, ["weak", "at", "nth"], radius, block_lines).filter(F.col("state") == KEPT).select(*keys, F.col("nth").alias("ord"))
    return claims.filter("line IS NOT NULL").join(stays, [*keys, "ord"], "left_semi").select(*claims.columns).unionByName(claims.filter("line IS NULL"))


def fill_gaps(published: DataFrame, extra: DataFrame, radius: int = 5, scope: str = "case", block_lines: int = 0) -> DataFrame:
    """The rows of `extra` that have no published line of their file within `radius`, in order; a kept one suppresses later ones. scope `case` compares
    within a case, `global` across cases."""
    keys = ["case_id", "file"] if scope == "case" else ["file"]
    none, line = F.lit(None), F.col("line").cast("long").alias("line")
    taken = published.filter("line IS NOT NULL").select(*keys, line).distinct().select("*", none.cast("long").alias("nth"), none.cast("string").alias("of"), F.lit(KEPT).alias("state"))
    first = F.min(F.struct(F.col("ord").cast("long").alias("nth"), F.col("case_id").cast("string").alias("of"))).alias("first")
    waiting = extra.filter("line IS NOT NULL").groupBy(*keys, line).agg(first).select(*keys, "line", "first.*", F.lit(OPEN).alias("state"))
    waiting = waiting.join(taken.select(*keys, "line"), [*keys, "line"], "left_anti")  # so that a line is one point
    rows = _spaced(taken.unionByName(waiting), keys, ["nth", "of"], radius, block_lines).filter((F.col("state") == KEPT) & F.col("nth").isNotNull())
    stays = rows.select("file", F.col("nth").alias("ord"), F.col("of").alias("case_id"))
    return extra.filter("line IS NOT NULL").join(stays, ["case_id", "file", "ord"], "left_semi").select(*extra.columns).unionByName(extra.filter("line IS NULL"))


def last_verdicts(verdicts: DataFrame) -> DataFrame:
    """One verdict a claim: the last row wins."""
    order = Window.partitionBy(*KEY).orderBy(F.col("ord").desc())
    return verdicts.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").drop("_nth")


def agreed(claims: DataFrame, *verdicts: DataFrame) -> DataFrame:
    """Claims that every verifier established; one that a verifier never saw is not agreed on."""
    for v in verdicts:
        claims = claims.join(last_verdicts(v).filter("verdict = 'established'").select(*KEY), KEY, "left_semi")
    return claims


def above_floor(findings: DataFrame, floor: float = 0.6) -> DataFrame:
    return findings.filter(F.coalesce("confidence", F.lit(1.0)) >= floor)


def targets(files: DataFrame, reported: DataFrame) -> DataFrame:
    """Changed code files (case_id, path) without a claim, of cases that have one."""
    seen = reported.select("case_id", F.col("file").alias("path")).distinct()
    code = files.filter("side = 'head'").filter(F.col("path").endswith(".py")).select("case_id", "path")
    return code.join(seen.select("case_id").distinct(), "case_id", "left_semi").join(seen, ["case_id", "path"], "left_anti")


def within(claims: DataFrame, remaining: DataFrame) -> DataFrame:
    return claims.join(remaining.select("case_id", F.col("path").alias("file")), ["case_id", "file"], "left_semi").select(*claims.columns)


def fresh(claims: DataFrame, claimed: DataFrame) -> DataFrame:
    """The first claim of each line that nothing has claimed yet."""
    key = ["case_id", "file", "line"]
    new = claims.join(claimed.select(*key).distinct(), key, "left_anti")
    order = Window.partitionBy(*key).orderBy("ord")
    return new.withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select(*claims.columns)


def unanswered(wanted: DataFrame, stored: DataFrame, key: str = "case_id") -> DataFrame:
    """Resume: rows of `wanted` without a stored answer, or with one that failed."""
    good = stored.filter(F.coalesce("error", F.lit("")) == "").select(key).distinct()
    return wanted.join(good, key, "left_anti")


def appended(claims: DataFrame, added: DataFrame) -> DataFrame:
    """Both, the added ones after all others in order."""
    offset = claims.agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("_offset"))
    shifted = added.join(F.broadcast(offset)).withColumn("ord", F.col("ord") + F.col("_offset")).drop("_offset")
    return claims.unionByName(shifted, allowMissingColumns=True)
