"""Quotes that are claimed of many files: an index of character grams finds the files that may hold a quote, so texts meet only quotes that they may have.

A text is marked at few of its places: of every WINDOW neighbouring grams of GRAM bytes, the one with the least hash. A quote that is long enough to fill a window has at least one mark, at the
same bytes wherever it stands, so a text that holds the quote has all of the quote's marks. Each quote is looked up by the mark that fewest texts have; one whose mark no text has is nowhere.
Quotes too short for a window are looked up by the grams of SHORT bytes they begin with, of which only those that some quote begins with are listed. Candidates come from an equi-join on the
mark, and `contains` decides, so nothing is lost and nothing is guessed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..sources.scratch import kept
from .anchoring import MIN_QUOTE, decided, hits_of, quote_hits, shown_texts
from .changes import Cases

GRAM, WINDOW, SHORT = 8, 24, 4
#: Quotes of so many bytes have a mark.
MARKED = GRAM + WINDOW - 1
_PIECE = 1 << 20


def _grams(data: bytes, size: int) -> np.ndarray:
    """The bytes at each place as a number: grams are told apart exactly."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(raw) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out << np.uint64(8)) | raw[k : k + n]
    return out


def _scattered(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x * np.uint64(0xD6E8FEB86659FD93)


def marks(text: bytes) -> np.ndarray:
    """The different marks of a text, a piece of it at a time."""
    found = []
    for at in range(0, max(1, len(text) - MARKED + 1), _PIECE):
        grams = _grams(text[at : at + _PIECE + MARKED - 1], GRAM)
        if len(grams) >= WINDOW:
            order = _scattered(grams)
            least = np.lib.stride_tricks.sliding_window_view(order, WINDOW).argmin(axis=1) + np.arange(len(order) - WINDOW + 1)
            found.append(np.unique(grams[np.unique(least)]))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _marked(columns: list[str]):
    """Rows (..., text binary) -> the columns and `mark`, a row a mark."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [marks(t.as_py() or b"") for t in batch.column("text")]
            take = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            values = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in columns], pa.array(values)], names=[*columns, "mark"])

    return mark


def _prefixed(begins):
    """begins: a broadcast of sorted SHORT-byte grams. As _marked, but for every place where one of them stands."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.intersect1d(_grams(t.as_py() or b"", SHORT), begins.value) for t in batch.column("text")]
            take = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            values = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("case_id").take(take), batch.column("file").take(take), pa.array(values)], names=["case_id", "file", "mark"])

    return mark


def candidates(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """quotes (quote: different normalised ones), texts (case_id, file, text) -> quote, case_id, file of every text that may hold the quote."""
    plain = texts.select("case_id", "file", F.col("text").cast("binary").alias("text"))
    kinds = "".join(f"{c} {texts.schema[c].dataType.simpleString()}, " for c in ("case_id", "file"))
    size = F.octet_length("quote")
    long = kept(quotes.filter(size >= MARKED).select("quote", F.col("quote").cast("binary").alias("text")).mapInArrow(_marked(["quote"]), "quote string, mark long"), "quote-marks")
    held = kept(plain.mapInArrow(_marked(["case_id", "file"]), f"{kinds}mark long").join(long.select("mark").distinct(), "mark", "left_semi"), "text-marks")
    counts = held.groupBy("mark").agg(F.count("*").alias("n"))
    rarest = long.join(counts, "mark", "left").groupBy("quote").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "mark")).alias("one")).filter("one.n > 0").select("quote", F.col("one.mark").alias("mark"))
    found = held.join(rarest, "mark").select("quote", "case_id", "file")
    short = quotes.filter((size >= SHORT) & (size < MARKED)).select("quote", F.conv(F.hex(F.substring(F.col("quote").cast("binary"), 1, SHORT)), 16, 10).cast("long").alias("mark"))
    begins = np.array([r["mark"] for r in short.select("mark").distinct().toLocalIterator()], np.uint64)  # at most 2^32 numbers; in practice as many as there are short quotes
    if len(begins):
        listed = plain.mapInArrow(_prefixed(quotes.sparkSession.sparkContext.broadcast(np.unique(begins))), f"{kinds}mark long")
        found = found.unionByName(listed.join(short, "mark").select("quote", "case_id", "file"))
    return found


def anchor_shared(claims: DataFrame, cases: Cases, min_quote: int = MIN_QUOTE, with_deletions: bool = False) -> DataFrame:
    """As anchoring.anchor, for few quotes that are claimed of many files: a file's text is read once for all quotes, and again only for those it may hold."""
    shown = kept(shown_texts(cases, with_deletions), "shown-texts")
    said = F.coalesce("quote", F.lit(""))
    names = kept(claims.select(said.alias("_raw")).distinct().withColumn("_quote", normalise(F.col("_raw"))), "quotes")  # a quote is normalised once, however often it is claimed
    quoted = claims.withColumn("_raw", said).join(names, "_raw").drop("_raw")
    everything = shown.select("case_id", "file", F.concat_ws("\n", "_said", F.array_join(F.transform("_lost", lambda x: x["said"]), "\n")).alias("text"))
    pairs = candidates(names.filter(F.char_length("_quote") >= min_quote).select(F.col("_quote").alias("quote")).distinct(), everything)
    hits = quote_hits(pairs.withColumnRenamed("quote", "_quote").join(shown, ["case_id", "file"]), min_quote).select("case_id", "file", F.col("_quote"), "_found", "_gone")
    hits = kept(hits.filter((F.size("_found") > 0) | F.col("_gone").isNotNull()), "quote-hits")
    lines = claims.select("case_id", "file", "line").distinct().join(shown.select("case_id", "file", "_said", "_top"), ["case_id", "file"])
    at = F.when(F.col("line").between(1, F.col("_top")), F.split_part("_said", F.lit("\n"), F.greatest(F.col("line"), F.lit(1))))
    lines = kept(lines.select("case_id", "file", F.col("line").alias("_line"), "_top", at.alias("_there")), "claimed-lines")
    place = [quoted["case_id"] == lines["case_id"], quoted["file"] == lines["file"], quoted["line"].eqNullSafe(lines["_line"])]
    joined = quoted.join(lines, place, "left").drop(lines["case_id"], lines["file"], lines["_line"])
    return decided(joined.join(hits, ["case_id", "file", "_quote"], "left"), claims.columns, min_quote)


def anchor_every(places: DataFrame, asked: DataFrame, cases: Cases, min_quote: int = MIN_QUOTE, with_deletions: bool = False) -> DataFrame:
    """As anchoring.anchor, for claims that every quote of asked (ord, quote) is at every one of places (case_id, file, line). What may hold which quotes is settled in one row a place, and the
    quotes, few as they are, go to every task: claims, of which there are as many as places times quotes, are made where they leave, and nothing of theirs is exchanged."""
    shown = kept(shown_texts(cases, with_deletions), "shown-texts")
    names = asked.withColumn("_quote", normalise(F.coalesce("quote", F.lit(""))))
    everything = shown.select("case_id", "file", F.concat_ws("\n", "_said", F.array_join(F.transform("_lost", lambda x: x["said"]), "\n")).alias("text"))
    pairs = candidates(names.filter(F.char_length("_quote") >= min_quote).select(F.col("_quote").alias("quote")).distinct(), everything)
    perhaps = pairs.groupBy("case_id", "file").agg(F.collect_set("quote").alias("_perhaps"))
    met = places.join(shown, ["case_id", "file"], "left").join(perhaps, ["case_id", "file"], "left")
    hits = F.filter(F.transform("_perhaps", lambda q: F.struct(q.alias("_quote"), *(c.alias(n) for n, c in hits_of(q, min_quote).items()))), lambda h: (F.size(h["_found"]) > 0) | h["_gone"].isNotNull())
    there = F.when(F.col("line").between(1, F.col("_top")), F.split_part("_said", F.lit("\n"), F.greatest(F.col("line"), F.lit(1))))
    rows = met.select("case_id", "file", "line", "_top", there.alias("_there"), F.coalesce(hits, F.expr("array()")).alias("_all"))
    own = F.when(F.size("_all") > 0, F.get(F.filter("_all", lambda h: h["_quote"] == F.col("_quote")), F.lit(0)))
    claimed = rows.crossJoin(F.broadcast(names)).withColumn("_own", own).withColumns({"_found": F.col("_own._found"), "_gone": F.col("_own._gone")})
    return decided(claimed, ["case_id", "ord", "file", "line", "quote"], min_quote)
