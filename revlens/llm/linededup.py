"""Line dedup across documents (DataFrame functions only).

A line that many documents hold stays in one of them, the one with the largest doc_id. Only 128-bit hashes of line keys travel. They
are dealt by hash and a slot of the document, so that a line of a third of all documents is counted in many tasks; the few
summaries of each hash are then range-partitioned by hash, sorted within by document and position, and streamed: the
first of each hash is the keeper, the sum its number of documents. The verdicts come back as one compressed keep bitmap a
document (only the 64-line words in which something is dropped), never as text.

Defined results: null or empty text is one empty line; a document is a distinct doc_id, so repeated rows count
once and are treated alike; a null doc_id counts as no document and never keeps a common line; an empty table gives an empty
result. Columns of the input other than doc_id and text pass through `dedup_lines` unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WHITE, ascii_lower, drop_table, materialize, packed

#: Into so many tasks the documents of one line are dealt before they are counted.
SLOTS = 64


def _lines(text: str = "text"):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n")


def _row_hash():
    """Together with doc_id it names a row's content, so that rows that share a doc_id but not the text stay apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def line_occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row, pos, h1, h2 for each line whose key has min_chars code points or more."""
    key = F.trim(F.col("line"), F.lit(WHITE))
    long_lines = (
        docs.select("doc_id", _row_hash().alias("row"), F.posexplode(_lines()).alias("pos", "line"))
        .select("doc_id", "row", "pos", key.alias("line"))
        .filter(F.char_length("line") >= min_chars)
        .withColumn("line", ascii_lower(F.col("line")))
    )
    return long_lines.select(
        "doc_id", "row", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2")
    )


def common_lines(occurrences: DataFrame, min_docs: int) -> DataFrame:
    """h1, h2, keeper of each hash that min_docs documents or more hold."""
    slot = F.pmod(F.hash("doc_id"), F.lit(SLOTS)).alias("slot")
    counted = (
        occurrences.filter(F.col("doc_id").isNotNull())
        .select("h1", "h2", slot, "doc_id", "pos")
        .repartition("h1", "h2", "slot")
        .groupBy("h1", "h2", "slot", "doc_id")
        .agg(F.min("pos").alias("pos"))
        .groupBy("h1", "h2", "slot")
        .agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"), F.max_by(F.col("pos"), F.col("doc_id")).alias("pos"))
    )
    streamed = counted.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.col("last").desc(), "pos")
    key = Window.partitionBy("h1", "h2")
    return (
        streamed.withColumn("nth", F.row_number().over(key.orderBy(F.col("last").desc(), "pos")))
        .withColumn("all_docs", F.sum("docs").over(key))
        .filter((F.col("nth") == 1) & (F.col("all_docs") >= min_docs))
        .select("h1", "h2", F.col("last").alias("keeper"))
    )


def drop_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, row, n_dropped, dropped: map of 64-line word -> bits set where a line goes. Documents that lose nothing are absent:
    all their lines are kept. Written when this returns; the tables on the way there are gone again."""
    occurrences = materialize(line_occurrences(docs, min_chars), "lines")
    common = materialize(common_lines(occurrences, min_docs), "common-lines")
    gone = occurrences.join(common, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    words = (
        gone.select("doc_id", "row", "pos")
        .distinct()
        .groupBy("doc_id", "row", F.shiftright("pos", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, pos % 64))").alias("bits"))
    )
    bitmaps = materialize(
        words.groupBy("doc_id", "row").agg(
            F.sum(F.bit_count("bits")).alias("n_dropped"),
            F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"),
        ),
        "line-bitmaps",
    )
    for table in (occurrences, common):
        drop_table(table)
    return bitmaps


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with text replaced by its kept lines, and a struct `line_dedup` of n_lines and n_dropped."""
    left = docs.select(packed(docs).alias("d"), F.col("doc_id").alias("l_doc"), _row_hash().alias("l_row"))
    right = bitmaps.select(F.col("doc_id").alias("r_doc"), F.col("row").alias("r_row"), "dropped")
    # A merge at every size: the texts are dealt out by document once, whether or not the bitmaps would fit a broadcast.
    joined = left.join(right.hint("merge"), F.col("l_doc").eqNullSafe(F.col("r_doc")) & (F.col("l_row") == F.col("r_row")), "left")
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(
        F.expr("filter(lines, (x, i) -> (shiftright(coalesce(try_element_at(dropped, shiftright(i, 6)), 0L), i % 64) & 1L) = 0L)")
    )
    cut = joined.select("d", "dropped", _lines("d.text").alias("lines")).withColumn("kept", kept)
    counts = F.struct(F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"))
    text = F.array_join("kept", "\n").alias("text")
    columns = [text if c == "text" else F.col("d")[c].alias(c) for c in docs.columns if c != "line_dedup"]
    return cut.select(*columns, counts.alias("line_dedup"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs, all columns, with common lines gone from text; plus `line_dedup`."""
    return apply_bitmaps(docs, drop_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs))
