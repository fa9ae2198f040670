"""The registered queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, langid, linededup, mixing, periodic, quality, ranked, sharding, simhash, suffixdedup, toxicity, warc

from .common import as_bytes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.apply_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixdedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "decon.n_words",
        "decon.n_hit",
        F.size("decon.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("decon.items", ",").cast("binary"), 256).alias("items_sha256"),
        "decon.contaminated",
    )


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size")
    keep = ["doc_id", size, F.crc32(as_bytes()).alias("text_crc32")]
    placed = sharding.assign_shards(_table(spark, sf_dir, "documents"), keep=keep)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def planted_runs(doc_id: int | None, n_words: int) -> tuple[int, int] | None:
    """A tenth of the documents, by the checksum of their id, repeat their words from some place on (op13's contract)."""
    h = crc32(str(doc_id).encode())
    if doc_id is None or h % 10:
        return None
    g = h // 10
    a = g % n_words
    return a, 1 + (n_words - a) // (3 + g % 8)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(_table(spark, sf_dir, "documents"), tiling=planted_runs)
    listed = F.transform("periodic.runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = F.col("periodic.strongest")
    return found.select(
        "doc_id",
        F.size("periodic.runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * periodic.strongest.length div periodic.strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_quality_rules, op3_simhash_dedup, op4_line_dedup, op5_html_extract, op6_language_id, op7_toxicity, op8_suffix_dedup, op9_decontaminate, op10_warc_archive, op11_ranked_search, op12_sharding, op13_periodic_runs)}
