"""A training-data pipeline over ``documents``: five stages, each a whole operator whose decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm import decontam, linededup, mixing, neardup, quality
from revlens.llm.common import Run, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule, or whose host is rejected by any rule, go."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines stay in one document only; n_chars follows the text."""
    return linededup.dedup_lines(docs).select(*docs.columns).withColumn("n_chars", F.char_length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: those whose 5-word shingles have a similarity of 0.8 or more."""
    return neardup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark text go."""
    return decontam.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, with how often each is taken, so that sources meet their targets."""
    return mixing.mixed_docs(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix sources", mix),
]

#: Near copies are components of exact comparisons, which SQL can't express; tests hold the stage against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document that the stages keep: its columns, and size, source_size, target, repeats and taken of the mix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Run(spark) as tables:
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            tables.drop(but=1)
        return STAGES[-1][1](spark, docs, sf_dir)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus to train on: the documents that the stages keep, whole, each as often as the mix takes it (`epoch` from 1)."""
    return mixing.repeated(run(spark, sf_dir))
