"""Case files, predictions, logs and manifests: JSON lines with explicit schemas, read and written by Spark."""

from __future__ import annotations

import json
import os
import subprocess
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..operators.spans import label_table

RUNS, REPORTS, DATA = "runs", "reports", "data"
#: What a case can't do without.
REQUIRED = ("case_id", "pr_title", "pr_description", "changed_files", "added_lines", "head_files", "diff", "findings")


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop sees them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def path_exists(spark: SparkSession, path: str) -> bool:
    store, at = _at(spark, path)
    return store.exists(at)


def _exists(path: str | Path) -> bool:
    """Of a path in a run folder: local, or a URI of a store that the running session reaches."""
    return path_exists(SparkSession.active(), str(path)) if "://" in str(path) else Path(path).exists()


def _read_text(path: str | Path) -> str:
    if "://" not in str(path):
        return Path(path).read_text(encoding="utf-8")
    return SparkSession.active().read.text(str(path), wholetext=True).first()["value"]


def _write_text(path: str | Path, text: str) -> None:
    if "://" not in str(path):
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
        return
    store, at = _at(SparkSession.active(), str(path))
    out = store.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), value of every line of the text files at path. Each split numbers its own lines; how many stand before it follows from one count a split."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*place, F.monotonically_increasing_id().alias("id"), "value")
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "split", "first", before.alias("before"))
    return lines.join(F.broadcast(splits), ["file", "split"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line_no"), "value")


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file, line_no, row, bad (the line, if it is no JSON of the schema) of every line that isn't blank."""
    told = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = numbered_lines(spark, path).filter(F.trim(F.regexp_replace("value", r"\s", " ")) != "").withColumn("row", told)
    return rows.select("file", "line_no", "row", F.when(F.col("row").isNull() | ~F.col("value").rlike(r"^\s*\{"), F.col("value")).otherwise(F.col("row._bad")).alias("bad"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a malformed line fails the job, and the error names it as path:line."""
    rows = _parsed(spark, path, schema)
    message = F.concat(F.regexp_replace("file", "^file:/+", "/"), F.lit(":"), F.col("line_no").cast("string"), F.lit(": this line is malformed"))
    names = [f.name for f in rows.schema["row"].dataType.fields if f.name != "_bad"]
    # Whoever looks at a field has the line checked, so no later check of the fields can come before.
    sound = rows.withColumn("row", F.when(F.col("bad").isNull(), F.col("row")).otherwise(F.raise_error(message)))
    return sound.select(*[F.col("row")[n].alias(n) for n in names])


def check_jsonl(spark: SparkSession, path: str, limit: int = 5) -> list[tuple[str, int]]:
    """(file, line number) of the first lines that are no JSON."""
    bad = numbered_lines(spark, path).filter(F.trim(F.regexp_replace("value", r"\s", " ")) != "").filter(F.try_parse_json("value").isNull())
    return [(r["file"], r["line_no"]) for r in bad.orderBy("file", "line_no").limit(limit).collect()]


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing file is an empty table."""
    return read_jsonl(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema)


def write_rows(rows: DataFrame, path: str, ordered_by: list[str] | None = None) -> None:
    """Overwrites. With `ordered_by` one file in that order (an export); else as many files as partitions."""
    out = rows.coalesce(1).sortWithinPartitions(*ordered_by) if ordered_by else rows
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases with defaults in place of missing optional fields; a case without a required one fails the job."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"{path}: no such cases file; ingest the repository first")
    cases = read_jsonl(spark, path, schemas.CASES)
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    message = F.concat(F.lit(f"{path}: case "), F.coalesce("case_id", F.lit("?")), F.lit(" lacks "), F.array_join(lacking, ", "))
    return with_defaults(_held(cases, F.size(lacking) == 0, message))


def _held(rows: DataFrame, right: Column, message: Column) -> DataFrame:
    """rows, of which any that isn't right fails the job."""
    return rows.filter(F.when(right, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def with_defaults(cases: DataFrame) -> DataFrame:
    """Null fields become empty ones; a row without case_id fails the job."""
    out = _held(cases, F.col("case_id").isNotNull(), F.lit("a case has no case_id"))
    for f in cases.schema.fields:
        kind = f.dataType.simpleString()
        empty = {"boolean": F.lit(False), "string": F.lit("")}.get(kind)
        if empty is None and kind.startswith("array"):
            empty = F.array().cast(kind)
        if empty is None and kind.startswith("map"):
            empty = F.create_map().cast(kind)
        if empty is not None and f.name != "case_id":
            out = out.withColumn(f.name, F.coalesce(f.name, empty))
    return out


def load_labels(cases: DataFrame) -> DataFrame:
    return label_table(cases)


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return as_predictions(read_jsonl(spark, path, schemas.PREDICTIONS))


def as_predictions(rows: DataFrame) -> DataFrame:
    """Claims in the library's form: line, or start_line where there is none; end_line defaults to it; confidence 1; texts empty. `ord`, which decides
    ties, is the row's own, or follows the order in which rows are read (within a file that is one split, the order of its lines)."""
    line = F.coalesce("line", "start_line")
    out = rows.withColumn("line", line).withColumn("end_line", F.coalesce("end_line", line)).withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))
    out = out.withColumn("message", F.coalesce("message", "title", F.lit("")))
    for c in ("type", "detector", "stage", "quote"):
        out = out.withColumn(c, F.coalesce(c, F.lit("")))
    read = F.monotonically_increasing_id()
    out = out.withColumn("ord", F.coalesce("ord", read) if "ord" in rows.columns else read)
    return out.select(*[c.split()[0] for c in schemas.CLAIMS.split(", ")])


def prediction_rows(claims: DataFrame) -> DataFrame:
    """The output projection."""
    return claims.select("case_id", "ord", "file", "line", "end_line", "type", "confidence", "detector", "stage", "message")


def load_answer_key(spark: SparkSession, path: str) -> DataFrame:
    """pull_id, head_commit, is_defective, findings; empty without a file."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"pull_id long, head_commit string, is_defective boolean, findings array<{schemas.FINDING}>")
    keys = spark.read.schema(schemas.KEYS).option("multiLine", True).json(path)
    return keys.select(F.explode("pull_requests").alias("pull_id", "k")).select(F.col("pull_id").cast("long").alias("pull_id"), "k.head_commit", "k.is_defective", "k.findings")


def read_manifest(folder: str | Path) -> dict:
    path = f"{folder}/config.json"
    if not _exists(path):
        raise FileNotFoundError(f"{folder} is no run: it has no config.json")
    return json.loads(_read_text(path))


def write_manifest(folder: str | Path, manifest: dict) -> None:
    _write_text(f"{folder}/config.json", json.dumps(manifest, indent=2, ensure_ascii=False) + "\n")


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def commit(folder: str = ".") -> str:
    done = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True)
    return done.stdout.strip() if done.returncode == 0 else ""


def provenance(folder: str = ".") -> dict:
    return {"created_utc": now(), "commit": commit(folder)}


def cases_file(repository: str, root: str | None = None) -> str:
    return f"{root or DATA}/{repository}/cases.jsonl"


def answer_key_file(repository: str, root: str | None = None) -> str:
    return f"{root or DATA}/{repository}/answer_key.json"


def recorded_cases_file(manifest: dict) -> str:
    """What the run recorded, else the repository's default."""
    return manifest.get("cases_file") or cases_file(manifest["repository"])


def cases_of(spark: SparkSession, manifest: dict) -> DataFrame:
    """The cases of a run; if the recorded file is gone, those of the repository."""
    path = recorded_cases_file(manifest)
    if not path_exists(spark, path) and manifest.get("repository"):
        path = cases_file(manifest["repository"])
    return load_cases(spark, path)


def claims_file(folder: str | Path) -> str:
    """The anchored claims if there are any, else the unanchored ones."""
    anchored = f"{folder}/predictions_anchored.jsonl"
    return anchored if _exists(anchored) else f"{folder}/predictions.jsonl"


def run_dir(run: str, out: str = RUNS) -> str:
    return run if ("://" in run and _exists(run)) or Path(run).is_dir() else f"{out}/{run}"


def same_run(first: dict, second: dict) -> None:
    """Two verify runs may only be joined if they checked the same claims."""
    if first.get("verified_run") != second.get("verified_run"):
        raise ValueError(f"the runs checked different claims: {first.get('verified_run')} and {second.get('verified_run')}")


def same_conditions(before: dict, now: dict) -> None:
    """A run is only resumed under the prompt and the model build it began with; what either doesn't tell is not compared."""
    for what in ("prompt", "model_build"):
        was, is_ = before.get(what), now.get(what)
        if was and is_ and was != is_:
            raise ValueError(f"the run was answered under another {what.replace('_', ' ')} ({was}, now {is_}); start a new one")


def complete(*manifests: dict) -> bool:
    """All runs upstream ended, without failed calls or errors; one that doesn't say is taken to have ended."""
    return all(m.get("complete", True) and not m.get("call_failures") and not m.get("errors") for m in manifests)


def settings(path: str | Path = ".env") -> dict[str, str]:
    """KEY=value lines; quotes and `export` are taken off; the environment wins."""
    found: dict[str, str] = {}
    if Path(path).exists():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            name, equals, value = line.strip().removeprefix("export ").partition("=")
            if equals and name.strip() and not name.startswith("#"):
                found[name.strip()] = value.strip().strip("\"'")
    return found | {k: os.environ[k] for k in found if k in os.environ}
