"""Shared helpers: where intermediate tables are written, word rules, Arrow plumbing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OWN: dict[str, str] = {}
#: Spark deletes an execution's shuffle files at its end, rather than when the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        folder = tempfile.mkdtemp(prefix="revlens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[context.applicationId] = "file://" + folder
    return _OWN[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/revlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop_all(spark: SparkSession) -> None:
    """Delete every table and archive that this application wrote; results that still read them must have been written elsewhere."""
    _delete(spark, f"{shared_dir(spark)}/revlens/{spark.sparkContext.applicationId}")


class Run:
    """Owns the intermediate tables that are written within its context, in its own thread; what other runs and threads write is theirs. A run that fails leaves none behind."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self._outer = spark, [], []

    def __enter__(self) -> Run:
        self._outer.append(_RUN.set(self))
        return self

    def __exit__(self, failed: type[BaseException] | None, *_: object) -> None:
        _RUN.reset(self._outer.pop())
        if failed:
            self.drop()

    def drop(self, but: int = 0) -> None:
        """Delete the run's tables, but for its last `but` ones."""
        going = self.paths[: len(self.paths) - but]
        del self.paths[: len(going)]
        for path in going:
            _delete(self.spark, path)


_RUN: ContextVar[Run | None] = ContextVar("revlens-run", default=None)


_LOCK, _CLEANING = Lock(), {"runs": 0, "before": None}


@contextmanager
def _cleaning_up(spark: SparkSession) -> Iterator[None]:
    """The setting is on while any thread writes a table, and as it was afterwards."""
    with _LOCK:
        if not _CLEANING["runs"]:
            _CLEANING["before"] = spark.conf.get(_CLEAN_UP, None)
        _CLEANING["runs"] += 1
        spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        with _LOCK:
            _CLEANING["runs"] -= 1
            if not _CLEANING["runs"]:
                if _CLEANING["before"] is None:
                    spark.conf.unset(_CLEAN_UP)
                else:
                    spark.conf.set(_CLEAN_UP, _CLEANING["before"])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: it cuts the lineage, survives lost executors and
    gives the planner the true size when it decides about a broadcast. The shuffle files behind it go as soon as it is written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if run := _RUN.get():
        run.paths.append(path)
    with _cleaning_up(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def packed(docs: DataFrame) -> Column:
    """All columns as one struct, so that names that an operator adds can't clash with theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def unpacked(struct: str, columns: list[str]) -> list[Column]:
    return [F.col(struct)[c].alias(c) for c in columns]


def join_back(rows: DataFrame, totals: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with what was aggregated from them by `keys`. The hash as one more key has both sides dealt afresh: an aggregate that kept its own dealing would
    bind the join to it, and adaptive execution could not split a hot key's rows."""
    left, right = (df.withColumn("_key_hash", F.hash(*keys)) for df in (rows, totals))
    return left.join(right, ["_key_hash", *keys], how).drop("_key_hash")


def pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `limit` bytes at most; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def drop_table(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and nothing will read again."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


def ascii_lower(column: Column) -> Column:
    """A-Z only; letters outside ASCII keep their case."""
    return F.translate(column, UPPER, LOWER)


def as_bytes(column: str = "text") -> Column:
    """UTF-8 bytes; null is empty. Python gets bytes, so that malformed text can't stop a worker."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))
