"""The log of a run's answers: a data source whose writers ask, and log what they are told while they are still asking.

A writer gets questions, asks them one after another, and makes a file of every few answers, complete as soon as it has its name; so a task that dies loses the answers it was
collecting and no other. (Answers that went through a second process first would wait in its buffers.) A commit record says how many files and answers each task wrote; answers count with or without
it. A task that is tried again may write an answer twice: readers take one of each key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .scratch import kept
from .tables import path_exists

#: Answers of a task that a killed run may lose.
FLUSH_ROWS = 1
COMMITTED = "_committed.json"
#: Questions of one task, batch by batch -> answers, one at a time.
Answer = Callable[[Iterator[pa.RecordBatch]], Iterator[dict]]


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows that are answers already."""
    for batch in batches:
        yield from batch.to_pylist()


@dataclass(frozen=True)
class Asker:
    """prepare: rows that are wanted -> rows of questions, in the partitions and the order in which they are to be asked; answer: what a task does with them."""

    prepare: Callable[[DataFrame], DataFrame]
    answer: Answer = _told


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as tasks on other machines have to know it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(folder).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file:///") else whole


@dataclass
class TaskAnswers(WriterCommitMessage):
    task: int
    files: int
    answers: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, answer: Answer, schema: pa.Schema, rows: int):
        self.path, self.answer, self.schema, self.rows = path, answer, schema, rows

    def _open(self) -> tuple[pa.fs.FileSystem, str]:
        store, folder = pa.fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        return store, folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TaskAnswers:
        context, (store, folder) = TaskContext.get(), self._open()
        waiting: list[dict] = []
        files = answers = 0

        def flush() -> int:
            name = f"{context.partitionId():05d}-{context.taskAttemptId()}-{files:06d}.parquet"
            pq.write_table(pa.Table.from_pylist(waiting, self.schema), f"{folder}/.{name}", filesystem=store)  # names that begin with a dot are no part of a table
            store.move(f"{folder}/.{name}", f"{folder}/{name}")
            waiting.clear()
            return files + 1

        try:
            for row in self.answer(iterator):
                waiting.append(row)
                answers += 1
                if len(waiting) >= self.rows:
                    files = flush()
        finally:
            if waiting:
                files = flush()
        return TaskAnswers(context.partitionId(), files, answers)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = self._open()
        with store.open_output_stream(f"{folder}/{COMMITTED}") as out:
            out.write(json.dumps([asdict(m) for m in messages if m is not None]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What was answered stays."""


def _log_questions(questions: DataFrame, path: str, answer: Answer, schema: str, rows: int) -> None:
    """One job: every task asks its questions and logs the answers under the path, a folder of the shared storage."""
    spark = questions.sparkSession
    format_, arrow = f"revlens-answers-{uuid.uuid4().hex}", to_arrow_schema(StructType.fromDDL(schema))

    class AnswerLog(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_

        def writer(self, schema: StructType, overwrite: bool) -> _Writer:
            return _Writer(self.options["path"], answer, arrow, rows)

    spark.dataSource.register(AnswerLog)
    questions.write.format(format_).option("path", qualified(spark, path)).mode("append").save()


def logged(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """All answers in a log; a batch that was cut off by the end of its run adds nothing."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(log) if path_exists(spark, log) else spark.createDataFrame([], schema)


def answered(wanted: DataFrame, ask: Asker | Callable[[DataFrame], DataFrame], schema: str, log: str, keys: Sequence[str] = ("case_id",), batch_rows: int = FLUSH_ROWS) -> DataFrame:
    """What is answered of `wanted`: rows with `keys` and `error`. One job asks for all rows that the log (a folder of the shared storage) lacks or has an error for, and its tasks log answers as they
    come, batch_rows at a time. Rows are dealt by the first key, so what belongs to one case is asked for in one task. A plain function for `ask` gives the answers itself."""
    spark, keys, ask = wanted.sparkSession, list(keys), ask if isinstance(ask, Asker) else Asker(ask)
    good = F.coalesce("error", F.lit("")) == ""
    wanted = kept(wanted, "wanted")
    done = logged(spark, log, schema).filter(good).select(*keys).distinct()
    open_ = kept(wanted.join(done, keys, "left_anti"), "open")
    made = f"{log}/{uuid.uuid4().hex}"
    if not open_.isEmpty():
        _log_questions(ask.prepare(open_.repartition(spark.sparkContext.defaultParallelism, keys[0])), made, ask.answer, schema, batch_rows)
    found = logged(spark, log, schema).filter(good).dropDuplicates(keys)
    if path_exists(spark, made):
        failed = spark.read.schema(schema).parquet(made).filter(~good).dropDuplicates(keys)
        found = found.unionByName(failed.join(found.select(*keys), keys, "left_anti"))
    return found.join(wanted.select(*keys).distinct(), keys, "left_semi")
