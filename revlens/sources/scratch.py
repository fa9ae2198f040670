"""Tables between stages, in a folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in local mode, where it may be unset, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _OWN:
        folder = tempfile.mkdtemp(prefix="revlens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[context.applicationId] = "file://" + folder
    return _OWN[context.applicationId]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/revlens-stages/{spark.sparkContext.applicationId}"


def drop_kept(spark: SparkSession) -> None:
    """Delete every table that this application kept between stages; results that still read them must have been written elsewhere."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once and read back: model calls aren't repeated, the lineage is cut, and a lost executor costs nothing."""
    path = f"{_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


class Owned:
    """Tables that one piece of work keeps and drops, whatever else keeps tables at the time."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{_folder(spark)}/owned-{uuid.uuid4().hex}"

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def drop(self) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        folder.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
