"""Cases as they arrive: the content rules over a stream of case files, each case once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas
from ..plans.stages import rules
from ..sources.tables import with_defaults


def case_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON-lines case files that appear in a folder."""
    return spark.readStream.schema(schemas.CASES).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def review_stream(stream: DataFrame, out: str, checkpoint: str, stage: Callable[[DataFrame], DataFrame] = rules) -> StreamingQuery:
    """Runs a stage on each micro-batch and writes it under batch=<id>: a replayed batch overwrites its own output, so results appear once."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        stage(with_defaults(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
