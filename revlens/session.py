"""A Spark session with the settings this library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "revlens", master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive execution, UTC, ANSI arithmetic; anything else from `conf` (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.maxPlanStringLength": "200000",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
