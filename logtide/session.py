"""A session with the settings this engine expects; existing settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "logtide", master: str | None = None, **conf: str) -> SparkSession:
    """UTC and adaptive execution; sizes of partitions are left to AQE's coalescing and skew splitting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
