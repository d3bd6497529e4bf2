"""A session with the settings that the queries are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "orefield", **conf: str) -> SparkSession:
    """Adaptive plans, UTC, and shuffles that AQE sizes; anything may be set otherwise by keyword."""
    builder = SparkSession.builder.appName(name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
