"""The shared folder of a session, for tables that must be cut off from their lineage or kept between runs."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='orefield-')}"


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which a session on a cluster must name; one on a single machine gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/orefield-kept/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written to the path and read from there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = filesystem(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, at = filesystem(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, at = filesystem(spark, path)
        fs.delete(at, True)
