"""Helpers shared by the training-data operators: shared storage, row identity, column names, caches of workers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Memos of the Python helpers hold at most this many short entries (some 15 MB), then start anew.
CACHE_ENTRIES = 100_000
#: Python operators work on slices of a batch that have at most this many bytes of text, or one row.
SLICE_BYTES = 16 << 20
SLICE_ROWS = 4096


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='orefield-')}"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    On a cluster it must be set. A session on one machine only, as in tests, gets a folder of its own where it is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/orefield/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return a reader of it.

    What follows no longer depends on the tasks that made df, so a lost executor costs only its own tasks.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete materialized tables, once nothing reads them any more."""
    for df in written:
        _delete(df.sparkSession, [df.written_to])


def release(spark: SparkSession) -> None:
    """Delete all that this application has written to the shared folder; its results must have been written before."""
    _delete(spark, [shared_root(spark)])


def _delete(spark: SparkSession, folders: Iterable[str]) -> None:
    context = spark.sparkContext
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def row_key(*cols: Column) -> Column:
    """A 128-bit key of a row's content, as two numbers: rows alike in all the columns share it, nulls included."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))


def own_name(df: DataFrame, name: str) -> str:
    """A name like the given one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often, or however deep in a lambda, body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def slices(batches: Iterable[pa.RecordBatch], text: str, rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut by rows and by bytes of their text column; a row of more bytes stands alone."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        upto, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = int(np.searchsorted(upto, before + most, side="right"))
            end = max(at + 1, min(end, at + rows, batch.num_rows))
            yield batch.slice(at, end - at)
            at = end


_kept: dict[str, object] = {}


def kept_by_worker(key: str, make: Callable[[], object]):
    """An object that a worker process makes once and keeps between tasks: one at a time, so that a process which goes
    on from one operator to the next doesn't hold both operators' tables."""
    if key not in _kept:
        _kept.clear()
        _trim()
        _kept[key] = make()
    return _kept[key]


def drop_kept() -> None:
    """For operators that keep nothing: a worker that comes from another one gives that one's object up."""
    if _kept:
        _kept.clear()
        _trim()


def _trim() -> None:
    """Give freed memory back to the system, where the C library knows how."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass
    pa.default_memory_pool().release_unused()
