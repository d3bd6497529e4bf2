"""Vector search, reciprocal rank fusion, hybrid retrieval and its metrics."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How deep each list goes, the constant of the fusion, how many are ranked again and shown.
LIST_K, RRF_K, RERANK, FINAL = 50, 60, 30, 5
QUESTION_CHARS = 1000
#: So many queries are sent to the tasks at once; more come in further passes.
QUERIES_AT_ONCE = 4096
#: So many distances of questions to rows are looked at, at once.
PAIRS_AT_ONCE = 1 << 20


def cosine_distance(vector: Column, asked: list[float]) -> Column:
    q = [float(x) for x in asked]
    norm = float(np.sqrt(np.dot(q, q)))
    sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = sum_of(F.zip_with(vector, F.array(*map(F.lit, q)), lambda a, b: a.cast("double") * b))
    length = F.sqrt(sum_of(F.transform(vector, lambda a: a.cast("double") * a.cast("double"))))
    return 1 - F.try_divide(dot, length * norm)


def dense(df: DataFrame, asked: list[float], k: int = LIST_K, by: str = "id", vector: str = "embedding") -> DataFrame:
    """The k nearest rows to one vector, exactly: each task keeps its own k, and the identifier breaks ties."""
    return df.withColumn("distance", cosine_distance(F.col(vector), asked)).orderBy("distance", by).limit(k)


class Nearest:
    """The k nearest rows of each question so far, ties by identifier; what a task holds doesn't grow with its rows."""

    def __init__(self, questions: int, k: int, like: np.ndarray):
        self.k, self.distance, self.ids = k, np.full((questions, k), np.inf), np.zeros((questions, k), like.dtype)

    @staticmethod
    def parts(rows: int, questions: int) -> Iterator[slice]:
        """Stretches of rows, so many that their distances to the questions are PAIRS_AT_ONCE at most."""
        step = max(1, PAIRS_AT_ONCE // max(1, questions))
        return (slice(at, at + step) for at in range(0, rows, step))

    def take(self, some: np.ndarray, ids: np.ndarray, distance: np.ndarray) -> None:
        """Rows by identifier and their distances (a line for each of some questions)."""
        distance = np.where(np.isfinite(distance), distance, np.inf)
        nearer = distance.min(1) <= self.distance[some, -1]
        some, distance = some[nearer], distance[nearer]
        every = np.hstack([self.distance[some], distance])
        names = np.hstack([self.ids[some], np.broadcast_to(ids, distance.shape)])
        order = np.lexsort((names, every), axis=1)[:, : self.k]
        self.distance[some], self.ids[some] = np.take_along_axis(every, order, axis=1), np.take_along_axis(names, order, axis=1)

    def found(self, names: np.ndarray, by: str) -> Iterator[pd.DataFrame]:
        for few in self.parts(len(names), self.k):
            there = np.isfinite(self.distance[few])
            yield pd.DataFrame({"query": np.repeat(names[few], there.sum(1)), by: self.ids[few][there], "distance": self.distance[few][there]})


def dense_many(df: DataFrame, queries: DataFrame, k: int, by: str = "id", vector: str = "embedding") -> DataFrame:
    """(query, id, distance, rank): the k nearest other rows of each query, exactly.

    Queries go to the tasks in blocks; a task scans its rows once per block and gives its own k best of each, so what
    is shuffled is k rows for each query and task. Where there is more than one block and the session names a shared
    folder (spark.checkpoint.dir), a block's results are written there before the next block is fetched, so the driver
    holds one block of queries at a time, however many there are.
    """
    shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    folder = f"{shared.rstrip('/')}/nearest-{uuid.uuid4().hex}" if shared else None
    n = queries.count()
    passes = max(1, -(-n // QUERIES_AT_ONCE))
    dealt = queries.select(by, vector).withColumn("__pass", F.pmod(F.xxhash64(by), F.lit(passes)))
    kind = df.schema[by].dataType.simpleString()

    def scan(names: np.ndarray, matrix: np.ndarray):
        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for f in frames:
                if not len(f):
                    continue
                rows = np.stack(f[vector].to_numpy()).astype(float)
                rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)
                best = best or Nearest(len(names), k, f[by].to_numpy())
                for few in best.parts(len(rows), len(names)):
                    ids = f[by].to_numpy()[few]
                    distance = 1 - matrix @ rows[few].T
                    distance[names[:, None] == ids[None, :]] = np.inf
                    best.take(np.arange(len(names)), ids, distance)
            if best:
                yield from best.found(names, by)

        return run

    parts = []
    for p in range(passes):
        block = dealt.where(F.col("__pass") == p).toPandas()
        if len(block):
            matrix = np.stack(block[vector].to_numpy()).astype(float)
            matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
            found = df.select(by, vector).mapInPandas(scan(block[by].to_numpy(), matrix), f"query {kind}, {by} {kind}, distance double")
            if folder and passes > 1:
                found.write.parquet(f"{folder}/{p}")
                found = df.sparkSession.read.schema(found.schema).parquet(f"{folder}/{p}")
            parts.append(found)
    if not parts:
        return df.limit(0).select(F.col(by).alias("query"), by, F.lit(0.0).alias("distance"), F.lit(1).alias("rank"))
    best = W.partitionBy("query").orderBy("distance", by)
    return reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranked(df: DataFrame, order: list[Column], k: int = LIST_K, by: str = "id") -> DataFrame:
    """(id, rank) of the first k rows: the limit leaves k rows, which alone are numbered."""
    first = df.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(W.orderBy(*order))).select(by, "rank")


def fuse(*lists: DataFrame, k: int = RRF_K, by: str = "id") -> DataFrame:
    """(id, score): reciprocal ranks summed; order by score, then identifier."""
    every = reduce(DataFrame.unionByName, (x.select(by, "rank") for x in lists))
    return every.groupBy(by).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score")).orderBy(F.desc("score"), by)


def metrics(judged: DataFrame, at: int = 5, within: int = 10) -> DataFrame:
    """questions, recall at 5 and mean reciprocal rank at 10, from (query, rank, relevant)."""
    first = judged.groupBy("query").agg(F.min(F.when(F.col("relevant") & (F.col("rank") <= within), F.col("rank"))).alias("first"))
    return first.agg(F.count(F.lit(1)).alias("questions"), F.avg(F.when(F.col("first") <= at, 1.0).otherwise(0.0)).alias(f"recall_at_{at}"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias(f"mrr_at_{within}"))
