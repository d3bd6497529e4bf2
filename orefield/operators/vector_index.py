"""Nearest neighbours under filters, by inverted lists of vectors under coarse centroids.

The index is a table of all rows, written in lists: every vector goes to the nearest of a few hundred centroids, fitted on
a bounded sample. A question reads the lists of its nearest centroids, as many as it takes: a first few, then more, until k
rows that pass the filter are found and, of the sample's vectors that are as near as the last of them, all but a few are
in lists that were read. So a filter that few rows pass reads more lists, in the end all of them, and then the answer is
exact. It is exact too where that is asked for: lists are read until none is left that can hold a nearer row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orefield.operators.retrieval import LIST_K, Nearest
from orefield.storage import delete, scratch, written

#: Centroids are fitted on at most about so many vectors, chosen by a hash of their identifier, in so many rounds.
SAMPLE, ROUNDS = 20_000, 8
LISTS = 64
#: How many lists are read first, and how many times as many after each round.
FIRST_LISTS = 8
GROWTH = 1.5
#: The share of the near vectors of the sample that must be in lists that were read; at least LEAST_NEAR of them are looked
#: at. At most ESTIMATE vectors of the sample are kept for that.
RECALL, ESTIMATE, LEAST_NEAR = 0.95, 2000, 30
#: So many questions are sent to the tasks at once; more come in further blocks.
QUESTIONS_AT_ONCE = 4096
SEED = 7


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fitted(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centroids of unit vectors; an empty one takes the vector that is farthest from its own."""
    x = _unit(np.asarray(sample, float))
    lists = min(lists, len(x))
    centres = x[np.random.default_rng(seed).permutation(len(x))[:lists]]
    for _ in range(rounds):
        near = x @ centres.T
        owner, best = near.argmax(1), near.max(1)
        for c in range(lists):
            own = x[owner == c]
            if len(own):
                centres[c] = own.sum(0)
            else:
                far = best.argmin()
                centres[c], best[far] = x[far], 2
        centres = _unit(centres)
    return centres


class VectorIndex:
    """Lists under a folder: data/list=<number>, the centroids, and how far each list's farthest vector is from its own."""

    def __init__(self, spark: SparkSession, folder: str, by: str = "id", vector: str = "embedding"):
        self.spark, self.folder, self.by, self.vector = spark, folder.rstrip("/"), by, vector

    def build(self, rows: DataFrame, lists: int = LISTS, sample: int = SAMPLE) -> VectorIndex:
        """Write all rows, with all their columns, into lists. Rows without a vector, or with a zero one, are in none: no
        angle to them is known."""
        length = F.aggregate(F.col(self.vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        there = rows.where(F.col(self.vector).isNotNull() & (F.coalesce(length, F.lit(0.0)) > 0))
        n = there.count()
        share = min(1.0, sample / max(1, n))
        chosen = there.where(F.pmod(F.xxhash64(self.by), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select(self.vector).limit(2 * sample)
        picked = chosen.toPandas()[self.vector]  # a bounded sample
        delete(self.spark, self.folder)
        centres = fitted(np.stack(picked.to_numpy()), lists) if len(picked) else np.zeros((0, 1))
        vector = self.vector

        def dealt(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    near = _unit(np.stack(f[vector].to_numpy()).astype(float)) @ centres.T
                    yield f.assign(list=near.argmax(1).astype("int32"), near=near.max(1))

        schema = ", ".join(f"`{c}` {t}" for c, t in there.dtypes)
        placed = there.mapInPandas(dealt, f"{schema}, list int, near double") if len(centres) else there.withColumns({"list": F.lit(0), "near": F.lit(1.0)})
        # a large list is written by several tasks
        spread = F.pmod(F.xxhash64(self.by), F.lit(8))
        placed.repartition("list", spread).write.partitionBy("list").parquet(f"{self.folder}/data")
        data = self.spark.read.schema(placed.schema).parquet(f"{self.folder}/data")
        reach = data.groupBy("list").agg(F.min("near").alias("reach"), F.count(F.lit(1)).alias("rows"))
        known = self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "list int, centre array<double>")
        written(reach.join(known, "list").coalesce(1), f"{self.folder}/centroids")
        kept = picked.head(ESTIMATE)
        near = _unit(np.stack(kept.to_numpy()).astype(float)) @ centres.T if len(kept) else np.zeros((0, 1))
        told = [(int(i), [float(x) for x in v]) for i, v in zip(near.argmax(1) if len(kept) else (), kept)]
        written(self.spark.createDataFrame(told, "list int, vector array<double>").coalesce(1), f"{self.folder}/sample")
        return self

    def lists(self) -> DataFrame:
        """(list, reach, rows, centre): a row for each list that has rows; reach is the least cosine of a row with its centre."""
        return self.spark.read.parquet(f"{self.folder}/centroids")

    def _orders(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per question the lists, nearest centroid first, and the least distance that a row of each of them can have."""
        known = self.lists().orderBy("list").collect()  # one row a list
        numbers = np.array([r["list"] for r in known])
        to_centre = np.clip(asked @ np.array([r["centre"] for r in known]).T, -1, 1)
        # a row's angle to the question is at least that to the centre less the row's own to the centre
        angle = np.arccos(to_centre) - np.arccos(np.clip([r["reach"] for r in known], -1, 1))[None, :]
        order = np.lexsort((np.broadcast_to(numbers, to_centre.shape), -to_centre), axis=1)
        return numbers[order], np.take_along_axis(1 - np.cos(np.maximum(0, angle)), order, axis=1)

    def read(self, lists: list[int]) -> DataFrame:
        """The rows of some lists, with `list`; no file of another list is opened."""
        return self.spark.read.option("basePath", f"{self.folder}/data").parquet(*[f"{self.folder}/data/list={i}" for i in lists]).drop("near")

    def search(self, asked: list[float], k: int = LIST_K, where: Column | None = None, exact: bool = False, first: int = FIRST_LISTS) -> DataFrame:
        """(id, distance, rank) of the k nearest rows that pass the filter, ties by identifier; see search_many."""
        one = self.spark.createDataFrame([(0, [float(x) for x in asked])], "query int, asked array<double>")
        return self.search_many(one, k, where, exact, first).drop("query")

    def search_many(self, queries: DataFrame, k: int = LIST_K, where: Column | None = None, exact: bool = False, first: int = FIRST_LISTS) -> DataFrame:
        """(query, id, distance, rank) for each question of `queries` (query, asked: its vector).

        Lists are read in rounds, for the questions that have fewer than k rows yet or too few of the near vectors of the
        sample; with `exact`, for those whose unread lists may have a nearer row. Questions go to the tasks in blocks of
        QUESTIONS_AT_ONCE; a task gives its k best of each that it has rows for.
        """
        n = queries.count()
        blocks = max(1, -(-n // QUESTIONS_AT_ONCE))
        dealt = queries.withColumn("__block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
        parts = [x for b in range(blocks) for x in self._block(dealt.where(F.col("__block") == b), k, where, exact, first)]
        if not parts:
            kinds = dict(queries.dtypes) | dict(self.lists().dtypes)
            return self.spark.createDataFrame([], f"query {kinds['query']}, {self.by} long, distance double, rank int")
        best = W.partitionBy("query").orderBy("distance", self.by)
        return reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def _block(self, queries: DataFrame, k: int, where: Column | None, exact: bool, first: int) -> list[DataFrame]:
        asked = queries.select("query", "asked").toPandas()  # a bounded block
        if not len(asked) or self.lists().isEmpty():
            return []
        vectors = _unit(np.stack(asked["asked"].to_numpy()).astype(float))
        order, least = self._orders(vectors)
        told = self.spark.read.schema("list int, vector array<double>").parquet(f"{self.folder}/sample").toPandas()  # ESTIMATE rows at most
        sample = (_unit(np.stack(told["vector"].to_numpy()).astype(float)), told["list"].to_numpy())
        kind, found = dict(queries.dtypes)["query"], []
        pending, at, upto = np.arange(len(asked)), 0, first
        while len(pending) and at < order.shape[1]:
            wanted = order[pending, at:upto]
            rows = self.read(np.unique(wanted).tolist())
            passed = (rows if where is None else rows.where(where)).select(self.by, self.vector, "list")
            names = asked["query"].to_numpy()[pending]
            scan = self._scan(names, vectors[pending], wanted, k)
            by_kind = dict(passed.dtypes)[self.by]
            found.append(written(passed.mapInPandas(scan, f"query {kind}, {self.by} {by_kind}, distance double"), scratch(self.spark, "nearest")))
            best = W.partitionBy("query").orderBy("distance", self.by)
            told = reduce(DataFrame.union, found).withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= k)
            have = {r["query"]: (r["n"], r["d"]) for r in told.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).collect()}
            count = np.array([have.get(q, (0, 0.0))[0] for q in names])
            last = np.array([have.get(q, (0, 0.0))[1] for q in names])
            if exact:
                short = least[pending, upto:].min(axis=1, initial=np.inf) <= last
            else:
                short = np.array([self._reached(vectors[q], d, order[q, :upto], sample) < RECALL for q, d in zip(pending, last)])
            pending, at, upto = pending[(count < k) | short], upto, int(np.ceil(upto * GROWTH))
        return found

    @staticmethod
    def _reached(question: np.ndarray, distance: float, read: np.ndarray, sample: tuple[np.ndarray, np.ndarray]) -> float:
        """The share of the sample's vectors within a distance that are in lists that were read."""
        vectors, lists = sample
        far = 1 - vectors @ question
        near = far <= max(distance, np.partition(far, min(LEAST_NEAR, len(far)) - 1)[min(LEAST_NEAR, len(far)) - 1])
        return float(np.isin(lists[near], read).mean())

    def _scan(self, names: np.ndarray, vectors: np.ndarray, wanted: np.ndarray, k: int):
        by, vector = self.by, self.vector

        def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = None
            for f in frames:
                for number, part in f.groupby("list"):
                    (mine,) = (wanted == number).any(1).nonzero()
                    if not len(mine):
                        continue
                    ids, rows = part[by].to_numpy(), _unit(np.stack(part[vector].to_numpy()).astype(float))
                    best = best or Nearest(len(names), k, ids)
                    for few in best.parts(len(rows), len(mine)):
                        best.take(mine, ids[few], 1 - vectors[mine] @ rows[few].T)
            if best:
                yield from best.found(names, by)

        return run
