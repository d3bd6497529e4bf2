"""Centroid clustering by Delta Lloyd rounds over whole numbers.

A vector's components become integers, so sums, centroids and distances are exact and don't depend on the order of rows.
What is kept between rounds: a table of assignments (vector, owner, squared distance), written to the shared folder, and
the sums and counts of each centroid. A round compares a vector whose owner hasn't moved with the moved centroids only,
for no other can have come nearer; a vector whose owner has moved is compared with all of them. Vectors that change hands
are summed with a minus for the old owner and a plus for the new one, in each task, and only these sums leave the tasks.
When no centroid moves, the rounds that are left would change nothing and aren't run.

Defined results: vectors that are null, have another number of components, or a null or non-finite one, are left out, and
so are those with a component over LARGEST, since a distance to them may not fit a long; repeated rows are as many
vectors; a null identifier is kept, but names no first centroid; of vectors alike in identifier the one with the smaller
components comes first; with fewer vectors than centroids there are as many centroids as vectors with an identifier, and
none at all give no rows; ties of distance go to the smaller number. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import discard, materialize

CENTROIDS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
#: A component's largest size, scaled: sums of DIMS squared differences of such stay under 2 ** 63.
LARGEST = 1 << 27
#: Up to this size products and their sums are exact in doubles, which multiply faster.
EXACT_IN_DOUBLES = 1 << 22

STATE = "vec_id long, v array<int>, owner int, distance long, before int"
NOBODY = -1


def whole_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): the kept vectors as integers, floor(scale * component)."""
    x = F.col(embedding).cast("array<double>")
    fits = F.forall(x, lambda c: F.coalesce(F.abs(c * scale) <= LARGEST, F.lit(False)) & ~F.isnan(c))
    kept = df.where((F.size(x) == dims) & fits)
    return kept.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: str = "1") -> list[list[int]]:
    """The k vectors whose identifiers have the least hashes, in that order; k vectors come to the driver."""
    lead = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = vectors.where("vec_id is not null").select(lead.alias("lead"), "v").orderBy("lead", "v").limit(k)
    return [list(r["v"]) for r in found.collect()]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of the one to all of the other, exactly."""
    largest = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    kind = np.float64 if largest < EXACT_IN_DOUBLES else np.int64
    a, b = x.astype(kind), centroids.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def compared(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, distance) of each vector now; moved: numbers of the centroids that moved since the distances were taken."""
    owner, distance = owner.copy(), distance.copy()
    left = np.isin(owner, moved) | (owner == NOBODY)
    if left.any():
        all_ = distances(x[left], centroids)
        owner[left] = all_.argmin(1)  # the first of equal ones
        distance[left] = all_.min(1)
    stays = ~left
    if stays.any() and len(moved):
        to = distances(x[stays], centroids[moved])
        best = to.argmin(1)
        near, number = to[np.arange(len(to)), best], moved[best]
        wins = (near < distance[stays]) | ((near == distance[stays]) & (number < owner[stays]))
        owner[stays] = np.where(wins, number, owner[stays])
        distance[stays] = np.where(wins, near, distance[stays])
    return owner, distance


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(rows, -1)


def _assigning(centroids: list[list[int]], moved: list[int]):
    centres, changed = np.array(centroids, np.int64), np.array(moved, np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            before = np.asarray(batch.column("owner"))
            owner, distance = compared(_matrix(batch.column("v"), batch.num_rows), before, np.asarray(batch.column("distance")), centres, changed)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.array(before, pa.int32())], ["vec_id", "v", "owner", "distance", "before"])

    return run


def _transferring(k: int, dims: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each centroid that a task's vectors left or came to: (number, vectors, component, sum)."""
        count, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), batch.num_rows).astype(np.int64)
            for side, sign in (("owner", 1), ("before", -1)):
                at = np.asarray(batch.column(side))
                there = at != NOBODY
                np.add.at(count, at[there], sign)
                np.add.at(total, at[there], sign * x[there])
        (at,) = (total.any(1) | (count != 0)).nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at], pa.int64()), pa.array(total[at].tolist(), pa.list_(pa.int64()))], ["number", "vectors", "sums"])

    return run


def transfers(state: DataFrame, k: int, dims: int) -> list[tuple[int, int, list[int]]]:
    """(number, vectors, sums): what each centroid won less what it lost; at most k rows come to the driver."""
    moved = state.where("owner <> before").select("v", "owner", "before")
    parts = moved.mapInArrow(_transferring(k, dims), "number int, vectors long, sums array<long>")
    # decimals, since many tasks' sums may pass a long
    sums = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)]
    summed = parts.groupBy("number").agg(F.sum("vectors").alias("vectors"), *sums)
    return [(r["number"], r["vectors"], [int(r[f"s{i}"]) for i in range(dims)]) for r in summed.collect()]


def cluster(df: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) per kept vector, after `rounds` rounds and a last
    assignment; `centroid` has the integers of its centroid."""
    spark = df.sparkSession
    vectors = whole_vectors(df, vec_id, embedding, dims, scale)
    start = vectors.select("*", F.lit(NOBODY).alias("owner"), F.lit(0).cast("long").alias("distance"), F.lit(NOBODY).alias("before"))
    state = materialize(start, "vectors")
    centroids = first_centroids(state, k)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>")
    count, total = [0] * len(centroids), [[0] * dims for _ in centroids]
    moved = list(range(len(centroids)))
    for k_round in range(rounds + 1):
        last, state = state, materialize(state.mapInArrow(_assigning(centroids, moved), STATE), "assignments")
        discard(last)
        if k_round == rounds:
            break
        for number, vectors_, sums in transfers(state, len(centroids), dims):
            count[number] += vectors_
            total[number] = [a + b for a, b in zip(total[number], sums)]
        new = [[s // n for s in t] if n else c for c, n, t in zip(centroids, count, total)]
        moved = [i for i, (a, b) in enumerate(zip(centroids, new)) if a != b]
        centroids = new
        if not moved:
            break
    inertia = {r["owner"]: int(r["s"]) for r in state.groupBy("owner").agg(F.sum("distance").alias("s")).collect()}  # k rows
    per = spark.createDataFrame([(i, inertia[i], sum(inertia.values()), centroids[i]) for i in inertia], "owner int, cluster_inertia long, inertia long, centroid array<int>")
    found = state.join(F.broadcast(per), "owner")  # k rows at most
    return found.select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def oracle(k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> str:
    """DuckDB SQL for the rows of op13: every vector against every centroid in each round."""
    steps = [
        f"""kept AS (
  SELECT vec_id, row_number() OVER () AS r, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x) AND abs({scale} * CAST(x AS DOUBLE)) <= {LARGEST}]) = {dims}
)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), v) - 1 AS k, v FROM kept WHERE vec_id IS NOT NULL QUALIFY k < {k})",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""d{i} AS (SELECT x.vec_id, x.r, x.v, c.k, CAST(list_sum([(x.v[i] - c.v[i]) * (x.v[i] - c.v[i]) FOR i IN range(1, {dims + 1})]) AS BIGINT) AS d
  FROM kept x, c{i} c),
a{i} AS (SELECT vec_id, r, v, least_one.k AS k, least_one.d AS d FROM (SELECT vec_id, r, v, min({{'d': d, 'k': k}}) AS least_one FROM d{i} GROUP BY vec_id, r, v))"""
        )
        if i < rounds:
            steps.append(
                f"""p{i} AS (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, {dims + 1}) r(i) GROUP BY k, i),
m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM p{i} GROUP BY k),
c{i + 1} AS (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON c.k = m.k)"""
            )
    last = rounds
    return f"""WITH {','.join(steps)}
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON a.k = c.k"""
