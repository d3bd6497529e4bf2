"""Delta Lloyd against a plain version that compares every vector with every centroid in each round."""

import hashlib
import math
import random

import numpy as np
import pytest

from orefield.llm import centroids

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, k, rounds, dims, scale):
    """{row: (cluster, distance, cluster_inertia, inertia, centroid)} by Python integers; rows that are left out are missing."""
    fits = lambda e: e is not None and len(e) == dims and all(x is not None and math.isfinite(x) and abs(x * scale) <= centroids.LARGEST for x in e)
    v = {i: [math.floor(float(np.float32(x)) * scale) for x in e] for i, (_, e) in enumerate(rows) if fits(e)}
    lead = sorted((hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), x) for i, x in v.items() if rows[i][0] is not None)
    centres = [x for _, x in lead[:k]]
    if not centres:
        return {}
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for step in range(rounds + 1):
        owner = {i: min((far(x, c), n) for n, c in enumerate(centres)) for i, x in v.items()}
        if step < rounds:
            for n in range(len(centres)):
                own = [v[i] for i in v if owner[i][1] == n]
                if own:
                    centres[n] = [sum(c) // len(own) for c in zip(*own)]
    inertia = {n: sum(d for d, m in owner.values() if m == n) for n in range(len(centres))}
    return {i: (n, d, inertia[n], sum(inertia.values()), tuple(centres[n])) for i, (d, n) in owner.items()}


def check(spark, rows, **how):
    how = {"k": 16, "rounds": 3, "dims": 4, "scale": 64} | how
    got = sorted((repr(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in centroids.cluster(spark.createDataFrame(rows, SCHEMA), **how).collect())
    assert got == sorted((repr(rows[i][0]), *x) for i, x in plain(rows, **how).items())
    return got


def vectors(n, dims=4, seed=1, spread=1.0):
    draw = random.Random(seed)
    heart = [[draw.gauss(0, 2) for _ in range(dims)] for _ in range(7)]
    return [(i, [x + draw.gauss(0, spread) for x in draw.choice(heart)]) for i in range(n)]


@pytest.mark.parametrize("k,rounds", [(16, 3), (5, 8), (3, 0), (40, 2)])
def test_as_plain(spark, k, rounds):
    check(spark, vectors(300), k=k, rounds=rounds)


def test_ties_and_repeated_rows(spark):
    grid = [(i, [float(i % 3), 0.0, float(i % 2), -0.0]) for i in range(60)]
    check(spark, grid + grid[:20] + [(7, [9.0, 9.0, 9.0, 9.0])], k=6)


def test_odd_vectors_are_left_out(spark):
    odd = [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5), (904, [1.0, None, 0.0, 0.0]), (905, [float("nan")] * 4), (906, [0.0, float("inf"), 0.0, 0.0]), (907, [1e30, 0.0, 0.0, 0.0]), (None, [0.5, 0.5, 0.5, 0.5])]
    got = check(spark, vectors(50) + odd, k=4)
    assert len(got) == 51 and "None" in {r[0] for r in got}


def test_few_vectors_or_none(spark):
    check(spark, vectors(5))
    check(spark, [])
    check(spark, [(None, [1.0, 2.0, 3.0, 4.0])])


def test_large_components_are_exact(spark):
    draw = random.Random(3)
    check(spark, [(i, [draw.uniform(-2e6, 2e6) for _ in range(4)]) for i in range(80)], k=5)


def test_other_columns_may_have_any_name(spark):
    rows = vectors(40)
    plain_rows = spark.createDataFrame(rows, SCHEMA)
    named = plain_rows.selectExpr("vec_id", "embedding", "1 as owner", "2 as cluster", "3 as v", "4 as distance")
    shape = lambda df: sorted(tuple(r)[:5] for r in centroids.cluster(df, 4, dims=4).collect())
    assert shape(named) == shape(plain_rows)


def test_a_round_compares_moved_centroids_and_owners_only():
    x, centres = np.array([[0, 0], [10, 0], [4, 0]]), np.array([[0, 0], [9, 0], [5, 0]])
    owner, distance = np.array([0, 1, 0]), np.array([0, 1, 16])
    # centroid 2 moved near: the third vector goes over; the first, whose owner stays, isn't compared with 0 and 1
    new, far = centroids.compared(x, owner, distance, centres, np.array([2]))
    assert new.tolist() == [0, 1, 2] and far.tolist() == [0, 1, 1]
    # an equal distance goes to the smaller number only
    new, _ = centroids.compared(np.array([[2, 0]]), np.array([1]), np.array([4]), np.array([[0, 0], [4, 0]]), np.array([0]))
    assert new.tolist() == [0]
