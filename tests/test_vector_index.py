"""The vector index against exact scans: recall under filters, exact answers, and what is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield.operators import retrieval
from orefield.operators.vector_index import VectorIndex, fitted

SF = "/root/testdata/sf0.1"
SCHEMA = "id long, embedding array<float>, kind string"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet")


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return VectorIndex(spark, str(tmp_path_factory.mktemp("index")), "vec_id").build(vectors)


def asked(vectors, every=50):
    return vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), F.col("embedding").cast("array<double>").alias("asked"))


def exact(vectors, where, k, every=50):
    rows = vectors if where is None else vectors.where(where)
    matrix = np.array([r["embedding"] for r in rows.orderBy("vec_id").collect()], float)
    ids = np.array([r["vec_id"] for r in rows.orderBy("vec_id").select("vec_id").collect()])
    if not len(ids):
        return {}
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    out = {}
    for r in asked(vectors, every).collect():
        q = np.array(r["asked"])
        far = 1 - matrix @ (q / np.linalg.norm(q))
        out[r["query"]] = [ids[i] for i in np.lexsort((ids, far))[:k]]
    return out


@pytest.mark.parametrize("where", [None, "label = 3", "vec_id % 100 = 7", "vec_id % 1000 = 7", "false"])
def test_recall_under_filters(vectors, index, where):
    want = exact(vectors, where, 50)
    got = index.search_many(asked(vectors), 50, None if where is None else F.expr(where)).collect()
    found = {(r["query"], r["vec_id"]) for r in got}
    every = {(q, i) for q, ids in want.items() for i in ids}
    assert len(found & every) >= 0.9 * len(every) and len(found) == len(every)


def test_exact_is_exact(vectors, index):
    want = exact(vectors, "label < 3", 10, every=400)
    got = {}
    for r in index.search_many(asked(vectors, 400), 10, F.expr("label < 3"), exact=True).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["vec_id"])
    assert got == want


def test_one_question(vectors, index):
    q = vectors.where("vec_id = 5").first()["embedding"]
    got = index.search(q, 3, exact=True).orderBy("rank").collect()
    want = retrieval.dense(vectors, q, 3, "vec_id").collect()
    assert [r["vec_id"] for r in got] == [r["vec_id"] for r in want] and got[0]["vec_id"] == 5
    assert [round(r["distance"], 9) for r in got] == [round(r["distance"], 9) for r in want]


def test_clustered_vectors_read_few_lists(spark, tmp_path, monkeypatch):
    draw = np.random.default_rng(3)
    hearts = draw.normal(size=(40, 16))
    rows = [(i, [float(x) for x in hearts[i % 40] + draw.normal(size=16) * 0.05], "ab"[i % 2]) for i in range(2000)]
    made = VectorIndex(spark, str(tmp_path / "i")).build(spark.createDataFrame(rows, SCHEMA), lists=40)
    read = []
    monkeypatch.setattr(made, "read", lambda lists, f=made.read: (read.append(lists), f(lists))[1])
    got = [r["id"] for r in made.search(rows[7][1], 20, F.col("kind") == "b", first=2).collect()]
    assert len(got) == 20 and all(i % 40 == 7 for i in got)
    assert sum(map(len, read)) <= 4  # of 40


def test_odd_rows_ties_and_no_rows(spark, tmp_path):
    rows = [(3, [1.0, 0.0], "a"), (1, [2.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (4, None, "a"), (5, [0.0, 0.0], "a"), (6, [0.0, 1.0], None), (7, [None, 1.0], "a"), (2, [1.0, 0.0], "a")]
    made = VectorIndex(spark, str(tmp_path / "i")).build(spark.createDataFrame(rows, SCHEMA))
    assert [r["id"] for r in made.search([5.0, 0.0], 10).orderBy("rank").collect()] == [1, 2, 2, 3, 6]
    none = VectorIndex(spark, str(tmp_path / "n")).build(spark.createDataFrame([], SCHEMA))
    assert none.search([1.0, 0.0], 3).collect() == []
    assert made.search_many(spark.createDataFrame([], "query int, asked array<double>"), 3).collect() == []


def test_centroids_are_units():
    found = fitted(np.random.default_rng(1).normal(size=(100, 5)), 8)
    assert found.shape == (8, 5) and np.allclose(np.linalg.norm(found, axis=1), 1)
