"""What a task holds or writes doesn't grow with the table."""

import tracemalloc
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from orefield.operators import contracts, retrieval
from orefield.plans import datasets, records


def test_nearest_holds_few_distances_and_breaks_ties_by_identifier():
    rng, n, rows, k = np.random.default_rng(1), 50, 40_000, 7
    best, ids = retrieval.Nearest(n, k, np.zeros(1, int)), rng.permutation(rows)
    distance = rng.integers(0, 900, (n, rows)).astype(float)
    parts = list(best.parts(rows, n))
    assert len(parts) > 1 and all((p.stop - p.start) * n <= retrieval.PAIRS_AT_ONCE for p in parts)
    for p in parts:
        best.take(np.arange(n), ids[p], distance[:, p])
    want = np.lexsort((np.broadcast_to(ids, distance.shape), distance), axis=1)[:, :k]
    assert (best.ids == ids[want]).all()


def test_an_archive_is_written_batch_by_batch(tmp_path):
    class Rows:
        def repartition(self, *how):
            return self

        def mapInPandas(self, put, schema):
            frame = pd.DataFrame({"ID_NOTICE_CAN": [str(k) for k in range(2000)], "TITLE": ["x" * 400] * 2000})
            tracemalloc.start()
            list(put(frame.copy() for _ in range(30)))
            self.peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            return self

        write = property(lambda self: self)
        format = mode = lambda self, *how: self

        def save(self):
            pass

    rows = Rows()
    datasets.archived(rows, str(tmp_path), 1)
    with zipfile.ZipFile(tmp_path / "0.zip") as z:
        read = pd.concat([pd.read_csv(z.open(name), dtype=str) for name in ("one.CSV", "two.csv")])
    assert len(read) == 60_000 and set(read["ID_NOTICE_CAN"]) == {str(k) for k in range(2000)}
    assert rows.peak < 10_000_000  # 24 MB of titles


def test_urls_stay_where_they_are(spark):
    urls = spark.createDataFrame([(1, "a", "/x/open1"), (2, "a", "/x/y"), (3, "b", "/x/y"), (4, "a", None), (4, "a", None)], "id long, host string, path string")
    rules = spark.createDataFrame([("a", "/x/", False), ("a", "/x/*open", True), ("a", "/x/open*$", False), ("a", "/x/open1", True)], "host string, pattern string, allow boolean")
    found = contracts.may_crawl(urls, rules)
    assert sorted((r["id"], r["allowed"]) for r in found.collect()) == [(1, False), (2, False), (3, True), (4, True), (4, True)]
    assert "[id" not in "".join(line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line)


def test_an_organisations_pairs_are_written_by_many_tasks(spark):
    tracks = spark.range(200).select(F.col("id").alias("track_id"), F.lit(1).alias("org_id"), F.lit(-1).cast("long").alias("owner_id"))
    members = spark.range(300).select(F.lit(1).alias("org_id"), F.col("id").alias("user_id"), F.lit("admin").alias("role"), F.lit(True).alias("active"), F.lit("e").alias("email"))
    found = contracts.recipients(tracks, members)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 60_000 and found.distinct().count() == 60_000 and max(sizes) <= 20_000


def test_documents_are_dealt_out_before_their_texts_are_made(spark):
    plan = records.document_contexts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_facts_are_found_by_many_tasks(spark):
    assert records.facts_in_sentences(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_meetings_ask_python_once(spark):
    plan = records.meetings_filled(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
