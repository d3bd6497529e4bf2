"""Work over what is stored: only what changes is written, and it is counted; requests and categories literally."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orefield.operators import upkeep
from orefield.operators.bucketed import BucketedTable, Change

INDEX = [("cpi", "IN", 2000, 50.0), ("cpi", "IN", 2010, 100.0), ("fx", "IN", 2000, 45.0)]


def test_restate_counts_changed_rows(spark, tmp_path):
    kept = BucketedTable(spark, str(tmp_path / "t"), "id long, currency string, country string, year int, award_value double, inr_real double", ["id"], 4)
    kept.upsert(spark.createDataFrame([(1, "INR", "IN", 2000, 100.0, None), (2, "INR", "IN", 2010, 100.0, None), (3, "INR", "IN", None, 5.0, None)], "id long, currency string, country string, year int, award_value double, inr_real double"))
    index = spark.createDataFrame(INDEX, "series string, country string, year int, value double")
    assert upkeep.restate(kept, index, 2010).updated == 2
    assert {r["id"]: r["inr_real"] for r in kept.read().collect()} == {1: 200.0, 2: 100.0, 3: None}
    assert upkeep.restate(kept, index, 2010) == Change()
    later = spark.createDataFrame([*INDEX, ("cpi", "IN", 2011, 110.0)], "series string, country string, year int, value double")
    assert upkeep.restate(kept, later, 2011).updated == 2 and {r["id"]: r["inr_real"] for r in kept.read().collect()} == {1: 220.0, 2: 110.0, 3: None}


def test_reclassify_counts_changed_rows(spark, tmp_path):
    kept = BucketedTable(spark, str(tmp_path / "t"), "id long, title string, product_category string, category string, sector string", ["id"], 4)
    kept.upsert(spark.createDataFrame([(1, "Widening of NH-44 road", "", "Works", "other"), (2, "Widening of NH-30 road", "", "Works", "roads"), (3, None, None, None, "x")], "id long, title string, product_category string, category string, sector string"))
    first = upkeep.reclassify(kept)
    assert first.updated == 2 and {r["id"]: r["sector"] for r in kept.read().collect()}[1] == "roads"
    assert upkeep.reclassify(kept) == Change()


def test_replay_keeps_what_is_later(spark, tmp_path):
    at = lambda d: datetime(2026, 1, d)
    kept = BucketedTable(spark, str(tmp_path / "t"), "k long, fetched_at timestamp, page_id long, v string", ["k"], 4)
    pages = spark.createDataFrame([(1, at(1), 1, "a", "up"), (1, at(3), 2, "b", "up"), (1, at(3), 3, "c", "up"), (2, at(2), 4, "d", "mp"), (3, at(5), 5, "e", "up")], "k long, fetched_at timestamp, page_id long, v string, source string")
    kept.upsert(spark.createDataFrame([(2, at(9), 9, "z")], "k long, fetched_at timestamp, page_id long, v string"))
    assert upkeep.replay(kept, pages, "2026-01-01", "2026-01-05") == Change(1, 0, 0, 1)
    assert {r["k"]: r["v"] for r in kept.read().collect()} == {1: "c", 2: "z"}
    assert upkeep.replay(kept, pages, "2026-01-01", "2026-01-05") == Change()
    assert upkeep.replay(kept, pages, "2026-01-01", "2026-02-01", source="up").inserted == 1


@pytest.mark.parametrize("given,errors", [
    ({}, []), ({"q": "road", "page": "2", "page_size": "100", "sort": "value", "pin": "490", "min_value": "0", "closes_after": "2026-01-01T10:00:00"}, []), ({"pin": "0490"}, ["pin"]), ({"pin": "4"}, ["pin"]), ({"page": "0"}, ["page"]), ({"page": "x"}, ["page"]),
    ({"page_size": "101", "buyer": "1.5"}, ["buyer", "page_size"]), ({"min_value": "1e3", "max_value": "-2"}, ["max_value", "min_value"]), ({"q": "x" * 201, "state": ""}, ["q", "state"]), ({"sort": "Value"}, ["sort"]), ({"closes_before": "tomorrow"}, ["closes_before"]), ({"q": ""}, []), ({"unknown": "x"}, []),
])
def test_requests(spark, given, errors):
    df = spark.createDataFrame([(given,)], "g map<string, string>").select(upkeep.request_errors(F.col("g")).alias("e"))
    assert [e["parameter"] for e in df.first()["e"]] == errors


@pytest.mark.parametrize("ref,hints,category", [("IN-X-18247-CW-RFB", ["goods"], "works"), ("", ["NC"], "services"), ("", ["Non Consulting Services"], "services"), ("", [None, " ", "Consultant Services"], "consultancy"), ("", ["Small Works"], "works"), ("", ["x", "Goods"], "goods"), ("", ["services"], "services"), ("", ["x"], ""), (None, [None], "")])
def test_categories(spark, ref, hints, category):
    df = spark.createDataFrame([(ref, *hints)], ", ".join(["r string", *(f"h{k} string" for k in range(len(hints)))]))
    assert df.select(upkeep.category_of(F.col("r"), *(F.col(f"h{k}") for k in range(len(hints))))).first()[0] == category


def test_restating_joins_and_shuffles_no_rows(spark, tmp_path, monkeypatch):
    shape = "id long, currency string, country string, year int, award_value double, inr_real double"
    kept = BucketedTable(spark, str(tmp_path / "t"), shape, ["id"], 4)
    kept.upsert(spark.createDataFrame([(k, "INR", "IN", 2000 + 10 * (k % 2), 100.0, None) for k in range(40)] + [(None, "INR", "IN", 2010, 7.0, None)], shape))
    index = spark.createDataFrame(INDEX, "series string, country string, year int, value double")
    plans, group = [], type(index).groupBy
    monkeypatch.setattr(type(index), "groupBy", lambda df, *c: (plans.append(df._jdf.queryExecution().executedPlan().toString()) if "__old" in df.columns else None, group(df, *c))[1])
    assert upkeep.restate(kept, index, 2010) == Change(0, 41, 0, 4)
    assert plans and not any("SortMergeJoin" in p or "Exchange hashpartitioning" in p for p in plans)
    assert {r["inr_real"] for r in kept.read().where("id % 2 = 0").collect()} == {200.0} and kept.read().where("id is null").first()["inr_real"] == 7.0
    only = kept.rework(lambda rows: rows.withColumn("award_value", F.when(F.col("id") == 3, 1.0).otherwise(F.col("award_value"))))
    assert only == Change(0, 1, 0, 1) and kept.read().count() == 41 and kept.read().where("award_value = 1").count() == 1
    with pytest.raises(ValueError):
        kept.rework(lambda rows: rows.where("id > 3"))
