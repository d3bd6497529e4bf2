"""Conversion errors, listings, files, reports, digests and times in words, on literal rows."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orefield.functions import timing
from orefield.operators import intake

GOOD = {"tender_id": "2026_A_1", "title": "Road works", "org_chain": "State||Roads||Division", "published": "01-Jan-2026 09:00 AM", "closes": "07-Jan-2026 11:00 PM", "opens": "NA", "value": "8,00,000", "emd": "", "fee": "NA", "prebid": "As per NIT", "pincode": "01", "location": "-"}


def converted(spark, **changes):
    raw = {k: v for k, v in (GOOD | changes).items() if v is not None}
    df = spark.createDataFrame([("up", "Delhi", "u", raw)], "source string, state string, url string, detail map<string, string>")
    return intake.converted(df).first()


def test_a_good_record(spark):
    r = converted(spark)
    assert r["errors"] == [] and r["buyer_raw"] == "State || Roads" and r["org_chain"] == "State || Roads || Division" and r["pincode"] == "" == r["location"]
    assert r["closes_at"] == datetime(2026, 1, 7, 17, 30) and r["opens_at"] is None and r["prebid_meeting"] is None and float(r["value_inr"]) == 800000


@pytest.mark.parametrize("changes,errors", [
    ({"closes": "31-Foo-2026", "value": "lots", "title": ""}, [("closes_at", "unrecognised date", "31-Foo-2026"), ("value_inr", "not a money amount", "lots")]),
    ({"published": None, "closes": "", "emd": "x"}, [("emd_inr", "not a money amount", "x"), ("published_at", "required", None), ("closes_at", "required", None)]),
    ({"title": "ab", "tender_id": "", "org_chain": "", "emd": "-5"}, [("source_tender_id", "fewer than 3 characters", ""), ("title", "fewer than 3 characters", "ab"), ("buyer_raw", "fewer than 2 characters", ""), ("emd_inr", "negative", "-5.00")]),
    ({"closes": "31-Dec-2025 09:00 AM"}, [("__all__", "closes before it is published", "01-Jan-2026 09:00 AM, 31-Dec-2025 09:00 AM")]),
])
def test_errors_are_collected_by_stage(spark, changes, errors):
    assert [tuple(e) for e in converted(spark, **changes)["errors"]] == errors


def test_listing_plan(spark):
    row = lambda t, pos=0, title="Road", closes="07-Jan-2026 11:00 PM": ("up", t, title, "01-Jan-2026 09:00 AM", closes, pos)
    listed = spark.createDataFrame([row("same", title=" Road "), row("moved", closes="08-Jan-2026 11:00 PM"), row("title", title="Bridge"), row("odd", closes="soon"), row("new"), row("twice", 2, "Bridge"), row("twice", 1), row(""), row(None)], "source string, tender_id string, title string, published string, closes string, pos int")
    stored = spark.createDataFrame([("up", t, "Road", datetime(2026, 1, 1, 3, 30), datetime(2026, 1, 7, 17, 30)) for t in ("same", "moved", "title", "odd", "twice", "gone")] + [("mp", "new", "Road", datetime(2026, 1, 1, 3, 30), datetime(2026, 1, 7, 17, 30))], "source string, tender_id string, title string, published_at timestamp, closes_at timestamp")
    plan = lambda **how: {r["tender_id"]: r["fetch"] for r in intake.listing_plan(listed, stored, **how).collect()}
    assert plan() == {"same": False, "moved": True, "title": True, "odd": True, "new": True, "twice": False}
    assert set(plan(incremental=False).values()) == {True}


def test_files_read(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"abc")
    (tmp_path / "b").write_bytes(b"")  # isn't listed
    (tmp_path / "c").write_bytes(b"\x00" * 70_000)
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in intake.files_read(spark, str(tmp_path)).collect()}
    assert got == {n: (len(x), hashlib.sha256(x).hexdigest()) for n, x in (("a", b"abc"), ("c", b"\x00" * 70_000))}


def test_crawl_report(spark):
    tenders = spark.createDataFrame([("a", "1", "Delhi", 10.0), ("a", "1", "Delhi", 10.0), ("b", "1", "", None)], "source string, tender_id string, state string, value_inr double")
    runs = spark.createDataFrame([(1, "a", "ok", datetime(2026, 1, 1), datetime(2026, 1, 1, 0, 7, 30), 6, 1, 1, 1, 1, 1, 1), (2, "a", "partial", datetime(2026, 1, 1), None, 9, 1, 0, 0, 0, 0, 0), (3, "b", "running", datetime(2026, 1, 1), None, 1, 0, 0, 0, 0, 0, 0)], "run_id long, source string, status string, started timestamp, finished timestamp, planned int, new int, updated int, unchanged int, skipped int, quarantined int, failed int")
    totals, each = intake.crawl_report(tenders, runs)
    assert totals.first().asDict() == {"tenders": 3, "states": 1, "total_value": 20.0, "distinct_ids": 2, "repeats": 3}
    assert [tuple(r) for r in each.orderBy("run_id").collect()] == [(1, "a", "ok", 7.5, True), (2, "a", "partial", 0.0, False)]


def test_digests(spark):
    tenders = spark.createDataFrame([(k, f"T{k}", "PWD", "Agra" if k % 2 else None, "UP", v, datetime(2026, 1, 1 + k)) for k, v in ((1, None), (2, 0.0), (3, 2.5e7), (4, 150000.0), (5, 1234.0))], "id long, title string, buyer string, location string, state string, value_inr double, closes_at timestamp")
    due = spark.createDataFrame([(7, k) for k in range(1, 6)] + [(8, 1), (9, 99)], "sub_id int, id long")
    got = {r["sub_id"]: r for r in intake.digests(due, tenders, "2026-01-02 00:00:00", most=4).collect()}
    assert set(got) == {7, 8} and (got[7]["subject"], got[7]["total"], got[8]["subject"]) == ("5 new tenders", 5, "1 new tender")
    assert [(r["title"], r["place"], r["value"], r["closes_in"], r["urgent"]) for r in got[7]["rows"]] == [("T1", "Agra, UP", "Not disclosed", "today", True), ("T2", "UP", "Not disclosed", "in 1 day", True), ("T3", "Agra, UP", "₹2.50 crore", "in 2 days", True), ("T4", "UP", "₹1.50 lakh", "in 3 days", False)]


@pytest.mark.parametrize("minutes,closing,left", [(-1, ("Closed", False, True), "Closed"), (0, ("Closes within an hour", True, False), "< 1m"), (59, ("Closes within an hour", True, False), "0h 59m"), (312, ("Closes in 5h", True, False), "5h 12m"), (1440, ("Closes in 1 day", True, False), "1d 00h"), (4 * 1440 - 1, ("Closes in 3 days", True, False), "3d 23h"), (16 * 1440 + 240, ("Closes in 16 days", False, False), "16d 04h"), (None, None, None)])
def test_closing_times(spark, minutes, closing, left):
    df = spark.createDataFrame([(minutes,)], "m int").select((F.lit("2026-01-01").cast("timestamp") + F.make_interval(mins=F.col("m"))).alias("at"), F.lit("2026-01-01").cast("timestamp").alias("now"))
    r = df.select(timing.closes_in(F.col("at"), F.col("now")).alias("c"), timing.countdown(F.col("at"), F.col("now")).alias("d")).first()
    assert (tuple(r["c"]) if r["c"] else None, r["d"]) == (closing, left)


@pytest.mark.parametrize("seconds,said", [(None, "never"), (20, "just now"), (30, "1 min ago"), (59 * 60, "59 min ago"), (90 * 60, "2 h ago"), (23 * 3600, "23 h ago"), (24 * 3600, "1 day ago"), (60 * 3600, "3 days ago")])
def test_time_ago(spark, seconds, said):
    df = spark.createDataFrame([(seconds,)], "s int").select((F.lit("2026-02-01").cast("timestamp") - F.make_interval(secs=F.col("s"))).alias("at"))
    assert df.select(timing.time_ago(F.col("at"), F.lit("2026-02-01").cast("timestamp"))).first()[0] == said


def test_period_end(spark):
    df = spark.createDataFrame([("monthly",), ("yearly",), (None,)], "i string").select(timing.period_end(F.lit("2026-01-31").cast("timestamp"), F.col("i")).alias("e"))
    assert [str(r[0].date()) for r in df.collect()] == ["2026-03-02", "2027-01-31", "2026-03-02"]


def test_page_error(spark):
    df = spark.createDataFrame([("<b>Stale Session</b> session has timed out", None), ("<p>x</p>", None), ("<p>y</p>", {"title": "t"})], "h string, d map<string, string>")
    assert [r[0] for r in df.select(intake.page_error(F.col("h"), F.col("d"))).collect()] == ["stale session", "not a detail page", None]
