"""Coverage, health, plans walked newest first, bidders' shares and outcomes kept in step, on rows small enough to check."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orefield.functions import scalars
from orefield.functions.pincodes import PIN_STATES
from orefield.operators import monitoring
from orefield.operators.bucketed import BucketedTable, Change

RUN = "run_id long, source string, status string, started timestamp, finished timestamp, new int, updated int"
at = lambda d, h=0: datetime(2026, 1, d, h)


def test_coverage_has_every_source(spark):
    registry = spark.createDataFrame([("a", "A", True), ("b", "B", True), ("c", "C", False)], "key string, name string, enabled boolean")
    tenders = spark.createDataFrame([("a", at(9)), ("a", at(5)), ("a", at(1)), ("a", None), ("x", at(9))], "source string, closes_at timestamp")
    runs = spark.createDataFrame([(1, "a", "succeeded", at(1), at(1, 2), 3, 0), (2, "a", "failed", at(2), at(2, 1), 0, 0), (3, "b", "running", None, None, 0, 0), (4, "b", "succeeded", at(3), at(3, 1), 1, 1)], RUN)
    got = {r["key"]: r for r in monitoring.coverage(registry, tenders, runs, "2026-01-05", ["a", "c"]).collect()}
    assert {k: (r["open_tenders"], r["enabled"]) for k, r in got.items()} == {"a": (2, True), "b": (0, False), "c": (0, False)}
    assert got["a"]["last_run"]["status"] == "failed" and got["a"]["last_success"] == at(1, 2)
    assert got["b"]["last_run"]["status"] == "running" and got["c"]["last_run"] is None and got["c"]["last_success"] is None


def test_health(spark):
    runs = spark.createDataFrame([(1, "a", "succeeded", at(1), at(1, 2), 3, 0), (2, "a", "failed", at(5, 1), at(5, 2), 0, 0), (3, "b", "failed", at(5, 3), None, 0, 0)], RUN)
    dead = spark.createDataFrame([(True,), (False,), (False,)], "resolved boolean")
    bad = spark.createDataFrame([(at(5),), (at(1),)], "created_at timestamp")
    r = monitoring.health(runs, dead, bad, "2026-01-05 12:00:00").first()
    assert (r["runs_24h"], r["last_run_id"], r["last_success_at"], r["open_dead_letters"], r["quarantined_24h"]) == ({"failed": 2}, 3, at(1, 2), 2, 1)
    none = monitoring.health(runs.limit(0), dead.limit(0), bad.limit(0), "2026-01-05").first()
    assert (none["runs_24h"], none["last_run_id"], none["open_dead_letters"]) == ({}, None, 0)


def walked(rows, since=None):
    out = {}
    for project in {r[0] for r in rows}:
        redundant = empty = 0
        for _, doc, day, refs in sorted((r for r in rows if r[0] == project), key=lambda r: (r[2], r[1]), reverse=True):
            if since and day.year < since:
                break
            if refs is None:
                continue
            if not refs:
                empty += 1
                if empty >= 3:
                    break
                continue
            empty, new = 0, 0
            for ref in dict.fromkeys(refs):
                if ref and (project, ref) not in out:
                    out[project, ref] = doc
                    new += 1
            redundant = 0 if new else redundant + 1
            if redundant >= 2:
                break
    return out


@pytest.mark.parametrize("since", [None, 2021])
def test_plans_are_read_until_they_bring_nothing(spark, since):
    draw = random.Random(3)
    rows = [(f"p{draw.randrange(12)}", k, datetime(2019 + draw.randrange(5), 1 + draw.randrange(12), 1), draw.choice([None, [], [], ["a"], ["a", "b"], ["c", "", "c"], [f"r{k % 9}", "a"]])) for k in range(200)]
    df = spark.createDataFrame(rows, "project string, doc_id long, doc_date timestamp, refs array<string>")
    assert {(r["project"], r["ref"]): r["doc_id"] for r in monitoring.plan_walk(df, since).collect()} == walked(rows, since)


def test_bidder_shares(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 40), ("a", 30), ("a", 0), ("a", None), ("b", None)], "g string, num_bidders int")
    (r,) = monitoring.bidder_shares(df, ["g"]).collect()
    assert len(r["shares"]) == 31 and r["shares"][0] == 0 and r["shares"][1] == 0.5 == r["shares"][30] and sum(r["shares"]) == 1


TRACK = "tender_id long, org_id long, status string, l1_amount double, value_inr double, num_bidders int, winner_name string, org_name string, contribute boolean"
OUTCOME = "source_id string, tender_id long, org_id long, estimated_value double, award_value double, num_bidders int, winner string, award_date date, shared boolean"


def test_outcomes_follow_their_tracks(spark, tmp_path):
    kept = BucketedTable(spark, str(tmp_path / "o"), OUTCOME, ["source_id"], 4)
    track = lambda *rows: spark.createDataFrame([(t, 7, s, a, 100.0, 2, None, "Org", True) for t, s, a in rows], TRACK)
    gone = lambda *ids: spark.createDataFrame([(7, t) for t in ids], "org_id long, tender_id long")
    rows = lambda: {r["tender_id"]: (r["award_value"], str(r["award_date"]), r["winner"]) for r in kept.read().collect()}
    monitoring.keep_outcomes(kept, track((1, "won", 90.0), (2, "lost", 80.0), (3, "watching", 70.0), (4, "won", None)), gone(), "2026-01-01")
    assert rows() == {1: (90.0, "2026-01-01", "Org"), 2: (80.0, "2026-01-01", "")}
    wrote, cut = monitoring.keep_outcomes(kept, track((1, "won", 95.0), (2, "watching", 80.0), (5, "won", 60.0)), gone(9), "2026-02-01")
    assert rows() == {1: (95.0, "2026-01-01", "Org"), 5: (60.0, "2026-02-01", "Org")} and (wrote.inserted, wrote.updated, cut.deleted) == (1, 1, 1)
    assert monitoring.keep_outcomes(kept, track((1, "won", 95.0)), gone(), "2026-03-01") == (Change(), Change())
    monitoring.keep_outcomes(kept, track((1, "won", 95.0)).limit(0), gone(1, 5), "2026-03-01")
    assert rows() == {}


@pytest.mark.parametrize("pin,state", [("110001", "Delhi"), ("160017", "Chandigarh"), ("140301", "Punjab"), ("403001", "Goa"), ("400001", "Maharashtra"), ("247667", "Uttarakhand"), ("247001", "Uttar Pradesh"), ("262501", "Uttarakhand"), ("262001", "Uttar Pradesh"), ("682555", "Lakshadweep"), ("682001", "Kerala"), ("737101", "Sikkim"), ("834001", "Jharkhand"), (" 800001 ", "Bihar"), ("012345", ""), ("99", ""), ("990001", ""), ("", ""), (None, "")])
def test_pins(spark, pin, state):
    assert spark.createDataFrame([(pin,)], "p string").select(scalars.pincode_state(F.col("p"), PIN_STATES)).first()[0] == state
