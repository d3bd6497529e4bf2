"""Queries against their SQL on small tables that the test tables don't have: gaps in keys, moments near a boundary."""

import datetime

import duckdb
from compare import rows_of

from orefield.operators import entities
from orefield.plans import intake, streams


def agrees(spark, folder, name, table, query, sql, view):
    spark.createDataFrame(*table).write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    con.sql(f"create view {name} as {view.format(at=f'{folder}/{name}.parquet/*.parquet')}")
    df, rel = query(spark, str(folder)), con.sql(sql)
    got, want = rows_of(df.columns, df.collect()), rows_of(rel.columns, rel.fetchall())
    assert got == want
    return got[0]


def test_times_are_told_to_the_nearest_millisecond(spark, tmp_path):
    now = datetime.datetime(2024, 1, 15)
    moments = [now + datetime.timedelta(microseconds=m) for m in (-400, -600, 3_599_999_600, 86_399_999_500, 86_399_999_499, -29_999_600, 0)]
    events = [(k, at) for k, at in enumerate(moments)]
    rows = agrees(spark, tmp_path, "events", (events, "event_id long, ts timestamp"), intake.times_told, intake.SQL["times_told"], "select event_id, ts::timestamp as ts from '{at}'")
    assert len(rows) == len(events)


def test_a_feed_of_events_with_gaps_and_numbers_over_a_million(spark, tmp_path):
    # user 1's event 7 and user 0's event 1,000,007 have one identifier, and whole pages of numbers are missing
    events = [(k, 1, "view") for k in range(1200)] + [(1_000_000 + k, 0, "click") for k in range(700)]
    rows = agrees(spark, tmp_path, "events", (events, "event_id long, user_id long, event_type string"), streams.feed_drained, streams.SQL["feed_drained"], "select * from '{at}'")
    assert len(rows) == 1900


def test_numbers_are_not_misspelt():
    assert entities.score("roads wing 12345 | division 7", "roads wing 12346 | division 7") <= entities.OWN_TOKEN_CAP
    assert entities.score("public works divison", "public works division") >= entities.MERGE_FROM
