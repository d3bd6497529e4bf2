from datetime import datetime

from pyspark.sql import functions as F

from orefield.operators.upsert import last_wins
from orefield.streaming import incremental

KIND = "k int, fetched_at int, content_hash string"


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    rows = [(1, 1, "a"), (2, 1, "b"), (1, 3, "c"), (1, 2, "late"), (3, 5, "d"), (2, 4, "b")]
    for name, order in (("x", rows), ("y", rows[::-1])):
        src = tmp_path / name
        for n, r in enumerate(order):
            spark.createDataFrame([r], KIND).coalesce(1).write.mode("append").parquet(str(src / f"p{n}"))
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(str(src))
        for _ in range(2):  # a second run finds nothing new
            incremental.upsert_stream(stream, ["k"], ["fetched_at", "content_hash"], str(tmp_path / f"{name}-t"), str(tmp_path / f"{name}-c")).awaitTermination(120)
        got = {r.k: r.content_hash for r in incremental.Snapshots(spark, str(tmp_path / f"{name}-t")).read().collect()}
        assert got == {r.k: r.content_hash for r in last_wins(spark.createDataFrame(rows, KIND), ["k"], ["fetched_at"]).collect()}


def test_alerts(spark):
    at = lambda d: datetime(2026, 1, d)
    subs = spark.createDataFrame([(1, ["A"], [], None, at(1)), (2, [], ["x"], 10.0, at(1))], "sub_id int, states array<string>, sectors array<string>, min_value double, checked_until timestamp")
    rows = spark.createDataFrame([(1, "A", "x", 5.0, at(2)), (2, "B", "x", 20.0, at(2)), (3, "A", "y", None, at(3)), (4, "A", "x", 50.0, at(1)), (5, "A", "x", 50.0, at(9))], "id int, state string, sector string, value double, first_seen timestamp")
    sent = spark.createDataFrame([(1, 3)], "sub_id int, id int")
    due, moved = incremental.due_alerts(subs, rows, sent, "2026-01-05")
    assert sorted((r.sub_id, r.id) for r in due.collect()) == [(1, 1), (2, 2)]
    assert {r.checked_until for r in moved.collect()} == {at(5)}
    assert incremental.due_alerts(moved, rows, sent, "2026-01-06")[0].count() == 0
    assert incremental.due_alerts(subs, rows, sent, "2026-01-05", most=0)[0].count() == 0


def test_windows_close_on_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = incremental.windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    total = lambda df: {(r.start, r.event_type): r.n for r in df.collect()}
    assert total(spark.table("w")) == total(incremental.windowed_counts(events))


def test_stale_runs(spark):
    runs = spark.sql("select stack(2, 1, 'running', timestamp'2026-01-01 00:00:00', 2, 'running', timestamp'2026-01-01 09:00:00') as (id, status, started)")
    assert {r.id: r.status for r in incremental.stale_runs(runs, "2026-01-01 10:00:00").collect()} == {1: "incomplete", 2: "running"}
    assert incremental.first_of_each(runs.union(runs), ["id"]).select(F.count("id")).first()[0] == 2
