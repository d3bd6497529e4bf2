"""State machines over streams: any order and redeliveries give one state, equal to a plain replay; windows and batches agree."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from orefield.operators.bucketed import BucketedTable
from orefield.streaming import stateful

EVENT = "event_id string, ts timestamp, org_id string, sub_id string, event string, period_end string"
START = datetime(2026, 1, 1)


def deliveries(n=120, seed=1):
    draw = random.Random(seed)
    kinds = [*stateful.BECOMES, "subscription.updated", "payment.captured"]
    weights = [3, 3, 6, 6, 2, 2, 2, 1, 1, 1, 1]
    return [(f"e{i:03}", START + timedelta(minutes=draw.randrange(3000)), f"o{draw.randrange(6)}", draw.choice(["a", "b", "c", None]), draw.choices(kinds, weights)[0], draw.choice([None, f"2026-0{i % 9 + 1}-01"])) for i in range(n)]


def replayed(rows):
    """{(org, sub): (status, end, ignored)} by the rules, one event after the other."""
    state = {}
    for _, _, org, sub, event, end in sorted(set(rows), key=lambda r: (r[1], r[0])):
        if sub is None:
            continue
        now = state.get((org, sub))
        becomes = stateful.BECOMES.get(event)
        if becomes is None or (now and now[0] in ("cancelled", "completed")):
            if now:
                now[2] += 1
            continue
        if becomes == "active":
            for (o, s), other in state.items():
                if o == org and s != sub and other[0] in ("active", "pending"):
                    other[0] = "cancelled"
        state[org, sub] = [becomes, end or (now[1] if now else None), now[2] if now else 0]
    return {k: tuple(v) for k, v in state.items()}


def streamed(spark, tmp_path, rows, schema, apply, table, order, files=6):
    """Rows as files of a stream, in the given order, through `apply` into a table in buckets."""
    per = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * per : (k + 1) * per], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{k:02}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

    def into(batch, number):
        table.upsert(batch.withColumn("n", F.lit(number)).select(*table.columns), order=order, batch=number)

    apply(stream).writeStream.foreachBatch(into).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(300)
    return table.read()


@pytest.mark.parametrize("order", ["as sent", "backwards", "twice and mixed"])
def test_one_state_in_any_order(spark, tmp_path, order):
    rows = deliveries()
    given = {"as sent": sorted(rows, key=lambda r: r[1]), "backwards": sorted(rows, key=lambda r: r[1])[::-1], "twice and mixed": random.Random(5).sample(rows + rows[:60], 180)}[order]
    table = BucketedTable(spark, str(tmp_path / "t"), "org_id string, sub_id string, status string, period_end string, ignored int", ["org_id", "sub_id"], 2)
    got = streamed(spark, tmp_path, given, EVENT, lambda s: stateful.subscriptions(s, late="30 days"), table, ["ignored", "status"])
    assert {(r.org_id, r.sub_id): (r.status, r.period_end, r.ignored) for r in got.collect()} == replayed(rows)


def test_what_the_watermark_has_passed_is_settled(spark, tmp_path):
    day = lambda d, h=0: START + timedelta(days=d, hours=h)
    rows = [("e1", day(0), "o", "a", "subscription.activated", None), ("e2", day(5), "o", "a", "subscription.halted", None), ("e3", day(9), "o", "a", "subscription.resumed", None), ("e4", day(1), "o", "a", "subscription.cancelled", None), ("e3", day(9), "o", "a", "subscription.resumed", None), ("e5", day(10), "o", "b", "subscription.activated", None)]
    table = BucketedTable(spark, str(tmp_path / "t"), "org_id string, sub_id string, status string, period_end string, ignored int", ["org_id", "sub_id"], 2)
    got = streamed(spark, tmp_path, rows, EVENT, lambda s: stateful.subscriptions(s, late="1 hour"), table, ["ignored"], files=6)
    # the cancellation of the second day comes after the watermark is past it; the redelivery counts nothing
    assert {(r.sub_id, r.status, r.ignored) for r in got.collect()} == {("a", "cancelled", 0), ("b", "active", 0)}


def test_batch_as_replay(spark):
    rows = deliveries(400, seed=3)
    got = stateful.subscriptions(spark.createDataFrame(rows + rows[:50], EVENT).repartition(5)).collect()
    assert {(r.org_id, r.sub_id): (r.status, r.period_end, r.ignored) for r in got} == replayed(rows)
    assert stateful.subscriptions(spark.createDataFrame([], EVENT)).count() == 0


ATTEMPT = "attempt_id long, ts timestamp, track string, day string, failed boolean"


def attempts(seed=2):
    draw = random.Random(seed)
    return [(i, START + timedelta(minutes=draw.randrange(4000)), f"t{draw.randrange(5)}", f"2026-01-0{draw.randrange(1, 4)}", draw.random() < 0.6) for i in range(80)]


def reminded(rows):
    out = {}
    for _, _, track, day, failed in sorted(rows, key=lambda r: (r[1], str(r[0]))):
        sends, sent = out.get((track, day), (0, False))
        if not sent:
            out[track, day] = (sends + 1, not failed)
    return out


def test_reminders_once_a_day_and_released_on_failure(spark, tmp_path):
    rows = attempts()
    df = spark.createDataFrame(rows, ATTEMPT)
    assert {(r.track, r.day): (r.sends, r.sent) for r in stateful.reminders(df).collect()} == reminded(rows)
    window = stateful.claims(df).groupBy("track", "day").agg(F.count("*").alias("n"), F.bool_or(~F.col("failed")).alias("ok")).collect()
    assert {(r.track, r.day): (r.n, r.ok) for r in window} == reminded(rows)
    table = BucketedTable(spark, str(tmp_path / "t"), "track string, day string, sends int, sent boolean", ["track", "day"], 2)
    got = streamed(spark, tmp_path, rows[::-1], ATTEMPT, lambda s: stateful.reminders(s, late="30 days"), table, ["sends"])
    assert {(r.track, r.day): (r.sends, r.sent) for r in got.collect()} == reminded(rows)
