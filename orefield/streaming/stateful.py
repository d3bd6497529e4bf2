"""State machines over streams whose events come late, out of order, and more than once.

A key's recent events are kept in state by (time, identifier), so a redelivery finds itself there. At each batch they are
folded in order of time from the state before them; what the watermark has passed is folded into that state for good and
forgotten, so a key holds as many events as come within the allowed delay. An event that is later than the watermark, or
was settled already, changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Fold = Callable[[dict, dict], dict]


class _InOrder(StatefulProcessor):
    def __init__(self, key: str, fold: Fold, rows_of: Callable[[str, dict], list[dict]], columns: list[str]):
        self.key, self.fold, self.rows_of, self.columns = key, fold, rows_of, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.settled = handle.getValueState("settled", "state string")
        self.pending = handle.getMapState("pending", "ms long, id string", "event string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for ms, name, event in zip(frame["ms"], frame["id"], frame["event"]):
                if int(ms) >= mark and not self.pending.containsKey((int(ms), name)):
                    self.pending.updateValue((int(ms), name), (event,))
        state = json.loads(self.settled.get()[0]) if self.settled.exists() else {}
        events = sorted(((k[0], k[1], v[0]) for k, v in self.pending.iterator()), key=lambda e: e[:2])
        done = [e for e in events if e[0] < mark]
        for ms, name, event in done:
            state = self.fold(state, json.loads(event))
            self.pending.removeKey((ms, name))
        if done:
            self.settled.update((json.dumps(state),))
        for _, _, event in events[len(done) :]:
            state = self.fold(state, json.loads(event))
        found = self.rows_of(key[0], state)
        if found:
            yield pd.DataFrame(found, columns=self.columns)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, ts: str, event_id: str, fold: Fold, rows_of: Callable[[str, dict], list[dict]], schema: str, late: str = "1 hour") -> DataFrame:
    """The rows that a stream's events leave for each key, given anew whenever some of its events come.

    fold: the state (a dict that JSON can hold, at first empty) after one more event (a dict of the row's columns; times
    as text). rows_of: the rows of `schema` that a key's state stands for. The session's state store must keep maps: this
    sets the one that does.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    body = F.to_json(F.struct(*events.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    rows = events.withColumn("__at", F.col(ts).cast("timestamp")).withWatermark("__at", late)
    rows = rows.select(F.col(key).cast("string").alias("key"), "__at", F.unix_millis("__at").alias("ms"), F.col(event_id).cast("string").alias("id"), body.alias("event"))
    columns = spark.createDataFrame([], schema).columns
    return rows.groupBy("key").transformWithStateInPandas(_InOrder(key, fold, rows_of, columns), schema, "Update", "EventTime")


def in_order_batch(events: DataFrame, key: str, ts: str, event_id: str, fold: Fold, rows_of: Callable[[str, dict], list[dict]], schema: str) -> DataFrame:
    """The same for events that are all there: rows come sorted by key, time and identifier, and a task keeps one state,
    however many events a key has."""
    spark = events.sparkSession
    columns = spark.createDataFrame([], schema).columns
    body = F.to_json(F.struct(*events.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(event_id).cast("string").alias("id"), body.alias("event"))
    once = rows.dropDuplicates(["key", "ms", "id"]).repartition("key").sortWithinPartitions("key", "ms", "id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, {}
        for frame in frames:
            out = []
            for k, event in zip(frame["key"], frame["event"]):
                if k != last:
                    out += rows_of(last, state) if last is not None else []
                    last, state = k, {}
                state = fold(state, json.loads(event))
            yield pd.DataFrame(out, columns=columns)
        if last is not None:
            yield pd.DataFrame(rows_of(last, state), columns=columns)

    return once.mapInPandas(run, schema)


# ---- subscriptions ----------------------------------------------------------------------------------------------------

#: What an event makes of its subscription; which states are never left, and which entitle to a plan.
BECOMES = {
    "subscription.authenticated": "created", "subscription.pending": "pending", "subscription.activated": "active", "subscription.charged": "active", "subscription.resumed": "active",
    "subscription.halted": "halted", "subscription.paused": "halted", "subscription.cancelled": "cancelled", "subscription.completed": "completed",
}
TERMINAL, ENTITLED = ("cancelled", "completed"), ("active", "pending")
SUBSCRIPTION = "org_id string, sub_id string, status string, period_end string, ignored int"


def subscription_fold(state: dict, event: dict) -> dict:
    """An organisation's subscriptions {sub: [status, end of period, events ignored]} after one event.

    A subscription that has ended stays so; one that becomes active ends the others of its organisation that entitle.
    """
    sub, becomes = event.get("sub_id"), BECOMES.get(event.get("event"))
    if sub is None:
        return state
    status, end, ignored = state.get(str(sub), [None, None, 0])
    if status in TERMINAL or becomes is None:
        if status is None:
            return state
        return state | {str(sub): [status, end, ignored + 1]}
    after = dict(state)
    if becomes == "active":
        after = {s: (["cancelled", e, i] if s != str(sub) and was in ENTITLED else [was, e, i]) for s, (was, e, i) in state.items()}
    after[str(sub)] = [becomes, event.get("period_end") or end, ignored]
    return after


def subscription_rows(org: str, state: dict) -> list[dict]:
    return [{"org_id": org, "sub_id": s, "status": status, "period_end": end, "ignored": n} for s, (status, end, n) in sorted(state.items())]


def subscriptions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """What deliveries (event_id, ts, org_id, sub_id, event, period_end) make of subscriptions, on a stream or not."""
    how = dict(key="org_id", ts="ts", event_id="event_id", fold=subscription_fold, rows_of=subscription_rows, schema=SUBSCRIPTION)
    return in_order(events, **how, late=late) if events.isStreaming else in_order_batch(events, **how)


# ---- reminders --------------------------------------------------------------------------------------------------------

REMINDER = "track string, day string, sends int, sent boolean"


def reminder_fold(state: dict, event: dict) -> dict:
    """{day: [attempts that sent, whether one went through]}: a day is claimed by the first attempt, and a failure gives it
    back."""
    sends, sent = state.get(event["day"], [0, False])
    if sent:
        return state
    return state | {event["day"]: [sends + 1, not event["failed"]]}


def reminder_rows(track: str, state: dict) -> list[dict]:
    return [{"track": track, "day": day, "sends": n, "sent": sent} for day, (n, sent) in sorted(state.items())]


def reminders(attempts: DataFrame, late: str = "1 hour") -> DataFrame:
    """How often each track was reminded on each day, from attempts (attempt_id, ts, track, day, failed)."""
    how = dict(key="track", ts="ts", event_id="attempt_id", fold=reminder_fold, rows_of=reminder_rows, schema=REMINDER)
    return in_order(attempts, **how, late=late) if attempts.isStreaming else in_order_batch(attempts, **how)


def claims(attempts: DataFrame) -> DataFrame:
    """The attempts that may send, as a window: those without an earlier success for the track on the day."""
    before = W.partitionBy("track", "day").orderBy("ts", F.col("attempt_id").cast("string")).rowsBetween(W.unboundedPreceding, -1)
    return attempts.withColumn("__done", F.max((~F.col("failed")).cast("int")).over(before)).where(F.coalesce("__done", F.lit(0)) == 0).drop("__done")
