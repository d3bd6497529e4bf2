"""Queries of streams: state machines, claims, paged feeds, with SQL twins of the state they end in."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orefield.operators.bucketed import BucketedTable
from orefield.sources import feeds
from orefield.sources.tables import table
from orefield.storage import scratch, written
from orefield.streaming import stateful

SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return keep


# ---- subscriptions ----------------------------------------------------------------------------------------------------

#: Deliveries that events stand for, by their number: the endings are rare.
KINDS = ["activated", "charged", "pending", "charged", "halted", "resumed", "updated", "authenticated", "charged", "paused", "activated", "charged", "pending", "charged", "cancelled", "charged", "activated", "halted", "completed"]

_BECOMES = "CASE event " + " ".join(f"WHEN '{k.removeprefix('subscription.')}' THEN '{v}'" for k, v in stateful.BECOMES.items()) + " END"

#: The rules one event after the other, by recursion over an organisation's events in order; three subscriptions each.
REPLAY = f"""WITH RECURSIVE raw AS (SELECT *, {KINDS!r}[event_id * 7 % {len(KINDS)} + 1] AS event FROM events),
ev AS (SELECT user_id AS org, CAST(event_id % 3 + 1 AS INTEGER) AS sub, {_BECOMES} AS becomes, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') END AS ends, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), CAST(event_id AS VARCHAR)) AS rn FROM raw),
st AS (SELECT DISTINCT org, CAST(0 AS BIGINT) AS rn, CAST([NULL, NULL, NULL] AS VARCHAR[]) AS s, CAST([NULL, NULL, NULL] AS VARCHAR[]) AS e, CAST([0, 0, 0] AS INTEGER[]) AS g FROM ev
UNION ALL SELECT org, rn, [CASE WHEN i = sub THEN CASE WHEN dead THEN s[i] ELSE becomes END WHEN NOT dead AND becomes = 'active' AND s[i] IN ('active', 'pending') THEN 'cancelled' ELSE s[i] END FOR i IN [1, 2, 3]],
  [CASE WHEN i = sub AND NOT dead THEN coalesce(ends, e[i]) ELSE e[i] END FOR i IN [1, 2, 3]], [CASE WHEN i = sub AND dead AND s[i] IS NOT NULL THEN g[i] + 1 ELSE g[i] END FOR i IN [1, 2, 3]]
  FROM (SELECT st.org, ev.rn, s, e, g, sub, becomes, ends, becomes IS NULL OR coalesce(s[sub] IN ('cancelled', 'completed'), FALSE) AS dead FROM st JOIN ev ON ev.org = st.org AND ev.rn = st.rn + 1)),
last AS (SELECT * FROM st QUALIFY rn = max(rn) OVER (PARTITION BY org))
SELECT CAST(org AS VARCHAR) AS org_id, CAST(i - 1 AS VARCHAR) AS sub_id, s[i] AS status, e[i] AS period_end, g[i] AS ignored FROM last, (SELECT unnest([1, 2, 3]) AS i) WHERE s[i] IS NOT NULL"""


def deliveries(events: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") * 7 % len(KINDS) + 1).cast("int"))
    ends = F.when(F.col("event_id") % 2 == 0, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd"))
    return events.select(F.col("event_id").cast("string").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("org_id"), (F.col("event_id") % 3).cast("string").alias("sub_id"), F.concat(F.lit("subscription."), kind).alias("event"), ends.alias("period_end"))


@query(REPLAY)
def subscription_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-07: what deliveries make of subscriptions, some of which come twice: endings are never left, and one that
    becomes active ends the others of its organisation."""
    sent = deliveries(table(spark, sf_dir, "events"))
    return stateful.subscriptions(sent.unionByName(sent.where("cast(event_id as long) % 5 = 0")))


@query(REPLAY)
def subscription_states_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-07, SNK-01: the same by a stream into a table in buckets."""
    kinds = table(spark, sf_dir, "events").schema
    # as a folder or a file, whichever the table is
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 50).parquet(f"{sf_dir}/[e]vents.parquet")
    kept = BucketedTable(spark, scratch(spark, "subscriptions"), stateful.SUBSCRIPTION, ["org_id", "sub_id"], 8)

    def into(batch: DataFrame, number: int) -> None:
        kept.upsert(batch, batch=number)

    found = stateful.subscriptions(deliveries(stream), late="365 days")
    found.writeStream.foreachBatch(into).outputMode("update").option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return kept.read()


# ---- reminders --------------------------------------------------------------------------------------------------------

_ATTEMPT = "SELECT event_id, CAST(user_id AS VARCHAR) AS track, strftime(ts, '%Y-%m-%d') AS day, epoch_ms(ts) AS ms, event_id % 3 = 0 AS failed FROM events"


def attempts(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("attempt_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("track"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day"), (F.col("event_id") % 3 == 0).alias("failed"))


@query(f"""WITH a AS ({_ATTEMPT}), f AS (SELECT track, day, min(struct_pack(ms := ms, id := CAST(event_id AS VARCHAR))) FILTER (NOT failed) AS first FROM a GROUP BY track, day)
SELECT track, day, CAST(count(*) AS INTEGER) AS sends, first IS NOT NULL AS sent FROM a JOIN f USING (track, day) WHERE first IS NULL OR struct_pack(ms := ms, id := CAST(event_id AS VARCHAR)) <= first GROUP BY track, day, first""")
def reminders_claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-06: attempts to remind: the first of a day claims it, a failure gives it back, nothing is sent after a success."""
    return stateful.reminders(attempts(table(spark, sf_dir, "events")))


@query(f"WITH a AS ({_ATTEMPT}), f AS (SELECT *, max(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY track, day ORDER BY ms, CAST(event_id AS VARCHAR) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM a) SELECT event_id AS attempt_id FROM f WHERE coalesce(done, 0) = 0")
def reminders_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-06, AGG-30: the attempts that may send."""
    return stateful.claims(attempts(table(spark, sf_dir, "events"))).select("attempt_id")


# ---- paged feeds ------------------------------------------------------------------------------------------------------

#: Records of a page, and how many of them the page before doesn't have.
PAGE_ROWS, OWN = 500, 450


def placed(rows: DataFrame, by: str) -> DataFrame:
    """rows with their place in order of `by`, from 0, whatever gaps there are: numbered within ranges, a task each."""
    spark = rows.sparkSession
    ranged = written(rows.repartitionByRange(8 * spark.sparkContext.defaultParallelism, by).withColumn("range", F.spark_partition_id()), scratch(spark, "ranges"))
    sizes = {r["range"]: r["count"] for r in ranged.groupBy("range").count().collect()}  # a number a range
    before, n = [], 0
    for k in sorted(sizes):
        before, n = [*before, (k, n)], n + sizes[k]
    starts = F.broadcast(spark.createDataFrame(before, "range int, before long"))
    return ranged.join(starts, "range").withColumn("place", F.col("before") + F.row_number().over(W.partitionBy("range").orderBy(by)) - 1).drop("range", "before")


def publish(records: DataFrame, folder: str, rows: int = PAGE_ROWS) -> None:
    """Write records (pos, record) as a feed's pages, a page a group."""
    total = records.agg(F.max("pos")).first()[0] + 1
    paged = records.groupBy((F.floor(F.col("pos") / rows) * rows).alias("offset")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "record"))), lambda x: x["record"])).alias("items"))

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for offset, items in zip(f["offset"], f["items"]):
                feeds.write_page(folder, int(offset), json.dumps({"total": total, "items": [json.loads(x) for x in json.loads(items)]}).encode())
            yield f[["offset"]]

    paged.mapInPandas(put, "offset long").write.format("noop").mode("overwrite").save()


@query("SELECT user_id * 1000000 + event_id AS id, event_type AS kind, CAST(event_id AS BIGINT) AS page_order FROM events")
def feed_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11: a feed of pages in two runs of a stream, the second from where the first stopped; a tenth of the records
    come on two pages."""
    events = placed(table(spark, sf_dir, "events"), "event_id").select("event_id", "place", (F.col("user_id") * 1000000 + F.col("event_id")).alias("id"), "event_type")
    # a page has 450 records of its own, and the last 50 of the page before again
    page, k = F.floor(F.col("place") / OWN), F.col("place") % OWN
    again = PAGE_ROWS - OWN
    places = F.array(page * PAGE_ROWS + k, F.when(k >= OWN - again, (page + 1) * PAGE_ROWS + again + k))
    kinds = F.struct("id", F.col("event_type").alias("kind"), F.col("event_id").alias("page_order"))
    records = events.select(F.explode(F.array_compact(places)).alias("pos"), F.to_json(kinds).alias("record"))
    folder = scratch(spark, "feed")
    publish(records, f"{folder}/pages")
    kept = BucketedTable(spark, f"{folder}/table", "id long, offset long, ord int, kind string, page_order long", ["id", "page_order"], 8)
    options = {"pages": f"{folder}/pages", "cache": f"{folder}/cache", "rows": str(PAGE_ROWS)}
    for more in ({"limit": str(3 * PAGE_ROWS)}, {"per_batch": "100"}):
        stream = feeds.read_feed(spark, **options, **more).select(F.from_json("record", "id long, kind string, page_order long").alias("r"), "offset", "ord")
        feeds.drain(stream.select("r.id", "offset", "ord", "r.kind", "r.page_order"), kept, f"{folder}/progress")
    return kept.read().select("id", "kind", "page_order")
