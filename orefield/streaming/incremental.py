"""Incremental processing on Structured Streaming: upserts that ignore late pages, alerts with a high-water mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orefield.operators.upsert import last_wins, upsert


#: The key of a list that doesn't restrict; no state or sector is named so.
ANY = "\0any"


class Snapshots:
    """A table kept as numbered snapshots under a folder; a snapshot is complete once its number is in the log.

    A batch that is delivered again finds its own number there and changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self) -> DataFrame:
        return self.spark.read.schema("batch long, path string").json(f"{self.folder}/log")

    def current(self) -> tuple[int, str] | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/log")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        best = self._log().orderBy(F.desc("batch")).first()
        return (best["batch"], best["path"]) if best else None

    def read(self) -> DataFrame | None:
        now = self.current()
        return self.spark.read.parquet(now[1]) if now else None

    def write(self, df: DataFrame, batch: int) -> None:
        path = f"{self.folder}/snapshot-{batch:09d}"
        df.write.mode("overwrite").parquet(path)
        self.spark.createDataFrame([(batch, path)], "batch long, path string").coalesce(1).write.mode("append").json(f"{self.folder}/log")


def upsert_stream(pages: DataFrame, keys: list[str], order: list[str], folder: str, checkpoint: str, keep_known: tuple[str, ...] = ()) -> StreamingQuery:
    """Apply each micro-batch of a stream of records to the snapshot; older fetches never replace newer ones."""
    table = Snapshots(pages.sparkSession, folder)

    def apply(batch: DataFrame, number: int) -> None:
        now = table.current()
        if now and now[0] >= number:
            return
        latest = last_wins(batch, keys, order)
        stored = table.read()
        if stored is None:
            fetched = order[0]
            fresh = latest.withColumns({"first_seen": F.col(fetched), "last_seen": F.col(fetched)})
        else:
            fresh = upsert(stored, latest, keys, at=order[0], keep_known=keep_known).drop("outcome")
        table.write(fresh, number)

    return pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def due_alerts(subscriptions: DataFrame, rows: DataFrame, delivered: DataFrame, now: str, most: int = 25) -> tuple[DataFrame, DataFrame]:
    """(to send, subscriptions with their mark moved to now).

    subscriptions: sub_id, states, sectors, min_value, checked_until; an empty list doesn't restrict. rows: id, state,
    sector, value, first_seen. A subscription gets at most `most` rows in a run, newest first; what is over is not sent
    later, since the mark moves to `now` whatever was sent. A subscription has a key for each of its states and sectors,
    or for any; a row has its own and those for any, so they meet in an equi-join, each pair once.
    """
    from pyspark.sql import Window as W

    at = F.lit(now).cast("timestamp")
    since = subscriptions.agg(F.min("checked_until")).first()[0]
    fresh = rows.where((F.col("first_seen") > F.lit(since)) & (F.col("first_seen") <= at)) if since is not None else rows.where(F.col("first_seen") <= at)
    each = lambda c: F.explode(F.when(F.size(c) > 0, F.array_distinct(c)).otherwise(F.array(F.lit(ANY))))
    keys = subscriptions.select("sub_id", "min_value", "checked_until", each("states").alias("__state"), "sectors").select("sub_id", "min_value", "checked_until", "__state", each("sectors").alias("__sector"))
    own = fresh.select("id", "value", "first_seen", F.explode(F.array("state", F.lit(ANY))).alias("__state"), "sector").withColumn("__sector", F.explode(F.array("sector", F.lit(ANY))))
    enough = F.col("min_value").isNull() | (F.col("value") >= F.col("min_value"))
    matched = own.join(keys, ["__state", "__sector"]).where(enough & (F.col("first_seen") > F.col("checked_until")))
    unsent = matched.select("sub_id", "id", "first_seen").join(delivered.select("sub_id", "id"), ["sub_id", "id"], "left_anti")
    newest = W.partitionBy("sub_id").orderBy(F.desc("first_seen"), F.desc("id"))
    return unsent.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= most).drop("k"), subscriptions.withColumn("checked_until", at)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; on a stream, rows later than the watermark are dropped and windows close."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_of_each(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Redeliveries out: one row per key, within the watermark on a stream."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def stale_runs(runs: DataFrame, as_of: str, hours: int = 6) -> DataFrame:
    """Runs that still run after so long become incomplete."""
    over = (F.col("status") == "running") & (F.col("started") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))
    return runs.withColumn("status", F.when(over, "incomplete").otherwise(F.col("status")))
