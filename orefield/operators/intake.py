"""What a crawl brings in: pages judged and converted, listings compared with what is stored, files and runs accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions import scalars, timing
from orefield.functions.scalars import blank
from orefield.sources import pages

#: The least characters of texts that a tender must have; the most rows of a digest.
LEAST_CHARS = {"source": 1, "source_tender_id": 3, "title": 3, "buyer_raw": 2}
DIGEST_ROWS = 25
STALE, NO_DETAIL = "stale session", "not a detail page"


def page_error(html: Column, detail: Column) -> Column:
    """Why a fetched page can't be read: the session was over, or it is no detail page; null if it can."""
    return F.when(pages.is_stale(html), STALE).when(detail.isNull(), NO_DETAIL)


def converted(rows: DataFrame, detail: str = "detail") -> DataFrame:
    """rows (source, state, url, detail: a map of a page's texts by field) with the fields of a tender, and `errors`.

    errors: an array of (field, error, input). First all texts that can't be converted and all dates that are missing are
    named; only a record without such has its lengths and signs looked at, all at once; only one that passes these has its
    dates compared. A meeting before the bids that can't be read is unknown, and so is a PIN that is none.
    """
    d = lambda k: F.coalesce(F.col(detail)[k], F.lit(""))
    err = lambda cond, field, said, given: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(field).alias("field"), (said if isinstance(said, Column) else F.lit(said)).alias("error"), given.cast("string").alias("input")))
    unless = lambda c: F.when(blank(c), "").otherwise(c)
    times = {"published_at": "published", "closes_at": "closes", "opens_at": "opens"}
    sums = {"value_inr": "value", "emd_inr": "emd", "fee_inr": "fee"}
    pin = F.trim(d("pincode"))
    made = rows.withColumns({
        **{f: scalars.parse_portal_time(d(k)) for f, k in times.items()}, **{f: scalars.parse_inr(d(k)) for f, k in sums.items()}, "prebid_meeting": scalars.parse_portal_time(d("prebid")),
        "source_tender_id": d("tender_id"), "title": d("title"), "buyer_raw": scalars.buyer_from_chain(d("org_chain")), "org_chain": F.replace(d("org_chain"), F.lit("||"), F.lit(" || ")), "ref_no": d("ref_no"), "category": d("category"), "tender_type": d("tender_type"),
        "product_category": unless(d("product_category")), "location": unless(d("location")), "pincode": F.when(pin.rlike(r"^[1-9]\d{5}$"), pin).otherwise(""),
    })
    unread = [err(scalars.parse_portal_time_error(d(k)).isNotNull(), f, scalars.parse_portal_time_error(d(k)), d(k)) for f, k in times.items()]
    unread += [err(scalars.parse_inr_error(d(k)).isNotNull(), f, scalars.parse_inr_error(d(k)), d(k)) for f, k in sums.items()]
    missing = [err(F.col(f).isNull() & scalars.parse_portal_time_error(d(k)).isNull(), f, "required", F.lit(None)) for f, k in list(times.items())[:2]]
    short = [err(F.length(F.coalesce(f, F.lit(""))) < n, f, f"fewer than {n} characters", F.col(f)) for f, n in LEAST_CHARS.items()]
    below = [err(F.col(f) < 0, f, "negative", F.col(f)) for f in sums]
    order = err(F.col("closes_at") < F.col("published_at"), "__all__", "closes before it is published", F.concat_ws(", ", d("published"), d("closes")))
    made = made.withColumn("__first", F.array_compact(F.array(*unread, *missing))).withColumn("__second", F.array_compact(F.array(*short, *below)))
    errors = F.when(F.size("__first") > 0, F.col("__first")).when(F.size("__second") > 0, F.col("__second")).otherwise(F.array_compact(F.array(order)))
    return made.withColumn("errors", errors).drop("__first", "__second")


def listing_plan(listed: DataFrame, stored: DataFrame, incremental: bool = True) -> DataFrame:
    """(tender_id, fetch): which listed tenders must be fetched: new ones, and those whose title or one of whose dates isn't
    what is stored, or can't be read; all, if the crawl isn't incremental. Of rows of one tender the first by `pos` counts.

    listed: source, tender_id, title, published, closes, pos (texts as on the page). stored: source, tender_id, title,
    published_at, closes_at.
    """
    first = listed.where(F.coalesce("tender_id", F.lit("")) != "").groupBy("source", "tender_id").agg(F.min(F.struct("pos", "title", "published", "closes")).alias("l"))
    known = stored.select("source", "tender_id", F.struct("title", "published_at", "closes_at").alias("s"))
    same = (
        (scalars.parse_portal_time(F.col("l.closes")) == F.col("s.closes_at")) & (scalars.parse_portal_time(F.col("l.published")) == F.col("s.published_at"))
        & (F.trim("l.title") == F.trim("s.title"))
    )
    return first.join(known, ["source", "tender_id"], "left").select("source", "tender_id", (~(F.coalesce(same, F.lit(False)) & F.lit(incremental))).alias("fetch"))


def files_read(spark, path: str) -> DataFrame:
    """(path, bytes, sha256, modified) of files, as provenance of what is read from them; a task reads a file. Spark
    lists no empty files."""
    found = spark.read.format("binaryFile").load(path)
    return found.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def crawl_report(tenders: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row: tenders, distinct_ids, states, total_value, repeats), and per finished run its minutes and whether its items add up.

    tenders: source, tender_id, state, value_inr. runs: run_id, source, status, started, finished, planned, new, updated,
    unchanged, skipped, quarantined, failed. Repeats are items that were stored before: changed, unchanged or skipped.
    """
    distinct = tenders.select("source", "tender_id").distinct().agg(F.count(F.lit(1)).alias("distinct_ids"))
    totals = tenders.agg(F.count(F.lit(1)).alias("tenders"), F.count_distinct(F.when(F.col("state") != "", F.col("state"))).alias("states"), F.coalesce(F.sum("value_inr"), F.lit(0)).alias("total_value"))
    repeats = runs.agg(F.coalesce(F.sum(F.col("updated") + F.col("unchanged") + F.col("skipped")), F.lit(0)).alias("repeats"))
    minutes = F.coalesce((F.unix_timestamp("finished") - F.unix_timestamp("started")) / 60.0, F.lit(0.0))
    items = F.col("new") + F.col("updated") + F.col("unchanged") + F.col("skipped") + F.col("quarantined") + F.col("failed")
    each = runs.where("status <> 'running'").select("run_id", "source", "status", F.round(minutes, 1).alias("minutes"), (items == F.col("planned")).alias("adds_up"))
    return totals.join(F.broadcast(distinct)).join(F.broadcast(repeats)), each  # a row each


def digests(due: DataFrame, tenders: DataFrame, now: str, most: int = DIGEST_ROWS) -> DataFrame:
    """(sub_id, subject, total, rows): what a subscription is sent: the first tenders by closing, at most `most`, in words,
    and how many there are in all.

    due: sub_id, id. tenders: id, title, buyer, location, state, value_inr, closes_at.
    """
    at = F.lit(now).cast("timestamp")
    days = F.floor((F.unix_timestamp("closes_at") - F.unix_timestamp(at)) / 86400)
    said = F.struct(
        "closes_at", "id", "title", "buyer", F.array_join(F.array(*(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)) for c in ("location", "state"))), ", ").alias("place"), shown(F.col("value_inr")).alias("value"),
        F.when(days < 1, "today").when(days == 1, "in 1 day").otherwise(F.format_string("in %d days", days)).alias("closes_in"), (days < timing.URGENT_DAYS).alias("urgent"),
    )
    listed = due.join(tenders, "id").groupBy("sub_id").agg(F.array_sort(F.collect_list(said)).alias("all"))
    n = F.size("all")
    subject = F.when(n == 1, "1 new tender").otherwise(F.format_string("%d new tenders", n))
    return listed.select("sub_id", subject.alias("subject"), n.alias("total"), F.slice("all", 1, most).alias("rows"))


def shown(value: Column) -> Column:
    """An amount for a reader: in crores, lakhs, or grouped rupees; none for nothing."""
    v = value.cast("double")
    return F.when(F.coalesce(v, F.lit(0.0)) == 0, "Not disclosed").when(v >= 1e7, F.concat(F.lit("₹"), F.format_number(v / 1e7, 2), F.lit(" crore"))).when(v >= 1e5, F.concat(F.lit("₹"), F.format_number(v / 1e5, 2), F.lit(" lakh"))).otherwise(F.concat(F.lit("₹"), F.format_number(v, 0)))
