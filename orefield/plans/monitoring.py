"""Queries of coverage, health, plans, rules and places, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions import scalars
from orefield.functions.pincodes import PIN_STATES
from orefield.operators import bookkeeping, monitoring, rules
from orefield.operators.bucketed import BucketedTable
from orefield.sources.tables import AS_OF, TENDER_SQL, table, tenders
from orefield.storage import scratch

SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return keep


_PINS = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in PIN_STATES.items()) + ") AS p(prefix, state)"


@query(f"""WITH b AS (SELECT c_custkey AS buyer_id, CASE WHEN c_custkey % 11 = 0 THEN ' ' || CAST(100000 + c_custkey * 7919 % 900000 AS VARCHAR) || ' ' WHEN c_custkey % 13 = 0 THEN '0' || CAST(10000 + c_custkey AS VARCHAR) ELSE CAST(100000 + c_custkey * 7919 % 900000 AS VARCHAR) END AS pin FROM customer),
m AS (SELECT buyer_id, state, row_number() OVER (PARTITION BY buyer_id ORDER BY length(prefix) DESC) AS k FROM b JOIN {_PINS} ON starts_with(trim(pin), prefix) WHERE length(trim(pin)) = 6 AND NOT starts_with(trim(pin), '0'))
SELECT b.buyer_id, coalesce(m.state, '') AS state FROM b LEFT JOIN m ON b.buyer_id = m.buyer_id AND m.k = 1""")
def pin_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08: the state of every buyer's PIN by the whole table of prefixes."""
    k = F.col("c_custkey")
    plain = (100000 + k * 7919 % 900000).cast("string")
    pin = F.when(k % 11 == 0, F.concat(F.lit(" "), plain, F.lit(" "))).when(k % 13 == 0, F.concat(F.lit("0"), (10000 + k).cast("string"))).otherwise(plain)
    return table(spark, sf_dir, "customer").select(k.alias("buyer_id"), scalars.pincode_state(pin, PIN_STATES).alias("state"))


# ---- sources and crawls -----------------------------------------------------------------------------------------------

#: Runs from events: an event's user says the source, its kind the outcome.
_RUNS = "SELECT event_id AS run_id, ['ASIA', 'EUROPE', 'AMERICA', 'AFRICA'][user_id % 4 + 1] AS source, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'click' THEN 'running' ELSE 'failed' END AS status, ts AS started, CASE WHEN event_type <> 'click' THEN ts + INTERVAL 1 HOUR END AS finished, event_id % 7 AS new, event_id % 5 AS updated FROM events"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, at = table(spark, sf_dir, "events"), F.col("ts").cast("timestamp")
    status = F.when(F.col("event_type") == "purchase", monitoring.SUCCEEDED).when(F.col("event_type") == "click", "running").otherwise("failed")
    source = F.element_at(F.array(*map(F.lit, ("ASIA", "EUROPE", "AMERICA", "AFRICA"))), (F.col("user_id") % 4 + 1).cast("int"))
    return e.select(F.col("event_id").alias("run_id"), source.alias("source"), status.alias("status"), at.alias("started"), F.when(F.col("event_type") != "click", at + F.expr("INTERVAL 1 HOUR")).alias("finished"), (F.col("event_id") % 7).alias("new"), (F.col("event_id") % 5).alias("updated"))


@query(f"""WITH {TENDER_SQL}, r AS ({_RUNS}), o AS (SELECT source, count(*) AS n FROM tender WHERE closes_at >= TIMESTAMP '{AS_OF}' GROUP BY source),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY started DESC, run_id DESC) = 1), s AS (SELECT source, max(finished) AS at FROM r WHERE status = 'succeeded' GROUP BY source)
SELECT r_name AS key, r_name <> 'AFRICA' AND r_regionkey < 4 AS enabled, coalesce(o.n, 0) AS open_tenders, l.status AS last_status, strftime(l.finished, '%Y-%m-%d %H:%M:%S') AS last_finished, l.new AS last_new, strftime(s.at, '%Y-%m-%d %H:%M:%S') AS last_success
FROM region LEFT JOIN o ON o.source = r_name LEFT JOIN l ON l.source = r_name LEFT JOIN s ON s.source = r_name""")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-24, JON-20: every registered source with what is open, its newest run and its newest success."""
    registry = table(spark, sf_dir, "region").select(F.col("r_name").alias("key"), (F.col("r_regionkey") < 4).alias("enabled"))
    found = monitoring.coverage(registry, tenders(spark, sf_dir), runs(spark, sf_dir), AS_OF, ["ASIA", "EUROPE", "AMERICA", "MIDDLE EAST"])
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return found.select("key", "enabled", "open_tenders", F.col("last_run.status").alias("last_status"), at("last_run.finished").alias("last_finished"), F.col("last_run.new").alias("last_new"), at("last_success").alias("last_success"))


@query(f"""WITH r AS ({_RUNS}), d AS (SELECT * FROM r WHERE started >= TIMESTAMP '2024-01-19 00:00:00' AND started <= TIMESTAMP '2024-01-20 00:00:00'), a AS (SELECT * FROM r WHERE started <= TIMESTAMP '2024-01-20 00:00:00')
SELECT (SELECT count(*) FROM d WHERE status = 'succeeded') AS succeeded, (SELECT count(*) FROM d WHERE status = 'running') AS running, (SELECT count(*) FROM d WHERE status = 'failed') AS failed,
(SELECT arg_max(run_id, struct_pack(s := started, r := run_id)) FROM a) AS last_run_id, (SELECT strftime(max(finished), '%Y-%m-%d %H:%M:%S') FROM a WHERE status = 'succeeded') AS last_success_at,
(SELECT count(*) FROM a WHERE status = 'failed' AND run_id % 3 <> 0) AS open_dead_letters, (SELECT count(*) FROM d WHERE status = 'failed' AND run_id % 3 = 0) AS quarantined_24h""")
def crawl_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25: the last day's runs by status, the newest run and success, dead letters that are open, what was set aside."""
    all_of = runs(spark, sf_dir).where("started <= timestamp'2024-01-20 00:00:00'")
    failed = all_of.where("status = 'failed'")
    found = monitoring.health(all_of, failed.select((F.col("run_id") % 3 == 0).alias("resolved")), failed.where("run_id % 3 = 0").select(F.col("started").alias("created_at")), "2024-01-20 00:00:00")
    n = lambda s: F.coalesce(F.try_element_at("runs_24h", F.lit(s)), F.lit(0)).alias(s)
    return found.select(n("succeeded"), n("running"), n("failed"), "last_run_id", F.date_format("last_success_at", "yyyy-MM-dd HH:mm:ss").alias("last_success_at"), "open_dead_letters", "quarantined_24h")


#: A buyer's orders as versions of its plan: what they list repeats, some list nothing, and some can't be read.
_PLANS = "SELECT o_custkey AS project, o_orderkey AS doc_id, o_orderdate AS doc_date, CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN [] ELSE list_distinct(['r' || (o_orderkey % 3), 'r' || (o_orderkey % 5), '']) END AS refs FROM orders"


@query(f"""WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY doc_date DESC, doc_id DESC) AS rn FROM ({_PLANS})),
w AS (SELECT DISTINCT project, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS seen, CAST([] AS VARCHAR[]) AS new, CAST(NULL AS BIGINT) AS doc_id, 0 AS redundant, 0 AS empty FROM v
UNION ALL SELECT project, rn, list_concat(seen, n), n, doc_id, CASE WHEN refs IS NULL OR len(refs) = 0 THEN redundant WHEN len(n) = 0 THEN redundant + 1 ELSE 0 END, CASE WHEN refs IS NULL THEN empty WHEN len(refs) = 0 THEN empty + 1 ELSE 0 END
  FROM (SELECT v.project, v.rn, w.seen, v.doc_id, v.refs, w.redundant, w.empty, CASE WHEN v.refs IS NULL THEN [] ELSE list_filter(v.refs, lambda r: r <> '' AND NOT list_contains(w.seen, r)) END AS n
    FROM w JOIN v ON v.project = w.project AND v.rn = w.rn + 1 WHERE w.redundant < {monitoring.MOST_REDUNDANT} AND w.empty < {monitoring.MOST_EMPTY} AND year(v.doc_date) >= 1993))
SELECT project, unnest(new) AS ref, doc_id FROM w""")
def plans_walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-28: the newest plan that lists each reference, older plans unread once they bring nothing."""
    k = F.col("o_orderkey")
    part = lambda n: F.concat(F.lit("r"), (k % n).cast("string"))
    refs = F.when(k % 13 == 0, F.lit(None).cast("array<string>")).when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(part(3), part(5), F.lit(""))))
    plans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), k.alias("doc_id"), F.col("o_orderdate").alias("doc_date"), refs.alias("refs"))
    return monitoring.plan_walk(plans, since=1993)


@query(f"""WITH a AS (SELECT p_brand, l_partkey % 40 AS n FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT p_brand, least(n, 30) AS n, count(*) AS k FROM a WHERE n >= 1 GROUP BY ALL), t AS (SELECT p_brand, sum(k) AS k FROM c GROUP BY p_brand)
SELECT t.p_brand, CAST(i AS INTEGER) AS bidders, round(coalesce(c.k, 0) / t.k, 12) AS share FROM t, range(0, 31) r(i) LEFT JOIN c ON c.p_brand = t.p_brand AND c.n = i""")
def bidder_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-04: how often so many bid, by brand; more than thirty count as thirty."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("p_brand", (F.col("l_partkey") % 40).alias("num_bidders"))
    found = monitoring.bidder_shares(rows, ["p_brand"])
    return found.select("p_brand", F.posexplode("shares").alias("bidders", "share")).select("p_brand", "bidders", F.round("share", 12).alias("share"))


@query("""SELECT CAST(o_custkey AS VARCHAR) || ':' || o_orderkey AS source_id, CASE WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS award_value, CASE WHEN o_orderkey % 5 = 0 THEN DATE '2026-01-01' ELSE DATE '2026-02-01' END AS award_date
FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 7 <> 3 AND o_orderkey % 6 <> 2""")
def outcomes_in_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-18, RUL-05: training rows after tracks are set, changed, reopened and deleted; the first award date stays."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    track = lambda status, price: orders.select(
        k.alias("tender_id"), F.col("o_custkey").alias("org_id"), status.alias("status"), price.alias("l1_amount"), F.col("o_totalprice").alias("value_inr"), F.lit(3).alias("num_bidders"), F.lit("W").alias("winner_name"), F.lit("Org").alias("org_name"), F.lit(True).alias("contribute"),
    )
    shape = "source_id string, tender_id long, org_id long, estimated_value double, award_value double, num_bidders int, winner string, award_date date, shared boolean"
    kept = BucketedTable(spark, scratch(spark, "outcomes"), shape, ["source_id"], 16)
    none = orders.limit(0).select(F.col("o_custkey").alias("org_id"), k.alias("tender_id"))
    first, second = F.lit("won"), F.when(k % 6 == 2, "watching").otherwise("lost")
    monitoring.keep_outcomes(kept, track(first, F.col("o_totalprice")).where("tender_id % 5 = 0"), none, "2026-01-01")
    monitoring.keep_outcomes(kept, track(second, F.when(k % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))), none, "2026-02-01")
    monitoring.keep_outcomes(kept, track(first, F.col("o_totalprice")).limit(0), orders.where("o_orderkey % 7 = 3").select(F.col("o_custkey").alias("org_id"), k.alias("tender_id")), "2026-03-01")
    return kept.read().select("source_id", "award_value", "award_date")


# ---- rules and catalogues ---------------------------------------------------------------------------------------------

_BELOW = "round_even((1.0 - ratio) * 100, 0)"


@query(f"""WITH r AS (SELECT o_orderkey AS k, o_totalprice AS est, ['works', 'goods', '', 'consultancy', 'services'][o_orderkey % 5 + 1] AS category, CASE o_orderkey % 7 WHEN 0 THEN 'qcbs' WHEN 1 THEN 'reverse_auction' ELSE 'open' END AS method,
CASE o_orderkey % 4 WHEN 0 THEN 'NHAI' WHEN 1 THEN 'GeM buyer' ELSE 'Board' END AS buyer, ['Odisha', 'Kerala', ''][o_orderkey % 3 + 1] AS state, CASE WHEN o_orderkey % 11 = 0 THEN 'gem' ELSE 'portal' END AS source, CASE WHEN o_orderkey % 2 = 0 THEN DATE '2026-02-01' ELSE DATE '2025-12-01' END AS day,
CASE WHEN o_orderkey % 9 <> 0 THEN 1.0 - (o_orderkey % 31) / 100.0 END AS ratio, o_orderkey % 6 = 0 AS class1 FROM orders),
b AS (SELECT *, category IN ('works', '') AND buyer = 'NHAI' AS roads, category IN ('works', '') AND state = 'Odisha' AS od, ratio IS NOT NULL AS bid, {_BELOW} AS below FROM r),
c AS (SELECT *, roads OR (od AND day >= DATE '2026-01-03') AS bound FROM b),
f AS (SELECT k, unnest(list_filter([
  CASE WHEN category = 'consultancy' OR method = 'qcbs' THEN 'qcbs' END, CASE WHEN bound AND bid AND below > 10 THEN 'aps' END, CASE WHEN bound AND bid AND below <= 10 THEN 'aps_free_band' END, CASE WHEN od AND day < DATE '2026-01-03' THEN 'odisha_floor' END,
  CASE WHEN od AND day >= DATE '2026-01-03' THEN 'odisha_cap_abolished' END, CASE WHEN ratio < 0.8 THEN 'abnormally_low' END, CASE WHEN bid AND NOT ratio < 0.8 AND category = 'works' AND NOT bound AND ratio < 0.9 AND state <> '' THEN 'state_aps' END,
  CASE WHEN category IN ('goods', 'services') THEN 'mse_preference' END, CASE WHEN category IN ('goods', 'services') AND est >= 500000 AND NOT class1 THEN 'make_in_india' END, CASE WHEN (source = 'gem' OR method = 'reverse_auction' OR buyer = 'GeM buyer') AND est > 1000000 THEN 'reverse_auction' END], lambda x: x IS NOT NULL)) AS key FROM c)
SELECT k AS o_orderkey, key FROM f""")
def rules_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-03: every rule, over tenders of each category, method, buyer, place, portal and day, with and without a bid."""
    k = F.col("o_orderkey")
    of = lambda n, values: F.element_at(F.array(*map(F.lit, values)), (k % n + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", of(5, ["works", "goods", "", "consultancy", "services"]).alias("category"), F.when(k % 7 == 0, "qcbs").when(k % 7 == 1, "reverse_auction").otherwise("open").alias("method"),
        F.when(k % 4 == 0, "NHAI").when(k % 4 == 1, "GeM buyer").otherwise("Board").alias("buyer"), F.lit("Work").alias("title"), of(3, ["Odisha", "Kerala", ""]).alias("state"), F.when(k % 11 == 0, "gem").otherwise("portal").alias("source"),
        F.when(k % 2 == 0, F.lit("2026-02-01")).otherwise(F.lit("2025-12-01")).cast("date").alias("on_date"), F.col("o_totalprice").alias("estimated_value_inr"), F.lit(False).alias("is_mse"), (k % 6 == 0).alias("is_class1_local"),
        F.when(k % 9 != 0, 1.0 - (k % 31) / 100.0).alias("ratio"),
    )
    return rules.findings(rows).select("o_orderkey", F.explode("findings").alias("f")).select("o_orderkey", F.col("f.key").alias("key"))


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate) AS year FROM orders) SELECT CAST(year AS INTEGER) AS year, CASE WHEN year % 2 = 0 THEN 'https://example.org/' || year || '.zip' ELSE 'https://example.org/page' || year END AS url FROM y WHERE year >= 1995""")
def catalogue_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20: the yearly files from 1995 on of a catalogue with an entry for each year of the orders."""
    years = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")).distinct()
    link = lambda tail: F.concat(F.lit("https://example.org/"), F.col("y").cast("string"), F.lit(tail))
    rows = years.select(F.concat(F.lit("Notices "), F.col("y").cast("string")).alias("title"), F.when(F.col("y") % 2 == 0, F.array(link(".txt"), link(".zip"))).alias("download_url"), F.array(F.concat(F.lit("https://example.org/page"), F.col("y").cast("string"))).alias("access_url"))
    return bookkeeping.yearly_files(rows, 1995, 1990, 2030, "https://example.org/%s.zip")
