"""Queries of the relational operators over the tender view, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orefield.operators import search, upsert
from orefield.operators.search import TenderQuery
from orefield.sources.tables import AS_OF, TENDER_SQL, buyers, table, tenders

SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return keep


WITH = f"WITH {TENDER_SQL} "
AT = f"TIMESTAMP '{AS_OF}'"
WEEK = f"TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY"


def open_():
    return F.col("closes_at") > F.lit(AS_OF).cast("timestamp")


def soon():
    return open_() & (F.col("closes_at") <= F.expr(f"TIMESTAMP '{AS_OF}' + INTERVAL 7 DAYS"))


money = lambda c: F.sum(c).cast("double")

ASKED = TenderQuery(sector="BUILDING", source="ASIA", min_value=50_000, closes_after="1999-01-01", pin_prefix="14")


@query(WITH + "SELECT id, state, category, CAST(value_inr AS DOUBLE) AS value_inr, closes_at FROM tender WHERE sector = 'BUILDING' AND source = 'ASIA' AND value_inr >= 50000 AND closes_at >= TIMESTAMP '1999-01-01' AND pincode LIKE '14%'")
def filter_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-01, FLT-03."""
    return search.matching(tenders(spark, sf_dir), ASKED).select("id", "state", "category", F.col("value_inr").cast("double").alias("value_inr"), "closes_at")


@query(WITH + "SELECT state AS key, count(*) AS n FROM tender WHERE state <> '' GROUP BY state ORDER BY n DESC, key LIMIT 40")
def facet_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02."""
    return search.facet_terms(tenders(spark, sf_dir, closing=False), "state")


FACETED = TenderQuery(state="CHINA", sector="BUILDING", min_value=100_000)
_FACET = "SELECT '{f}' AS facet, {f} AS key, count(*) AS n FROM tender WHERE {c} GROUP BY {f}"
_BUCKET = "CASE WHEN value_inr < 100000 THEN 'under_1l' WHEN value_inr < 1000000 THEN '1l_10l' WHEN value_inr < 10000000 THEN '10l_1cr' ELSE 'over_1cr' END"


@query(WITH + " UNION ALL ".join([
    _FACET.format(f="state", c="sector = 'BUILDING' AND value_inr >= 100000"), _FACET.format(f="sector", c="state = 'CHINA' AND value_inr >= 100000"),
    _FACET.format(f="category", c="state = 'CHINA' AND sector = 'BUILDING' AND value_inr >= 100000"), _FACET.format(f="source", c="state = 'CHINA' AND sector = 'BUILDING' AND value_inr >= 100000"),
    f"SELECT 'value' AS facet, {_BUCKET} AS key, count(*) AS n FROM tender WHERE state = 'CHINA' AND sector = 'BUILDING' AND value_inr IS NOT NULL GROUP BY 2",
]))
def facets_disjunctive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03."""
    return search.disjunctive_facets(tenders(spark, sf_dir, closing=False), FACETED)


@query(WITH + """SELECT b.bucket, b.ord, CAST(count(t.id) AS BIGINT) AS n
FROM (VALUES ('under_1l', 0, NULL, 100000), ('1l_10l', 1, 100000, 1000000), ('10l_1cr', 2, 1000000, 10000000), ('over_1cr', 3, 10000000, NULL)) b(bucket, ord, lo, hi)
LEFT JOIN tender t ON t.value_inr IS NOT NULL AND (b.lo IS NULL OR t.value_inr >= b.lo) AND (b.hi IS NULL OR t.value_inr < b.hi) GROUP BY b.bucket, b.ord""")
def value_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-04."""
    return search.value_buckets(tenders(spark, sf_dir, closing=False))


@query(WITH + f"""SELECT count(*) AS total, count(*) FILTER (closes_at > {AT}) AS open, count(*) FILTER (closes_at > {AT} AND closes_at <= {WEEK}) AS closing_soon,
CAST(sum(value_inr) FILTER (closes_at > {AT}) AS DOUBLE) AS open_value, count(DISTINCT state) AS states, count(DISTINCT buyer_id) AS buyers FROM tender""")
def stats_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05, AGG-12, FLT-07."""
    return tenders(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(open_()).alias("open"), F.count_if(soon()).alias("closing_soon"),
        money(F.when(open_(), F.col("value_inr"))).alias("open_value"), F.count_distinct("state").alias("states"), F.count_distinct("buyer_id").alias("buyers"),
    )


@query(WITH + f"SELECT CASE WHEN state = '' OR state IS NULL THEN 'Unknown' ELSE state END AS state, count(*) AS n FROM tender WHERE closes_at > {AT} GROUP BY 1")
def stats_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05."""
    named = F.when(F.coalesce("state", F.lit("")) == "", "Unknown").otherwise(F.col("state"))
    return tenders(spark, sf_dir).where(open_()).groupBy(named.alias("state")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "state")


SECTORS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "SERVICES")


def _sector_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, k) for k, s in enumerate(SECTORS)], "sector string, ord int")


@query(WITH + f"""SELECT s.sector, s.ord, coalesce(o.open, 0) AS open, coalesce(o.closing_soon, 0) AS closing_soon, o.value_inr
FROM (VALUES {", ".join(f"('{s}', {k})" for k, s in enumerate(SECTORS))}) s(sector, ord) LEFT JOIN (
SELECT sector, count(*) AS open, count(*) FILTER (closes_at <= {WEEK}) AS closing_soon, CAST(sum(value_inr) AS DOUBLE) AS value_inr FROM tender WHERE closes_at > {AT} GROUP BY sector) o ON s.sector = o.sector""")
def sector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-06, JON-20."""
    counts = tenders(spark, sf_dir).where(open_()).groupBy("sector").agg(F.count(F.lit(1)).alias("open"), F.count_if(soon()).alias("closing_soon"), money("value_inr").alias("value_inr"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return _sector_registry(spark).join(counts, "sector", "left").select("sector", "ord", zero("open"), zero("closing_soon"), "value_inr")


@query(WITH + f"""SELECT m.state, m.open, m.closing_soon, m.value_inr, t.sector AS top_sector FROM (
SELECT state, count(*) AS open, count(*) FILTER (closes_at <= {WEEK}) AS closing_soon, CAST(sum(value_inr) AS DOUBLE) AS value_inr FROM tender WHERE closes_at > {AT} GROUP BY state) m
JOIN (SELECT state, sector FROM (SELECT state, sector, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, sector) AS k FROM tender WHERE closes_at > {AT} GROUP BY state, sector) WHERE k = 1) t ON m.state = t.state""")
def map_top_sector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-07, WIN-02: one aggregation by (state, sector), then the rest from its few rows."""
    cells = tenders(spark, sf_dir).where(open_()).groupBy("state", "sector").agg(F.count(F.lit(1)).alias("n"), F.count_if(soon()).alias("soon"), F.sum("value_inr").alias("v"))
    best = F.min(F.struct(-F.col("n"), "sector"))["sector"]
    return cells.groupBy("state").agg(F.sum("n").alias("open"), F.sum("soon").alias("closing_soon"), money("v").alias("value_inr"), best.alias("top_sector"))


@query(WITH + f"""SELECT c_custkey AS buyer_id, c_name AS buyer, count(t.id) AS tenders, count(t.id) FILTER (t.closes_at > {AT}) AS open, CAST(sum(t.value_inr) AS DOUBLE) AS total_value
FROM customer LEFT JOIN tender t ON t.buyer_id = c_custkey GROUP BY c_custkey, c_name""")
def buyer_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08, JON-01: summed per buyer before the join, so no alias or tender multiplies a sum."""
    sums = tenders(spark, sf_dir).groupBy("buyer_id").agg(F.count(F.lit(1)).alias("tenders"), F.count_if(open_()).alias("open"), money("value_inr").alias("total_value"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return buyers(spark, sf_dir).select("buyer_id", "buyer").join(sums, "buyer_id", "left").select("buyer_id", "buyer", zero("tenders"), zero("open"), "total_value")


@query(WITH + """SELECT buyer, sector AS home, total FROM (SELECT sector AS buyer, state AS sector, count(*) AS n, sum(count(*)) OVER (PARTITION BY sector) AS total,
row_number() OVER (PARTITION BY sector ORDER BY count(*) DESC, state) AS k FROM tender GROUP BY sector, state) WHERE k = 1""")
def home_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-13, here of sectors: where most of their tenders are, ties by name, and how many they have in all."""
    cells = tenders(spark, sf_dir, closing=False).groupBy(F.col("sector").alias("buyer"), "state").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(-F.col("n"), F.col("state").alias("home")))["home"]
    return cells.groupBy("buyer").agg(best.alias("home"), F.sum("n").alias("total")).orderBy(F.desc("total"), "buyer")


STATUSES = ("F", "O", "P", "W")


@query(WITH + f"""SELECT s.status, count(t.id) AS n, CAST(coalesce(sum(coalesce(CASE WHEN t.id % 3 = 0 THEN CAST(t.value_inr * 0.9 AS DECIMAL(18,2)) END, t.value_inr)) FILTER (s.status IN ('O', 'P')), 0) AS DOUBLE) AS pipeline_value
FROM (VALUES {", ".join(f"('{s}')" for s in STATUSES)}) s(status) LEFT JOIN tender t ON t.status = s.status GROUP BY s.status""")
def pipeline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-09, AGG-10: a histogram of all statuses, zeros included, and the value of the live ones (own bid, else tender value)."""
    bid = F.when(F.col("id") % 3 == 0, (F.col("value_inr") * F.lit("0.9").cast("decimal(2,1)")).cast("decimal(18,2)"))
    sums = tenders(spark, sf_dir, closing=False).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(bid, F.col("value_inr"))).alias("v"))
    registry = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    live = F.when(F.col("status").isin("O", "P"), F.col("v"))
    return registry.join(sums, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(live, F.lit(0)).cast("double").alias("pipeline_value"))


@query("SELECT event_type AS source, event_id, ts, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC NULLS FIRST, event_id DESC) = 1")
def latest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-01, AGG-24: by an aggregate that keeps one row per source in each task, not a window over all its rows."""
    events = table(spark, sf_dir, "events")
    best = F.max(F.struct(F.col("ts").isNull().alias("unknown"), "ts", "event_id", "user_id"))
    return events.groupBy(F.col("event_type").alias("source")).agg(best.alias("b")).select("source", "b.event_id", "b.ts", "b.user_id")


TRACKED = "id % 7 = 0"


@query(WITH + f"""SELECT id, state, sector, CAST(value_inr AS DOUBLE) AS value_inr FROM tender WHERE closes_at > {AT} AND sector IN ('BUILDING', 'MACHINERY') AND state IN ('INDIA', 'CHINA', 'JAPAN')
AND (value_inr IS NULL OR value_inr <= 200000) AND NOT EXISTS (SELECT 1 FROM tender k WHERE k.id = tender.id AND k.{TRACKED})""")
def recommend_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-03, FLT-06, FLT-09, RUL-06: open tenders for a profile, unknown values included, tracked ones left out."""
    from orefield.operators.rules import recommended

    all_of = tenders(spark, sf_dir)
    tracked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).where(TRACKED)
    return recommended(all_of, tracked, AS_OF, states=["INDIA", "CHINA", "JAPAN"], sectors=["BUILDING", "MACHINERY"], cap=200_000).select("id", "state", "sector", F.col("value_inr").cast("double").alias("value_inr"))


@query("""SELECT event_id, user_id, ts FROM events e WHERE ts > TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' AND event_type = 'purchase'
AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id = e.event_id AND d.event_id % 5 = 0)""")
def undelivered_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-04, FLT-08: matches in the half-open window that no delivery is logged for."""
    events = table(spark, sf_dir, "events")
    at = lambda s: F.lit(s).cast("timestamp")
    due = events.where((F.col("ts") > at("2024-01-10")) & (F.col("ts") <= at("2024-01-20")) & (F.col("event_type") == "purchase"))
    return due.join(events.where("event_id % 5 = 0").select("event_id"), "event_id", "left_anti").select("event_id", "user_id", "ts")


@query(WITH + "SELECT id, CAST(value_inr AS DOUBLE) AS value_inr, closes_at FROM tender ORDER BY value_inr DESC NULLS LAST, closes_at NULLS LAST, id LIMIT 25")
def topk_value_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-01, SRT-05."""
    return search.page(tenders(spark, sf_dir), 1, 25, "value").select("id", F.col("value_inr").cast("double").alias("value_inr"), "closes_at")


@query(WITH + "SELECT id, closes_at FROM tender ORDER BY closes_at NULLS LAST, id LIMIT 20 OFFSET 40")
def page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-03."""
    return search.page(tenders(spark, sf_dir), 3, 20).select("id", "closes_at")


@query(WITH + "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS last_page FROM tender")
def page_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01."""
    return search.page_count(tenders(spark, sf_dir, closing=False), 20)


@query(WITH + """SELECT error, count(*) AS n FROM (SELECT CASE WHEN published_at IS NULL OR closes_at IS NULL THEN 'required' WHEN closes_at < published_at THEN 'closes before it is published' ELSE 'valid' END AS error FROM tender) GROUP BY error""")
def validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10, SNK-03."""
    marked = tenders(spark, sf_dir).withColumn("errors", upsert.tender_errors())
    first = F.when(F.size("errors") == 0, "valid").otherwise(F.col("errors")[0]["error"])
    return marked.groupBy(first.alias("error")).agg(F.count(F.lit(1)).alias("n"))


_VERSIONS = """SELECT l_orderkey, l_linenumber, l_shipdate AS fetched_at, l_quantity AS quantity, l_extendedprice AS price, md5(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '|' || l_returnflag) AS content_hash, l_suppkey, l_partkey FROM lineitem"""
_PICK = "SELECT * FROM v WHERE {c} QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY fetched_at DESC, price DESC, l_suppkey DESC, l_partkey DESC) = 1"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.md5(F.concat_ws("|", F.col("l_quantity").cast("long").cast("string"), "l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").alias("fetched_at"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), made.alias("content_hash"), "l_suppkey", "l_partkey")


KEYS = ["l_orderkey", "l_linenumber"]
ORDER = ["fetched_at", "price", "l_suppkey", "l_partkey"]


@query(f"""WITH v AS ({_VERSIONS}), s AS ({_PICK.format(c="l_suppkey % 2 = 0")}), b AS ({_PICK.format(c="l_suppkey % 2 = 1")})
SELECT coalesce(s.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(s.l_linenumber, b.l_linenumber) AS l_linenumber,
CASE WHEN b.fetched_at IS NULL THEN NULL WHEN s.fetched_at IS NULL THEN 'new' WHEN s.content_hash <> b.content_hash AND s.fetched_at <= b.fetched_at THEN 'updated' ELSE 'unchanged' END AS outcome,
CASE WHEN s.fetched_at IS NULL OR (s.content_hash <> b.content_hash AND s.fetched_at <= b.fetched_at) THEN b.quantity ELSE s.quantity END AS quantity,
coalesce(s.fetched_at, b.fetched_at) AS first_seen, greatest(coalesce(s.fetched_at, b.fetched_at), coalesce(b.fetched_at, s.fetched_at)) AS last_seen
FROM s FULL JOIN b ON s.l_orderkey = b.l_orderkey AND s.l_linenumber = b.l_linenumber""")
def upsert_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-01, STM-02, JON-15: a snapshot and a batch, one shuffle on the key each."""
    versions = _versions(spark, sf_dir)
    stored = upsert.last_wins(versions.where("l_suppkey % 2 = 0"), KEYS, ORDER).withColumns({"first_seen": F.col("fetched_at"), "last_seen": F.col("fetched_at")})
    batch = upsert.last_wins(versions.where("l_suppkey % 2 = 1"), KEYS, ORDER)
    return upsert.upsert(stored, batch, KEYS).select(*KEYS, "outcome", "quantity", "first_seen", "last_seen")


@query(f"WITH v AS ({_VERSIONS}) SELECT l_orderkey, l_linenumber, fetched_at, quantity, price FROM ({_PICK.format(c='true')})")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02: one aggregate per key, no window."""
    return upsert.last_wins(_versions(spark, sf_dir), KEYS, ORDER).select(*KEYS, "fetched_at", "quantity", "price")


@query("""SELECT user_id AS run_id, count(*) AS planned, count(*) FILTER (event_type = 'view') AS new, count(*) FILTER (event_type = 'click') AS updated, count(*) FILTER (event_type = 'scroll') AS unchanged,
CASE WHEN count(*) FILTER (event_type IN ('view', 'click', 'scroll')) < count(*) THEN 'incomplete' ELSE 'ok' END AS status FROM events GROUP BY user_id""")
def reconcile_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-11."""
    named = F.create_map(*[F.lit(x) for x in ("view", "new", "click", "updated", "scroll", "unchanged")])
    outcomes = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), named[F.col("event_type")].alias("outcome"))
    return upsert.reconcile(outcomes).select("run_id", "planned", "new", "updated", "unchanged", "status")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (ts > TIMESTAMP '2024-01-29') AS last_day FROM events GROUP BY event_type")
def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") > F.lit("2024-01-29").cast("timestamp")).alias("last_day"))


@query("""SELECT CAST(user_id AS BIGINT) AS user_id, month, units, sum(units) OVER (PARTITION BY user_id ORDER BY month) AS running FROM (
SELECT user_id, strftime(ts, '%Y-%m-%d') AS month, count(*) AS units FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)""")
def quota_metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22: usage per user and period, and its running sum."""
    used = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("month")).agg(F.count(F.lit(1)).alias("units"))
    return used.withColumn("running", F.sum("units").over(W.partitionBy("user_id").orderBy("month")))


@query("SELECT lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS folded, count(DISTINCT source) AS sources, count(*) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_source_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-29."""
    folded = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    rows = table(spark, sf_dir, "documents").select(folded.alias("folded"), "source").withColumn("digest", F.sha2("folded", 256))
    # digests are counted without texts; then only the texts of those that several sources have are brought together
    seen = rows.groupBy("digest").agg(F.count_distinct("source").alias("sources"), F.count(F.lit(1)).alias("n")).where("sources > 1")
    return rows.select("digest", "folded").join(seen, "digest").groupBy("digest").agg(F.first("folded").alias("folded"), F.first("sources").alias("sources"), F.first("n").alias("n")).drop("digest")


@query("""SELECT o.o_custkey AS buyer_id, list_sort(list(DISTINCT l_suppkey)) AS suppliers FROM orders o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o.o_custkey""")
def awards_by_buyer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-17, JON-19: one-to-many lists in order."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("buyer_id")).agg(F.sort_array(F.collect_set("l_suppkey")).alias("suppliers"))


@query("""SELECT doc_id, coalesce(n, 0) AS n_facts FROM documents LEFT JOIN (SELECT doc_id AS d, count(*) AS n FROM labels GROUP BY doc_id) ON doc_id = d""")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left outer count."""
    n = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "documents").select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_facts"))


@query(WITH + f"""SELECT buyer_id, CAST(count(*) AS BIGINT) AS n, list(id ORDER BY closes_at, id) AS ids FROM tender WHERE closes_at > {AT} AND closes_at <= {WEEK} GROUP BY buyer_id""")
def reminder_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-30, STM-06: what closes within the week, batched per buyer in order of closing."""
    due = tenders(spark, sf_dir).where(soon())
    listed = F.transform(F.sort_array(F.collect_list(F.struct("closes_at", "id"))), lambda x: x["id"])
    return due.groupBy("buyer_id").agg(F.count(F.lit(1)).alias("n"), listed.alias("ids"))


@query("""SELECT CAST(part.p_size AS BIGINT) AS size, count(*) AS n, CAST(sum(p_retailprice) AS DOUBLE) AS total FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 70) GROUP BY part.p_size""".replace("CAST(sum(p_retailprice) AS DOUBLE)", "CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE)"))
def semi_join_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-06, AGG-17: rows whose key is frequent, by a semi join."""
    part = table(spark, sf_dir, "part")
    frequent = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).where("n > 70").select("p_brand")
    return part.join(frequent, "p_brand", "left_semi").groupBy(F.col("p_size").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"), money(F.col("p_retailprice").cast("decimal(18,2)")).alias("total"))


@query("""SELECT k AS ref FROM (SELECT l_suppkey AS k FROM lineitem UNION SELECT l_partkey FROM lineitem UNION SELECT o_custkey FROM orders)""")
def feed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-02: keys that any of three feeds has."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_suppkey").alias("ref")).union(line.select("l_partkey")).union(table(spark, sf_dir, "orders").select("o_custkey")).distinct()


@query("""SELECT coalesce(a.k, b.k, c.k) AS ref, coalesce(a.n, 0) AS notices, coalesce(b.n, 0) AS payments, coalesce(c.n, 0) AS plans FROM
(SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) a FULL JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) b ON a.k = b.k
FULL JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) c ON coalesce(a.k, b.k) = c.k""")
def feed_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-09: three feeds merged on their key, each summed up first."""
    line = table(spark, sf_dir, "lineitem")
    count = lambda df, k, n: df.groupBy(F.col(k).alias("ref")).agg(F.count(F.lit(1)).alias(n))
    a, b, c = count(line.where("l_returnflag = 'R'"), "l_suppkey", "notices"), count(line.where("l_returnflag = 'A'"), "l_partkey", "payments"), count(table(spark, sf_dir, "orders"), "o_custkey", "plans")
    return a.join(b, "ref", "full").join(c, "ref", "full").na.fill(0)


@query("SELECT k.n_name AS state, count(*) AS n FROM customer JOIN nation k ON c_nationkey = n_nationkey WHERE upper(k.n_name) = upper('india') GROUP BY 1")
def exact_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04: equality without regard to case."""
    nation = table(spark, sf_dir, "nation").where(F.upper("n_name") == F.upper(F.lit("india")))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id, event_id, status FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'entitled' ELSE 'free' END AS status FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (status = 'entitled') DESC, ts DESC, event_id DESC) = 1""")
def current_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-07: the newest entitled event of a user, else the newest."""
    entitled = F.col("event_type") == "purchase"
    best = F.max(F.struct(entitled.alias("e"), "ts", "event_id"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", F.when(F.col("b.e"), "entitled").otherwise("free").alias("status"))
