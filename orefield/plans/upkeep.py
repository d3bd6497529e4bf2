"""Queries of work over what is stored, and of requests, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.operators import intake, upkeep
from orefield.operators.bucketed import BucketedTable
from orefield.plans.awards import INDEX
from orefield.plans.awards import SQL as AWARDS_SQL
from orefield.plans.text import CATEGORIES, PHRASES, PRODUCTS, _cascade_sql
from orefield.sources import pages as portal
from orefield.sources.tables import awards, table
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


@query(AWARDS_SQL["deflate_real"])
def prices_restated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-15: a table's real amounts after its index got a later year: first stated without that, then anew."""
    # dealt out by all that tells a row from another, then counted where it is: nearly no row has a copy
    own = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "award_value", "award_date"]
    once = awards(spark, sf_dir).select(*own, "year").repartition(*own).groupBy(*own, "year").agg(F.count(F.lit(1)).alias("copies"))
    code = F.element_at(F.array(F.lit("INR"), F.lit("USD"), F.lit("EUR")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    once = once.withColumns({"currency": code, "country": F.lit("FR"), "inr_real": F.lit(None).cast("double")})
    kept = BucketedTable(spark, scratch(spark, "awards"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in once.schema), own, 16)
    kept.upsert(once)
    index = spark.createDataFrame(INDEX, "series string, country string, year int, value double")
    upkeep.restate(kept, index.where("year < 1999"), 1999)
    upkeep.restate(kept, index, 2002)
    found = kept.read().withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "currency", F.round("inr_real", 0).alias("inr_real"))


@query(f"""WITH t AS (SELECT p_partkey, p_name || ' ' || {PHRASES!r}[p_partkey % {len(PHRASES)} + 1] AS title, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE {PRODUCTS!r}[p_partkey % {len(PRODUCTS)} + 1] END AS product, {CATEGORIES!r}[p_partkey % {len(CATEGORIES)} + 1] AS category FROM part)
SELECT p_partkey, {_cascade_sql()} AS sector FROM t""")
def sectors_reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-16: a table's sectors after its rules have changed."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("p_partkey") % len(values) + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.concat_ws(" ", "p_name", pick(PHRASES)).alias("title"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(pick(PRODUCTS)).alias("product_category"), pick(CATEGORIES).alias("category"), F.lit("other").alias("sector"))
    kept = BucketedTable(spark, scratch(spark, "sectors"), "p_partkey long, title string, product_category string, category string, sector string", ["p_partkey"], 8)
    kept.upsert(rows)
    upkeep.reclassify(kept)
    return kept.read().select("p_partkey", "sector")


@query("""WITH p AS (SELECT user_id, event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'), l AS (SELECT user_id, max(struct_pack(t := ts, e := event_id, k := event_type)) AS b FROM p GROUP BY user_id),
s AS (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0)
SELECT coalesce(l.user_id, s.user_id) AS user_id, CASE WHEN s.user_id % 2 = 0 THEN 'later' WHEN l.b IS NULL THEN 'before' ELSE l.b.k END AS kind FROM l FULL JOIN s ON l.user_id = s.user_id""")
def pages_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-05, SNK-02: pages of ten days replayed over a table, of which some rows come from later pages."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("user_id"), F.col("ts").cast("timestamp").alias("fetched_at"), F.col("event_id").cast("long").alias("page_id"), F.col("event_type").alias("kind"))
    kept = BucketedTable(spark, scratch(spark, "pages"), "user_id long, fetched_at timestamp, page_id long, kind string", ["user_id"], 8)
    u = F.col("user_id")
    there = events.select("user_id").distinct().where("user_id % 3 = 0")
    kept.upsert(there.select("user_id", F.when(u % 2 == 0, F.lit("2030-01-01")).otherwise(F.lit("2000-01-01")).cast("timestamp").alias("fetched_at"), F.lit(0).cast("long").alias("page_id"), F.when(u % 2 == 0, "later").otherwise("before").alias("kind")))
    upkeep.replay(kept, events, "2024-01-10", "2024-01-20")
    return kept.read().select("user_id", "kind")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'REF/' || o_orderkey || ' · ' ELSE '' END || 'Construction of road no ' || o_orderkey END AS context FROM orders""")
def chunks_reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-06, DOC-04: contexts of chunks made anew from stored pages, some linked to a tender since; without pages they stay."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    chunks = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("doc_id"), F.lit("2. EMD").alias("heading"), F.lit("2. EMD\nRs. 5").alias("text"), F.lit("old").alias("context"))
    pages = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("Name of work: Construction of road no "), k).alias("text"))
    linked = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("").alias("title"), F.concat(F.lit("REF/"), k).alias("reference"), F.lit("").alias("buyer"))
    return upkeep.reindex(chunks, pages, linked, size=8).select("id", "context")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN ['works', 'goods', 'services', 'consultancy'][o_orderkey // 4 % 4 + 1] ELSE ['services', 'consultancy', 'works', 'goods', 'services', '', 'works'][o_orderkey % 7 + 1] END AS category FROM orders""")
def categories_hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-10: a contract's category by its reference, else by the first label that tells one."""
    k = F.col("o_orderkey")
    code = F.element_at(F.array(*map(F.lit, ("CW", "GO", "NC", "CS"))), (F.floor(k / 4) % 4 + 1).cast("int"))
    ref = F.when(k % 4 == 0, F.concat(F.lit("in-x-"), k.cast("string"), F.lit("-"), code, F.lit("-rfb"))).otherwise("Package 1")
    label = F.element_at(F.array(*map(F.lit, ("Non-consulting services", "Consultant", "Civil WORKS", " go ", "Other services", "", "unknown"))), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", upkeep.category_of(ref, F.lit(None).cast("string"), label, F.when(k % 7 == 6, "cw")).alias("category"))


@query("""SELECT o_orderkey, ['', 'pin: not a PIN prefix; sort: not an ordering', 'max_value: not an amount; min_value: not an amount', 'buyer: not a whole number from 1 on; page_size: not a whole number from 1 to 100', 'closes_before: not a time; state: empty', 'q: more than 200 characters'][o_orderkey % 6 + 1] AS errors FROM orders""")
def requests_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-02: what is wrong with the parameters of requests."""
    k = F.col("o_orderkey")
    asked = {
        "q": F.when(k % 6 == 5, F.repeat(F.lit("x"), 201)).otherwise(k.cast("string")), "pin": F.when(k % 6 == 1, "012").otherwise("11"), "sort": F.when(k % 6 == 1, "oldest").otherwise("value"), "min_value": F.when(k % 6 == 2, "-1").otherwise("10.50"), "max_value": F.when(k % 6 == 2, "1.234").otherwise(F.floor("o_totalprice").cast("string")),
        "buyer": F.when(k % 6 == 3, "0").otherwise(F.when(k > 0, k.cast("string"))), "page": F.lit("1"), "page_size": F.when(k % 6 == 3, "101").otherwise("100"), "closes_before": F.when(k % 6 == 4, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), "state": F.when(k % 6 == 4, " "),
    }
    given = F.map_from_arrays(F.array(*map(F.lit, asked)), F.array(*asked.values()))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(upkeep.request_errors(given), lambda e: F.concat(e["parameter"], F.lit(": "), e["error"])), "; ").alias("errors"))


@query("""WITH r AS (SELECT event_id AS run_id, event_id % 9 AS expected, event_id % 9 + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END AS listed, event_id % 3 AS pending, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS failed, event_id % 9 AS done, event_id % 2 = 0 AS force FROM events),
p AS (SELECT *, list_filter([CASE WHEN expected <> listed THEN 'index claims ' || expected || ' tenders, listings show ' || listed END, CASE WHEN pending > 0 THEN pending || ' tenders never finished' END, CASE WHEN failed > 0 THEN failed || ' tenders dead-lettered' END], lambda x: x IS NOT NULL) AS problems FROM r)
SELECT run_id, CASE WHEN force AND pending > 0 THEN 'incomplete' WHEN len(problems) > 0 THEN 'mismatch' ELSE 'succeeded' END AS status, CASE WHEN run_id % 7 <> 0 THEN expected END AS expected, CASE WHEN run_id % 7 <> 0 THEN done + failed END AS accounted, CASE WHEN run_id % 7 <> 0 THEN problems ELSE [] END AS problems FROM p""")
def runs_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-02, AGG-11: runs' accounts written as JSON and read again; a run without one has no problems."""
    k = F.col("event_id")
    runs = table(spark, sf_dir, "events").select(
        k.alias("run_id"), (k % 9).alias("expected"), (k % 9 + (k % 4 == 0).cast("int")).alias("listed"), (k % 3).alias("pending"), F.when(k % 5 == 0, 2).otherwise(0).alias("failed"), (k % 9).alias("done"), (k % 2 == 0).alias("force")
    )
    made = upkeep.reconciled(runs).select("run_id", "status", F.when(F.col("run_id") % 7 != 0, F.col("reconciliation")).alias("reconciliation"))
    return upkeep.run_summary(made)


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'stale session' WHEN 1 THEN 'not a detail page' END AS error, CASE WHEN o_orderkey % 3 = 2 THEN '2024_A_' || o_orderkey || '_1' END AS tender_id FROM orders")
def pages_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06, SRC-07: fetched pages that can be read, and why the others can't."""
    k = F.col("o_orderkey")
    caption = F.when(k % 3 == 2, "Tender ID").otherwise("Anything")
    html = F.concat(F.lit("<table><tr><td class='td_caption'>"), caption, F.lit("</td><td class='td_field'>2024_A_"), k.cast("string"), F.lit("_1</td></tr></table>"), F.when(k % 3 == 0, "<b>Stale Session</b> Your session has timed out").otherwise(""))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), html.alias("html")).withColumn("d", portal.detail_of("html"))
    return rows.select("id", intake.page_error(F.col("html"), F.col("d")).alias("error"), F.col("d")["tender_id"].alias("tender_id"))
