"""Queries of scalars, searches, alerts, bookkeeping and feeds, over values made from the tables, with their SQL twins.

The SQL says what the values are by how they were made, or works them out by other means than the operators do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.functions import scalars
from orefield.operators import answers, bank, bookkeeping, contracts, documents, entities, exports, fulltext, notices, rules, search
from orefield.sources import awards
from orefield.sources import pages as portal
from orefield.sources.tables import AS_OF, TENDER_SQL, table, tenders
from orefield.streaming import incremental

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


def pick(k: Column, values: list) -> Column:
    return F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))


def text(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """Some columns of a table, whose small file is one split, dealt out before texts are made of them and searched; to
    more tasks than cores, so that none waits long for the last one."""
    return table(spark, sf_dir, name).select(key, *columns).repartition(4 * spark.sparkContext.defaultParallelism, key)


# ---- scalars ----------------------------------------------------------------------------------------------------------

RUPEES = "CAST(floor(o_totalprice) AS BIGINT)"


@query(f"""SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN {RUPEES} WHEN 1 THEN {RUPEES} + 0.5 WHEN 2 THEN {RUPEES} END AS DOUBLE) AS inr,
CASE WHEN o_orderkey % 6 = 4 THEN 'not a money amount' END AS error,
CAST(CASE o_orderkey % 4 WHEN 0 THEN ({RUPEES} % 900 + 1) * 10000000 WHEN 1 THEN ({RUPEES} % 900 + 1) * 100000 WHEN 2 THEN {RUPEES} % 900 + 1 END AS DOUBLE) AS amount FROM orders""")
def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-01, NUM-02."""
    rupees, k = F.floor("o_totalprice").cast("long"), F.col("o_orderkey")
    small = (rupees % 900 + 1).cast("string")
    grouped = F.when(rupees >= 1000, F.concat((rupees / 1000).cast("long").cast("string"), F.lit(","), F.lpad((rupees % 1000).cast("string"), 3, "0"))).otherwise(text(rupees))
    said = pick(k, [F.concat(F.lit("Rs. "), text(rupees), F.lit("/-")), F.concat(F.lit("₹ "), text(rupees), F.lit(".50")), grouped, F.lit("NA"), F.concat(text(rupees), F.lit(" only")), F.lit(" ")])
    amount = pick(k, [F.concat(small, F.lit(" Cr")), F.concat(F.lit("about "), small, F.lit(" lakhs")), F.concat(small, F.lit(".00")), F.lit("0.00")])
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.parse_inr(said).cast("double").alias("inr"), scalars.parse_inr_error(said).alias("error"), scalars.parse_amount(amount).cast("double").alias("amount"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) - INTERVAL 330 MINUTE + CASE o_orderkey % 4 WHEN 0 THEN INTERVAL 897 MINUTE WHEN 1 THEN INTERVAL 545 MINUTE ELSE INTERVAL 0 MINUTE END END AS portal_time,
CAST(o_orderdate AS DATE) AS award_date, CASE WHEN year(o_orderdate) >= 1995 THEN CAST(o_orderdate AS DATE) END AS dmy,
strftime(CAST(o_orderdate AS TIMESTAMP), '%Y-%m') AS month FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) AS o_orderdate FROM orders)""")
def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-01, DAT-02, DAT-03, DAT-06."""
    k, day = F.col("o_orderkey"), F.date_trunc("day", "o_orderdate")
    said = pick(k, [F.concat(F.upper(F.date_format(day, "dd-MMM-yyyy")), F.lit(" 02:57 pm")), F.concat(F.date_format(day, "dd-MMM-yyyy"), F.lit(" 09:05")), F.date_format(day, "dd-MMM-yyyy"), F.lit("31-Foo-2026 04:00 PM")])
    award = pick(k, [F.date_format(day, "dd/MM/yyyy"), F.upper(F.date_format(day, "dd-MMM-yyyy")), F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd-MMM-yyyy")])
    dmy = F.concat_ws("-", F.dayofmonth(day), F.month(day), F.year(day))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", scalars.parse_portal_time(said).alias("portal_time"), scalars.parse_award_date(award).alias("award_date"), scalars.day_month_year(dmy, "1995-01-01", "2030-12-31").alias("dmy"), scalars.month_in_india(day).alias("month"),
    )


@query("""SELECT p_partkey, p_name || ' ' || p_brand AS cleaned, p_name || ' || ' || p_brand AS buyer, p_partkey % 3 = 0 AS is_blank, CASE p_partkey % 3 WHEN 1 THEN '''=' || p_name WHEN 2 THEN p_name ELSE '''-' || p_name END AS cell FROM part""")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01 to STR-03, STR-16."""
    k = F.col("p_partkey")
    said = F.concat(F.lit(" \n"), F.col("p_name"), F.lit(" \t"), F.col("p_brand"), F.lit(" "))
    chain = F.concat(F.lit("|| "), F.col("p_name"), F.lit("|| ||"), F.col("p_brand"), F.lit("||x||y"))
    cell = pick(k, [F.concat(F.lit("-"), F.col("p_name")), F.concat(F.lit("="), F.col("p_name")), F.col("p_name")])
    return table(spark, sf_dir, "part").select("p_partkey", scalars.clean(said).alias("cleaned"), scalars.buyer_from_chain(chain).alias("buyer"), scalars.blank(pick(k, ["N/A", "x", "na na"])).alias("is_blank"), scalars.safe_cell(cell).alias("cell"))


CODES = ["45233140-2", "45232000", "45310000-3", "45111200", "904", "79710000", "72000000-5", "33600000", "38000000", "34110000", "50000000", "15000000", "98000000", "", "abc", "65310000"]
CODE_SECTORS = ["roads", "water", "electrical", "buildings", "water", "security", "it", "health", "lab", "transport", "facility", "supplies", "", "", "", "electrical"]
PINS = {"11": "Delhi", "49": "Chhattisgarh", "16": "Punjab", "1600": "Chandigarh", "403": "Goa", "40": "Maharashtra"}
PIN_TEXTS = ["110001", "490006", "160017", "140301", "403001", "400001", "012345", "49000", " 110092 ", ""]
PIN_STATES = ["Delhi", "Chhattisgarh", "Chandigarh", "", "Goa", "Maharashtra", "", "", "Delhi", ""]


@query(f"SELECT p_partkey, {CODE_SECTORS!r}[p_partkey % {len(CODES)} + 1] AS sector, {PIN_STATES!r}[p_partkey % {len(PIN_TEXTS)} + 1] AS state FROM part")
def coded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06, STR-08."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", scalars.cpv_sector(pick(k, CODES)).alias("sector"), scalars.pincode_state(pick(k, PIN_TEXTS), PINS).alias("state"))


@query("""WITH c AS (SELECT c_custkey, CAST(c_custkey * c_custkey * 37 AS BIGINT) AS m FROM customer), v AS (SELECT c_custkey, CASE WHEN m >= 10000000 THEN m // 100000 * 100000 WHEN m >= 100000 THEN m // 1000 * 1000 ELSE m END AS n FROM c)
SELECT c_custkey, CASE WHEN n >= 10000000 THEN '₹' || printf('%.2f', n / 1e7) || ' Cr' WHEN n >= 100000 THEN '₹' || printf('%.2f', n / 1e5) || ' L' WHEN n >= 1000 THEN '₹' || (n // 1000) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') ELSE '₹' || n END AS shown,
CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) WHEN n < 100000 THEN (n // 1000) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') WHEN n < 10000000 THEN (n // 100000) || ',' || lpad(CAST(n // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0')
ELSE (n // 10000000) || ',' || lpad(CAST(n // 100000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(n // 1000 % 100 AS VARCHAR), 2, '0') || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0') END AS grouped FROM v WHERE n < 1000000000""")
def money_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-15: amounts in lakhs, crores and Indian groups; amounts of two decimals, which need no rounding."""
    m = F.col("c_custkey") * F.col("c_custkey") * 37
    n = F.when(m >= 10_000_000, m - m % 100_000).when(m >= 100_000, m - m % 1000).otherwise(m)
    return table(spark, sf_dir, "customer").select("c_custkey", n.alias("n")).where("n < 1000000000").select("c_custkey", scalars.format_inr(F.col("n")).alias("shown"), scalars.indian_grouping(F.col("n")).alias("grouped"))


@query("""SELECT c_custkey, list_sort(list_distinct([c_custkey % 9 + 1, c_custkey % 5 + 3, c_custkey % 5 + 4])) AS cites, CAST(CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1 END AS INTEGER) AS has_bids,
CAST(least(1.0, greatest(0.0, (c_custkey % 40 - 10) / 20.0)) AS DOUBLE) AS used FROM customer""")
def lists_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-01, STR-14, STR-18: citations, bids in order, how much of the time for bids is over."""
    k = F.col("c_custkey")
    said = F.concat(F.lit("so it is ["), text(k % 9 + 1), F.lit(", "), text(k % 5 + 3), F.lit("-"), text(k % 5 + 4), F.lit("]."))
    bids = F.when(k % 7 == 0, F.array(F.lit(0.0), F.lit(-3.0))).otherwise(F.array(k.cast("double"), F.lit(0.0)))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hours = lambda n: F.timestamp_seconds(F.unix_timestamp(start) + n * 3600)
    used = scalars.window_used(start, hours(F.lit(20)), hours(k % 40 - 10))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_sort(F.transform(scalars.cited_numbers(said), lambda x: x.cast("long"))).alias("cites"), F.size(scalars.sorted_bids(bids)).alias("n"), used.alias("used")).select("c_custkey", "cites", F.when(F.col("n") > 0, F.col("n")).alias("has_bids"), "used")


# ---- searches and alerts ----------------------------------------------------------------------------------------------

TITLES = ["Construction of rural roads", "Supply of hospital beds", "Repair of the water pump", "Road marking and signs", "Laying of sewer pipes", "Widening of road bridge at river", "Security guards for hospital", "Pumps, pipes & valves"]


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tenders with a title each, a reference, and who buys them where."""
    t = tenders(spark, sf_dir)
    return t.select("id", pick(F.col("id"), TITLES).alias("title"), F.concat(F.lit("REF/"), text("id")).alias("reference"), F.regexp_replace("buyer", "#", " ").alias("buyer"), F.col("state").alias("place"), "state", "pincode", "sector", "value_inr", "closes_at")


TITLED_SQL = f"{TENDER_SQL}, titled AS (SELECT *, {TITLES!r}[id % {len(TITLES)} + 1] AS title FROM tender)"


def known_words(rows: DataFrame) -> DataFrame:
    return fulltext.vocabulary(rows, "title", "id")


@query(f"WITH {TITLED_SQL} SELECT id, false AS exact, CAST(CASE WHEN regexp_matches(title, '(?i)road') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(title, '(?i)bridge') THEN 1 ELSE 0 END AS INTEGER) AS n_terms FROM titled WHERE regexp_matches(title, '(?i)\\broad') AND regexp_matches(title, '(?i)\\bbridge')")
def search_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-01 to FTS-04, FTS-07: both words are there, so the text is taken as it is."""
    rows = titled(spark, sf_dir)
    return fulltext.staged_search(rows, "roads bridges", known_words(rows)).select("id", "exact", "n_terms")


@query(f"WITH {TITLED_SQL} SELECT id, false AS exact, CAST(2 AS INTEGER) AS n_terms FROM titled WHERE regexp_matches(title, '(?i)\\bhospital') AND regexp_matches(title, '(?i)\\bbeds?\\b')")
def search_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-07, FTS-08: a misspelt word is corrected where nothing is found otherwise."""
    rows = titled(spark, sf_dir)
    return fulltext.staged_search(rows, "hospitl beds", known_words(rows)).select("id", "exact", "n_terms")


@query(f"WITH {TITLED_SQL} SELECT id, false AS exact, CAST(1 AS INTEGER) AS n_terms FROM titled WHERE regexp_matches(title, '(?i)\\b(bridge|sewer)')")
def search_any_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-07: no title has both words, so either is enough."""
    rows = titled(spark, sf_dir)
    return fulltext.staged_search(rows, "bridge sewer", known_words(rows)).select("id", "exact", "n_terms")


@query(f"WITH {TITLED_SQL} SELECT id, true AS exact FROM titled WHERE id = 7")
def search_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-04, FTS-06: an identifier as the text, whatever the case, comes first."""
    rows = titled(spark, sf_dir)
    return fulltext.staged_search(rows, '"ref/7"', known_words(rows)).where("exact").select("id", "exact")


@query(f"WITH {TITLED_SQL} SELECT id, CAST(row_number() OVER (ORDER BY title = 'Road marking and signs' DESC, id) AS INTEGER) AS place FROM titled WHERE title = 'Road marking and signs'")
def search_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-12, SRT-02: all results in search order, without pages; the order is part of the rows."""
    rows = titled(spark, sf_dir)
    found = fulltext.staged_search(rows, '"marking and signs"', known_words(rows))
    return fulltext.numbered(found, [], [F.desc("exact"), F.desc("score"), F.col("id")]).select("id", F.col("rank").cast("int").alias("place"))


@query(f"WITH {TITLED_SQL} SELECT id FROM titled WHERE regexp_matches(title, '(?i)\\bhospital') OR regexp_matches(title, '(?i)\\bpump') OR contains(title, ' & ')")
def alert_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FTS-11, FLT-05: any keyword, as written or corrected; one without words is looked for as it stands."""
    rows = titled(spark, sf_dir)
    return fulltext.keyword_rows(rows, "hospitl; pumps, &", known_words(rows)).select("id")


@query(WITH + f"SELECT id, state, pincode FROM tender WHERE closes_at >= {AT} AND (state IN ('NATION_3', 'NATION_8') OR pincode LIKE '12%' OR pincode LIKE '135%')")
def alert_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06: any of the states or PIN prefixes."""
    area = bookkeeping.in_area(["NATION_3", "NATION_8"], ["12", "135"])
    return tenders(spark, sf_dir).where((F.col("closes_at") >= F.lit(AS_OF).cast("timestamp")) & area).select("id", "state", "pincode")


@query(WITH + f"""SELECT id, state, sector, CAST(value_inr AS DOUBLE) AS value_inr FROM tender WHERE closes_at > {AT} AND sector IN ('BUILDING', 'MACHINERY') AND state IN ('NATION_3', 'NATION_8', 'NATION_12', 'NATION_20')
AND (value_inr IS NULL OR value_inr <= 200000) AND id % 7 <> 0""")
def recommend_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-03, FLT-09, RUL-06: open tenders for a profile without those that are tracked."""
    every = tenders(spark, sf_dir)
    found = rules.recommended(every, every.where("id % 7 = 0").select("id"), AS_OF, states=["NATION_3", "NATION_8", "NATION_12", "NATION_20"], sectors=["BUILDING", "MACHINERY"], cap=200_000)
    return found.select("id", "state", "sector", F.col("value_inr").cast("double").alias("value_inr"))


_FACET = "SELECT '{f}' AS facet, {f} AS key, count(*) AS n FROM tender WHERE {c} GROUP BY {f}"
_BUCKET = "CASE WHEN value_inr < 100000 THEN 'under_1l' WHEN value_inr < 1000000 THEN '1l_10l' WHEN value_inr < 10000000 THEN '10l_1cr' ELSE 'over_1cr' END"


@query(WITH + " UNION ALL ".join([
    _FACET.format(f="state", c="sector = 'BUILDING' AND value_inr >= 100000"), _FACET.format(f="sector", c="state = 'NATION_3' AND value_inr >= 100000"),
    _FACET.format(f="category", c="state = 'NATION_3' AND sector = 'BUILDING' AND value_inr >= 100000"), _FACET.format(f="source", c="state = 'NATION_3' AND sector = 'BUILDING' AND value_inr >= 100000"),
    f"SELECT 'value' AS facet, {_BUCKET} AS key, count(*) AS n FROM tender WHERE state = 'NATION_3' AND sector = 'BUILDING' AND value_inr IS NOT NULL GROUP BY 2",
]))
def facets_of_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-03: all five facets, each under the others' filters."""
    return search.disjunctive_facets(tenders(spark, sf_dir, closing=False), search.TenderQuery(state="NATION_3", sector="BUILDING", min_value=100_000))


# ---- documents --------------------------------------------------------------------------------------------------------

@query(f"""WITH o AS (SELECT o_orderkey, {RUPEES} AS n, date_trunc('day', o_orderdate) AS d FROM orders),
f AS (SELECT o_orderkey, unnest([{{'kind': 'date', 'value': strftime(d, '%Y-%m-%d'), 'k': 0}}, {{'kind': 'money', 'value': CAST(n AS VARCHAR), 'k': 1}}, {{'kind': 'percent', 'value': CAST(o_orderkey % 50 + 1 AS VARCHAR), 'k': 2}}, {{'kind': 'number', 'value': '7', 'k': 3}}]) AS x FROM o)
SELECT o_orderkey, x.kind AS kind, x.value AS value FROM f""")
def facts_in_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRD-01, GRD-02: dates, money, percentages and numbers; a citation and a plural of 'deck' are none of them."""
    n, d = F.floor("o_totalprice").cast("long"), F.date_trunc("day", "o_orderdate")
    said = F.concat(F.lit("By "), F.date_format(d, "d MMMM yyyy"), F.lit(" Rs. "), text(n), F.lit(" and "), text(F.col("o_orderkey") % 50 + 1), F.lit(" per cent for 7 decks [3]."))
    rows = dealt(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderdate").select("o_orderkey", F.explode(documents.facts_of(said)).alias("f"))
    return rows.select("o_orderkey", "f.kind", "f.value")


@query("""WITH o AS (SELECT c_custkey AS answer_id, c_custkey % 4 AS k FROM customer)
SELECT answer_id, CAST(CASE k WHEN 3 THEN 0 ELSE 2 END AS BIGINT) AS checked, CAST(CASE k WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS unsupported, CAST(CASE k WHEN 3 THEN 1 ELSE 0 END AS BIGINT) AS uncited, CAST(CASE k WHEN 2 THEN 1 ELSE 0 END AS BIGINT) AS invalid, k = 0 AS ok FROM o""")
def grounded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRD-03, GRD-04: answers that are supported, whose value isn't, that cite nothing there is, or nothing."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    said = pick(k, [
        F.concat(F.lit("The deposit is Rs. "), text(k), F.lit(" [1]. It is due in 30 days [2].")), F.concat(F.lit("The deposit is Rs. "), text(k + 1000000), F.lit(" [1]. It is due in 30 days [2].")),
        F.concat(F.lit("The deposit is Rs. "), text(k), F.lit(" [1]. It is due in 30 days [2][9].")), F.concat(F.lit("The deposit is Rs. "), text(k), F.lit(".")),
    ])
    passages = rows.select(k.alias("answer_id"), F.posexplode(F.array(F.concat(F.lit("Deposit: Rs. "), text(k), F.lit("/-")), F.lit("within 30 days"))).alias("i", "text")).select("answer_id", (F.col("i") + 1).alias("n"), "text")
    return documents.grounding(rows.select(k.alias("answer_id"), said.alias("answer")), passages)


@query(f"""WITH o AS (SELECT o_orderkey, {RUPEES} AS n FROM orders)
SELECT o_orderkey, unnest(['emd', 'completion_period', 'prebid_meeting', 'liquidated_damages', 'min_turnover', 'bid_validity']) AS key,
unnest(['Rs. ' || n, CAST(o_orderkey % 30 + 1 AS VARCHAR) || ' months', '03-Oct-2026 at 11:00 AM', '0.5% per week subject to 10%', 'Rs. ' || (n * 2) || ' (30% of the estimated cost)', 'ninety days']) AS value FROM o""")
def brief_of_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BRF-01: fields of notices by their labels, with a qualifier and a span to the sentence's last value."""
    n = F.floor("o_totalprice").cast("long")
    said = F.concat(
        F.lit("Earnest Money Deposit of Rs. "), text(n), F.lit(" by draft. Period of completion "), text(F.col("o_orderkey") % 30 + 1), F.lit(" months. Pre-bid meeting: 03-Oct-2026 at 11:00 AM in the hall. "),
        F.lit("Liquidated damages 0.5% per week subject to 10% of all. Average annual turnover of Rs. "), text(n * 2), F.lit(" (30% of the estimated cost) is needed. Bids shall remain valid for ninety days. Nothing else."),
    )
    orders = dealt(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    rows = answers.brief_fields(orders.select("o_orderkey", said.alias("text")))
    return rows.select("o_orderkey", "key", "value")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'eligible' WHEN 1 THEN 'not_eligible' ELSE 'unknown' END AS verdict FROM customer""")
def eligibility_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ELG-01."""
    k = F.col("c_custkey") % 4
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", F.lit(100.0).alias("required_turnover"), F.when(k == 2, None).otherwise(F.when(k == 1, 50.0).otherwise(100.0)).cast("double").alias("own_turnover"), F.lit(None).cast("double").alias("required_similar_work"), F.lit(None).cast("double").alias("own_similar_work"),
        F.when(k == 3, 5.0).cast("double").alias("required_years"), F.lit(None).cast("double").alias("own_years"),
    )
    return rules.eligibility(rows).select("c_custkey", "verdict")


# ---- bookkeeping ------------------------------------------------------------------------------------------------------

@query("""SELECT l_orderkey AS tender_id, first.l_suppkey AS organisation, first.l_linenumber AS line FROM (
SELECT l_orderkey, arg_min({'l_suppkey': l_suppkey, 'l_linenumber': l_linenumber}, (l_suppkey * 1000000000 + l_orderkey) * 10 + l_linenumber) AS first FROM lineitem GROUP BY l_orderkey)""")
def crawl_walk_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-23: the first listing row of each tender, organisation after organisation."""
    listings, organisations = _listings(spark, sf_dir)
    return bookkeeping.walk(listings, organisations)[0].select(F.col("tender_id").cast("long").alias("tender_id"), "organisation", "line")


def _listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    line = table(spark, sf_dir, "lineitem")
    listings = line.select(F.col("l_suppkey").alias("organisation"), ((F.col("l_suppkey") * 1000000000 + F.col("l_orderkey")) * 10 + F.col("l_linenumber")).alias("ord"), text("l_orderkey").alias("tender_id"), F.col("l_linenumber").alias("line"))
    return listings, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("organisation"), (F.lit(600) + F.col("s_suppkey") % 2).alias("claimed"))


@query("""SELECT s_suppkey AS organisation, 600 + s_suppkey % 2 AS claimed, coalesce(n, 0) AS listed, 600 + s_suppkey % 2 <> coalesce(n, 0) AS mismatch FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey""")
def crawl_walk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-23: what organisations claim and what they list."""
    return bookkeeping.walk(*_listings(spark, sf_dir))[1]


@query("""SELECT s_suppkey AS source FROM supplier WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id * 2 = s_suppkey AND event_type = 'click' AND ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 6 HOUR)""")
def free_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-24: sources without a running crawl of the last six hours."""
    runs = table(spark, sf_dir, "events").select((F.col("user_id") * 2).alias("source"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.col("ts").alias("started"))
    return bookkeeping.free_sources(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source")), runs, "2024-01-20 00:00:00")


@query("""WITH r AS (SELECT n_name AS source, n_nationkey AS ord, n_nationkey % 3 <> 0 AS enabled FROM nation)
SELECT source, CAST(row_number() OVER (ORDER BY source <> 'NATION_9', ord) - 1 AS INTEGER) AS place, CAST(5 + floor((row_number() OVER (ORDER BY source <> 'NATION_9', ord) - 1) * 50 / count(*) OVER ()) AS INTEGER) AS hourly_minute,
CAST((60 + (row_number() OVER (ORDER BY source <> 'NATION_9', ord) - 1) * 4) // 60 % 24 AS INTEGER) AS nightly_hour, CAST((60 + (row_number() OVER (ORDER BY source <> 'NATION_9', ord) - 1) * 4) % 60 AS INTEGER) AS nightly_minute
FROM r WHERE enabled OR source = 'NATION_9'""")
def crawl_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18: keys to sources, each once, and when they are crawled."""
    registry = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), F.col("n_nationkey").alias("ord"), (F.col("n_nationkey") % 3 != 0).alias("enabled"))
    asked = spark.createDataFrame([(0, " "), (1, "NATION_9"), (2, "all"), (3, "NATION_9")], "pos int, key string")
    found = fulltext.numbered(bookkeeping.resolve_sources(asked, registry), [], [F.col("pos"), F.col("ord")]).withColumn("place", F.col("rank") - 1)
    total = found.agg(F.count(F.lit(1)).alias("n"))
    timed = bookkeeping.schedule(found.join(F.broadcast(total)))
    return found.join(timed, "source").select("source", F.col("place").cast("int").alias("place"), "hourly_minute", "nightly_hour", "nightly_minute")


@query("""SELECT user_id AS task_id, count(*) AS attempts, 'failed at ' || max(event_id) AS error FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'purchase' AND value > 90) = 0 AND count(*) >= 3""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-04: tasks of which no attempt came through."""
    e = table(spark, sf_dir, "events")
    error = F.when(~((F.col("event_type") == "purchase") & (F.col("value") > 90)), F.concat(F.lit("failed at "), text("event_id")))
    return bookkeeping.dead_letters(e.select(F.col("user_id").alias("task_id"), F.col("event_id").alias("attempt"), error.alias("error")), 3)


@query("""SELECT o_orderkey AS item, o_custkey AS tender_id, CASE WHEN o_orderstatus = 'O' AND o_custkey % 4 <> 0 THEN -o_custkey ELSE o_orderkey END AS page_id, CASE WHEN o_orderstatus = 'O' THEN 'unchanged' ELSE 'updated' END AS outcome, o_orderstatus = 'O' AND o_custkey % 4 <> 0 AS discarded FROM orders""")
def kept_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-13."""
    loaded = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("tender_id"), F.col("o_orderkey").alias("page_id"), F.when(F.col("o_orderstatus") == "O", "unchanged").otherwise("updated").alias("outcome"))
    current = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tender_id"), F.when(F.col("c_custkey") % 4 != 0, -F.col("c_custkey")).alias("page_id"))
    return bookkeeping.kept_pages(loaded, current, 0)


@query("""SELECT conv_id AS doc_id, turn AS ord, CASE WHEN conv_id % 3 = 0 THEN upper(role) ELSE role END AS text FROM conversations WHERE conv_id % 3 <> 0 OR turn % 2 = 0""")
def chunks_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-14."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("role").alias("text"))
    return bookkeeping.replace_chunks(rows, rows.where("doc_id % 3 = 0 AND ord % 2 = 0").withColumn("text", F.upper("text")))


_DOCS = "SELECT doc_id % 5 AS org_id, sha256(text) AS sha256, min(doc_id) AS doc_id FROM documents WHERE {c} GROUP BY 1, 2"


@query(f"""WITH s AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN doc_id % 3 <> 0 THEN doc_id END AS tender_id FROM ({_DOCS.format(c="doc_id % 2 = 0")})), u AS ({_DOCS.format(c="TRUE")})
SELECT u.org_id, u.sha256, CASE WHEN s.doc_id IS NULL OR s.status = 'failed' THEN u.doc_id + 1000000 ELSE s.doc_id END AS doc_id, CASE WHEN s.doc_id IS NULL OR s.status = 'failed' THEN 'pending' ELSE s.status END AS status,
CASE WHEN s.doc_id IS NULL OR s.status = 'failed' THEN 77 ELSE coalesce(s.tender_id, 77) END AS tender_id FROM u LEFT JOIN s ON u.org_id = s.org_id AND u.sha256 = s.sha256""")
def documents_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-17."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 5).alias("org_id"), F.sha2("text", 256).alias("sha256"), "doc_id")
    stored = docs.where("doc_id % 2 = 0").groupBy("org_id", "sha256").agg(F.min("doc_id").alias("doc_id"))
    stored = stored.select("org_id", "sha256", "doc_id", F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("ready").alias("status"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id")).alias("tender_id"))
    return bookkeeping.register(stored, docs.select("org_id", "sha256", (F.col("doc_id") + 1000000).alias("doc_id"), F.lit("pending").alias("status"), F.lit(77).cast("long").alias("tender_id")))


@query("""SELECT c_nationkey AS org_id, c_custkey AS tender_id, CASE WHEN c_custkey % 2 = 0 THEN 'won' ELSE 'watching' END AS status FROM customer""")
def tenders_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-18."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("tender_id"))
    asked = rows.withColumn("status", F.lit("watching"))
    return bookkeeping.track(rows.where("tender_id % 2 = 0").withColumn("status", F.lit("won")), asked.union(asked))


@query("""SELECT c_nationkey AS org_id, count(*) AS alerts FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'O' GROUP BY 1""")
def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-18, AGG-23."""
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("org_id"), F.col("c_custkey").alias("user_id"))
    return bookkeeping.alert_counts(members, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderstatus") == "O").alias("active")))


@query("""SELECT org_id, count(*) AS seats FROM (SELECT c_nationkey AS org_id FROM customer UNION ALL SELECT user_id % 25 FROM events WHERE event_type <> 'purchase' AND ts > TIMESTAMP '2024-01-20') GROUP BY 1""")
def seats_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23: members and open invitations."""
    invites = table(spark, sf_dir, "events").select((F.col("user_id") % 25).alias("org_id"), (F.col("event_type") == "purchase").alias("accepted"), F.col("ts").alias("expires_at"))
    return bookkeeping.seats(table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("org_id")), invites, "2024-01-20 00:00:00")


@query("SELECT DISTINCT n_name AS country, c_mktsegment AS currency FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26: countries and currencies that rates are needed for."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("currency")).distinct()


@query("""SELECT c_custkey AS id, list_sort(list_distinct(['NATION_' || (c_custkey % 30), 'NATION_1'])) AS states, ['BUILDING'] AS sectors, list_sort(list_distinct([CAST(c_custkey % 60 AS VARCHAR), '490'])) AS pin_prefixes,
list_filter([CASE WHEN c_custkey % 30 > 24 THEN 'unknown state: NATION_' || (c_custkey % 30) END, CASE WHEN c_custkey % 60 < 10 THEN 'not a PIN prefix: ' || (c_custkey % 60) END], lambda x: x IS NOT NULL) AS errors FROM customer""")
def alert_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-16."""
    k = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select(k.alias("id"), F.array(F.concat(F.lit("NATION_"), text(k % 30)), F.lit("NATION_1")).alias("states"), F.array(F.lit("BUILDING"), F.lit("BUILDING")).alias("sectors"), F.array(F.lit("490"), text(k % 60)).alias("pin_prefixes"))
    return bookkeeping.criteria(asked, [f"NATION_{n}" for n in range(25)], ["BUILDING", "MACHINERY"])


@query("""SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 ELSE 3 END AS INTEGER) AS our_rank, CAST(o_orderkey % 7 + 1 AS INTEGER) AS num_bidders,
CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 < 1 OR o_orderkey % 9 > o_orderkey % 7 + 1 ELSE 3 > o_orderkey % 7 + 1 END AS refused FROM orders""")
def rank_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-17."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders")
    stored = rows.select(k.alias("id"), F.lit(3).alias("our_rank"), (k % 7 + 1).cast("int").alias("num_bidders"))
    return bookkeeping.rank_errors(stored, rows.select(k.alias("id"), F.when(k % 2 == 0, (k % 9).cast("int")).alias("our_rank"), F.lit(None).cast("int").alias("num_bidders")))


@query(WITH + "SELECT id, buyer, CAST(value_inr AS DOUBLE) AS value_inr FROM tender WHERE id = 7")
def tender_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-18: one row by its key; the filter reaches all tables' scans."""
    return tenders(spark, sf_dir).where("id = 7").select("id", "buyer", F.col("value_inr").cast("double").alias("value_inr"))


@query("""SELECT o_orderkey, ['open', 'limited', 'single', 'open', ''][o_orderkey % 5 + 1] AS method, ['consultancy', 'works', '', 'goods'][o_orderkey % 4 + 1] AS category FROM orders""")
def outcome_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-11."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", bookkeeping.outcome_method(pick(k, ["Global Tenders", "Open Limited", "Single", "National Competitive Bid", "Auction"])).alias("method"), bookkeeping.outcome_category(pick(k, ["Consultancy Services", " WORKS", "other", "Goods"])).alias("category"))


@query("SELECT y AS year, CASE WHEN y % 2 = 0 THEN 'https://example.org/' || y || '.zip' ELSE 'https://example.org/page' || y END AS url FROM (SELECT unnest([2015, 2016, 2017, 2018]) AS y)")
def yearly_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20: a catalogue's yearly files from 2015 on."""
    rows = [(f"Notices {y}", [f"https://example.org/{y}.txt", f"https://example.org/{y}.zip"] if y % 2 == 0 else None, [f"https://example.org/page{y}"]) for y in range(2011, 2019)] + [("All years", ["x.zip"], None)]
    return bookkeeping.yearly_files(spark.createDataFrame(rows, "title string, download_url array<string>, access_url array<string>"), 2015, 2006, 2030, "https://example.org/%s.zip")


# ---- a development bank's feeds -----------------------------------------------------------------------------------------

@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS amount FROM orders""")
def bank_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-04, NUM-09."""
    k, d, n = F.col("o_orderkey"), F.col("o_orderdate"), F.floor("o_totalprice").cast("long")
    said = pick(k, [F.date_format(d, "yyyy/MM/dd"), F.date_format(d, "yyyy-MM-dd"), F.upper(F.date_format(d, "dd-MMM-yyyy")), F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit("T00:00:00Z")), F.lit("soon")])
    return table(spark, sf_dir, "orders").select("o_orderkey", bank.bank_date(said).alias("day"), bank.bank_amount(pick(k, [F.concat(F.lit("USD "), text(n), F.lit(".00")), F.concat(F.lit("$"), text(n)), F.concat(F.lit("-"), text(n))])).cast("double").alias("amount"))


@query("""SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 1000 WHEN 2 THEN 70 WHEN 3 THEN 60 END AS DOUBLE) AS price FROM orders""")
def bank_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-08: evaluated, opening where the evaluated one has lost a digit, opening alone, signed alone, none."""
    k = F.col("o_orderkey")
    none = F.lit(None).cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", bank.bidder_price(pick(k, [F.lit(100.0), F.lit(99.0), none, none, none]), pick(k, [F.lit(80.0), F.lit(1000.0), F.lit(70.0), F.lit(0.0), none]), pick(k, [none, none, F.lit(5.0), F.lit(60.0), none])).alias("price"))


@query("""SELECT upper(event_type) || '/' || event_id AS ref, 'P' || user_id AS project_id, CAST(ts AS DATE) AS signing_date, CASE WHEN value > 0 THEN round(value, 2) END AS amount_usd, CASE WHEN event_id % 2 = 0 THEN 'A' || event_id ELSE 'B' || event_id END AS contract_no FROM events WHERE event_type <> 'view' AND user_id % 2 = 0""")
def bank_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11, SRC-22: a paged feed whose pages overlap, its records as rows, for one country."""
    e = table(spark, sf_dir, "events")
    records = e.select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", " ").otherwise(F.concat(F.lit(" "), "event_type", F.lit("/"), text("event_id"), F.lit("-"))).alias("borrower_contract_reference_number"), F.concat(F.lit(" P"), text("user_id")).alias("project_id"), F.lit("S").alias("supplier"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("contract_signing_date"), F.format_string("%.2f", "value").alias("supplier_contract_amount_usd"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("A"), text("event_id"))).alias("wb_contract_number"), F.concat(F.lit("B"), text("event_id")).alias("contract_number"), F.when(F.col("user_id") % 2 == 0, "India").otherwise("Nepal").alias("borrower_country"),
    )
    pages = records.withColumn("offset", F.col("id") % 100).unionByName(records.where("id % 10 = 0").withColumn("supplier", F.lit("again")).withColumn("offset", F.col("id") % 100 + 100))
    rows = bank.payment_rows(bank.first_by_id(pages), "India").where("supplier = 'S'")
    return rows.select("ref", "project_id", "signing_date", F.col("amount_usd").cast("double").alias("amount_usd"), "contract_no")


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Renovation of Gangway cum shed' ELSE 'Renovationof Gangway cum shed' END AS joined FROM part")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12: with known words, and without."""
    lines = F.array(F.lit("Renovation"), F.lit("of Gangway c"), F.lit("um shed"))
    known = F.array(*map(F.lit, ["renovation", "of", "gangway", "cum", "shed"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, bank.joined_wraps(lines, known)).otherwise(bank.joined_wraps(lines)).alias("joined"))


@query("""SELECT key, source_id, award_usd, winner, method, category, bids FROM (SELECT o_orderkey AS key, 'X-' || (o_orderkey // 2) || CASE WHEN count(*) OVER (PARTITION BY o_orderkey // 2) > 1 THEN '#' || o_orderkey ELSE '' END AS source_id,
CAST(CASE o_orderkey % 3 WHEN 0 THEN 500 WHEN 1 THEN 300 ELSE 1000 END AS DOUBLE) AS award_usd, 'W' || o_orderkey AS winner, 'open' AS method, 'works' AS category,
CAST(CASE WHEN o_orderkey % 3 <> 1 AND o_orderkey % 4 <> 3 THEN 2 END AS INTEGER) AS bids FROM orders)""")
def bank_awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-21: awards from plans, payments and signed prices; bids only where one rate explains them."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    bidder = lambda name, role, price: F.struct(name.alias("name"), F.lit(role).alias("role"), price.alias("evaluated"), F.lit(None).cast("double").alias("opening"), F.lit(None).cast("double").alias("signed"))
    notices = o.select(
        k.alias("key"), F.lit(1).alias("notice_id"), F.concat(F.lit("X-"), text((k / 2).cast("long"))).alias("ref"), F.lit("P").alias("project"), F.lit("T").alias("title"), F.lit("Request for Bids").alias("method"), F.lit("Works").alias("group"),
        F.lit("2020-05-01").cast("date").alias("signed_on"), F.lit(None).cast("date").alias("noticed_on"), F.when(k % 4 == 3, "USD").otherwise("INR").alias("currency"), F.lit(70000.0).alias("signed_inr"),
        F.array(bidder(F.concat(F.lit("W"), text(k)), "awarded", F.lit(70000.0)), bidder(F.lit("L"), "evaluated", F.lit(80000.0)), bidder(F.lit("R"), "rejected", F.lit(1.0))).alias("bidders"),
    )
    payments = o.where("o_orderkey % 3 <> 2").select(k.alias("key"), F.explode(F.array(F.lit(100.0), F.lit(200.0))).alias("amount_usd"), F.lit("2020-06-01").cast("date").alias("signed_on"), F.lit("S").alias("supplier"))
    plans = o.where("o_orderkey % 3 <> 2").select(k.alias("key"), F.when(k % 3 == 0, "Signed").otherwise("Planned").alias("status"), F.lit(500.0).alias("actual_usd"), F.lit(450.0).alias("estimated_usd"), F.lit("plan").alias("title"))
    rates = spark.createDataFrame([(2020, 70.0)], "year int, rupees double")
    rows = bank.award_rows(notices, payments, plans, rates)
    return rows.select("key", "source_id", "award_usd", "winner", "method", "category", F.when(F.col("bids_usd").isNotNull(), F.size("bids_usd")).alias("bids"))


@query("""WITH o AS (SELECT o_orderkey AS key, o_orderkey % 4 AS k FROM orders)
SELECT key, 'a' AS payment_id, CASE k WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '1' END AS notice_id FROM o UNION ALL SELECT key, 'b', CASE k WHEN 0 THEN '2' WHEN 1 THEN '1' WHEN 2 THEN '1' END FROM o""")
def contracts_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-11: payments to notices by the winner's name, by the nearest price, all to the only one, or to none."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    far = F.col("kind") == 3
    kind = (k % 4).alias("kind")
    n = o.select(k.alias("key"), kind, F.explode(F.array(F.lit(1), F.lit(2))).alias("notice_id")).where("kind < 2 OR notice_id = 1")
    name = F.when((F.col("kind") == 0) & (F.col("notice_id") == 1), "A").otherwise(F.concat(F.lit("N"), text("notice_id")))
    price = F.when(F.col("kind") == 0, 1000.0).when(F.col("kind") == 1, F.when(F.col("notice_id") == 1, 900.0).otherwise(100.0)).when(F.col("kind") == 2, 1010.0).otherwise(5.0)
    notices = n.select("key", "notice_id", name.alias("winner"), price.alias("price_usd"))
    payments = o.select(k.alias("key"), kind, F.explode(F.array(F.lit("a"), F.lit("b"))).alias("payment_id"))
    paid = F.when(F.col("kind") == 2, F.when(F.col("payment_id") == "a", 500.0).otherwise(510.0)).when(F.col("kind") == 0, F.when(F.col("payment_id") == "a", 7.0).otherwise(990.0)).when(far, 50.0).otherwise(F.when(F.col("payment_id") == "a", 110.0).otherwise(880.0))
    return contracts.split_contracts(notices, payments.select("key", "payment_id", F.when(F.col("payment_id") == "a", "A").otherwise("B").alias("supplier"), paid.alias("amount_usd")))


# ---- notices ----------------------------------------------------------------------------------------------------------

@query("""SELECT o_orderkey AS doc_id, 'Construction of road no ' || o_orderkey || ' in the district' AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'REF/' || o_orderkey || ' · ' ELSE '' END || 'Construction of road no ' || o_orderkey || ' in the district · 2024_ABC_' || o_orderkey || '_1' AS context FROM orders""")
def document_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-04: the name of the work with its wrapped line, and what a document is about."""
    k = text("o_orderkey")
    # a small file is one split: keys are dealt out before the texts are made and searched
    o = table(spark, sf_dir, "orders").select("o_orderkey").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    head = F.concat(F.lit("NOTICE\nTender 2024_ABC_"), k, F.lit("_1\n1. Name of the work : Construction of road no "), k, F.lit("\n          in the district\nEMD    Rs. 5"))
    pages = o.select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.struct(F.lit(1).alias("page"), head.alias("text")), F.struct(F.lit(2).alias("page"), F.lit("Subject: other matters of no use").alias("text")))).alias("p")).select("doc_id", "p.*")
    known = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("").alias("title"), F.concat(F.lit("REF/"), k).alias("reference"), F.lit(" ").alias("buyer"))
    return notices.contexts(pages, known)


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN d + INTERVAL 660 MINUTE WHEN 1 THEN d + INTERVAL 900 MINUTE WHEN 2 THEN d + INTERVAL 30 MINUTE END - INTERVAL 330 MINUTE AS at FROM (SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS d FROM orders)""")
def meeting_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT-05: exactly one date and one clock time, of twelve or twenty-four hours."""
    day = F.date_format("o_orderdate", "dd-MMM-yyyy")
    said = pick(F.col("o_orderkey"), [F.concat(day, F.lit(" at 11:00 AM")), F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(", 15:00 hrs")), F.concat(day, F.lit(" 12.30 a.m.")), day, F.concat(day, F.lit(" 10:00 or 11:00"))])
    return dealt(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", notices.meeting_time(said).alias("at"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN d ELSE CASE o_orderkey % 4 WHEN 1 THEN d + INTERVAL 1410 MINUTE END END AS prebid FROM (SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS d FROM orders)""")
def meetings_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-07: stored ones stay; others are filled if inside the tender's time and the document names the tender."""
    k, day = F.col("o_orderkey"), F.date_trunc("day", "o_orderdate")
    rows = dealt(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(k.alias("id"), F.concat(F.lit("NIT/00"), text(k)).alias("reference"), day.alias("published_at"), (day + F.expr("INTERVAL 9 DAYS")).alias("closes_at"), F.when(k % 4 == 0, day).alias("prebid"))
    days = F.when(F.col("id") % 4 == 2, 30).otherwise(1)
    said = F.concat(F.date_format(F.date_add(F.col("published_at"), days), "dd-MMM-yyyy"), F.lit(" 05:00 AM"))
    fields = rows.select("id", said.alias("value"), F.concat(F.lit("Notice  no. "), F.when(F.col("id") % 4 == 3, F.lit("of another")).otherwise(F.lower("reference")), F.lit(" of today")).alias("text"))
    return notices.with_meetings(rows, fields).select("id", "prebid")


@query("""SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN 'ready' WHEN c_custkey % 5 IN (1, 2) THEN 'failed' ELSE 'ready' END AS status, CASE c_custkey % 5 WHEN 1 THEN 'no pages' WHEN 2 THEN 'no text' END AS error, c_custkey % 5 <> 0 AS worked FROM customer""")
def documents_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOC-06: a ready document is left alone; one without pages or text fails."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("doc_id"), F.when(k % 5 == 0, "ready").otherwise("pending").alias("status"))
    pages = rows.where("doc_id % 5 <> 1").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("page"), F.when(F.col("doc_id") % 5 == 2, " ").otherwise("words").alias("text"))
    return notices.processed(rows, pages)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'unknown' WHEN c_custkey % 10 >= 8 THEN 'met' WHEN c_custkey % 10 < 4 THEN 'not_met' ELSE 'unknown' END AS similar FROM customer""")
def similar_work_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ELG-01: one work of 80 %, two of 60 % or three of 40 %."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", notices.similar_work(F.array(F.lit(40), F.lit(60), F.lit(80)), F.when(k % 9 != 0, k % 10 * 10)).alias("similar"))


@query("""SELECT entity, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 50 IN (10, 20) THEN 'E1' ELSE 'E' || (c_custkey % 50) END AS entity FROM customer) GROUP BY 1""")
def merges_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-07: approved merges move tenders, rejected ones don't, entities without any go."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("E"), text(F.col("c_custkey") % 50)).alias("entity"))
    reviews = spark.createDataFrame([("E10", "E1", True), ("E20", "E1", True), ("E30", "E1", False)], "entity string, candidate string, approved boolean")
    moved, left = notices.reviewed(rows, reviews, rows.select("entity").distinct())
    return moved.join(left, "entity").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


# ---- portal pages -----------------------------------------------------------------------------------------------------

def _page(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


@query("""SELECT c_nationkey AS id, 'Org ' || c_nationkey AS name, CAST(count(*) AS INTEGER) AS tenders FROM customer GROUP BY c_nationkey""")
def portal_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-04: organisations of an index page with their number of tenders."""
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    row = _page("<tr><td>1</td><td> Org&nbsp;", text("id"), " </td><td><a href='/x?page=FrontEndTendersByOrganisation&amp;sp=", text("id"), "'>", text("n"), "</a></td></tr>")
    html = _page("<html><table><tr><td>No</td><td>Organisation</td><td>Tenders</td></tr>", row, row, "<tr><td>2</td><td>None</td><td>0</td></tr></table>")
    return n.select("id", F.explode(portal.organisations_of(html)).alias("o")).select("id", "o.name", "o.tenders")


@query("""SELECT o_orderkey AS id, 'Road no ' || o_orderkey AS title, 'REF/' || o_orderkey AS ref_no, '2024_A_' || o_orderkey || '_1' AS tender_id, 'State||Works' AS org_chain FROM orders""")
def portal_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05: a listing's row, its last cell but one read from its end."""
    k = text("o_orderkey")
    html = _page("<table><tr><td>1</td><td>01-Jan-2026 09:00 AM</td><td>02-Jan-2026</td><td>03-Jan-2026</td><td><a href='/y?component=FrontEndViewTender'>[Road no ", k, "]</a> [REF/", k, "][2024_A_", k, "_1]</td><td>State||Works</td></tr></table>")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(portal.listing_of(html)).alias("r"))
    return rows.select("id", "r.title", "r.ref_no", "r.tender_id", "r.org_chain")


@query("""SELECT o_orderkey AS id, '2024_A_' || o_orderkey || '_1' AS tender_id, CAST(floor(o_totalprice) AS BIGINT) || '.00' AS value, 'notice.pdf, plan.xlsx' AS documents, o_orderkey % 5 = 0 AS stale FROM orders""")
def portal_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-06, SRC-07: fields of a detail page by caption, its documents, and pages of a session that is over."""
    k = text("o_orderkey")
    cell = lambda caption, value: _page("<tr><td class='td_caption'>", caption, "</td><td class='td_field'>", value, "</td></tr>")
    html = _page("<table>", cell("Tender ID", _page("2024_A_", k, "_1")), cell("Tender Value in ₹", _page(text(F.floor("o_totalprice").cast("long")), ".00")), "</table><a href='/d1'>notice.pdf</a> <a href='/d2'>plan.xlsx</a><a href='/h'>Help</a>")
    over = F.concat(html, F.when(F.col("o_orderkey") % 5 == 0, "<b>Stale Session</b> Your session has timed out").otherwise(""))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), portal.detail_of(html).alias("d"), portal.is_stale(over).alias("stale"))
    return rows.select("id", F.col("d")["tender_id"].alias("tender_id"), F.col("d")["value"].alias("value"), F.col("d")["documents"].alias("documents"), "stale")


@query("""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title, CAST(len(regexp_extract_all(html, '(?i)<a\\s[^>]*href')) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '(?i)<p[\\s>]')) AS INTEGER) AS paragraphs FROM pages""")
def page_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles, links and paragraphs of all pages."""
    return table(spark, sf_dir, "pages").select("page_id", portal.outline_of("html").alias("o")).select("page_id", "o.title", "o.links", "o.paragraphs")


@query("""WITH n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'Dept of Works ' || c_nationkey ELSE 'P.W.D. ' || c_nationkey END AS name, c_nationkey FROM customer)
SELECT id, CASE WHEN id % 3 = 0 THEN 'department works ' || c_nationkey ELSE 'p w d ' || c_nationkey END AS norm FROM n""")
def names_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04: abbreviations spelt out, fillers and marks gone."""
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, _page("Dept of  Works ", text("c_nationkey"))).otherwise(_page("P.W.D. ", text("c_nationkey")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), entities.normalise(name).alias("norm"))


#: Pairs of normal forms, and what they score: alike, a misspelt word, a word of its own, levels of which one differs.
PAIRS = [("public works department", "works department public", 100.0), ("public works department bhopal", "public works departmant bhopal", None), ("water board north", "water board", 85.0), ("rail | north yard", "rail | south yard", None)]


@query(f"SELECT c_custkey AS id, c_custkey % 4 AS kind, [true, true, false, false][c_custkey % 4 + 1] AS merged, CASE c_custkey % 4 WHEN 0 THEN 100.0 WHEN 2 THEN 85.0 END AS score FROM customer")
def pairs_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-02 to ER-04: pairs that merge, and that a word of their own, or a level, keeps apart."""
    k = F.col("c_custkey")
    s = entities.pair_score(pick(k, [p[0] for p in PAIRS]), pick(k, [p[1] for p in PAIRS]))
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k % 4).alias("kind"), s.alias("s")).select("id", "kind", (F.col("s") >= entities.MERGE_FROM).alias("merged"), F.when(F.col("kind") % 2 == 0, F.col("s")).alias("score"))


# ---- award datasets ---------------------------------------------------------------------------------------------------

REASONS = ["cancelled_or_not_awarded", "framework_or_dps", "no_estimate_or_award", "award_equals_estimate", "ratio_out_of_band", "no_country", "no_id", "emitted"]


@query(f"SELECT o_orderkey AS id, {REASONS!r}[o_orderkey % 8 + 1] AS reason, CASE WHEN o_orderkey % 8 = 5 THEN 'X1' ELSE 'GB' END AS country FROM orders")
def notice_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11, FLT-15, NUM-07: why a European notice isn't taken, the first reason that holds."""
    k = F.col("o_orderkey") % 8
    given = {
        "CANCELLED": F.when(k == 0, "1").otherwise("0"), "B_FRA_AGREEMENT": F.when(k == 1, "Y").otherwise("N"), "AWARD_EST_VALUE_EURO": F.when(k == 2, "").otherwise("1000"),
        "AWARD_VALUE_EURO": F.when(k == 3, "1000").when(k == 4, "99000").otherwise("900"), "ISO_COUNTRY_CODE": F.when(k == 5, "X1").otherwise(" uk"), "ID_NOTICE_CAN": F.when(k == 6, " ").otherwise(text("o_orderkey")),
    }
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *(given.get(c, F.lit("")).alias(c) for c in awards.TED_COLUMNS))
    return awards.ted_reason(rows).select("id", "reason", F.col("iso").alias("country"))


@query("""SELECT o_orderkey AS id, 'IN' AS country, 2000 + o_orderkey % 20 AS year, CAST(o_orderkey AS DOUBLE) AS value FROM orders""")
def observations_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN-01: a statistics service's replies; observations without a value, of groups of countries, or by quarter go."""
    k = text("o_orderkey")
    year = text(2000 + F.col("o_orderkey") % 20)
    one = lambda country, date, value: _page('{"country": {"id": "', country, '"}, "date": "', date, '", "value": ', value, "}")
    reply = _page('[{"page": 1}, [', one("in", year, k), ", ", one("IN", "1990", k), ", ", one("EMU", year, k), ", ", one("IN", _page(year, "Q1"), k), ", ", one("IN", year, "null"), "]]")
    rows = table(spark, sf_dir, "orders").select(reply.alias("value"))
    return awards.price_observations(rows).select(F.col("value").cast("long").alias("id"), "country", F.col("year").cast("long").alias("year"), "value")


@query("""SELECT o_orderkey AS id, unnest(CASE o_orderkey % 5 WHEN 0 THEN ['emitted'] WHEN 1 THEN ['emitted', 'emitted'] WHEN 2 THEN ['ambiguous_scope'] WHEN 3 THEN ['no_award'] ELSE ['currency_mismatch'] END) AS reason,
unnest(CASE o_orderkey % 5 WHEN 0 THEN [1000.0] WHEN 1 THEN [400.0, 600.0] WHEN 2 THEN [NULL] WHEN 3 THEN [NULL] ELSE [1000.0] END)::DOUBLE AS estimate FROM orders""")
def release_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-12, JON-16, ARR-02: awards of a release and the estimates of what they cover."""
    k = F.col("o_orderkey") % 5
    award = lambda name, amount, currency, lots, status="active": f'{{"id": "{name}", "status": "{status}", "value": {{"amount": {amount}, "currency": "{currency}"}}, "relatedLots": {lots}}}'
    lots = '"lots": [{"id": "L1", "value": {"amount": 400}}, {"id": "L2", "value": {"amount": 600}}], '
    made = pick(F.col("o_orderkey"), [
        f'"awards": [{award("A", 900, "USD", "null")}]', f'"awards": [{award("A", 390, "USD", chr(91) + chr(34) + "L1" + chr(34) + chr(93))}, {award("B", 610, "USD", chr(91) + chr(34) + "L2" + chr(34) + chr(93))}]',
        f'"awards": [{award("A", 390, "USD", "null")}, {award("B", 610, "USD", "null")}]', f'"awards": [{award("A", 390, "USD", "null", "cancelled")}]', f'"awards": [{award("A", 900, "EUR", "null")}]',
    ])
    release = _page('{"ocid": "', text("o_orderkey"), '", "tender": {', F.when((k == 1) | (k == 2), lots).otherwise(""), '"value": {"amount": 1000, "currency": "USD"}, "datePublished": "2020-01-02T00:00:00Z"}, ', made, "}")
    rows = table(spark, sf_dir, "orders").select(F.from_json(release, awards.RELEASE).alias("r")).select("r.*")
    return awards.ocds_reasoned(rows, "PEN").select(F.col("ocid").cast("long").alias("id"), "reason", F.col("s.estimate").alias("estimate"))


# ---- contracts, exports, runs -----------------------------------------------------------------------------------------

SPANISH = ["Construcción de carretera", "Supervisión de obra", "Servicio de VIGILANCIA", "Ampliación de alcantarillado", "Electrificación rural", "Compra de medicamentos", "Construcción de aulas", "Otros bienes"]
SPANISH_SECTOR = ["roads", "consultancy", "security", "water", "electrical", "health", "buildings", "supplies"]
METHOD_TEXTS = ["Request for Bids", "Direct Selection", "QCBS", "Shopping", "National Competitive Bidding (NCB)", "Barter", ""]
METHOD_NAMES = ["open", "single", "qcbs", "limited", "open", "other", ""]


@query(f"""SELECT p_partkey, {SPANISH_SECTOR!r}[p_partkey % 8 + 1] AS sector, {METHOD_NAMES!r}[p_partkey % 7 + 1] AS method, 'AB/12-' || p_partkey AS ref, CASE WHEN p_partkey % 2 = 0 THEN 'P1:AB/12-' || p_partkey ELSE 'XY-' || (10000 + p_partkey) || '-CW-RFB' END AS key,
CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'works' END AS category, ['Uttar Pradesh', 'Goa', ''][p_partkey % 3 + 1] AS state FROM part""")
def contract_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07, STR-09, STR-10, JON-10: sectors, methods, references, keys and states of contracts."""
    k = F.col("p_partkey")
    ref = _page("  ab/12-", text(k), " .")
    keyed = F.when(k % 2 == 0, ref).otherwise(_page("xy-", text(10000 + k), "-cw-rfb"))
    state = contracts.find_state(["Goa", "Pradesh", "Uttar Pradesh"], pick(k, ["a road", "beaches of goa", "none"]), pick(k, ["in uttar pradesh", "Uttar Pradesh", "x"]))
    return table(spark, sf_dir, "part").select(
        "p_partkey", contracts.spanish_sector(pick(k, SPANISH), F.lit("goods")).alias("sector"), contracts.bank_method(pick(k, METHOD_TEXTS)).alias("method"), contracts.reference(ref).alias("ref"), contracts.merge_key(F.lit("P1"), keyed).alias("key"), contracts.reference_category(keyed).alias("category"), state.alias("state"),
    )


@query("""SELECT page_id FROM (SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 2 = 0 THEN 'listing' ELSE 'detail' END AS kind, datediff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') AS age FROM orders)
WHERE NOT (kind = 'listing' AND age > 7) AND NOT (kind = 'detail' AND age > 30 AND page_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1))""")
def pages_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-05, SNK-11: young pages, and old details that something refers to."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("page_id"), F.when(k % 2 == 0, "listing").otherwise("detail").alias("kind"), F.col("o_orderdate").alias("fetched_at"))
    used = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("page_id"))
    return exports.retained(rows, [used, used.limit(0)], "1998-01-01 00:00:00").select("page_id")


@query("""SELECT o_orderkey AS id, k AS kind, 'BEGIN:VEVENT' || chr(13) || chr(10) || 'UID:' || o_orderkey || '-' || k || chr(13) || chr(10) || 'DTSTART:' || strftime(o_orderdate, '%Y%m%dT%H%M%SZ') || chr(13) || chr(10) || 'SUMMARY:' || CASE k WHEN 'closes_at' THEN 'Closes' ELSE 'Bids open' END || ': Road\\, no\\; ' || o_orderkey || chr(13) || chr(10) || 'END:VEVENT' AS event
FROM orders, (SELECT unnest(['closes_at', 'opens_at']) AS k) WHERE k = 'closes_at' OR o_orderkey % 2 = 0""")
def calendar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-08: what is known of a tender's days, as events."""
    at = F.col("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _page("Road, no; ", text("o_orderkey")).alias("title"), at.alias("closes_at"), F.when(F.col("o_orderkey") % 2 == 0, at).alias("opens_at"), F.lit(None).cast("timestamp").alias("prebid_meeting"))
    return exports.calendar(rows).select("id", "kind", "event")


@query("""SELECT event_id AS id, CASE WHEN event_type = 'click' AND ts < TIMESTAMP '2024-01-20' - INTERVAL 6 HOUR THEN 'incomplete' WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status FROM events""")
def runs_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-04: crawls that run for too long are incomplete."""
    runs = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"), F.col("ts").alias("started"))
    return incremental.stale_runs(runs, "2024-01-20 00:00:00").select("id", "status")


@query("""SELECT u.user_id AS sub_id, e.event_id AS id FROM (SELECT DISTINCT user_id FROM events WHERE user_id < 40) u JOIN events e ON (u.user_id % 3 = 0 OR e.event_type = ['click', 'view', 'purchase'][u.user_id % 3 + 1]) AND (u.user_id % 2 = 0 OR e.user_id % 4 = u.user_id % 4) AND e.value >= 50
AND e.ts > TIMESTAMP '2024-01-15' AND e.ts <= TIMESTAMP '2024-01-20' AND e.event_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY u.user_id ORDER BY e.ts DESC, e.event_id DESC) <= 25""")
def alerts_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-01, SNK-09: new rows for subscriptions by their states, sectors and least value, without what was sent."""
    e = table(spark, sf_dir, "events")
    u = F.col("user_id")
    some = e.where("user_id < 40").select("user_id").distinct()
    kinds = F.when(u % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(u, ["click", "view", "purchase"])))
    subs = some.select(u.alias("sub_id"), kinds.alias("states"), F.when(u % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(text(u % 4))).alias("sectors"), F.lit(50.0).alias("min_value"), F.lit("2024-01-15").cast("timestamp").alias("checked_until"))
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("state"), text(u % 4).alias("sector"), "value", F.col("ts").alias("first_seen"))
    sent = rows.where("id % 5 = 0").select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("sub_id"))
    return incremental.due_alerts(subs, rows, sent, "2024-01-20 00:00:00")[0].select("sub_id", "id")


@query("""SELECT user_id AS org_id, event_id AS n, sum(event_id) OVER (PARTITION BY user_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 200000 AS ok FROM events""")
def usage_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22: uses that still fit a month's cap, in order of time."""
    usage = table(spark, sf_dir, "events").select(F.col("user_id").alias("org_id"), F.col("ts").alias("at"), F.col("event_id").alias("n"))
    return contracts.admitted(usage, 200_000).select("org_id", "n", "ok")


@query("""SELECT o_orderkey AS id, o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0 AS allowed FROM orders""")
def crawl_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03: of a host's rules the longest that fits decides; a host without rules is open."""
    k = F.col("o_orderkey")
    urls = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 3 == 0, "a").otherwise("b").alias("host"), F.when(k % 2 == 0, _page("/x/open/", text(k))).otherwise(_page("/x/y", text(k))).alias("path"))
    rules_of = spark.createDataFrame([("a", "/x/", False), ("a", "/x/*open", True), ("c", "/", False)], "host string, pattern string, allow boolean")
    return contracts.may_crawl(urls, rules_of).select("id", "allowed")


@query("""SELECT 'Dept of ' || n_name AS name, n_name AS state, CASE WHEN n_nationkey % 2 = 0 THEN 'E' || n_nationkey ELSE 'Dept of ' || n_name END AS entity, CASE WHEN n_nationkey % 2 = 0 THEN 'alias' ELSE 'new' END AS method FROM nation""")
def names_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ER-05, ER-06: known aliases first, in any state; what is left becomes entities of its own."""
    nation = table(spark, sf_dir, "nation")
    names = nation.select(_page("Dept of ", F.col("n_name")).alias("name"), F.col("n_name").alias("state"), F.lit(1).cast("long").alias("n"))
    aliases = nation.where("n_nationkey % 2 = 0").select(entities.normalise(_page("DEPARTMENT, ", F.col("n_name"))).alias("norm"), _page("E", text("n_nationkey")).alias("entity"))
    known, rest = entities.resolve_known(names, aliases)
    return known.unionByName(entities.resolve(rest)).select("name", "state", "entity", "method")


@query("""WITH o AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders)
SELECT id, 'P12345' AS project_id, 'AB/' || id AS ref, CAST(2 AS INTEGER) AS version, DATE '2020-05-01' AS signed_on, unnest(['First Co', 'Second Co', 'Third Co']) AS name, unnest(['awarded', 'evaluated', 'rejected']) AS role, unnest(['INR', 'INR', 'USD']) AS currency,
unnest([n, NULL, 7])::DOUBLE AS opening, unnest([n + 1, n + 5, NULL])::DOUBLE AS evaluated, unnest([n + 2, NULL, NULL])::DOUBLE AS signed FROM o""")
def notices_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: award notices' headers and bidders, with sums in and after their labels, and in two currencies."""
    k, n = text("o_orderkey"), F.floor("o_totalprice").cast("long")
    html = _page(
        "<p>Project: P12345</p><p>Bid/Contract Reference No: AB/", k, "</p><p>Notice Version No: 2</p><p>Contract Signature Date: (YYYY/MM/DD) 2020/05/01</p><p>INR 5</p><div><b>Scores</b></div><div>Awarded Bidder(s):</div><div><b>First Co (7639)</b></div><div>Country: India</div>",
        "<div>Bid Price at Opening</div><div>USD 9.00 INR ", text(n), "</div><div>Evaluated Bid Price: INR ", text(n + 1), "</div><div>Signed Contract price</div><div>INR ", text(n + 2), "</div><div>INR 1</div><div>Evaluated Bidder(s):</div><p>Name: Second Co [SC]</p>",
        "<p>Read Out Price : USD 3</p><p>Final Evaluation Price</p><p>INR ", text(n + 5), "</p><div>Rejected Bidder(s):</div><div><strong>Third Co</strong></div><div>Bid price at opening</div><div>USD 7</div><div>Evaluated Bid Price</div><div>Reason for rejection</div><div>INR 3</div>",
    )
    # pages are far larger than the rows that they are made from, which lie in few files
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    rows = bank.read_notices(orders.select(F.col("o_orderkey").alias("id"), html.alias("html")))
    return rows.select("id", "project_id", "ref", "version", "signed_on", F.inline("bidders"))
