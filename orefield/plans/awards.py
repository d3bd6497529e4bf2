"""Queries over award facts: ratios, admission, rules, real amounts, markets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.operators import prices, rules
from orefield.sources.tables import AWARD_SQL, awards

SQL: dict[str, str] = {}
QUERIES = {}
WITH = f"WITH {AWARD_SQL} "
#: The band of believable ratios of award to estimate.
RATIO_MIN, RATIO_MAX = 0.2, 3.0
IN_BAND = f"raw_ratio BETWEEN {RATIO_MIN} AND {RATIO_MAX}"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return keep


def banded(ratio=None):
    ratio = F.col("raw_ratio") if ratio is None else ratio
    return F.when(ratio.between(RATIO_MIN, RATIO_MAX), F.bround(ratio, 6))


@query(WITH + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN {IN_BAND} THEN round_even(raw_ratio, 6) END AS ratio, CASE WHEN {IN_BAND} THEN round(ln(raw_ratio), 9) END AS log_ratio FROM award")
def ratio_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-14, NUM-04."""
    ok = F.col("raw_ratio").between(RATIO_MIN, RATIO_MAX)
    return awards(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", banded().alias("ratio"), F.when(ok, F.round(F.ln("raw_ratio"), 9)).alias("log_ratio"))


#: Reject reasons in order: the first that holds is the row's.
def reject_reason():
    return (
        F.when(F.coalesce(F.col("estimated_value"), F.lit(0)) <= 0, "no_estimate").when(F.coalesce(F.col("award_value"), F.lit(0)) <= 0, "no_award")
        .when(F.col("award_value") >= 90_000, "implausible_amount").when(F.col("raw_ratio") < RATIO_MIN, "ratio_low").when(F.col("raw_ratio") > RATIO_MAX, "ratio_high")
        .when(F.col("year") < 1996, "before_since").otherwise("kept")
    )


@query(WITH + f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(estimated_value, 0) <= 0 THEN 'no_estimate' WHEN coalesce(award_value, 0) <= 0 THEN 'no_award' WHEN award_value >= 90000 THEN 'implausible_amount'
WHEN raw_ratio < {RATIO_MIN} THEN 'ratio_low' WHEN raw_ratio > {RATIO_MAX} THEN 'ratio_high' WHEN year < 1996 THEN 'before_since' ELSE 'kept' END AS reason FROM award) GROUP BY reason""")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-18."""
    return awards(spark, sf_dir).groupBy(reject_reason().alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(WITH + """SELECT l_partkey, n, winner, winner_n, total FROM (SELECT l_partkey, l_suppkey AS winner, count(*) AS winner_n, sum(count(*)) OVER (PARTITION BY l_partkey) AS n,
CAST(sum(CAST(sum(CAST(award_value AS DECIMAL(18,2))) AS DECIMAL(28,2))) OVER (PARTITION BY l_partkey) AS DOUBLE) AS total,
row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, min(award_date), l_suppkey) AS k FROM award GROUP BY l_partkey, l_suppkey) WHERE k = 1""")
def award_group_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-15: per group the most common winner, of equal ones the first seen; two aggregations, no window."""
    pairs = awards(spark, sf_dir).groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("m"), F.min("award_date").alias("first"), F.sum(F.col("award_value").cast("decimal(18,2)")).alias("v"))
    best = F.min(F.struct(-F.col("m"), "first", "l_suppkey", "m"))
    return pairs.groupBy("l_partkey").agg(F.sum("m").alias("n"), best.alias("b"), F.sum("v").cast("double").alias("total")).select("l_partkey", "n", F.col("b.l_suppkey").alias("winner"), F.col("b.m").alias("winner_n"), "total")


@query(WITH + """SELECT l_suppkey, l_partkey, award_date, l_orderkey FROM award QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY award_date DESC, l_orderkey DESC, l_partkey DESC) = 1""")
def latest_notice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-16, AGG-28."""
    best = F.max(F.struct("award_date", "l_orderkey", "l_partkey"))
    return awards(spark, sf_dir).groupBy("l_suppkey").agg(best.alias("b")).select("l_suppkey", "b.l_partkey", "b.award_date", "b.l_orderkey")


_BELOW = "round_even((1.0 - raw_ratio) * 100, 0)"


@query(WITH + f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN {_BELOW} <= 10 THEN 0.0::DOUBLE WHEN {_BELOW} < 20 THEN round_even(0.1::DOUBLE * ({_BELOW} - 10), 2) ELSE round_even(1.0::DOUBLE + 0.2::DOUBLE * ({_BELOW} - 20), 2) END AS aps_percent
FROM award WHERE {IN_BAND}""")
def aps_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-02, NUM-05."""
    kept = awards(spark, sf_dir).where(F.col("raw_ratio").between(RATIO_MIN, RATIO_MAX))
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rules.additional_security_percent(F.col("raw_ratio")).alias("aps_percent"))


@query(WITH + f"""SELECT year, count(*) AS n, quantile_cont(raw_ratio, 0.25) AS p25, quantile_cont(raw_ratio, 0.5) AS median, quantile_cont(raw_ratio, 0.75) AS p75 FROM award WHERE {IN_BAND} GROUP BY year""")
def market_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market by year (specified only): exact interpolated quartiles of the ratios."""
    kept = awards(spark, sf_dir).where(F.col("raw_ratio").between(RATIO_MIN, RATIO_MAX))
    found = kept.groupBy(F.col("year").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.percentile("raw_ratio", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("v"))
    return found.select("year", "n", *(F.col("v")[k].alias(c) for k, c in enumerate(("p25", "median", "p75"))))


@query(WITH + f"""SELECT p_brand, q * 0.05 AS q, quantile FROM (SELECT p_brand, unnest([1, 10, 19]) AS q, unnest(quantile_cont(raw_ratio, [0.05, 0.5, 0.95])) AS quantile FROM award WHERE {IN_BAND} GROUP BY p_brand)""".replace("q * 0.05 AS q", "CAST(q AS BIGINT) AS q"))
def ratio_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-04: quantiles of the ratio per group, three of the nineteen."""
    kept = awards(spark, sf_dir).where(F.col("raw_ratio").between(RATIO_MIN, RATIO_MAX))
    found = kept.groupBy("p_brand").agg(F.percentile("raw_ratio", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("v"))
    return found.select("p_brand", F.explode(F.arrays_zip(F.array(F.lit(1).cast("long"), F.lit(10).cast("long"), F.lit(19).cast("long")).alias("q"), F.col("v").alias("quantile"))).alias("z")).select("p_brand", "z.q", "z.quantile")


#: The nineteen quantiles, .05 to .95.
QUANTILES = [k / 20 for k in range(1, 20)]


@query(WITH + f"""SELECT p_brand, unnest(range(1, 20)) AS q, unnest(quantile_cont(raw_ratio, {QUANTILES!r})) AS quantile FROM award WHERE {IN_BAND} GROUP BY p_brand""")
def ratio_quantiles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-04: all nineteen quantiles of the ratio per group."""
    kept = awards(spark, sf_dir).where(F.col("raw_ratio").between(RATIO_MIN, RATIO_MAX))
    found = kept.groupBy("p_brand").agg(F.percentile("raw_ratio", F.array(*map(F.lit, QUANTILES))).alias("v"))
    return found.select("p_brand", F.posexplode("v").alias("k", "quantile")).select("p_brand", (F.col("k") + 1).cast("long").alias("q"), "quantile")


#: A small literal price index: consumer prices of India, rupees and euros per dollar; 1999 of the euro is missing.
INDEX = [("cpi", "IN", y, 50.0 + 5 * (y - 1995)) for y in range(1995, 2000)] + [("fx", "IN", y, 35.0 + y - 1995) for y in range(1995, 2000)] + [("fx", "XC", y, 0.8 + 0.02 * (y - 1995)) for y in range(1996, 2001) if y != 1999]
_INDEX_SQL = "idx(series, country, year, value) AS (VALUES " + ", ".join(f"('{s}', '{c}', {y}, {v}::DOUBLE)" for s, c, y, v in INDEX) + ")"
_EXT_SQL = """l AS (SELECT series, country, max(year) AS last, arg_max(value, year) AS v FROM idx GROUP BY ALL),
b AS (SELECT i.series, i.country, min(i.year) AS y0, arg_min(i.value, i.year) AS v0 FROM idx i JOIN l USING (series, country) WHERE i.year >= last - 3 AND i.year < last AND i.value > 0 GROUP BY ALL),
ext AS (SELECT * FROM idx UNION ALL SELECT series, country, y, v * pow(coalesce(pow(v / v0, 1.0 / (last - y0)), 1.0), y - last) FROM l LEFT JOIN b USING (series, country), LATERAL (SELECT unnest(range(last + 1, 2003)) AS y))"""


@query(f"""WITH {AWARD_SQL}, {_INDEX_SQL}, {_EXT_SQL}, a AS (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'INR' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency FROM award)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, currency, round(round(CASE currency WHEN 'INR' THEN award_value WHEN 'USD' THEN award_value * i.value ELSE award_value / x.value * i.value END * (SELECT value FROM ext WHERE series = 'cpi' AND year = 2002) / c.value, 2), 0) AS inr_real
FROM a LEFT JOIN ext i ON i.series = 'fx' AND i.country = 'IN' AND i.year = greatest(a.year, 1995) LEFT JOIN ext x ON x.series = 'fx' AND x.country = 'XC' AND x.year = greatest(a.year, 1996)
LEFT JOIN ext c ON c.series = 'cpi' AND c.country = 'IN' AND c.year = greatest(a.year, 1995)""")
def deflate_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NUM-03, NUM-10, JON-14, WIN-05, SNK-15."""
    code = F.element_at(F.array(F.lit("INR"), F.lit("USD"), F.lit("EUR")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = awards(spark, sf_dir).withColumns({"currency": code, "country": F.lit("FR")})
    index = spark.createDataFrame(INDEX, "series string, country string, year int, value double")
    return prices.to_real(rows, index, 2002, "award_value").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "currency", F.round("inr_real", 0).alias("inr_real"))


@query(WITH + f"""SELECT key, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN raw_ratio < 0.8 THEN 'abnormally_low' END, CASE WHEN raw_ratio >= 0.8 AND raw_ratio < 0.9 THEN 'state_aps' END], lambda x: x IS NOT NULL)) AS key FROM award WHERE {IN_BAND}) GROUP BY key""")
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RUL-03: which rules bids in the band meet, as works of a state without a schedule of its own."""
    rows = awards(spark, sf_dir).where(F.col("raw_ratio").between(RATIO_MIN, RATIO_MAX)).select(
        F.lit("works").alias("category"), F.lit("open").alias("method"), F.lit("").alias("buyer"), F.lit("").alias("title"), F.lit("Kerala").alias("state"), F.lit("portal").alias("source"),
        F.lit("2026-02-01").cast("date").alias("on_date"), F.col("estimated_value").alias("estimated_value_inr"), F.lit(False).alias("is_mse"), F.lit(None).cast("boolean").alias("is_class1_local"), F.col("raw_ratio").alias("ratio"),
    )
    return rules.findings(rows).select(F.explode("findings").alias("f")).groupBy(F.col("f.key").alias("key")).agg(F.count(F.lit(1)).alias("n"))
