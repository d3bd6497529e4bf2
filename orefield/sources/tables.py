"""The landed tables, and the tender view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment at which queries about open tenders are asked; nothing here reads the clock.
AS_OF = "2001-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buyers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A buyer with its state (nation) and the source (region) that publishes it."""
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("buyer"), F.col("n_name").alias("state"), F.col("r_name").alias("source"),
        F.col("c_mktsegment").alias("sector"), (110000 + F.col("c_custkey") * 37 % 700000).cast("string").alias("pincode"),
    )


def tenders(spark: SparkSession, sf_dir: str, closing: bool = True) -> DataFrame:
    """One row per tender. Closing times come from one pre-aggregated shuffle on the order key, joined on that key; what
    doesn't ask when tenders close does without."""
    orders = table(spark, sf_dir, "orders")
    if closing:
        closes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("closes_at"))
        orders = orders.join(closes, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    joined = orders.join(buyers(spark, sf_dir), F.col("o_custkey") == F.col("buyer_id"))
    return joined.select(
        F.col("o_orderkey").alias("id"), "buyer_id", "buyer", "state", "source", "sector", F.col("o_orderpriority").alias("category"), "pincode",
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("decimal(18,2)").alias("value_inr"), F.col("o_orderdate").alias("published_at"), *(["closes_at"] if closing else []),
    )


#: The same view for DuckDB.
TENDER_SQL = """tender AS (
  SELECT o_orderkey AS id, c_custkey AS buyer_id, c_name AS buyer, n_name AS state, r_name AS source, c_mktsegment AS sector,
    o_orderpriority AS category, CAST(110000 + c_custkey * 37 % 700000 AS VARCHAR) AS pincode, o_orderstatus AS status,
    CAST(o_totalprice AS DECIMAL(18,2)) AS value_inr, o_orderdate AS published_at, closes_at
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS closes_at FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
)"""


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Award facts: what was paid for a part against its list price, with supplier and year."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    award, estimate = F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice")
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_type", "p_brand", award.alias("award_value"), estimate.alias("estimated_value"),
        F.try_divide(award, estimate).alias("raw_ratio"), F.year("l_shipdate").alias("year"), F.col("l_shipdate").alias("award_date"),
    )


AWARD_SQL = """award AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_type, p_brand, l_extendedprice AS award_value, l_quantity * p_retailprice AS estimated_value,
    l_extendedprice / nullif(l_quantity * p_retailprice, 0) AS raw_ratio, year(l_shipdate) AS year, l_shipdate AS award_date
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""
