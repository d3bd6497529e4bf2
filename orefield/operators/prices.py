"""Amounts in real rupees: exchange rates and price indices, extended past their last year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many years before the last one give the growth that extends a series; shared currencies' areas.
GROWTH_YEARS = 3
AREAS = {"EUR": "XC"}
#: An index has a value for each country and year: 250 countries, two series, and 200 years at most.
MOST_VALUES = 100_000


def extended(index: DataFrame, until: int) -> DataFrame:
    """index (series, country, year, value) with years after each series' last one, grown at its recent mean rate.

    A gap inside a series stays one. The index is a small dimension: some hundred values per country.
    """
    last = index.groupBy("series", "country").agg(F.max("year").alias("last"), F.max_by("value", "year").alias("v"))
    prior = index.join(last, ["series", "country"]).where((F.col("year") >= F.col("last") - GROWTH_YEARS) & (F.col("year") < F.col("last")) & (F.col("value") > 0))
    base = prior.groupBy("series", "country").agg(F.min("year").alias("from"), F.min_by("value", "year").alias("v0"))
    joined = last.join(base, ["series", "country"], "left")
    growth = F.coalesce(F.pow(F.col("v") / F.col("v0"), F.lit(1.0) / (F.col("last") - F.col("from"))), F.lit(1.0))
    years = F.sequence(F.col("last") + 1, F.greatest(F.col("last"), F.lit(until)))
    more = joined.where(F.col("last") < until).select("series", "country", F.explode(years).alias("year"), F.col("last"), F.col("v"), growth.alias("g"))
    return index.select("series", "country", "year", "value").unionByName(more.select("series", "country", "year", (F.col("v") * F.pow("g", F.col("year") - F.col("last"))).alias("value")))


def upsert_index(index: DataFrame, batch: DataFrame) -> DataFrame:
    """One value per (series, country, year): the batch's, of several there the last by `ord`; else the stored one."""
    both = index.withColumn("ord", F.lit(-1)).unionByName(batch)
    return both.groupBy("series", "country", "year").agg(F.max_by("value", "ord").alias("value"))


def to_real(df: DataFrame, index: DataFrame, target: int, amount: str, currency: str = "currency", country: str = "country", year: str = "year", out: str = "inr_real") -> DataFrame:
    """df with `out`: the amount in rupees of the target year, or null where a rate or an index is missing.

    Years before a series' first one use its first value. The index has countries times years rows, a few thousand
    whatever df's size: it is extended once, on the driver's side of the plan, and joined three times by broadcast.
    """
    rows = extended(index, target).limit(MOST_VALUES + 1).collect()
    if len(rows) > MOST_VALUES:
        raise ValueError(f"an index of more than {MOST_VALUES} values is no dimension")
    full = F.broadcast(df.sparkSession.createDataFrame(rows, "series string, country string, year int, value double"))
    firsts: dict[tuple[str, str], int] = {}
    for r in rows:
        firsts[r["series"], r["country"]] = min(r["year"], firsts.get((r["series"], r["country"]), r["year"]))
    cpi_first, inr_first = firsts.get(("cpi", "IN")), firsts.get(("fx", "IN"))
    code = F.upper(F.coalesce(currency, F.lit("")))
    area = F.when(code.isin(list(AREAS)), F.create_map(*[F.lit(x) for kv in AREAS.items() for x in kv])[code]).otherwise(F.upper(country))
    fx_first = F.create_map(*[F.lit(x) for (s, c), y in firsts.items() if s == "fx" for x in (c, y)]) if any(s == "fx" for s, _ in firsts) else F.create_map(F.lit(""), F.lit(0))
    marked = df.withColumns({"__code": code, "__area": area}).withColumns({
        "__fy": F.greatest(F.col(year), fx_first[F.col("__area")]), "__iy": F.greatest(F.col(year), F.lit(inr_first)), "__cy": F.greatest(F.col(year), F.lit(cpi_first)),
    })
    pick = lambda series, name: full.where(F.col("series") == series).select(F.col("country").alias(f"{name}_c"), F.col("year").alias(f"{name}_y"), F.col("value").alias(name))
    rate, inr, cpi = pick("fx", "rate"), pick("fx", "inr").where("inr_c = 'IN'"), pick("cpi", "cpi").where("cpi_c = 'IN'")
    now = next((r["value"] for r in rows if (r["series"], r["country"], r["year"]) == ("cpi", "IN", target)), None)
    joined = marked.join(rate, (F.col("__area") == F.col("rate_c")) & (F.col("__fy") == F.col("rate_y")), "left").join(inr, F.col("__iy") == F.col("inr_y"), "left").join(cpi, F.col("__cy") == F.col("cpi_y"), "left")
    value = F.col(amount).cast("double")
    usd = F.when(F.col("__code") == "USD", value).otherwise(F.try_divide(value, F.col("rate")))
    rupees = F.when(F.col("__code") == "INR", value).otherwise(usd * F.when(F.col("inr") != 0, F.col("inr")))
    real: Column = F.round(rupees * F.try_divide(F.lit(now).cast("double"), F.col("cpi")), 2)
    return joined.withColumn(out, F.when(F.col(year).isNotNull(), real)).select(*df.columns, out)
