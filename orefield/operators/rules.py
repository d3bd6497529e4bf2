"""Procurement rules over tenders and bids, and the recommendation filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dates at which regimes change, thresholds in rupees, and the tiers of additional security.
TIERS_FROM, STATE_CAP_UNTIL = "2025-04-30", "2026-01-03"
STATE_FLOOR = 0.8501
LAKH = 100_000
MARKETPLACE_ABOVE, LOCAL_CONTENT_FROM = 10 * LAKH, 5 * LAKH
DEEP, HINT = 0.20, 0.10
GUARANTEE_RATE, GUARANTEE_YEARS = 0.015, 3.0
HIGHWAYS = r"(?i)ministry of road transport|\bmorth\b|\bnhai\b|national highways? authority|nhidcl|national highways? (?:and|&) infrastructure|\bnational highway\b|\bNH[- ]?\d"
MARKETPLACE = r"(?i)\bgem\b|government e-?marketplace"


def whole_percent_below(ratio: Column) -> Column:
    return F.bround((1.0 - ratio) * 100, 0)


def additional_security_percent(ratio: Column) -> Column:
    """Nothing to 10 % below the estimate, 0.1 % a point to 19 %, from 20 % on 1 % and 0.2 % a point."""
    below = whole_percent_below(ratio)
    return F.when(below <= 10, 0.0).when(below < 20, F.bround(0.1 * (below - 10), 2)).otherwise(F.bround(1.0 + 0.2 * (below - 20), 2))


def regime(category: Column, buyer: Column, title: Column, state: Column, day: Column) -> Column:
    """Which schedule of additional security binds: national highways, the state with a schedule of its own, or none."""
    works = F.coalesce(category, F.lit("")).isin("", "works")
    highways = F.concat_ws(" ", buyer, title).rlike(HIGHWAYS)
    return F.when(works & highways & (day >= F.lit(TIERS_FROM).cast("date")), "morth").when(works & (state == "Odisha") & (day >= F.lit(STATE_CAP_UNTIL).cast("date")), "odisha")


def security_cost(percent: Column) -> Column:
    return percent / 100 * GUARANTEE_RATE * GUARANTEE_YEARS


def floor_ratio(category: Column, state: Column, day: Column) -> Column:
    return F.when((state == "Odisha") & F.coalesce(category, F.lit("")).isin("", "works") & (day < F.lit(STATE_CAP_UNTIL).cast("date")), STATE_FLOOR)


def findings(df: DataFrame) -> DataFrame:
    """df with `findings`, an array of (key, severity), in a fixed order.

    df: category, method, buyer, title, state, source, on_date, estimated_value_inr, is_mse, is_class1_local, ratio
    (null where no bid is asked about).
    """
    c = F.col
    bound, floor = regime(c("category"), c("buyer"), c("title"), c("state"), c("on_date")), floor_ratio(c("category"), c("state"), c("on_date"))
    percent, bid = additional_security_percent(c("ratio")), c("ratio").isNotNull()
    deep = bid & (c("ratio") < 1 - DEEP)
    goods = c("category").isin("goods", "services")
    marketplace = (c("source") == "gem") | (c("method") == "reverse_auction") | F.coalesce(c("buyer"), F.lit("")).rlike(MARKETPLACE)
    rules = [
        ("qcbs", "warn", (c("category") == "consultancy") | (c("method") == "qcbs")),
        ("aps", "warn", bound.isNotNull() & bid & (percent > 0)),
        ("aps_free_band", "info", bound.isNotNull() & bid & (percent <= 0)),
        ("odisha_floor", "warn", floor.isNotNull()),
        ("odisha_cap_abolished", "info", floor.isNull() & (c("state") == "Odisha") & F.coalesce(c("category"), F.lit("")).isin("", "works")),
        ("abnormally_low", "warn", deep),
        ("state_aps", "info", ~deep & bid & (c("category") == "works") & bound.isNull() & (c("ratio") < 1 - HINT) & (F.coalesce(c("state"), F.lit("")) != "")),
        ("mse_preference", "info", goods),
        ("make_in_india", "info", goods & (c("estimated_value_inr") >= LOCAL_CONTENT_FROM) & ~c("is_class1_local").eqNullSafe(True)),
        ("reverse_auction", "info", marketplace & (c("estimated_value_inr") > MARKETPLACE_ABOVE)),
    ]
    made = [F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(key).alias("key"), F.lit(severity).alias("severity"))) for key, severity, cond in rules]
    return df.withColumn("findings", F.array_compact(F.array(*made)))


def recommended(tenders: DataFrame, tracked: DataFrame, as_of: str, states: list[str] = (), sectors: list[str] = (), cap: float | None = None) -> DataFrame:
    """Open tenders for a profile, with reasons; an empty list doesn't restrict, a tender of unknown value stays."""
    open_ = F.col("closes_at") > F.lit(as_of).cast("timestamp")
    kept = tenders.where(open_)
    for column, wanted in (("state", states), ("sector", sectors)):
        if wanted:
            kept = kept.where(F.col(column).isin(list(wanted)))
    if cap is not None:
        kept = kept.where(F.col("value_inr").isNull() | (F.col("value_inr") <= cap))
    because = F.array_compact(F.array(F.when(F.lit(bool(sectors)), F.concat(F.lit("sector: "), F.col("sector"))), F.when(F.lit(bool(states)), F.concat(F.lit("state: "), F.col("state"))), F.when(F.lit(cap is not None) & F.col("value_inr").isNotNull(), "within your size")))
    return kept.join(tracked, "id", "left_anti").withColumn("reasons", because)


def eligibility(df: DataFrame) -> DataFrame:
    """df with checks (turnover, similar_work, years) as met / not_met / unknown, and a verdict.

    df: required_* and own_* columns of the three. Nothing required is met; a requirement against nothing known is
    unknown; one unmet check decides, then one unknown.
    """
    check = lambda k: F.when(F.col(f"required_{k}").isNull(), "met").when(F.col(f"own_{k}").isNull(), "unknown").when(F.col(f"own_{k}") >= F.col(f"required_{k}"), "met").otherwise("not_met")
    checks = F.array(check("turnover"), check("similar_work"), check("years"))
    verdict = F.when(F.array_contains("checks", "not_met"), "not_eligible").when(F.array_contains("checks", "unknown"), "unknown").otherwise("eligible")
    return df.withColumn("checks", checks).withColumn("verdict", verdict)
