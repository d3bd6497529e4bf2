"""Filtering, facets, ordering and paging of tenders."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Half-open value ranges in rupees, in display order.
VALUE_BUCKETS = [("under_1l", None, 100_000), ("1l_10l", 100_000, 1_000_000), ("10l_1cr", 1_000_000, 10_000_000), ("over_1cr", 10_000_000, None)]
FACETS = ("state", "sector", "category", "source")
FACET_SIZE = 40
MOST_PER_PAGE = 100
ORDERINGS = ("closing", "newest", "value")


@dataclass(frozen=True)
class TenderQuery:
    """A conjunction of filters; an unset one doesn't restrict. Unknown values of a range never satisfy it."""

    state: str | None = None
    sector: str | None = None
    category: str | None = None
    source: str | None = None
    pin_prefix: str | None = None
    buyer_id: int | None = None
    min_value: float | None = None
    max_value: float | None = None
    closes_after: str | None = None
    closes_before: str | None = None

    def __post_init__(self):
        if self.pin_prefix is not None and not (self.pin_prefix.isdigit() and 2 <= len(self.pin_prefix) <= 6 and self.pin_prefix[0] != "0"):
            raise ValueError(f"not a PIN prefix: {self.pin_prefix!r}")
        if self.min_value is not None and self.max_value is not None and self.min_value > self.max_value:
            raise ValueError("min_value is over max_value")

    def terms(self) -> dict[str, Column]:
        when = lambda v: F.lit(v).cast("timestamp")
        made = {
            "state": lambda v: F.col("state") == v, "sector": lambda v: F.col("sector") == v, "category": lambda v: F.col("category") == v, "source": lambda v: F.col("source") == v,
            "pin_prefix": lambda v: F.col("pincode").startswith(v), "buyer_id": lambda v: F.col("buyer_id") == v,
            "min_value": lambda v: F.col("value_inr") >= v, "max_value": lambda v: F.col("value_inr") <= v,
            "closes_after": lambda v: F.col("closes_at") >= when(v), "closes_before": lambda v: F.col("closes_at") <= when(v),
        }
        return {f.name: made[f.name](getattr(self, f.name)) for f in fields(self) if getattr(self, f.name) is not None}

    def condition(self, skip: tuple[str, ...] = ()) -> Column:
        return reduce(lambda a, b: a & b, (c for n, c in self.terms().items() if n not in skip), F.lit(True))


def matching(df: DataFrame, query: TenderQuery, skip: tuple[str, ...] = ()) -> DataFrame:
    return df.where(query.condition(skip))


def facet_terms(df: DataFrame, field: str, size: int = FACET_SIZE) -> DataFrame:
    """(key, n): the most frequent values, the empty one left out; ties by key."""
    return df.where(F.col(field) != "").groupBy(F.col(field).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(size)


def _bucket_of(value: Column) -> Column:
    chain = None
    for name, low, high in VALUE_BUCKETS:
        inside = (value >= low if low is not None else F.lit(True)) & (value < high if high is not None else F.lit(True))
        chain = F.when(inside, name) if chain is None else chain.when(inside, name)
    return F.when(value.isNotNull(), chain)


def value_buckets(df: DataFrame) -> DataFrame:
    """(bucket, ord, n) in fixed order, with zeros: one pass of conditional counts, then one row per bucket."""
    counts = df.agg(*(F.count_if(_bucket_of(F.col("value_inr")) == name).alias(name) for name, _, _ in VALUE_BUCKETS))
    rows = F.array(*(F.struct(F.lit(name).alias("bucket"), F.lit(k).alias("ord"), F.col(name).alias("n")) for k, (name, _, _) in enumerate(VALUE_BUCKETS)))
    return counts.select(F.inline(rows))


def disjunctive_facets(df: DataFrame, query: TenderQuery, size: int = FACET_SIZE) -> DataFrame:
    """(facet, key, n): each facet counts what all other filters leave. One scan: a row is sent to the facets whose
    other filters it satisfies, and counted there before the shuffle."""
    everything = reduce(lambda a, b: a | b, (query.condition((f,)) for f in FACETS), query.condition(("min_value", "max_value")))
    sent = [F.when(query.condition((f,)) & (F.col(f) != ""), F.struct(F.lit(f).alias("facet"), F.col(f).alias("key"))) for f in FACETS]
    sent.append(F.when(query.condition(("min_value", "max_value")), F.struct(F.lit("value").alias("facet"), _bucket_of(F.col("value_inr")).alias("key"))))
    rows = df.where(everything).select(F.explode(F.array_compact(F.array(*sent))).alias("x")).select("x.*").where("key is not null")
    counts = rows.groupBy("facet", "key").agg(F.count(F.lit(1)).alias("n"))
    best = W.partitionBy("facet").orderBy(F.desc("n"), "key")
    return counts.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= size) | (F.col("facet") == "value")).drop("rank")


def ordered(df: DataFrame, by: str = "closing") -> DataFrame:
    """closing: soonest first; newest; value: highest first, unknown last. The identifier breaks ties."""
    keys = {
        "closing": [F.asc_nulls_last("closes_at"), "id"],
        "newest": [F.desc_nulls_last("published_at"), F.desc("id")],
        "value": [F.desc_nulls_last("value_inr"), F.asc_nulls_last("closes_at"), "id"],
    }
    return df.orderBy(*keys[by])


def page(df: DataFrame, number: int = 1, size: int = 20, by: str = "closing") -> DataFrame:
    size = max(1, min(size, MOST_PER_PAGE))
    return ordered(df, by).offset((max(1, number) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 20) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / size)).cast("long").alias("last_page"))
