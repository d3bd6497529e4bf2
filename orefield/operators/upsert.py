"""Idempotent conditional upserts, quarantine and reconciliation, as joins over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEW, UPDATED, UNCHANGED = "new", "updated", "unchanged"


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the row that comes last by `order`; rows alike in it are told apart by all their columns."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*order, *(c for c in rest if c not in order))
    best = df.groupBy(*keys).agg(F.max(ranked).alias("__best"))
    return best.select(*keys, *(F.col("__best")[c].alias(c) for c in rest))


def upsert(snapshot: DataFrame, batch: DataFrame, keys: list[str], hash_col: str = "content_hash", at: str = "fetched_at", keep_known: tuple[str, ...] = ()) -> DataFrame:
    """The new snapshot with `outcome`.

    snapshot: keys, payload, hash, fetched time, first_seen, last_seen. batch: the same without the last two, one row
    per key. A stored row changes only if the content differs and the batch isn't older; last_seen only moves forward;
    columns in keep_known keep a stored value where the batch has none. Both sides are joined on the key once.
    """
    s, b = snapshot.alias("s"), batch.alias("b")
    joined = s.join(b, [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full_outer")
    is_new, absent = F.col(f"s.{at}").isNull(), F.col(f"b.{at}").isNull()
    change = ~absent & ~is_new & ~F.col(f"s.{hash_col}").eqNullSafe(F.col(f"b.{hash_col}")) & (F.col(f"s.{at}") <= F.col(f"b.{at}"))
    take = is_new | change
    payload = [c for c in batch.columns if c not in keys]

    def value(c: str) -> Column:
        new = F.coalesce(f"b.{c}", f"s.{c}") if c in keep_known else F.col(f"b.{c}")
        return F.when(take, new).otherwise(F.col(f"s.{c}")).alias(c)

    outcome = F.when(absent, F.lit(None).cast("string")).when(is_new, NEW).when(change, UPDATED).otherwise(UNCHANGED)
    return joined.select(
        *(F.coalesce(f"b.{k}", f"s.{k}").alias(k) for k in keys), *(value(c) for c in payload),
        F.coalesce("s.first_seen", f"b.{at}").alias("first_seen"), F.greatest("s.last_seen", f"b.{at}").alias("last_seen"), outcome.alias("outcome"),
    )


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(rows.dropDuplicates(keys).join(target, keys, "left_anti"))


def tender_errors() -> Column:
    """What is wrong with a tender record, as an array of (field, error); empty if nothing is.

    Missing values are found first; rules across fields are asked only of records that are complete.
    """
    err = lambda cond, field, text: F.when(cond, F.struct(F.lit(field).alias("field"), F.lit(text).alias("error")))
    stage1 = F.array_compact(F.array(err(F.col("published_at").isNull(), "published_at", "required"), err(F.col("closes_at").isNull(), "closes_at", "required")))
    stage2 = F.array_compact(F.array(
        err(F.coalesce(F.length(F.trim("buyer")), F.lit(0)) == 0, "buyer", "required"), err(F.col("value_inr") < 0, "value_inr", "negative"),
        err(F.col("closes_at") < F.col("published_at"), "__all__", "closes before it is published"),
    ))
    return F.when(F.size(stage1) > 0, stage1).otherwise(stage2)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined with errors)."""
    marked = df.withColumn("errors", tender_errors())
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def reconcile(outcomes: DataFrame, run: str = "run_id", outcome: str = "outcome") -> DataFrame:
    """Per run: how many items had each outcome, how many are accounted for, what is wrong, and its status."""
    n = lambda v: F.count_if(F.col(outcome) == v)
    counts = outcomes.groupBy(run).agg(
        F.count(F.lit(1)).alias("planned"), n("new").alias("new"), n("updated").alias("updated"), n("unchanged").alias("unchanged"), n("quarantined").alias("quarantined"), n("failed").alias("failed"),
    )
    done = F.col("new") + F.col("updated") + F.col("unchanged") + F.col("quarantined") + F.col("failed")
    problems = F.array_compact(F.array(F.when(F.col("failed") > 0, "failed items"), F.when(F.col("quarantined") > 0, "quarantined items"), F.when(F.col("accounted") < F.col("planned"), "unaccounted items")))
    counts = counts.withColumn("accounted", done).withColumn("problems", problems)
    return counts.withColumn("status", F.when(F.col("accounted") < F.col("planned"), "incomplete").when(F.size("problems") > 0, "partial").otherwise("ok"))
