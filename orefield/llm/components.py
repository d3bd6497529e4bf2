"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import discard, materialize

#: The steps halve distances, so this many rounds are never needed; more means that something else is wrong.
MOST_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("m").alias("u"), "v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: u < v. Every node's smaller neighbours, and itself, go to the least of them."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.union(least.select(F.col("m").alias("u"), "v")).distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge; a component's name is its least node. Loops are ignored.

    Minima are taken per task before the shuffle, so a hub costs no more than its edges; each round's edges are
    written to the shared folder, which cuts the lineage.
    """
    now = edges.select(F.least(u, v).alias("u"), F.greatest(u, v).alias("v")).where("u < v").distinct()
    now, before = materialize(now, "edges"), None
    for _ in range(MOST_ROUNDS):
        # an edge table of stars has each node once as v, and no centre among them
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == before:
            break
        before = state
        last, now = now, materialize(_small_star(_large_star(now)), "edges")
        discard(last)
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()
