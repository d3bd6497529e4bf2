"""Entities of organisation names by joins: the same as the fold of a block in order of frequency, in many tasks.

Two names can merge only if each token of either has one like it on the other. So a pair is found at a name's rarest token:
it meets the names that have a token like that one. Tokens like each other are found among the different tokens, by their
rarest pairs of letters. Which normal forms become entities is settled in rounds: a form with an entity among the earlier
ones that it may merge with is none, one whose earlier ones are all none is one. Entities' candidates for review are
looked for in tiles of the entities before them, near the front first, since an equal score counts for the earlier one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from orefield.operators.entities import BETWEEN, MERGE_FROM, OWN_TOKEN_CAP, REVIEW_FROM, TYPO_LENGTH, _alike, first_token, normalise, pair_score, score
from orefield.storage import delete, scratch, written

#: Entities compared with as many others in one group.
TILE = 256


class _Kept:
    """Tables written on the way, deleted at the end but for the result."""

    def __init__(self, spark):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        self.paths.append(scratch(self.spark, "entities"))
        return written(df, self.paths[-1])

    def result(self, df: DataFrame) -> DataFrame:
        out = written(df, scratch(self.spark, "entities"))
        delete(self.spark, *self.paths)
        return out


@F.pandas_udf(BooleanType())
def _tokens_alike(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_alike(x, y) for x, y in zip(a, b)], dtype=bool)


def alike_tokens(tokens: DataFrame) -> DataFrame:
    """(token, other): tokens like each other, both ways, and each with itself. tokens: distinct, in a column `token`.

    A misspelling keeps a share of its pairs of letters (with the ends marked): of a token of n letters at most
    2 * (n // 3) + (n % 3 == 2) of n + 1 go. So two that are alike have one in common among as many of each one's
    rarest, and one more.
    """
    marked = F.concat(F.lit("^"), "token", F.lit("$"))
    pairs = tokens.where(F.length("token") >= TYPO_LENGTH).select("token", F.length("token").alias("n"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length("token") + 1), lambda i: F.substring(marked, i, F.lit(2)))).alias("at", "gram"))
    # a pair that a token has twice counts as two
    numbered = pairs.withColumn("k", F.row_number().over(W.partitionBy("token", "gram").orderBy("at"))).select("token", "n", F.concat("gram", F.col("k").cast("string")).alias("gram"))
    rarity = numbered.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(W.partitionBy("token").orderBy("df", "gram"))
    lost = 2 * F.floor(F.col("n") / 3) + (F.col("n") % 3 == 2).cast("int")
    prefix = numbered.join(rarity, "gram").withColumn("place", place).where(F.col("place") <= lost + 1).select("gram", "token", "n")
    other = prefix.select("gram", F.col("token").alias("other"), F.col("n").alias("m"))
    near = (F.greatest("n", "m") - F.least("n", "m")) * 5 <= F.col("n") + F.col("m")
    met = prefix.join(other, "gram").where((F.col("token") < F.col("other")) & near).select("token", "other").distinct()
    found = met.where(_tokens_alike("token", "other"))
    itself = tokens.select("token", F.col("token").alias("other"))
    return found.union(found.select("other", "token")).union(itself)


def alike_pairs(forms: DataFrame) -> DataFrame:
    """(state, head, norm, other, score) of forms of one block all of whose tokens have one like them, from REVIEW_FROM on.

    forms: (state, norm), distinct. Each form meets others at the token that has the fewest forms around it.
    """
    flat = F.regexp_replace("norm", r" \| ", " ")
    held = forms.select("state", "norm", first_token(F.col("norm")).alias("head"), F.explode(F.array_distinct(F.split(flat, " "))).alias("token"))
    like = alike_tokens(held.select("token").distinct())
    around = held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("token", "other")
    crowd = like.join(around, "other").groupBy("token").agg(F.sum("n").alias("crowd"))
    rarest = held.join(crowd, "token").groupBy("state", "head", "norm").agg(F.min(F.struct("crowd", "token"))["token"].alias("token"))
    asked = rarest.join(like, "token").select("state", "head", "norm", F.col("other").alias("token"))
    there = held.select("state", "head", F.col("norm").alias("other"), "token")
    met = asked.join(there, ["state", "head", "token"]).where("norm <> other").select("state", "head", F.least("norm", "other").alias("norm"), F.greatest("norm", "other").alias("other")).distinct()
    scored = met.withColumn("score", pair_score("norm", "other")).where(F.col("score") >= REVIEW_FROM)
    return scored.union(scored.select("state", "head", F.col("other").alias("norm"), F.col("norm").alias("other"), "score"))


def _settle(forms: DataFrame, edges: DataFrame, kept: _Kept) -> DataFrame:
    """(state, norm, rank) of the forms that become entities. forms: (state, norm, rank); edges: (state, norm, other) of
    forms that may merge, other the earlier one."""
    spread = edges.select("state", "norm").distinct()
    entities = [forms.join(spread, ["state", "norm"], "left_anti").select("state", "norm", "rank")]
    open_ = kept(forms.join(spread, ["state", "norm"], "left_semi").select("state", "norm", "rank"))
    left = kept(edges)
    new = kept(entities[0])
    while not open_.isEmpty():
        # with an entity before it a form is none; what it would have been asked for is asked no more
        hit = left.join(new.select("state", F.col("norm").alias("other")), ["state", "other"], "left_semi").select("state", "norm").distinct()
        none = kept(open_.join(hit, ["state", "norm"], "left_semi"))
        gone = none.select("state", F.col("norm").alias("other"))
        left = kept(left.join(none, ["state", "norm"], "left_anti").join(gone, ["state", "other"], "left_anti"))
        open_ = open_.join(none, ["state", "norm"], "left_anti")
        new = kept(open_.join(left.select("state", "norm").distinct(), ["state", "norm"], "left_anti"))
        entities.append(new)
        open_ = kept(open_.join(new, ["state", "norm"], "left_anti"))
    out = entities[0]
    for e in entities[1:]:
        out = out.union(e)
    return kept(out)


def _first_candidates(entities: DataFrame, kept: _Kept) -> DataFrame:
    """(state, norm, score, other): of each entity the best-scoring earlier one of its block that has a token of its own, or
    that it has one against; entities: (state, norm, rank).

    Such a score is OWN_TOKEN_CAP at most, and the earliest that reaches it is the best. So an entity is compared with the
    first tile of its block, then with the next 1, 2, 4, ..., until one has reached it.
    """
    block = W.partitionBy("state", "head").orderBy("rank")
    placed = kept(entities.withColumn("head", first_token(F.col("norm"))).withColumn("place", F.row_number().over(block) - 1).withColumn("tile", F.floor(F.col("place") / TILE)))
    most = placed.agg(F.max("tile")).first()[0]
    found, pending, lo, hi = [], placed, 0, 1
    kind = "state string, norm string, score double, place int, other string"

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        before = rows[~rows["asks"]].sort_values("place")
        out = []
        for r in rows[rows["asks"]].itertuples():
            best, value, at = None, 0.0, -1
            for place, norm in zip(before["place"], before["norm"]):
                if place >= r.place or value >= OWN_TOKEN_CAP:
                    break
                s = min(score(r.norm, norm), OWN_TOKEN_CAP)
                if s > value:
                    best, value, at = norm, s, place
            if value >= REVIEW_FROM:
                out.append((r.state, r.norm, value, at, best))
        return pd.DataFrame(out, columns=["state", "norm", "score", "place", "other"])

    while most is not None and lo <= most:
        tiles = placed.where((F.col("tile") >= lo) & (F.col("tile") < hi))
        asks = pending.where(F.col("tile") >= lo).withColumn("with", F.explode(F.sequence(F.lit(lo).cast("long"), F.least(F.col("tile"), F.lit(hi - 1).cast("long")))))
        asks = asks.select("state", "head", "norm", "place", "with", F.col("tile").alias("part"), F.lit(True).alias("asks"))
        parts = asks.select("state", "head", "with", "part").distinct()
        there = tiles.select("state", "head", "norm", "place", F.col("tile").alias("with")).join(parts, ["state", "head", "with"]).select("state", "head", "norm", "place", "with", "part", F.lit(False).alias("asks"))
        got = asks.unionByName(there).groupBy("state", "head", "with", "part").applyInPandas(compare, kind)
        best = F.min(F.struct((-F.col("score")).alias("less"), "place", "other"))
        got = kept(got.groupBy("state", "norm").agg(best.alias("b")).select("state", "norm", (-F.col("b.less")).alias("score"), F.col("b.place").alias("place"), F.col("b.other").alias("other")))
        found.append(got)
        pending = kept(pending.join(got.where(F.col("score") >= OWN_TOKEN_CAP), ["state", "norm"], "left_anti"))
        lo, hi = hi, 2 * hi
    if not found:
        return placed.select("state", "norm", F.lit(0.0).alias("score"), F.lit(0).alias("place"), F.col("norm").alias("other")).limit(0)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.groupBy("state", "norm").agg(F.min(F.struct((-F.col("score")).alias("less"), "place", "other")).alias("b")).select("state", "norm", (-F.col("b.less")).alias("score"), F.col("b.place").alias("place"), F.col("b.other").alias("other"))


def resolve(names: DataFrame) -> DataFrame:
    """(name, state, entity, method, score, candidate): what entities.resolve() gives, without a group for each block.

    names: (name, state, n), one row per name. States must not be null.
    """
    kept = _Kept(names.sparkSession)
    ranked = kept(names.withColumn("norm", normalise(F.col("name"))).withColumn("rank", F.struct((-F.col("n")).alias("less"), "name")))
    forms = kept(ranked.groupBy("state", "norm").agg(F.min("rank").alias("rank")))
    named = forms.select("state", "norm", "rank")
    pairs = kept(alike_pairs(forms.where("norm <> ''").select("state", "norm")))
    rank_of = lambda c, r: named.select("state", F.col("norm").alias(c), F.col("rank").alias(r))
    merging = pairs.where(F.col("score") >= MERGE_FROM)
    earlier = merging.join(rank_of("norm", "own"), ["state", "norm"]).join(rank_of("other", "before"), ["state", "other"]).where("before < own").select("state", "norm", "other")
    entities = _settle(forms, earlier, kept)
    # a name goes to its form's entity, or to the best of those that were there before it
    own = ranked.join(entities.select("state", "norm", F.col("rank").alias("made")), ["state", "norm"], "left")
    exact = own.where("made is not null").select("name", "state", "norm", F.col("made.name").alias("entity"), F.when(F.col("rank") == F.col("made"), "new").otherwise("exact").alias("method"), F.lit(100.0).alias("score"))
    made = entities.select("state", F.col("norm").alias("other"), F.col("rank").alias("made"))
    ways = merging.select("state", "norm", "other", "score").join(made, ["state", "other"])
    best = F.min(F.struct((-F.col("score")).alias("less"), "made"))
    fuzzy = own.where("made is null").drop("made").join(ways, ["state", "norm"]).where("made < rank").groupBy("name", "state", "norm").agg(best.alias("b"))
    fuzzy = fuzzy.select("name", "state", "norm", F.col("b.made.name").alias("entity"), F.lit("fuzzy").alias("method"), (-F.col("b.less")).alias("score"))
    # candidates of those that are new: all tokens paired, or else a token of their own
    hinted = pairs.join(entities.select("state", "norm", F.col("rank").alias("own")), ["state", "norm"]).join(made, ["state", "other"]).where("made < own").select("state", "norm", "score", "made")
    capped = _first_candidates(entities, kept).select("state", "norm", "score", "other").join(made, ["state", "other"]).select("state", "norm", "score", "made")
    every = hinted.unionByName(capped).groupBy("state", "norm").agg(best.alias("b")).select("state", "norm", F.col("b.made.name").alias("candidate"))
    new = exact.where("method = 'new'").join(every, ["state", "norm"], "left")
    rest = exact.where("method <> 'new'").unionByName(fuzzy).withColumn("candidate", F.lit(None).cast("string"))
    columns = ["name", "state", "entity", "method", "score", "candidate"]
    return kept.result(new.select(*columns).union(rest.select(*columns)))
