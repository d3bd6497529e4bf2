"""Entities by joins against the fold in order of frequency, and tokens alike against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from orefield.operators import entities, entity_join
from orefield.operators.entities import _alike
from orefield.plans.text import er_names

SF = "/root/testdata/sf0.001"


def made_names(n, seed):
    draw = random.Random(seed)
    orgs = ["Public Works Dept", "PWD", "Municipal Corporation", "Municipal Corp", "Nagar Nigam", "Jal Board", "Jal Bord", "Department of Health", "Office of the Department", "Department"]
    places = ["Bhopal", "Bhopaal", "Indore", "Indoore", "Raipur", "Ujjain", "Division No 1", "Division No 2", "Divison No 1", "Executive Engineer", "Exceutive Engineer", "Circle North", "circle, north", ""]
    wings = ["Engineering Wing", "Enginering Wing", "Health Wing", "Store", "Stores", ""]
    out = {}
    for _ in range(n):
        name = f"{draw.choice(orgs)} {draw.choice(places)}".strip()
        if draw.random() < 0.6:
            name += f" || {draw.choice(wings)} {draw.choice(places)}"
        out[name] = (name, draw.choice(["A", "B", ""]), draw.randrange(1, 9))
    return list(out.values())


def rows(df):
    return sorted(((r["name"], r["state"], r["entity"], r["method"], round(r["score"], 6), r["candidate"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_the_fold(spark, seed, monkeypatch):
    monkeypatch.setattr(entity_join, "TILE", 8)
    df = spark.createDataFrame(made_names(400, seed), "name string, state string, n long")
    got = rows(entity_join.resolve(df))
    assert got == rows(entities.resolve(df))
    assert {r[3] for r in got} == {"new", "exact", "fuzzy"} and any(r[5] for r in got)


def test_names_of_the_tables(spark):
    df = er_names(spark, SF)
    assert rows(entity_join.resolve(df)) == rows(entities.resolve(df))


def test_few_names_or_none(spark):
    kind = "name string, state string, n long"
    assert rows(entity_join.resolve(spark.createDataFrame([], kind))) == []
    for given in ([("PWD", "A", 1)], [("", "A", 2), ("...", "A", 1), ("of the", "B", 1)], [("Same Name", "A", 1), ("same name", "A", 1), ("SAME, NAME", "B", 5)]):
        df = spark.createDataFrame(given, kind)
        assert rows(entity_join.resolve(df)) == rows(entities.resolve(df))


def test_tokens_alike_are_all_found(spark):
    draw = random.Random(6)
    words = {"".join(draw.choice("abcdeino") for _ in range(draw.randrange(1, 13))) for _ in range(250)}
    for w in list(words):
        for _ in range(3):
            i = draw.randrange(len(w))
            words |= {w[:i] + w[i + 1 :], w[:i] + draw.choice("abz") + w[i:], w[:i] + draw.choice("abz") + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :], w + w[:2]}
    words.discard("")
    got = {tuple(r) for r in entity_join.alike_tokens(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    assert got == {(a, b) for a in words for b in words if _alike(a, b)}


def test_a_hot_block_is_many_groups(spark, monkeypatch):
    """Names of one block go to groups of a tile each."""
    monkeypatch.setattr(entity_join, "TILE", 20)
    df = spark.range(150).select(F.concat(F.lit("Department Wing "), F.conv(F.col("id") * 7919, 10, 26)).alias("name"), F.lit("A").alias("state"), F.lit(1).cast("long").alias("n"))
    assert rows(entity_join.resolve(df)) == rows(entities.resolve(df))
