"""Labelled pairs of names for judging entity resolution: known names with the changes that portals and officers make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orefield.operators.entities import first_token, normalise, pair_score
from orefield.operators.fulltext import _let

#: Words and what they are shortened to, and the kinds of change.
SHORTENED = [
    (r"\bDepartment\b", "Deptt."), (r"\bLimited\b", "Ltd"), (r"\bGovernment\b", "Govt."), (r"\bCorporation\b", "Corpn."),
    (r"\bDirectorate\b", "Dte."), (r"\bUniversity\b", "Univ."), (r"\bDistrict\b", "Distt."), (r"\bExecutive Engineer\b", "EE"),
]
KINDS = ("abbreviation", "punctuation", "upper_case", "office_of_prefix", "typo")
#: The least letters of a word that is misspelt.
TYPO_WORD = 7


def drawn(name: Column, what: str, n: Column | int, seed: int) -> Column:
    """A number from 0 to n - 1 that the name, the seed and what it is for decide."""
    return F.pmod(F.xxhash64(name, F.lit(what), F.lit(seed)), n if isinstance(n, Column) else F.lit(n))


def _shortened(name: Column, seed: int) -> Column:
    there = F.array_compact(F.array(*(F.when(name.rlike(p), F.lit(k)) for k, (p, _) in enumerate(SHORTENED))))
    made = lambda k: reduce(lambda a, x: F.when(k == x[0], F.regexp_replace(name, f"(?s)^(.*?){x[1][0]}", f"$1{x[1][1]}")).otherwise(a), enumerate(SHORTENED), F.lit(None).cast("string"))
    return _let(there, lambda x: F.when(F.size(x) > 0, _let(F.get(x, drawn(name, "word", F.greatest(F.size(x), F.lit(1)), seed).cast("int")), made)))


def _punctuated(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("-")), F.regexp_replace(name, r"\s*-\s*", " ")).otherwise(F.regexp_replace(name, r",\s*", " , "))


def _office_of(name: Column) -> Column:
    cut = F.instr(name, "||")
    return F.when(cut > 0, F.concat(F.substring(name, F.lit(1), cut - 1), F.lit("|| Office of the "), F.trim(F.substring(name, cut + 2, F.length(name)))))


def _misspelt(name: Column, seed: int) -> Column:
    """Two letters of a long word swapped, or one dropped; neither its first nor its last two."""
    words = F.regexp_extract_all(name, F.lit(f"([A-Za-z]{{{TYPO_WORD},}})"), F.lit(1))

    def changed(word: Column) -> Column:
        at = drawn(name, "letter", F.length(word) - 3, seed).cast("int") + 2
        head, a, b, tail = F.substring(word, F.lit(1), at - 1), F.substring(word, at, F.lit(1)), F.substring(word, at + 1, F.lit(1)), F.substring(word, at + 2, F.length(word))
        other = F.when(drawn(name, "how", 2, seed) == 0, F.concat(head, b, a, tail)).otherwise(F.concat(head, b, tail))
        start = F.instr(name, word)
        return F.concat(F.substring(name, F.lit(1), start - 1), other, F.substring(name, start + F.length(word), F.length(name)))

    return _let(words, lambda ws: F.when(F.size(ws) > 0, _let(F.get(ws, drawn(name, "which", F.greatest(F.size(ws), F.lit(1)), seed).cast("int")), changed)))


def perturbed(name: Column, kind: Column, seed: int = 7) -> Column:
    """The name with one change of a kind, the same whenever it is made; null where the change isn't possible or is none."""
    made = F.when(kind == KINDS[0], _shortened(name, seed)).when(kind == KINDS[1], _punctuated(name)).when(kind == KINDS[2], F.upper(name)).when(kind == KINDS[3], _office_of(name)).when(kind == KINDS[4], _misspelt(name, seed))
    return F.when(made != name, made)


def drawn_kind(name: Column, seed: int = 7) -> Column:
    return F.element_at(F.array(*map(F.lit, KINDS)), (drawn(name, "kind", len(KINDS), seed) + 1).cast("int"))


def labelled(names: DataFrame, name: str = "name", state: str = "state", kind: Column | None = None, seed: int = 7) -> DataFrame:
    """(name_a, name_b, source, note, same_entity, score): a name with its changed form, which is the same, and with the
    next name of its state and first word, which isn't. For names that are known to be different ones."""
    rows = names.select(F.col(name).alias("name_a"), F.col(state).alias("state"), (kind if kind is not None else drawn_kind(F.col(name), seed)).alias("note"))
    same = rows.withColumn("name_b", perturbed(F.col("name_a"), F.col("note"), seed)).where("name_b is not null").select("name_a", "name_b", F.lit("synthetic").alias("source"), "note", F.lit(1).alias("same_entity"))
    block = W.partitionBy("state", "head").orderBy("name_a")
    apart = rows.withColumn("head", first_token(normalise(F.col("name_a")))).withColumn("name_b", F.lead("name_a").over(block)).where("name_b is not null").select("name_a", "name_b", F.lit("neighbour").alias("source"), F.lit("").alias("note"), F.lit(0).alias("same_entity"))
    pairs = same.unionByName(apart)
    return pairs.withColumn("score", pair_score(normalise(F.col("name_a")), normalise(F.col("name_b"))))
