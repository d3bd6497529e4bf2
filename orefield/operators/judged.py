"""Answers judged by what they cite: status, the best quote for each citation, and figures over labelled questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions.scalars import cited_numbers
from orefield.operators.answers import ABSTAIN, cleaned, terms, units
from orefield.operators.documents import fact_key, facts_of, folded, grounding, sentences_of

#: What a shared value counts against a shared word, and how long a quote may be.
VALUE_WEIGHT, QUOTE_CHARS = 3, 300
ANSWERED, ABSTAINED, REJECTED = "answered", "abstained", "rejected"


def _values(text: str | Column) -> Column:
    return F.array_distinct(F.transform(facts_of(text), fact_key))


def claims_of(answers: DataFrame) -> DataFrame:
    """(answer_id, n, claim): for each passage that an answer cites, the sentences that do, in order."""
    cut = answers.select("answer_id", F.posexplode(sentences_of("answer")).alias("pos", "sentence"))
    cited = cut.select("answer_id", "pos", "sentence", F.explode(F.array_distinct(cited_numbers(F.col("sentence")))).alias("n"))
    said = F.sort_array(F.collect_list(F.struct("pos", "sentence")))
    return cited.groupBy("answer_id", "n").agg(F.array_join(F.transform(said, lambda x: x["sentence"]), " ").alias("claim"))


def best_quotes(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """(answer_id, n, quote): of a cited passage the sentence that shares most with the claim: values first, then words;
    of equal ones the first.

    claims: (answer_id, n, claim). passages: (answer_id, n, text). The two meet on their key; a passage's sentences are
    rows, of which the best is an aggregate.
    """
    asked = claims.select("answer_id", "n", _values("claim").alias("want_values"), terms(F.col("claim")).alias("want_terms"))
    told = passages.select("answer_id", "n", F.posexplode(units("text")).alias("pos", "sentence"))
    told = told.select("answer_id", "n", "pos", "sentence", _values("sentence").alias("values"), terms(F.col("sentence")).alias("terms"))
    both = told.join(asked, ["answer_id", "n"])
    score = VALUE_WEIGHT * F.size(F.array_intersect("want_values", "values")) + F.size(F.array_intersect("want_terms", "terms"))
    best = F.min_by("sentence", F.struct(-score, "pos"))
    return both.groupBy("answer_id", "n").agg(F.left(best, F.lit(QUOTE_CHARS)).alias("quote"))


def judged(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(answer_id, status, shown, citations) per answer: answered if all that it says stands in passages it cites, and it
    cites one; rejected otherwise, unless it refuses. citations: (n, quote) of an answered one; what isn't answered shows
    the standard refusal.

    answers: (answer_id, answer). passages: (answer_id, n, text), numbered as the answer cites them.
    """
    said = answers.select("answer_id", cleaned(F.coalesce("answer", F.lit(""))).alias("answer"))
    spoken = said.where(F.col("answer") != ABSTAIN)
    held = grounding(spoken, passages).select("answer_id", "ok")
    claims = claims_of(spoken)
    quoted = best_quotes(claims, passages)
    cited = quoted.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("n", "quote"))).alias("citations"))
    found = said.join(held, "answer_id", "left").join(cited, "answer_id", "left")
    status = F.when(F.col("answer") == ABSTAIN, ABSTAINED).when(F.col("ok") & F.col("citations").isNotNull(), ANSWERED).otherwise(REJECTED)
    none = F.array().cast("array<struct<n: int, quote: string>>")
    return found.select(
        "answer_id", status.alias("status"), F.when(status == ANSWERED, F.col("answer")).otherwise(ABSTAIN).alias("shown"),
        F.when(status == ANSWERED, F.col("citations").cast("array<struct<n: int, quote: string>>")).otherwise(none).alias("citations"),
    )


def values_match(expected: Column, answer: Column) -> Column:
    """Whether every value that is expected is in the answer; without values, whether the text is."""
    from pyspark.sql import types as T

    plain = F.pandas_udf(lambda s: s.fillna("").map(folded), T.StringType())
    want, have = _values(expected), _values(answer)
    return F.when(F.size(want) > 0, F.size(F.array_except(want, have)) == 0).otherwise(F.contains(plain(answer), plain(expected)))


def figures(results: DataFrame) -> DataFrame:
    """One row: questions, answerable, exact_match, grounding_rate, abstention_accuracy, false_abstentions, confident_wrong.

    results: (status, shown, answerable, expected). What isn't answered is an abstention; a rate over nothing is null.
    """
    answered, asked = F.col("status") == ANSWERED, F.col("answerable")
    right = values_match(F.col("expected"), F.col("shown"))
    n = F.count_if
    marked = results.select(asked.alias("asked"), answered.alias("answered"), (answered & asked & right).alias("right"))
    a, s, r = F.col("asked"), F.col("answered"), F.col("right")
    found = marked.agg(
        F.count(F.lit(1)).alias("questions"), n(a).alias("answerable"), n(r).alias("exact"), n(a & s).alias("told"), n(~a & ~s).alias("kept_back"), n(a & ~s).alias("false_abstentions"), n(s & ~r).alias("confident_wrong"),
    )
    # an answer is shown only if it is grounded, so the share of grounded ones is all or unknown
    return found.select(
        "questions", "answerable", F.try_divide("exact", "answerable").alias("exact_match"), F.when(F.col("told") > 0, 1.0).alias("grounding_rate"),
        F.try_divide(F.col("kept_back") + F.col("answerable") - F.col("false_abstentions"), "questions").alias("abstention_accuracy"), "false_abstentions", "confident_wrong",
    )
