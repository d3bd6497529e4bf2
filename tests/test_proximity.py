"""Covers and their ranks, on texts small enough to work out by hand, and against a plain search for covers."""

import random

import pytest

from orefield.operators import proximity
from orefield.operators.fulltext import parse_question

PARTS = (("title", "A", True), ("body", "D", True))
SCHEMA = "id long, title string, body string"


def ranks(spark, texts, question, parts=PARTS, **how):
    df = spark.createDataFrame([(i, *(t if isinstance(t, tuple) else (t, ""))) for i, t in enumerate(texts)], SCHEMA)
    return [(r["id"], round(r["score"], 6)) for r in proximity.search(df, question, parts=parts, **how).collect()]


def test_distance_alone_decides(spark):
    texts = ["repair of a road with new surface and a large bridge", "repair of road bridge", "bridge beyond the old road", "road, then a bridge", "bridge only"]
    assert ranks(spark, texts, "road bridge") == [(1, 1.0), (3, round(1 / 3, 6)), (2, 0.25), (0, round(1 / 7, 6))]


def test_every_shortest_stretch_counts(spark):
    # road 0, bridge 1, road 2: two covers side by side; then one with two words between
    assert ranks(spark, ["road bridge road", "road x y bridge"], "road bridge") == [(0, 2.0), (1, round(1 / 3, 6))]
    # repeated words inside a cover weigh in, but a longer stretch around a shorter one doesn't
    assert ranks(spark, ["road road bridge"], "road bridge") == [(0, 1.0)]


def test_stems_prefixes_and_stop_words(spark):
    texts = ["Construction of toilets", "toilet block", "a constructor", "the"]
    assert [i for i, _ in ranks(spark, texts, "toilets")] == [0, 1]
    assert [i for i, _ in ranks(spark, texts, "constr")] == [0, 2]
    assert [i for i, _ in ranks(spark, texts, "constructing the toilet")] == [0]
    assert ranks(spark, texts, "the of") == [] == ranks(spark, texts, '"" -')


def test_words_whose_ends_change_are_found(spark):
    texts = ["sensibility", "dying", "happy", "hoping", "relational", "skies"]
    for k, word in enumerate(["sensible", "die", "happiness", "hope", "relate", "sky"]):
        assert [i for i, _ in ranks(spark, texts, word)] == [k], word


def test_phrases_negation_and_or(spark):
    texts = ["minor bridge on river", "bridge minor", "minor works near bridge", "river minor bridge road", ("minor", "bridge")]
    assert [i for i, _ in ranks(spark, texts, '"minor bridge"')] == [0, 3]
    assert [i for i, _ in ranks(spark, texts, '"minor bridge" -road')] == [0]
    assert [i for i, _ in ranks(spark, texts, '-"minor bridge" bridge')] == [1, 2, 4]
    assert {i for i, _ in ranks(spark, texts, "river or works")} == {0, 2, 3}
    assert ranks(spark, ["minor bridge x x river", "river minor bridge"], 'river "minor bridge"') == [(1, 1.0), (0, round(1 / 3, 6))]


def test_labels_weigh(spark):
    texts = [("road", ""), ("", "road"), ("x", "road road")]
    assert ranks(spark, texts, "road") == [(0, 1.0), (2, 0.1), (1, 0.05)]


def test_one_word_for_two_clauses(spark):
    assert ranks(spark, ["roadside", "road x roadside"], "road roadside") == [(1, 1.0), (0, 1.0)][::-1]


def test_empty_texts_and_ties(spark):
    df = spark.createDataFrame([(2, "road", None), (1, "road", ""), (3, None, None), (None, "road", "")], SCHEMA)
    assert [r["id"] for r in proximity.search(df, "road", parts=PARTS).collect()] == [None, 1, 2]
    assert proximity.search(df.limit(0), "road", parts=PARTS).collect() == []
    with pytest.raises(ValueError, match="more than"):
        proximity.search(df, '"' + " ".join(f"w{k}" for k in range(70)) + '"', parts=PARTS)


def test_kept_postings_give_the_same(spark):
    df = spark.createDataFrame([(i, t, "") for i, t in enumerate(["minor bridges on rivers", "bridge minor", "the river"])], SCHEMA)
    question = proximity.lexemes_of(parse_question("river bridge"), spark)
    kept = proximity.covered(proximity.post(df, "id", PARTS), question, "id")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, proximity.search(df, "river bridge", parts=PARTS).collect()))


def plain(words, clauses):
    """Sum over all shortest stretches that have a word of each clause, by trying all of them."""
    hit = [[any(w.startswith(t) for t in c) for c in clauses] for w in words]
    whole = lambda a, b: all(any(hit[i][k] for i in range(a, b + 1)) for k in range(len(clauses)))
    score = 0.0
    for a in range(len(words)):
        for b in range(a, len(words)):
            if whole(a, b) and not (a < b and (whole(a + 1, b) or whole(a, b - 1))):
                items = sum(any(h) for h in hit[a : b + 1])
                noise = (b - a) - (items - 1)
                score += 1 / (1 + noise)
    return round(score, 6)


def test_covers_against_all_stretches(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["ka", "ko", "ki", "zu", "ze", "kam"]) for _ in range(draw.randrange(1, 25))) for _ in range(60)]
    for question, clauses in (("ka ko", [["ka"], ["ko"]]), ("ka ki or ko zu", [["ka"], ["ki", "ko"], ["zu"]]), ("kam k", [["kam"], ["k"]])):
        got = dict(ranks(spark, texts, question))
        want = {i: s for i, t in enumerate(texts) if (s := plain(t.split(), clauses))}
        assert got == want
