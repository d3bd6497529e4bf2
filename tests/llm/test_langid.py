import itertools

import numpy as np

from orefield.llm.langid import GAP, PENALTY, UNKNOWN, Model, Predictor, _shares, identify, train
from orefield.llm.queries import op5_language_mixture

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_language_mixture(spark, SF).collect()
    assert len(rows) == len(docs)
    out = [r for r in rows if r.held_out]
    assert 0.25 < len(out) / len(rows) < 0.42
    assert sum(r.lang_pred == docs[r.doc_id] for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_shares_and_set(spark):
    labelled = spark.createDataFrame(
        [("the cat and the dog went over the hill with the others " * 5, "en"), ("der hund und die katze gingen über den berg mit den anderen " * 5, "de"), ("le chat et le chien sont allés sur la colline avec les autres " * 5, "fr")],
        "text string, lang string",
    )
    own = Predictor(train(labelled))
    pure, mixed, none, nothing = own.predict(["the dog and the cat went over the hill " * 9, "the dog and the cat went " * 6 + "der hund und die katze gingen " * 6, "123 !!", None])
    assert pure[0] == "en" and set(pure[2]) == {"en"}
    assert set(mixed[2]) == {"en", "de"} and abs(mixed[2]["de"] - 0.5) < 0.1
    assert none[0] == nothing[0] == UNKNOWN


def test_frames(spark):
    labelled = spark.createDataFrame([("the cat and the dog", "en"), (None, "de"), ("der hund", None)], "text string, lang string")
    df = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "The dog", "c"), (1, "The dog", "c"), (2, "the dog " * 50000, "d")], "doc_id long, text string, score string")
    got = identify(df, train(labelled)).collect()
    assert sorted(r.lang_pred for r in got) == ["en", "en", "en", UNKNOWN, UNKNOWN]
    assert identify(df, train(labelled.limit(0))).where("lang_pred = 'und'").count() == 5
    assert identify(df.limit(0), train(labelled)).count() == 0


def _grid(langs, steps):
    return [np.array(x) / steps for x in itertools.product(range(steps + 1), repeat=langs) if sum(x) == steps]


def test_mixtures_against_a_grid_of_all_shares():
    """Expectation-maximisation and the choice of a set, against every mixture of a grid and every set."""
    rng = np.random.default_rng(3)
    grid = np.stack(_grid(3, 60))
    for words in (3, 20, 80):
        like = np.exp(rng.normal(0, 2, (3, words)))
        like /= like.max(0)
        weights = rng.integers(1, 5, words).astype(float)
        share, value = _shares(like, weights, np.array([0]), np.zeros(words, int), np.ones((3, 1)))
        all_values = np.log(grid @ like) @ weights
        assert all_values.max() - GAP - 1e-9 <= value[0] and abs(share.sum() - 1) < 1e-9
        chosen = Predictor(Model(list("abc"), np.zeros((1, 3))))._choose(np.log(like), weights, np.array([0]), np.zeros(words, int))[:, 0]
        cost = PENALTY * np.log(weights.sum() + 1)
        penalised = all_values - cost * ((grid > 0).sum(1) - 1)
        own = np.log(np.maximum(chosen @ like, 1e-300)) @ weights - cost * ((chosen > 1e-9).sum() - 1)
        assert own >= penalised.max() - GAP - 1e-9


def test_only_letters_count_and_ties_are_alphabetical(spark):
    model = train(spark.createDataFrame([("aaa bbb", "x"), ("aaa bbb", "w"), ("zzz yyy", "v")], "text string, lang string"))
    got = Predictor(model).predict(["½ ² 3 _ %", "aaa", "12aaa34"])
    assert [g[0] for g in got] == [UNKNOWN, "w", "w"] and got[0][1] == 0
