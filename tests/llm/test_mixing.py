import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orefield.llm import topics, words
from orefield.llm.mixing import _chances_as_frame, _fit_as_frame, keep_probabilities, mix, rake, tempered

SF = "/root/testdata/sf0.01"


def test_rake_meets_all_marginals():
    rng = random.Random(1)
    cells = {(a, b, c): rng.random() for a in "xyz" for b in "pq" for c in "uvw"}
    wanted = [{"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.9, "q": 0.1}, {"u": 0.2, "v": 0.2, "w": 0.6}]
    share = rake(cells, wanted)
    for k, w in enumerate(wanted):
        for c, t in w.items():
            assert sum(v for cell, v in share.items() if cell[k] == c) == pytest.approx(t, abs=1e-6)
    # raking keeps the odds ratios
    odds = lambda s: s["x", "p", "u"] * s["y", "q", "u"] / s["x", "q", "u"] / s["y", "p", "u"]
    assert odds(share) == pytest.approx(odds(cells), rel=1e-6)


def test_probabilities_give_the_budget():
    cells = {("a",): 100.0, ("b",): 900.0, ("c",): 0.0}
    keep = keep_probabilities(cells, {("a",): 0.5, ("b",): 0.5}, 400)
    assert keep[("a",)] == 1 and keep[("b",)] * 900 == pytest.approx(300) and keep[("c",)] == 0
    assert keep_probabilities(cells, {("a",): 0.5, ("b",): 0.5}, 2000) == {("a",): 1.0, ("b",): 1.0, ("c",): 0.0}


def brute(rows, power, keep_share):
    """rows: (doc_id, source, lang, topic, tokens) -> {doc_id: probability} of the sample, by a dense cube of cells."""
    axes = [sorted({r[k] for r in rows}) for k in (1, 2, 3)]
    cube = np.zeros([len(a) for a in axes])
    place = lambda r: tuple(axes[k].index(r[k + 1]) for k in range(3))
    for r in rows:
        cube[place(r)] += r[4]
    fitted = cube / cube.sum()
    others = [(1, 2), (0, 2), (0, 1)]
    wanted = [cube.sum(o) ** p / (cube.sum(o) ** p).sum() for o, p in zip(others, power)]
    for _ in range(2000):
        for k, o in enumerate(others):
            have = fitted.sum(o)
            fitted = fitted * np.expand_dims(np.divide(wanted[k], have, out=np.zeros_like(have), where=have > 0), o)
    low, high, budget = 0.0, 1e12, keep_share * cube.sum()
    ratio = np.divide(fitted, cube, out=np.zeros_like(cube), where=cube > 0)
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if (np.minimum(1, c * ratio) * cube).sum() < budget else (low, c)
    chance = {r[0]: min(1.0, c * ratio[place(r)]) if cube[place(r)] else 1.0 for r in rows}
    draw = lambda d: int(hashlib.md5(f"17|{d}".encode()).hexdigest()[:12], 16) / 16**12
    return {d: p for d, p in chance.items() if draw(d) < p}


def test_whole_sample_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = topics.fit(docs)
    rows = []
    for r in docs.collect():
        (topic,), n = topics.topics_of(model, pa.array([r.text]))
        assert n[0] == len([w for w in r.text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w])
        rows.append((r.doc_id, r.source or "", r.lang or "", topic if n[0] else "", int(n[0])))
    assert len({r[3] for r in rows}) > 4
    want = brute(rows, (0.5, 0.7, 0.8), 0.5)
    got = mix(docs.repartition(7), {"source": 0.5, "lang": 0.7, "topic": 0.8}, keep_share=0.5)
    assert got.columns == [*docs.columns, "mix_probability", "mix_weight"]
    tokens = {r[0]: r[4] for r in rows}
    found = {r.doc_id: r for r in got.collect()}
    assert set(found) == set(want)
    for d, p in want.items():
        assert found[d].mix_probability == pytest.approx(p, abs=1e-6) and found[d].mix_weight == pytest.approx(tokens[d] / p, rel=1e-5)


def test_topics_tell_texts_apart(spark):
    kinds = {"boat": "sail harbour wind anchor mast keel rope tide", "bread": "flour yeast oven dough crust knead salt loaf", "chess": "rook bishop pawn king queen mate board opening"}
    rng, rows = random.Random(2), []
    for k in range(300):
        kind = rng.choice(list(kinds))
        rows.append((k, kind, " ".join(rng.choice(kinds[kind].split() + ["the", "of", "and"]) for _ in range(40))))
    model = topics.fit(spark.createDataFrame(rows, "doc_id long, kind string, text string"))
    found, _ = topics.topics_of(model, pa.array([t for _, _, t in rows]))
    for name in set(found):
        assert len({kind for (_, kind, _), own in zip(rows, found) if own == name}) == 1


def test_hashes_are_of_the_strings_alone():
    some = pa.array(["", "a", "é", "word", "a" * 500, "x", "word"])
    h = words.hashes(some)
    assert len(set(h.tolist())) == 6 and h[3] == h[6] == words.hashes(some.slice(3, 1))[0]
    assert words.hashes(some.slice(2))[2] == h[4] and len(words.hashes(some.slice(0, 0))) == 0


def test_frames(spark):
    rows = [(1, "a b c", None, "x", 0.5, 1), (1, "a b c", None, "x", 0.5, 1), (None, None, "en", None, 1.0, 2), (2, "", "en", "x", 2.0, 3), (3, "long " * 50000, "en", "y", 3.0, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens double, m_source int")
    df = df.withColumnsRenamed({"tokens": "form"}).withColumns({"mine": F.lit(1), "cell": F.lit(2), "draw": F.lit(3), "mix_weight": F.lit("old")})
    targets = {"source": 1.0, "lang": 1.0, "topic": 1.0}
    got = mix(df, targets, keep_share=1.0)
    assert got.columns == [*(c for c in df.columns if c != "mix_weight"), "mix_probability", "mix_weight"]
    assert sorted((r.form, r.mix_weight) for r in got.collect()) == [(0.5, 3.0), (0.5, 3.0), (1.0, 0.0), (2.0, 0.0), (3.0, 50000.0)]
    assert mix(df.limit(0), targets).count() == 0
    named = mix(df.withColumn("n", F.lit(10)), targets, keep_share=1.0, topic="cell", tokens="n").collect()
    assert {r.mix_weight for r in named} == {10.0} and len(named) == 5
    assert tempered({"a": 1.0, "b": 9.0}, 0.5) == {"a": 0.25, "b": 0.75}


def test_both_fits_give_equal_probabilities(spark):
    cells = {("a", "p", "t"): 1000.0, ("a", "q", "t"): 1000.0, ("b", "p", "t"): 10.0, ("b", "q", "t"): 1000.0, ("b", "q", "u"): 3.0}
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"p": 0.5, "q": 0.5}, "topic": 1.0}
    total = sum(cells.values())
    wanted = [targets["source"], targets["lang"], {"t": 1 - 3 / total, "u": 3 / total}]
    share = rake(cells, wanted)
    assert any(abs(rake(cells, wanted, 25)[k] - v) > 1e-7 for k, v in share.items())
    rows = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, tokens double")
    fitted = _fit_as_frame(rows, targets)
    for part in (0.3, 0.9):
        want = keep_probabilities(cells, share, part * total)
        got = {(r.source, r.lang, r.topic): r.mix_probability for r in _chances_as_frame(fitted, part).collect()}
        assert got == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


@pytest.mark.parametrize("cells_on_driver", [50_000, 0])
def test_cells_without_tokens_are_kept(spark, cells_on_driver):
    rows = [(k, "a b c d", "en", "x") for k in range(20)] + [(k, None, "en", "x") for k in range(20, 30)] + [(k, "", "fr", "y") for k in range(30, 35)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": 1.0, "lang": 1.0, "topic": 1.0}
    got = mix(df, targets, keep_share=0.5, cells_on_driver=cells_on_driver).collect()
    assert sorted(r.doc_id for r in got if r.doc_id >= 20) == list(range(20, 35))
    assert {(r.mix_probability, r.mix_weight) for r in got} == {(0.5, 8.0), (1.0, 0.0)}
    assert mix(df.where("doc_id >= 20"), targets, cells_on_driver=cells_on_driver).count() == 15


def test_topics_are_fitted_on_all_texts(spark):
    """Each bin that any text has is in a centre, and how texts are dealt out changes nothing."""
    rng = random.Random(3)
    texts = [" ".join(f"kind{k % 5}{rng.randrange(30)}" for _ in range(20)) + (f" only{k}" if k % 100 == 0 else "") for k in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = topics.fit(df.repartition(5))
    _, bins, _ = topics.counted(pa.array(texts))
    assert (model.weights > 0).any(0)[np.unique(bins)].all()
    assert np.array_equal(model.weights, topics.fit(df.coalesce(2)).weights)


def test_large_batches_take_little_memory():
    """Pipeline's memory: what a worker holds beside a batch doesn't grow with the batch."""
    rng = random.Random(4)
    some = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(500)) for _ in range(50)]
    batch = pa.RecordBatch.from_pydict({"text": some * 80 + ["", None, "long " * 300_000]})
    tracemalloc.start()
    rows = [v for part in topics._vectors(iter([batch])) for v in part.column("v").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20 and len(rows) == batch.num_rows
    alone = [part.column("v").to_pylist()[0] for k in (0, 1, 4000, 4001, 4002) for part in topics._vectors(iter([batch.slice(k, 1)]))]
    assert alone == [rows[k] for k in (0, 1, 4000, 4001, 4002)]
