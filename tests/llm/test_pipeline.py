import corpus_pipeline
import public_tokenizers as P
import pyarrow as pa
from test_line_dedup import brute as dedup
from test_mixing import brute as mixture
from test_neardup import brute as near
from tokenizers import Tokenizer

from orefield.llm import langid, queries, topics
from orefield.llm.common import materialize

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "jaccard_join", "mixing", "bpe"]
    a = materialize(stages["language_id"](spark, docs, SF), "a")
    rows = a.collect()
    wanted = {r.doc_id: r.lang_pred for r in langid.identify(docs, queries.language_model(docs)).collect() if r.lang_pred != "und"}
    assert {r.doc_id: r.lang for r in rows} == wanted and len(rows) > 0.95 * docs.count()
    labels = {r.doc_id: r.lang for r in docs.collect()}
    assert sum(r.lang == labels[r.doc_id] for r in rows) > 0.97 * len(rows)

    b = materialize(stages["line_dedup"](spark, a, SF), "b")
    cut = dedup([(r.doc_id, r.text) for r in rows])
    assert {r.doc_id: r.text for r in b.collect()} == {k: t for k, t in cut.items() if t.strip()}

    c = materialize(stages["jaccard_join"](spark, b, SF), "c")
    groups = near([(r.doc_id, r.text) for r in b.collect()])
    assert sorted(r.doc_id for r in c.collect()) == sorted(k for k, (g, _, _) in groups.items() if g == k)

    d = materialize(stages["mixing"](spark, c, SF), "d")
    model, cells = topics.fit(c), []
    for r in c.collect():
        (topic,), n = topics.topics_of(model, pa.array([r.text]))
        cells.append((r.doc_id, r.source or "", r.lang or "", topic if n[0] else "", int(n[0])))
    assert sorted(r.doc_id for r in d.collect()) == sorted(mixture(cells, tuple(queries.MIX_TARGETS[m] for m in ("source", "lang", "topic")), 0.5))
    for df in (a, b, c, d):
        assert df.columns == docs.columns

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in d.collect()}
    e = stages["bpe"](spark, d, SF).collect()
    assert len(e) == len(texts)
    for r in e:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.round_trip and r.n_tokens == len(r.ids)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(texts)


def test_frames(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the cat " * 9, "en", None, 1), (3, "the dog and the cat\n" * 5, "en", "s", 5), (3, "the dog and the cat\n" * 5, "en", "s", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame_of in (df, df.limit(0)):
        frame = frame_of
        ids = {}
        for name, stage in corpus_pipeline.STAGES:
            frame = materialize(stage(spark, frame, SF), "frame")
            ids[name] = sorted(str(r.doc_id) for r in frame.collect())
        some = frame_of is df
        assert ids["language_id"] == ids["line_dedup"] == (["3", "3", "None"] if some else [])  # null and empty texts go
        assert ids["jaccard_join"] == (["3", "None"] if some else [])  # of rows alike one stays
        assert ids["mixing"] == ids["bpe"] == (["3"] if some else [])  # half of the tokens are drawn


def test_batches_are_bounded(spark):
    """Pipeline's memory: what goes between Spark and Python at once, unless the session has its own bounds."""
    rows = lambda: max(r.n for r in spark.range(0, 9000, 1, 1).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long").collect())
    for key in corpus_pipeline.BATCHES:
        spark.conf.unset(key)
    try:
        for _, stage in corpus_pipeline.STAGES[:1]:
            stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
        assert rows() == 2500
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
        corpus_pipeline.bound_batches(spark)
        assert rows() == 700
    finally:
        for key in corpus_pipeline.BATCHES:
            spark.conf.unset(key)
