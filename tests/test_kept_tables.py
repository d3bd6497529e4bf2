"""Tables in buckets, and the kept word list on them: what is rewritten, redeliveries, streams, equal to a rebuild."""

import os

import pytest
from pyspark.sql import functions as F

from orefield.operators import fulltext, wordlist
from orefield.operators.bucketed import BucketedTable, Change, upsert_stream

SF = "/root/testdata/sf0.001"
KIND = "k int, at int, v string"


def rows(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


def files(folder):
    return {os.path.join(d, f) for d, _, fs in os.walk(f"{folder}/data") for f in fs if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    return BucketedTable(spark, str(tmp_path / "t"), KIND, ["k"], buckets=8)


def test_insert_update_and_count(spark, table):
    make = lambda *r: spark.createDataFrame(list(r), KIND)
    assert table.upsert(make((1, 1, "a"), (2, 1, "b"), (3, 1, None))).inserted == 3
    got = table.upsert(make((1, 2, "A"), (3, 1, None), (4, 1, "d"), (4, 5, "D"), (None, 1, "n")), order=["at"])
    assert (got.inserted, got.updated) == (2, 1)
    assert rows(table) == sorted([(1, 2, "A"), (2, 1, "b"), (3, 1, None), (4, 5, "D"), (None, 1, "n")], key=repr)
    assert sum(n for _, n in table.manifest().values()) == 5


def test_only_changed_buckets_are_written(spark, table):
    table.upsert(spark.range(200).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("at"), F.lit("x").alias("v")))
    before, was = files(table.folder), table.manifest()
    got = table.upsert(spark.createDataFrame([(7, 2, "y")], KIND))
    assert got == Change(0, 1, 0, 1)
    new = files(table.folder) - before
    assert len(new) == 1
    now = table.manifest()
    assert sum(now[b][0] != was[b][0] for b in now) == 1
    # a third change of the same bucket lets the first files of it go, not those of the others
    table.upsert(spark.createDataFrame([(7, 3, "z")], KIND))
    assert table.read().count() == 200 and len(table.versions()) == 2


def test_nothing_new_writes_nothing(spark, table):
    batch = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], KIND)
    table.upsert(batch, batch=0)
    before, versions = files(table.folder), table.versions()
    assert table.upsert(batch) == Change() == table.upsert(spark.createDataFrame([(9, 9, "later")], KIND), batch=0)
    assert files(table.folder) == before and table.versions() == versions


def test_lost_writer_changes_nothing(spark, table):
    table.upsert(spark.createDataFrame([(1, 1, "a")], KIND), batch=0)
    # what a writer leaves that is lost before its manifest is complete
    spark.createDataFrame([(1, 9, "lost")], KIND).write.parquet(f"{table.folder}/data/v={2:012d}/bucket=1")
    os.makedirs(f"{table.folder}/manifest/v={2:012d}")
    spark.createDataFrame([(1, 9, "lost")], KIND).write.parquet(f"{table.folder}/staged")
    assert rows(table) == [(1, 1, "a")]
    table.upsert(spark.createDataFrame([(2, 1, "b")], KIND), batch=1)
    assert rows(table) == [(1, 1, "a"), (2, 1, "b")] and table.last_batch() == 1


def test_delete(spark, table):
    table.upsert(spark.createDataFrame([(k, 1, "x") for k in range(20)], KIND))
    got = table.delete(spark.createDataFrame([(3,), (3,), (99,)], "k int"))
    assert got == Change(0, 0, 1, 1) and 3 not in {r[0] for r in rows(table)}
    table.delete(spark.range(20).select(F.col("id").cast("int").alias("k")))
    assert rows(table) == [] and table.manifest() == {}
    assert table.delete(spark.createDataFrame([(3,)], "k int")) == Change()


def test_take_and_merge(spark, table):
    newer = lambda old, new: new("at") >= old("at")
    keep = {"v": lambda old, new: F.coalesce(new, old)}
    for batch in ([(1, 5, "a"), (2, 5, "b")], [(1, 4, "late"), (2, 6, None)]):
        table.upsert(spark.createDataFrame(batch, KIND), take=newer, merge=keep)
    assert rows(table) == [(1, 5, "a"), (2, 6, "b")]


def test_stream_in_any_order_and_again(spark, tmp_path):
    given = [(1, 1, "a"), (2, 1, "b"), (1, 3, "c"), (1, 2, "late"), (3, 5, "d"), (2, 4, "b")]
    newer = lambda old, new: new("at") > old("at")
    for name, order in (("x", given), ("y", given[::-1])):
        src, table = tmp_path / name, BucketedTable(spark, str(tmp_path / f"{name}-t"), KIND, ["k"], 4)
        for n, r in enumerate(order):
            spark.createDataFrame([r], KIND).coalesce(1).write.parquet(str(src / f"p{n}"))
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(str(src))
        for _ in range(2):
            upsert_stream(stream, table, ["at"], str(tmp_path / f"{name}-c"), take=newer).awaitTermination(120)
        assert rows(table) == [(1, 3, "c"), (2, 4, "b"), (3, 5, "d")]
        versions = table.versions()
        # the checkpoint is lost: all batches come again, and none is applied
        upsert_stream(stream, table, ["at"], str(tmp_path / f"{name}-c2"), take=newer).awaitTermination(120)
        assert rows(table) == [(1, 3, "c"), (2, 4, "b"), (3, 5, "d")] and table.versions() == versions


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The list of all documents, in three batches, of which one comes twice."""
    made = wordlist.WordList(spark, str(tmp_path_factory.mktemp("words")), buckets=8)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for k in (0, 1, 1, 2):
        made.add(docs.where(F.col("doc_id") % 3 == k), "text", "doc_id", batch=k)
    return made


def test_word_list_equals_a_rebuild(spark, kept):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = fulltext.vocabulary(docs, "text", "doc_id").where("length(word) >= 3 and word rlike '^[a-z]+$'")
    want = {tuple(r) for r in whole.collect()}
    assert {tuple(r) for r in kept.words.read().collect()} == want and len(want) > 500
    grams = {(r[0], r[1]) for r in kept.grams.read().collect()}
    assert grams == {(w[i : i + 3], word) for word, _ in want for w in [f"  {word} "] for i in range(len(w) - 2)}


def test_a_question_reads_its_buckets_only(spark, kept):
    asked = spark.createDataFrame([("tha",)], "gram string")
    paths = kept.grams.read_for(asked).inputFiles()
    assert len({p.split("bucket=")[1].split("/")[0] for p in paths}) == 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_corrections_against_all_words(spark, kept):
    words = {r["word"]: r["ndoc"] for r in kept.words.read().collect()}
    grams = lambda w: {f"  {w} "[i : i + 3] for i in range(len(w) + 1)}
    asked = ["zthat", "onthinx", "erinxg", "entirelz", "thatx", "xx", "qwxzv", "tthe", "the", "reoq"]
    got = {r["word"]: (r["fixed"], r["edits"]) for r in kept.corrections(asked).collect()}
    want = {}
    for w in asked:
        if len(w) < 3 or w == "the" or any(v.startswith(w) for v in words):
            continue
        share = {v: len(grams(w) & grams(v)) / len(grams(w) | grams(v)) for v in words}
        best = sorted((v for v in words if share[v] > 0), key=lambda v: (1 - share[v], v))[:100]
        near = [(edits(w, v), -words[v], v) for v in best if edits(w, v) <= (2 if len(w) >= 6 else 1)]
        if near:
            want[w] = (min(near)[2], min(near)[0])
    assert got == want and len(want) >= 4


def test_known_by_stem_or_head(spark, tmp_path):
    made = wordlist.WordList(spark, str(tmp_path / "w"), buckets=4)
    made.add(spark.createDataFrame([(1, "Toilet blocks on the road ab roadside"), (2, "toilet NH30 naïve"), (3, None), (4, "")], "id int, text string"), "text", "id", 0)
    assert {r[0]: r[1] for r in made.words.read().collect()} == {"toilet": 2, "blocks": 1, "the": 1, "road": 1, "roadside": 1}
    assert made.corrected("toliet roadz, Roads toi") == "toilet road, Roads toi"
    assert made.corrected('"toliet" OR x') == '"toilet" OR x'
    assert made.corrected("") == ""
