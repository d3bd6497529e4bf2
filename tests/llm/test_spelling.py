"""The errata trie against a plain version that looks every one-edit neighbour up."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from orefield.llm import spelling

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(spelling.CAPITALS, spelling.SMALL)


def counts(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def neighbours(words):
    letters = sorted({c for w in words for c in w})
    near = {w: set() for w in words}
    for w in words:
        for i in range(len(w) + 1):
            made = {w[:i] + w[i + 1 :]} | {w[:i] + c + w[i + 1 :] for c in letters} | {w[:i] + c + w[i:] for c in letters}
            for other in (made & words) - {w}:
                near[w].add(other)
                near[other].add(w)
    return near


def plain(rows):
    n = counts(rows)
    near, form = neighbours(set(n)), {}
    for w, found in near.items():
        best = min(found, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out)


def check(spark, rows):
    got = sorted(map(tuple, spelling.variants(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == plain(rows)
    return got


def pairs(spark, words):
    return {tuple(r) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()}


def test_table_as_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = check(spark, rows)
    assert sum(r[2] > 0 for r in got) > 5 and any(r[3] for r in got)


def test_every_pair_of_dense_words(spark):
    """Short words over few letters: all kinds of edits, runs of one letter, words that others begin with."""
    draw = random.Random(2)
    words = {"".join(draw.choice("abc") for _ in range(draw.randrange(1, 7))) for _ in range(300)} | {"a" * k for k in range(1, 9)} | {"aab", "aaab", "aaaab", "é", "éa", "ÿ"}
    near = neighbours(words)
    assert pairs(spark, words) == {(w, o) for w, found in near.items() for o in found}


def test_one_word_and_none(spark):
    assert pairs(spark, ["single"]) == set() == pairs(spark, [])
    assert pairs(spark, ["single", "singles"]) == {("single", "singles"), ("singles", "single")}


def test_light_edges_are_few(spark):
    words = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.split("text", r"\s+")).alias("word")).where("length(word) > 0").distinct()
    most = spelling.light_edges(words).groupBy("word").count().agg(F.max("count")).first()[0]
    assert most <= words.count().bit_length() + 1


def test_chains_of_forms(spark):
    def text(word, n):
        return " ".join([word] * n)

    # planets <- planetz <- planetzz, and a tie between two forms; each in a document of its own
    parts = [("planets", 700), ("planetz", 130), ("planetzz", 26), ("planetzzz", 5), ("markets", 60), ("markett", 60), ("marketa", 6), ("gardens", 24), ("gardenz", 5)]
    got = {r[0]: r for r in check(spark, [(i, text(w, n)) for i, (w, n) in enumerate(parts)])}
    assert got["planetzzz"][5] == "planets" and got["marketa"][3] == "markets" and got["gardenz"][3] is None


def test_odd_rows(spark):
    word = "Straße ÉCOLE×s naïvété aſſembly Kelvins Kelvins xyÀÿöabc xyàÿöabc ABCDEFG abcdefg"
    rows = [(k, word) for k in range(8)] + [(None, word), (None, None), (1, ""), (2, None), (3, " \n "), (4, "a" * 100_000), (4, "a" * 100_000)] + [(9, "repeated rows")] * 6 + [(10, "z" * 50_000 + " ") ] * 6
    check(spark, rows)


def test_very_long_text(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdef") for _ in range(6)) for _ in range(2_000)]
    check(spark, [(1, " ".join(draw.choice(words) for _ in range(60_000))), (2, " ".join(words))])


def test_no_rows_and_other_columns(spark):
    assert check(spark, []) == []
    df = spark.createDataFrame([(1, "lantern " * 9 + "lanterns " * 50)], SCHEMA)
    named = df.selectExpr("*", "1 as word", "2 as run", "3 as n", "4 as at", "'x' as doc")
    assert sorted(map(tuple, spelling.variants(named).collect())) == sorted(map(tuple, spelling.variants(df).collect()))
