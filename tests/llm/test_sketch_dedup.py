"""Fast similarity sketching and the near-duplicate operator against plain versions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orefield.llm import sketch_dedup

SCHEMA = "doc_id long, text string"
SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def plain(rows):
    """Sorted (doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [runs(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[top(i)] = min(d, names.get(top(i), d))
    found = [(d, len(sets[i]), names.get(top(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]
    return sorted(((d, n, c, d == c) for d, n, c in found), key=repr)


def check(spark, rows):
    got = sorted(map(tuple, sketch_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == plain(rows)
    return got


def words(n, seed):
    draw = random.Random(seed)
    return [f"w{draw.randrange(4000)}" for _ in range(n)]


def edited(base, n, seed):
    """The words with n of them, far from each other, replaced: each takes out four runs."""
    out, draw = list(base), random.Random(seed)
    for at in draw.sample(range(0, len(base), 5), n):
        out[at] = f"x{seed}"
    return out


def test_table_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = check(spark, rows)
    assert any(not r[3] for r in got)


def test_copies_near_copies_and_chains(spark):
    rows = []
    for group, size in ((0, 40), (1, 7), (2, 3)):
        base = words(200, group)
        rows += [(1000 * group + i, " ".join(edited(base, i % 5, 1000 * group + i))) for i in range(size)]
    # a chain: each text has lost two more words of the front than the one before, so the ends are far apart
    line = words(120, 9)
    rows += [(5000 + i, " ".join(line[5 * i :] + words(5 * i, 50))) for i in range(12)]
    got = check(spark, rows)
    assert len({r[2] for r in got if r[0] >= 5000}) < 12


def test_at_and_under_the_threshold(spark):
    shared = [f"s{i}" for i in range(83)]  # 80 runs
    rows = [(1, " ".join(shared)), (2, " ".join([*shared, *(f"t{i}" for i in range(20))])), (3, " ".join([*shared, *(f"u{i}" for i in range(21))]))]
    got = {r[0]: r[2] for r in check(spark, rows)}
    assert got == {1: 1, 2: 1, 3: 3}


def test_odd_rows(spark):
    long = " ".join(words(60_000, 4))
    rows = [(7, None), (8, ""), (9, " \t\n\x0b\x0c\r "), (10, "one two"), (11, "ONE\ttwo"), (12, "One two three four"), (13, "one two three four"), (14, "one  two\nthree\rfour one two three four"), (15, "\xc9t\xe9"), (16, "\xe9t\xe9"), (17, "a\xa0b"), (18, "a b"), (20, long), (19, long + " more"), (None, "one two"), (None, None), (None, "alone here"), (None, "alone here"), (21, "same"), (21, "same"), (21, "other"), (22, "ONE two three four five"), (23, "\U0001f600 \U0001f600 \U0001f600 \U0001f600 \U0001f600")]
    check(spark, rows)


def test_repeated_rows_and_no_rows(spark):
    check(spark, [(3, "all the same words here again")] * 300 + [(2, "all the same words here again")])
    assert check(spark, []) == []


def test_other_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], SCHEMA).selectExpr("*", "1 as node", "2 as row", "3 as component", "'x' as band")
    assert sorted(map(tuple, sketch_dedup.near_duplicates(df).collect())) == [(1, 2, 1, True), (2, 2, 1, False)]


def test_partitions_dont_matter(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    one = sorted(map(tuple, sketch_dedup.near_duplicates(df.repartition(1)).collect()))
    assert one == sorted(map(tuple, sketch_dedup.near_duplicates(df.repartition(13)).collect()))


def test_second_step_compares_blocks(spark, monkeypatch):
    """Leaders that aren't linked with all of their bucket, and components of more classes than a block."""
    monkeypatch.setattr(sketch_dedup, "BLOCK_CLASSES", 4)
    monkeypatch.setattr(sketch_dedup, "STAR_CLASSES", 3)
    base, rows = words(300, 1), []
    for k in range(60):
        rows.append((k, " ".join(edited(base, 9 if k % 3 else 2, k))))
    check(spark, rows)


def test_shingles():
    texts = ["A b\tC d e", "a b c", "", None, " ", "x", "a b c d e a b c d"]
    sets = sketch_dedup.shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [len(runs(t)) for t in texts]
    again = sketch_dedup.shingle_sets(pa.array(["zz"] + texts).slice(1))
    assert all((a == b).all() for a, b in zip(sets, again))
    assert set(sets[0]) < set(sets[6])


def test_sketch_is_the_same_in_any_company():
    draw = np.random.default_rng(1)
    sets = [np.unique(draw.integers(0, 1 << 63, n, np.uint64)) for n in (0, 1, 2, 5, 20, 300, 5000)]
    whole = sketch_dedup.sketches(sets)
    for k, s in enumerate(sets):
        assert (sketch_dedup.sketches([s])[0] == whole[k]).all()
    # by the rule itself, a round at a time
    for k in (1, 3, 5):
        want = [min((r, v) for r, b, v in offers if b == spot) for offers in [_offers(sets[k])] for spot in range(sketch_dedup.BINS)]
        assert [(int(x) >> 56, int(x) & (1 << 56) - 1) for x in whole[k]] == want
    assert (whole[1:] != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (whole[0] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def _offers(found):
    out = []
    for r in range(2 * sketch_dedup.BINS):
        for x in sketch_dedup._mix(found ^ sketch_dedup._mix(np.uint64([sketch_dedup.SEED + r]))):
            x = int(x)
            out.append((r, (x >> 57) % sketch_dedup.BINS if r < sketch_dedup.BINS else r - sketch_dedup.BINS, x & (1 << 56) - 1))
    return out


@pytest.mark.parametrize("size", [5, 20, 200, 2000])
def test_values_agree_as_sets_do(size):
    """The share of values that agree is the similarity on average, and spreads no more than that of independent ones."""
    draw, shares = np.random.default_rng(size), []
    for _ in range(300):
        x = np.unique(draw.integers(0, 1 << 63, size + size // 4, np.uint64))
        both = sketch_dedup.sketches([x, x[: size]])
        shares.append((both[0] == both[1]).mean())
    similarity = size / (size + size // 4)
    assert abs(np.mean(shares) - similarity) < 0.015
    assert np.std(shares) < 1.3 * (similarity * (1 - similarity) / sketch_dedup.BINS) ** 0.5


def test_recall():
    assert sketch_dedup.recall() > 0.9999999
    draw, missed = np.random.default_rng(5), 0
    for _ in range(200):
        x = draw.integers(0, 1 << 63, 60, np.uint64)
        a, b = sketch_dedup.band_keys(sketch_dedup.sketches([np.unique(x[:54]), np.unique(x[6:])]))
        missed += not (a == b).any()
    assert missed == 0
