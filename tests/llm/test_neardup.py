import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from orefield.llm import neardup
from orefield.llm.components import connected_components


def sets_of(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """rows: (doc_id, text) -> {doc_id: (class_id, exact_id, n_links)} by comparing all pairs that share a shingle."""
    sets = [sets_of(t) for _, t in rows]
    by_shingle = {}
    for k, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    linked = [set() for _ in rows]
    for k, s in enumerate(sets):
        for j in {j for x in s for j in by_shingle[x] if j > k}:
            both = len(s & sets[j])
            if 5 * both >= 4 * (len(s) + len(sets[j]) - both):
                linked[k].add(j)
                linked[j].add(k)
    out, seen = {}, {}
    for k in range(len(rows)):
        if k not in seen:
            todo, group = [k], {k}
            while todo:
                for j in linked[todo.pop()] - group:
                    group.add(j)
                    todo.append(j)
            seen |= dict.fromkeys(group, min(rows[j][0] for j in group))
        exact = min([rows[j][0] for j in linked[k] if sets[j] == sets[k]] + [rows[k][0]])
        out[rows[k][0]] = (seen[k], exact, len(linked[k]))
    return out


def test_whole_table_against_brute_force(spark):
    from orefield.llm.queries import op7_minhash_forest

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    wanted = brute(rows)
    got = {r.doc_id: (r.class_id, r.exact_id, r.n_links) for r in op7_minhash_forest(spark, sf).collect()}
    assert got == wanted
    assert sum(w[2] > 0 for w in wanted.values()) > 50


def test_group_larger_than_a_block(spark, monkeypatch):
    rng = random.Random(3)
    stem = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = []
    for k in range(700):
        words = list(stem)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(150)] = f"x{rng.randrange(9)}"
        rows.append((k, " ".join(words)))
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 40)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.class_id, r.exact_id, r.n_links) for r in got} == brute(rows)


def test_frames(spark):
    same = "one two three four five six seven eight nine ten eleven"
    rows = [(3, same, "a"), (3, same, "a"), (1, same.upper(), "b"), (None, same + " ", "c"), (4, None, "d"), (5, "", "e"), (6, " \n", "e"), (7, "hi", "f"), (8, "Hi", "g"), (9, "word " * 30000, "h"), (None, None, "i")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted(((str(r.doc_id), r.class_id, r.exact_id, r.n_links, r.copies) for r in neardup.near_duplicates(df).collect()), key=str)
    assert got == sorted([("3", 1, 1, 3, 4), ("3", 1, 1, 3, 4), ("1", 1, 1, 3, 4), ("None", 1, 1, 3, 4), ("4", 4, 4, 0, 1), ("5", 5, 5, 0, 1), ("6", 6, 6, 0, 1), ("7", 7, 7, 1, 2), ("8", 7, 7, 1, 2), ("9", 9, 9, 0, 1), ("None", None, None, 0, 1)], key=str)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "5", "6", "7", "9", "None"]
    assert neardup.near_duplicates(df.limit(0)).count() == 0 and neardup.keep_one(df.limit(0)).count() == 0


def test_prefixes_are_shortened_until_the_target():
    for size in (4, 5, 6, 9, 30, 64, 5000):
        d, s = neardup.prefix_depth(min(size, 64)), neardup.least_similarity(min(size, 64))
        assert neardup.recall(d, s) >= neardup.TARGET_RECALL
        assert d == neardup.DEPTH or neardup.recall(d + 1, s) < neardup.TARGET_RECALL
    assert neardup.prefix_depth(64) == 6 < neardup.prefix_depth(6)
    assert neardup.prefix_depth(3) > neardup.DEPTH and neardup.least_similarity(3) is None
    assert all(neardup.least_similarity(n) >= 0.8 for n in range(4, 80))


def test_chain_is_compared_along_its_links_only(spark, monkeypatch):
    """A long chain, where each text is like the next one but not like those further on, needs few pairs of blocks."""
    monkeypatch.setattr(neardup, "BLOCK_CLASSES", 8)
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(2000)]
    rows = [(k, " ".join(words[12 * k : 12 * k + 160])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.exact_id, r.n_links) for r in neardup.near_duplicates(df).collect()}
    wanted = brute(rows)
    assert {k: v[2] for k, v in got.items()} == {k: v[2] for k, v in wanted.items()} and got == wanted
    assert sum(v[2] for v in got.values()) >= 298


def test_any_partitions_give_the_same(spark):
    rng = random.Random(8)
    stem = [f"w{rng.randrange(90)}" for _ in range(80)]
    rows = [(k, " ".join(w if rng.random() > 0.02 else f"y{rng.randrange(50)}" for w in stem)) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(tuple, neardup.near_duplicates(df.repartition(n)).drop("row").collect())) for n in (1, 13)]
    assert found[0] == found[1] and {(d, c, e, n) for d, c, e, n, _ in found[0]} == {(k, *v) for k, v in brute(rows).items()}


def test_recall_by_similarity():
    """Share of pairs that share a long enough prefix, by similarity; the README has these figures."""
    rng, forest = np.random.default_rng(4), neardup.Forest()
    for both, other, least in ((800, 100, 0.97), (848, 76, 0.99), (900, 50, 0.995)):  # similarities 0.8, 0.85, 0.9
        hits = 0
        for _ in range(150):
            x = rng.integers(0, 1 << 63, both + 2 * other).astype(np.uint64)
            keys = np.stack([forest.keys(x[: both + other]), forest.keys(np.concatenate([x[:both], x[both + other :]]))])
            hits += bool(neardup.candidates((keys[:1], keys[1:]), (np.array([6], np.int32), np.array([6], np.int32)))[0, 0])
        assert hits / 150 >= least


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    forest = neardup.Forest()
    a = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    assert abs((forest.signature(a) == forest.signature(b)).mean() - 400 / 600) < 0.12


def test_components(spark):
    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=20))
    def run(edges):
        name = {n: n for e in edges for n in e if e[0] != e[1]}
        for _ in name:
            for a, b in edges:
                if a != b:
                    name[a] = name[b] = min(name[a], name[b])
        got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
        assert sorted((r.node, r.component) for r in got) == sorted(name.items())

    run()
