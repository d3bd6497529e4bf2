"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Shingles are runs of five words (lower case, cut at white space); a text of fewer words is one shingle. Texts with the
same shingles form one class, so copies are compared once. Each class has a whole key of DEPTH values in each of TREES
trees. A tree is a prefix trie, held as its keys in sorted order over the cluster's range partitions: the neighbours of
a key have the longest prefixes in common with it. A class's prefix is shortened from the whole key until its recall is
TARGET_RECALL, by the least similarity that a set of its size can have with another and still be linked; classes that
then share a prefix in a tree are candidates, and only these pairs are compared, by exact intersections of their sets.

To compare them, each class goes into one block: classes go together by the most frequent prefix that they, or those
they share a prefix with, have, and what goes together is cut into blocks by hash. Pairs of blocks that have a shared prefix between them are compared, each once; inside them only candidates
count. So tasks are bounded, and their number grows with what really shares prefixes: a group of n mutual near copies
costs as many pairs of blocks as an exact count of its links must. Links are counted in the tasks, and only a spanning
forest of them leaves.

Defined results: per document `class_id` (least identifier of all documents linked with it, directly or through others),
`exact_id` (least identifier with the same shingles) and `n_links` (other documents of similarity at least the threshold;
copies count each). Null, empty and blank texts have no shingles and are each their own class without links. Null
identifiers are kept; a class with no other identifier has a null name. Rows alike in identifier and text each count.
Very long texts are compared whole. Other columns are not read (`keep_one` keeps them, whatever their names). Shingles
are told apart by 64-bit hashes within a comparison, sets by 128-bit ones, and classes are numbered. Results don't depend on partitions. `recall()` is the chance that a link is found.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import CACHE_ENTRIES, discard, kept_by_worker, materialize, own_name, row_key, slices
from orefield.llm.components import connected_components

SHINGLE = 5
#: Similarity at which documents are linked, as a fraction of whole numbers so that the test is exact.
OVER, UNDER = 4, 5
#: A key has DEPTH values of eight bits.
TREES, DEPTH = 32, 8
TARGET_RECALL = 0.9999
#: A block has about so many classes, and so many shingles, at most.
BLOCK_CLASSES, BLOCK_SHINGLES = 2048, 2_000_000
#: Blocks of one prefix that are paired in one part.
BLOCKS_AT_ONCE = 64
COLUMNS_AT_ONCE = 2048
SEED = 20240607


def recall(depth: int, similarity: float = OVER / UNDER, trees: int = TREES) -> float:
    """Chance that two sets of this similarity share a prefix of this depth in a tree or more."""
    return 1 - (1 - similarity**depth) ** trees


def least_similarity(size: int) -> float | None:
    """The least similarity at which a set of this size is linked with another one; none if it can't be."""
    most = size * UNDER // OVER
    found = [both / (size + other - both) for other in range(size * OVER // UNDER, most + 1) for both in range(min(size, other) + 1) if UNDER * both >= OVER * (size + other - both) and not both == size == other]
    return min(found, default=None)


@lru_cache(maxsize=256)
def prefix_depth(size: int, target: float = TARGET_RECALL) -> int:
    """How long a prefix a set of this size keeps: shortened from the whole key until the recall is reached.

    More than DEPTH for a set that no other can be linked with, so that it shares no prefix.
    """
    similarity = least_similarity(size) if size < 64 else OVER / UNDER
    if similarity is None:
        return DEPTH + 1
    depth = DEPTH
    while depth > 1 and recall(depth, similarity) < target:
        depth -= 1
    return depth


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; none for a text without words."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    known = kept_by_worker("hashes of words", _WordHashes)
    if len(known) > CACHE_ENTRIES:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, min(len(h), SHINGLE), np.uint64)
    for k in range(min(len(h), SHINGLE)):
        out = _mix(out + h[k : k + n])
    return np.unique(out)


class Forest:
    """Whole keys of a set of shingles, one for each tree."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.a = (rng.integers(0, 1 << 31, (TREES * DEPTH, 1), np.uint32) << np.uint32(1)) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, (TREES * DEPTH, 1), np.uint32)

    def signature(self, found: np.ndarray) -> np.ndarray:
        x = (found >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 512):
            y = x[at : at + 512] * self.a
            y ^= self.b
            np.minimum(least, y.min(axis=1), out=least)
        return least

    def keys(self, found: np.ndarray) -> np.ndarray:
        """Numbers whose order is that of the keys' values, the first value in the highest byte."""
        values = ((self.signature(found) * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).reshape(TREES, DEPTH)
        return (values.view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def _prefixes(keys: np.ndarray, depth: int) -> np.ndarray:
    return keys.view(np.uint64) >> np.uint64(8 * (DEPTH - depth))


def class_of(found: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(found.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for part in slices(batches, "text"):
        sets = [shingles(t) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("row"),
                pa.array([dict(zip("ab", class_of(s))) if len(s) else None for s in sets], pa.struct([("a", pa.int64()), ("b", pa.int64())])),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([prefix_depth(min(len(s), 64)) for s in sets], pa.int32()),
                pa.array([forest.keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
            ],
            ["doc_id", "row", "class", "size", "depth", "keys"],
        )


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, node) of classes that share a prefix; rows come sorted by tree and key.

    What lies before or after a batch isn't known, so its first and last run count as shared; a prefix that no other
    class has after all goes when they are counted. A class is in the run of its own depth, and in those of longer
    prefixes if a class that keeps such a one is there.
    """
    for batch in batches:
        tree, key, node, depth = (np.asarray(batch.column(c)) for c in ("tree", "key", "node", "depth"))
        out = []
        for level in range(int(depth.min(initial=DEPTH)), DEPTH + 1):
            prefix = _prefixes(key, level)
            new = np.ones(len(key), bool)
            new[1:] = (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1])
            starts, run = np.flatnonzero(new), np.cumsum(new) - 1
            edge = (run == 0) | (run == run[-1])
            kept_here = np.maximum.reduceat(depth == level, starts)[run]
            several = np.diff(np.append(starts, len(key)))[run] > 1
            (at,) = ((depth <= level) & (edge | (several & kept_here))).nonzero()
            out.append((_mix(_mix(prefix[at] + np.uint64(level)) + tree[at].astype(np.uint64)).view(np.int64), node[at]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["prefix", "node"])


def shared_prefixes(classes: DataFrame) -> DataFrame:
    """(prefix, node, n): the trie nodes that each class shares with another, and how many classes have them."""
    keys = classes.where(F.col("depth") <= DEPTH).select("node", "depth", F.posexplode("keys").alias("tree", "key"))
    order = [F.col(c) for c in ("tree", "key", "node")]  # the node too, so that equal keys may fill several partitions
    walked = keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk, "prefix long, node long")
    walked = materialize(walked, "prefixes")
    counts = walked.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialize(walked.join(counts, "prefix"), "shared")
    discard(walked)
    return shared


def blocks(shared: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, block), a block for each class, and (low, high), the pairs of blocks to compare. Discards `shared`."""
    # the most frequent prefix of a class; then, over all its prefixes, that of those who share them
    top = F.max(F.struct("n", "prefix"))
    own = materialize(shared.groupBy("node").agg(top.alias("top")), "tops")
    around = shared.select("prefix", "node").join(own, "node").groupBy("prefix").agg(F.max("top").alias("top"))
    kin = shared.select("prefix", "node").join(around, "prefix").groupBy("node").agg(F.max("top").alias("top"))
    kin = materialize(kin.select("node", F.col("top.prefix").alias("kin")).join(classes.select("node", "size"), "node"), "kin")
    measure = kin.groupBy("kin").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    homes = kin.join(measure, "kin").select("node", F.xxhash64("kin", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block"))
    homes = materialize(homes, "homes")
    present = materialize(shared.select("prefix", "node").join(homes, "node").select("prefix", "block").distinct(), "present")
    # a prefix with many blocks is dealt out: one side's blocks by hash, the other's to all of its parts
    parts = present.groupBy("prefix").agg(F.ceil(F.count(F.lit(1)) / BLOCKS_AT_ONCE).alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").select("prefix", "parts")
    sided = present.join(parts, "prefix")
    one = sided.select("prefix", F.pmod(F.xxhash64("block"), "parts").alias("part"), "block")
    other = sided.select("prefix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("block").alias("other"))
    across = one.join(other, ["prefix", "part"]).where("block < other").select(F.col("block").alias("low"), F.col("other").alias("high")).distinct()
    within = homes.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("block").alias("low"), F.col("block").alias("high"))
    pairs = materialize(across.union(within), "blocks")
    discard(own, kin, present, shared)
    return homes, pairs


def _as_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        sets = [shingles(t).tobytes() for t in part.column("text").to_pylist()]
        kept = [n for n in part.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), pa.array(sets, pa.binary())], [*kept, "found"])


def candidates(keys: tuple[np.ndarray, np.ndarray], depth: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The matrix of which classes of the one side share a prefix, in some tree, with which of the other, as long as both
    of them keep."""
    need = np.maximum(depth[0][:, None], depth[1][None, :])
    out = np.zeros(need.shape, bool)
    for level in np.unique(need):
        same = np.zeros(need.shape, bool)
        for a, b in zip(_prefixes(keys[0], int(level)).T, _prefixes(keys[1], int(level)).T):
            same |= a[:, None] == b[None, :]
        out |= same & (need == level)
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The matrix of which sets of the one list are similar enough to which of the other, by exact intersection sizes."""
    sizes = [np.array([len(s) for s in side]) for side in (left, right)]
    if len(left) == len(right) == 1:
        both = np.array([[np.intersect1d(left[0], right[0], assume_unique=True).size]])
    else:
        owner = np.concatenate([np.repeat(np.arange(len(n)), n) for n in sizes])
        _, column, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
        n = sizes[0].sum()
        # only what both sides have counts; these columns are numbered anew
        there = np.zeros((2, len(times)), bool)
        there[0, column[:n]] = there[1, column[n:]] = True
        number = np.cumsum(there.all(0)) - 1
        kept = there.all(0)[column]
        parts = [(owner[p][kept[p]], number[column[p][kept[p]]]) for p in (slice(0, n), slice(n, None))]
        parts = [(o[order], c[order]) for o, c in parts for order in [np.argsort(c, kind="stable")]]
        both = np.zeros((len(left), len(right)), np.float32)
        for at in range(0, int(number[-1]) + 1, COLUMNS_AT_ONCE):
            dense = []
            for (o, c), count in zip(parts, map(len, (left, right))):
                a, b = np.searchsorted(c, [at, at + COLUMNS_AT_ONCE])
                x = np.zeros((count, COLUMNS_AT_ONCE), np.float32)
                x[o[a:b], c[a:b] - at] = 1
                dense.append(x)
            both += dense[0] @ dense[1].T
        both = np.rint(both).astype(np.int64)
    return UNDER * both >= OVER * (sizes[0][:, None] + sizes[1][None, :] - both)


def roots_of(links: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the first one that it is connected with; links: of the nodes x with the nodes y."""
    row, column = np.full(n, -1), np.full(n, -1)
    row[x], column[y] = np.arange(len(x)), np.arange(len(y))
    root = np.full(n, -1)
    for start in range(n):
        if root[start] < 0:
            root[start], todo = start, [start]
            while todo:
                k = todo.pop()
                near = ([y[links[row[k]]]] if row[k] >= 0 else []) + ([x[links[:, column[k]]]] if column[k] >= 0 else [])
                for found in near:
                    new = found[root[found] < 0]
                    root[new] = start
                    todo += new.tolist()
    return root


def _compare(group: pa.Table) -> list[tuple[int, int, int]]:
    """(node, root, links) for the classes of one pair of blocks; within one block all candidates, else those across."""
    node = np.asarray(group["node"])
    group = group.take(np.unique(node, return_index=True)[1])
    block = np.asarray(group["block"])
    low = np.flatnonzero(block == np.asarray(group["low"]))
    within = len(low) == len(block)
    high = low if within else np.flatnonzero(block == np.asarray(group["high"]))
    node, copies, depth = (np.asarray(group[c]) for c in ("node", "copies", "depth"))
    keys = np.asarray(group["keys"].combine_chunks().flatten()).reshape(len(node), TREES)
    wanted = candidates((keys[low], keys[high]), (depth[low], depth[high]))
    if within:
        np.fill_diagonal(wanted, False)
    rows, columns = wanted.any(1).nonzero()[0], wanted.any(0).nonzero()[0]
    if not len(rows):
        return []
    sets = lambda at: [np.frombuffer(x.as_py(), np.uint64) for x in group["found"].take(at)]
    links = linked(sets(low[rows]), sets(high[columns])) & wanted[np.ix_(rows, columns)]
    x, y = low[rows], high[columns]
    total = np.zeros(len(node), np.int64)
    total[x] += links @ copies[y]
    if not within:
        total[y] += copies[x] @ links
    root = roots_of(links, x, y, len(node))
    (out,) = total.nonzero()
    return list(zip(node[out].tolist(), node[root[out]].tolist(), total[out].tolist()))


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (low, high); each such group is compared once its last row is here."""
    group, parts = None, []

    def done():
        rows = _compare(pa.Table.from_batches(parts)) if sum(p.num_rows for p in parts) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ()))], ["node", "root", "links"])

    for batch in batches:
        low, high = np.asarray(batch.column("low")), np.asarray(batch.column("high"))
        new = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        for a, b in zip(new, np.append(new[1:], len(low))):
            if (low[a], high[a]) != group:
                if parts:
                    yield done()
                group, parts = (low[a], high[a]), []
            parts.append(batch.slice(a, b - a))
    if parts:
        yield done()


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, row, class_id, exact_id, n_links, copies) per row of df; `row` is row_key(doc_id, text)."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(text).alias("text"))
    signed = docs.mapInArrow(_sign, "doc_id long, row struct<a: long, b: long>, class struct<a: long, b: long>, size long, depth int, keys array<long>")
    signed = materialize(signed, "signatures")
    one = signed.where("class is not null").groupBy("class").agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("exact_id"), F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("size", "depth", "keys"))
    )
    # numbers instead of hashes: written once, so that all that follows sees the same ones
    classes = materialize(one.withColumn("node", F.monotonically_increasing_id()), "classes")
    members = materialize(signed.select("doc_id", "row", "class"), "members")
    discard(signed)  # the keys go on in one place only
    shared = shared_prefixes(classes)
    homes, pairs = blocks(shared, classes)
    routed = classes.drop("exact_id", "size", "class").join(homes, "node")
    # one text for each class; rows alike in identifier and text come more than once and are told apart later
    # (a merge join at any size, so that small inputs tell what large ones take)
    texts = docs.select("row", "text").join(routed.hint("merge"), "row").drop("row")
    sets = texts.mapInArrow(_as_sets, "node long, copies long, depth int, keys array<long>, block long, found binary")
    sides = pairs.select(F.col("low").alias("block"), "low", "high").union(pairs.where("low <> high").select(F.col("high").alias("block"), "low", "high"))
    dealt = sets.join(sides.hint("merge"), "block").repartition("low", "high").sortWithinPartitions("low", "high")
    compared = materialize(dealt.mapInArrow(_verify, "node long, root long, links long"), "links")
    totals = compared.groupBy("node").agg(F.sum("links").alias("links"))
    component = connected_components(compared.where("node <> root"), "node", "root")
    grown = classes.select("node", "class", "exact_id", "copies").join(totals, "node", "left").join(component, "node", "left")
    grown = grown.select("class", "exact_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    names = grown.groupBy("component").agg(F.min("exact_id").alias("class_id"))
    named = materialize(grown.join(names, "component").select("class", "class_id", "exact_id", "copies", (F.col("links") + F.col("copies") - 1).alias("n_links")), "named")
    discard(classes, homes, pairs, compared)
    found = members.join(named, "class", "left")
    alone = F.col("class").isNull()
    return found.select("doc_id", "row", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("exact_id")).alias("exact_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"))


def keep_one(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df without near duplicates: of each class the row with the least identifier stays, of rows alike in it one.

    Rows without words stay. A class whose identifiers are all null keeps one row of each text.
    """
    found, row = near_duplicates(df, text, doc_id), own_name(df, "row")
    stays = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("row").alias(row)).distinct()
    keyed = df.withColumn(row, row_key(F.col(doc_id), F.col(text)))
    kept = keyed.join(stays, row, "left_semi")
    wordless = F.coalesce(F.col(text), F.lit("")).rlike(r"^\s*$")
    once = kept.where(~wordless).dropDuplicates([row])
    return once.unionByName(kept.where(wordless)).drop(row)


#: What DuckDB gives for the same rows, by the shared shingles of all pairs; identifiers are taken to be unique and known.
ORACLE = r"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\s\x0B\x1C-\x1F\x{85}\x{A0}]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM split),
sizes AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(s, chr(10))) ELSE 'none' || doc_id END AS h FROM sets),
each AS (SELECT doc_id, unnest(s) AS s FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM each a JOIN each b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 5 * k >= 4 * (p.n + q.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, w.y FROM reached r JOIN ways w ON w.x = r.y),
named AS (SELECT x, min(y) AS class_id FROM reached GROUP BY x),
degrees AS (SELECT x, count(*) AS n_links FROM ways GROUP BY x)
SELECT doc_id, class_id, min(doc_id) OVER (PARTITION BY h) AS exact_id, coalesce(n_links, 0) AS n_links, count(*) OVER (PARTITION BY h) AS copies FROM sizes JOIN named ON named.x = doc_id LEFT JOIN degrees ON degrees.x = doc_id
"""
