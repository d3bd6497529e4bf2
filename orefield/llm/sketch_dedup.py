"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A text's set has its runs of four words (A-Z in lower case, cut at ASCII white space); a text of fewer words is one run.
Sets alike are one class. A class's sketch has BINS values, filled in rounds: in each of the first BINS rounds every
member of the set is hashed to one bin and offers it a value, which is the larger the later the round; the rounds after
these, one for each bin, offer every member to that bin. A set stops after the round that fills its last bin, and no
later round could change a value, so large sets need one or two rounds, and even a set of one member has all its values
after 2 * BINS of them. Each value agrees in two sets with the chance of their similarity, as concentrated as if bins
were independent. Bands of ROWS values each are the keys of buckets: classes of a bucket are candidates.

Links are confirmed on full sets, and only as many as tell the components. First each class is compared with one leader,
the least class of its largest bucket, so a group of any number of near copies costs as many comparisons as it has
members. Then, in the buckets that still hold several components, candidates of different components are compared, all
of them: small components go into blocks by the largest bucket that they, or those they share a bucket with, are in, a large one
has blocks of its own, and each pair of blocks with a bucket between them is one bounded group; inside it only candidates
of different components count.

Defined results: per row `n_shingles`, `component_id` (the least identifier reachable over links, its own included) and
`kept` (the identifier is that one). Null, empty and blank texts have an empty set, are linked with nothing and kept. A
null identifier is reached last: a component that has no other has a null name and keeps all its rows. Repeated rows each
count and share their fate. Ties can't occur: identifiers are whole numbers. Very long texts are worked on whole. Other
columns are not read, whatever their names. Runs are told apart by 64-bit hashes within a comparison, and sets by 128-bit
hashes; classes are numbered, not hashed. Results don't depend on partitions. `recall()` is the chance that a link's
classes share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import discard, materialize, row_key, slices
from orefield.llm.components import connected_components
from orefield.llm.neardup import OVER, UNDER, linked, roots_of
from orefield.llm.words import split_words

SHINGLE = 4
#: What words are cut at.
BLANKS = " \t\n\x0b\x0c\r"
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
SEED = 20261128
#: The first step compares at most so many classes with their leader in one group.
STAR_CLASSES = 512
#: A block has about so many classes, and so many shingles, at most. A component of more classes has blocks of its own.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1_000_000


def recall(similarity: float = OVER / UNDER) -> float:
    """Chance that two sets of this similarity share a bucket."""
    return 1 - (1 - similarity**ROWS) ** BANDS


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Of each text the distinct shingles as sorted 64-bit hashes; none for a text without words."""
    found = split_words(pc.ascii_lower(texts), BLANKS)
    words = found.words.cast(pa.binary())
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
    there = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    codes = np.asarray(found.codes)
    full = there[codes]
    h = known[codes[full]]
    starts = np.append(0, np.cumsum(full))[found.starts]
    runs = np.full(max(0, len(h) - SHINGLE + 1), SHINGLE, np.uint64)
    for k in range(SHINGLE):
        runs = _mix(runs + h[k : len(h) - SHINGLE + 1 + k])
    out = []
    for a, b in zip(starts, starts[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a : b - SHINGLE + 1]))
        elif b > a:
            whole = np.uint64([b - a])
            for k in range(a, b):
                whole = _mix(whole + h[k])
            out.append(whole)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS values for each set; an empty set's are all the largest number."""
    unfilled = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(sets), BINS), unfilled)
    sizes = np.array([len(s) for s in sets], np.int64)
    left = np.flatnonzero(sizes)
    members = np.concatenate([sets[i] for i in left]) if len(left) else np.empty(0, np.uint64)
    low = np.uint64((1 << 56) - 1)
    for k in range(2 * BINS):
        if not len(left):
            break
        x = _mix(members ^ _mix(np.uint64([SEED + k])))
        # of a value the round is the highest byte, so that earlier rounds win
        value = (x & low) | (np.uint64(k) << np.uint64(56))
        n = sizes[left]
        if k < BINS:
            spot = np.repeat(left * BINS, n) + ((x >> np.uint64(57)) % np.uint64(BINS)).astype(np.int64)
        else:
            spot = np.repeat(left * BINS + (k - BINS), n)
        np.minimum.at(out.reshape(-1), spot, value)
        open_ = (out[left] == unfilled).any(1)
        if not open_.all():
            members, left = members[np.repeat(open_, n)], left[open_]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's values, which no other band shares."""
    values = sketch.reshape(len(sketch), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sketch), BANDS))
    for k in range(ROWS):
        key = _mix(_mix(key + np.uint64(k + 1)) ^ values[:, :, k])
    return key.view(np.int64)


def _sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        sets = shingle_sets(part.column("text"))
        keys = band_keys(sketches(sets))
        names = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        halves = [pa.array([(x >> shift & (1 << 64) - 1) - (1 << 63) for x in names], pa.int64()) for shift in (64, 0)]
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                part.column("row"),
                pa.StructArray.from_arrays(halves, ["a", "b"]),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([k if len(s) else None for k, s in zip(keys, sets)], pa.list_(pa.int64())),
            ],
            ["doc_id", "row", "class", "size", "bands"],
        )


def _near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are linked; sizes too far apart decide without a look at the members."""
    if UNDER * min(len(a), len(b)) < OVER * max(len(a), len(b)):
        return False
    both = np.intersect1d(a, b, assume_unique=True).size
    return UNDER * both >= OVER * (len(a) + len(b) - both)


def _compare_with_leader(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (leader, chunk), the leader first. Gives (node, root) of those that are linked with it."""
    group, head = None, None
    for part in slices(batches, "text"):
        out = []
        leaders, chunks, nodes = (np.asarray(part.column(c)) for c in ("leader", "chunk", "node"))
        for k, found in enumerate(shingle_sets(part.column("text"))):
            if (leaders[k], chunks[k]) != group:
                group, head = (leaders[k], chunks[k]), found
            elif nodes[k] != leaders[k] and _near(head, found):
                out.append((nodes[k], leaders[k]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ((), ()))], ["node", "root"])


def with_leaders(shared: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root): the classes that are linked with the leader of their largest bucket."""
    led = shared.groupBy("node").agg(F.max(F.struct("n", "leader"))["leader"].alias("leader")).where("node <> leader")
    led = materialize(led, "leaders")
    heads = led.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / STAR_CLASSES).alias("chunks"))
    members = led.join(heads, "leader").select("node", "leader", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"))
    first = heads.select(F.col("leader").alias("node"), "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    dealt = texts.join(members.union(first).hint("merge"), "node").repartition("leader", "chunk")
    dealt = dealt.sortWithinPartitions("leader", "chunk", F.col("node") != F.col("leader"))
    found = materialize(dealt.select("leader", "chunk", "node", "text").mapInArrow(_compare_with_leader, "node long, root long"), "led")
    discard(led)
    return found


def blocks(rest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component, block) and (block, low, high), the pairs of blocks to compare, for both sides.

    rest: (node, size, component, band), buckets of several components. Blocks of one group (a large component) needn't be
    compared with each other; pairs are made between groups first, so that a large one counts once in a bucket.
    """
    popular = rest.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    own = materialize(rest.join(popular, "band").groupBy("node").agg(F.max(F.struct("n", "band")).alias("top")), "tops")
    around = rest.select("band", "node").join(own, "node").groupBy("band").agg(F.max("top").alias("top"))
    kin = rest.join(around, "band").groupBy("node").agg(F.max("top")["band"].alias("kin"), F.first("size").alias("size"), F.first("component").alias("component"))
    kin = materialize(kin, "kin")
    large = kin.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK_CLASSES).select("component", F.lit(True).alias("large"))
    settled = kin.join(large, "component", "left").select("node", "size", "component", F.coalesce("large", F.lit(False)).alias("large"), F.when(F.col("large"), F.col("component")).otherwise(F.col("kin")).alias("kin"))
    settled = materialize(settled, "settled")
    measure = settled.groupBy("large", "kin").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    block = F.xxhash64("large", "kin", F.pmod(F.xxhash64("node"), F.col("blocks")))
    homes = settled.join(measure, ["large", "kin"]).select("node", "component", block.alias("block"), F.when(F.col("large"), F.xxhash64("large", "kin")).otherwise(block).alias("group"), "large")
    homes = materialize(homes, "homes")
    present = materialize(rest.select("band", "node").join(homes, "node").select("band", "group", "block", "large").distinct(), "present")
    groups = present.select("band", "group").distinct()
    between = groups.join(groups.withColumnRenamed("group", "other"), "band").where("group < other")
    one, two = present.select("band", "group", F.col("block").alias("x")), present.select("band", F.col("group").alias("other"), F.col("block").alias("y"))
    across = between.join(one, ["band", "group"]).join(two, ["band", "other"]).select(F.least("x", "y").alias("low"), F.greatest("x", "y").alias("high")).distinct()
    within = homes.where("not large").groupBy("block").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select(F.col("block").alias("low"), F.col("block").alias("high"))
    pairs = materialize(across.union(within), "pairs")
    discard(own, kin, settled, present)
    return homes.select("node", "component", "block"), pairs.select(F.col("low").alias("block"), "low", "high").union(pairs.where("low <> high").select(F.col("high").alias("block"), "low", "high"))


def _compare_blocks(group: pa.Table) -> list[tuple[int, int]]:
    """(node, root) for the classes of a pair of blocks that candidates of other components link."""
    group = group.take(np.unique(np.asarray(group["node"]), return_index=True)[1])
    node, component, size, block = (np.asarray(group[c]) for c in ("node", "component", "size", "block"))
    low = np.flatnonzero(block == np.asarray(group["low"]))
    high = np.flatnonzero(block == np.asarray(group["high"]))
    keys = np.asarray(group["bands"].combine_chunks().flatten()).reshape(len(node), BANDS)
    wanted = np.zeros((len(low), len(high)), bool)
    for a, b in zip(keys[low].T, keys[high].T):
        wanted |= a[:, None] == b[None, :]
    wanted &= component[low][:, None] != component[high][None, :]
    wanted &= UNDER * np.minimum(size[low][:, None], size[high][None, :]) >= OVER * np.maximum(size[low][:, None], size[high][None, :])
    rows, columns = wanted.any(1).nonzero()[0], wanted.any(0).nonzero()[0]
    if not len(rows):
        return []
    sets = lambda at: shingle_sets(group["text"].take(at).combine_chunks())
    links = linked(sets(low[rows]), sets(high[columns])) & wanted[np.ix_(rows, columns)]
    root = roots_of(links, low[rows], high[columns], len(node))
    (out,) = (root != np.arange(len(node))).nonzero()
    return list(zip(node[out].tolist(), node[root[out]].tolist()))


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (low, high); each such group is compared once its last row is here."""
    group, parts = None, []

    def done():
        rows = _compare_blocks(pa.Table.from_batches(parts)) if sum(p.num_rows for p in parts) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), ()))], ["node", "root"])

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


def across_components(shared: DataFrame, classes: DataFrame, component: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, root): links between candidates that the first step left in different components."""
    of = classes.select("node", "size").join(component, "node", "left").select("node", "size", F.coalesce("component", "node").alias("component"))
    spread = shared.select("node", "band").join(of, "node")
    mixed = spread.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("band")
    rest = materialize(spread.join(mixed, "band"), "mixed")
    homes, pairs = blocks(rest)
    routed = homes.join(classes.select("node", "size", "bands"), "node")
    dealt = texts.join(routed.hint("merge"), "node").join(pairs.hint("merge"), "block").repartition("low", "high").sortWithinPartitions("low", "high")
    found = materialize(dealt.mapInArrow(_verify, "node long, root long"), "across")
    discard(rest)
    return found


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of df."""
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row"), F.col(text).alias("text"))
    signed = materialize(docs.mapInArrow(_sketch, "doc_id long, row struct<a: long, b: long>, class struct<a: long, b: long>, size long, bands array<long>"), "sketches")
    one = signed.where("size > 0").groupBy("class").agg(F.min("doc_id").alias("exact_id"), F.min("row").alias("row"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    # numbers instead of hashes: written once, so that all that follows sees the same ones
    classes = materialize(one.withColumn("node", F.monotonically_increasing_id()), "classes")
    spread = classes.select("node", F.explode("bands").alias("band"))
    buckets = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    shared = materialize(spread.join(buckets, "band"), "buckets")
    # one text of each class that has a bucket with others; repeated rows go in the tasks, before the shuffle
    involved = shared.select("node").distinct().join(classes.select("node", "row"), "node")
    once = docs.groupBy("row").agg(F.first("text").alias("text"))
    texts = materialize(once.join(involved.hint("merge"), "row").select("node", "text"), "texts")
    led = with_leaders(shared, texts)
    first = materialize(connected_components(led, "node", "root"), "first")
    links = led.union(across_components(shared, classes, first, texts))
    discard(texts, shared)
    component = connected_components(links, "node", "root")
    grown = classes.select("node", "class", "exact_id").join(component, "node", "left").select("class", "exact_id", F.coalesce("component", "node").alias("component"))
    names = grown.groupBy("component").agg(F.min("exact_id").alias("component_id"))
    named = materialize(grown.join(names, "component").select("class", "component_id"), "named")
    discard(classes, led, first)
    found = signed.select("doc_id", "class", "size").join(named, "class", "left")
    name = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("size").alias("n_shingles"), name.alias("component_id"), F.col("doc_id").eqNullSafe(name).alias("kept"))


#: What DuckDB gives for the same rows, by the shared shingles of all pairs; identifiers are taken to be unique and known.
ORACLE = r"""
WITH RECURSIVE split AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS s FROM sets),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM each a JOIN each b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (SELECT doc_id AS x, doc_id AS y FROM sizes UNION SELECT r.x, w.y FROM reached r JOIN ways w ON w.x = r.y),
named AS (SELECT x, min(y) AS component_id FROM reached GROUP BY x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN named ON x = doc_id
"""
