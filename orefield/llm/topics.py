"""Topics of texts: clusters of their words, fitted on all texts.

A text is its words' counts in BINS bins by hash, weighted by how few texts have the bin. The counts are written once;
spherical k-means runs over them, one pass of all texts a round. It begins at the mean and at texts drawn by a hash of
their counts, with chances that grow with how far they are from the centres before. Sums are whole numbers, so that they don't depend
on how the texts are dealt out. A text's topic is the centre that it has the least angle to. Words that all texts have
weigh nothing, so a text of only such words has topic 0, as has one without words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm import words
from orefield.llm.common import discard, drop_kept, materialize, slices

BINS, TOPICS = 1024, 8
ROUNDS = 30
#: A component of 1 of a text's unit vector as a whole number; sums of them are exact.
UNIT = (1 << 16) - 1
#: Of a text's vector: a bin, and how often the text has it; and its component in UNITs. At most BINS of them a text.
ENTRY, COMPONENT = np.dtype([("bin", "<u2"), ("n", "<u4")]), np.dtype([("bin", "<u2"), ("n", "<u2")])
ROWS_AT_ONCE = 1024
#: Bytes of text that are cut into words at once: each word takes some tens of bytes in a worker until it is counted.
TEXT_AT_ONCE = 1 << 20
BLANKS = " \n\t\r"


@dataclass(frozen=True)
class Topics:
    weights: np.ndarray  # topics x BINS: the centres, times the bins' weights


def counted(texts: pa.Array) -> tuple[words.Words, np.ndarray, np.ndarray]:
    """A batch's words, the bin of each different one, and the number of words of each text; lower case."""
    found = words.split_words(texts, BLANKS)
    bins = (words.hashes(pc.utf8_lower(found.words)) >> np.uint64(32)).astype(np.int64) % BINS
    empty = np.asarray(pc.equal(found.words, ""))
    bins[empty] = BINS
    there = np.append(0, np.cumsum(~empty[np.asarray(found.codes)]))
    return found, bins, there[found.starts[1:]] - there[found.starts[:-1]]


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_kept()
    for part in slices(batches, "text", most=TEXT_AT_ONCE):
        found, bins, _ = counted(part.column("text"))
        owner = np.repeat(np.arange(part.num_rows), np.diff(found.starts))
        there, n = np.unique(owner * (BINS + 1) + bins[np.asarray(found.codes)], return_counts=True)
        owner, bin_ = np.divmod(there, BINS + 1)
        kept = bin_ < BINS
        own = np.zeros(kept.sum(), ENTRY)
        own["bin"], own["n"] = bin_[kept], n[kept]
        ends = np.searchsorted(owner[kept], np.arange(part.num_rows + 1)) * ENTRY.itemsize
        rows = pa.BinaryArray.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(own.tobytes())])
        yield pa.RecordBatch.from_arrays([rows], ["v"])


def _entries(batches: Iterable[pa.RecordBatch], kind: np.dtype = COMPONENT) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows, where each one's entries begin and the last one's end, and all entries."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            rows = batch.slice(at, ROWS_AT_ONCE)
            v = rows.column("v")
            offsets = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1]
            entries = np.frombuffer(v.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind)
            yield rows, (offsets - offsets[0]) // kind.itemsize, entries


def _matrix(starts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Rows by bins; whole numbers, so that sums of rows are exact."""
    out = np.zeros((len(starts) - 1, BINS))
    out.ravel()[np.repeat(np.arange(len(out)) * BINS, np.diff(starts)) + entries["bin"]] = entries["n"]
    return out


def _cosines(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.round(rows @ (centres.T / UNIT), 9)


def _sums(vectors: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[np.ndarray]], slots: int) -> np.ndarray:
    """The sums of what run gives for the rows, whole numbers in so many slots: added in the tasks, of which there are as
    many as cores, then of these."""

    def added(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for some in run(batches):
            total += some
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = vectors.mapInArrow(added, "total binary").collect()
    return sum((np.frombuffer(bytes(r["total"]), np.int64) for r in parts), np.zeros(slots, np.int64))


def fit(df: DataFrame, text: str = "text") -> Topics:
    """Topics of df's texts, over all of them. The driver gets sums only, TOPICS times BINS numbers a core and round."""
    rows = df.where(F.length(text) > 0).select(F.col(text).alias("text"))
    written = materialize(rows.mapInArrow(_vectors, "v binary").where(F.length("v") > 0), "vectors")
    # tasks stream over their rows and hold sums only, so few of them do at any size
    vectors = written.coalesce(df.sparkSession.sparkContext.defaultParallelism)
    having = _sums(vectors, _having, BINS + 1)
    weight = np.log((1 + having[BINS]) / (1 + having[:BINS]))

    def scaled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, starts, entries in _entries(batches, ENTRY):
            x = entries["n"] * weight[entries["bin"]]
            length = np.sqrt(np.add.reduceat(x * x, starts[:-1]))
            own = np.empty(len(entries), COMPONENT)
            own["bin"], own["n"] = entries["bin"], np.rint(x * UNIT / np.repeat(np.maximum(length, 1e-12), np.diff(starts)))
            unit = pa.BinaryArray.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * COMPONENT.itemsize).astype(np.int32).tobytes()), pa.py_buffer(own.tobytes())])
            yield pa.RecordBatch.from_arrays([unit], ["v"])

    units = materialize(vectors.mapInArrow(scaled, "v binary"), "units")
    discard(written)
    centres = _centres(units.coalesce(df.sparkSession.sparkContext.defaultParallelism))
    discard(units)
    return Topics((centres * weight).astype(np.float32))


def _having(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """How many texts have each bin, and how many texts there are."""
    for rows, _, entries in _entries(batches, ENTRY):
        yield np.append(np.bincount(entries["bin"], minlength=BINS), rows.num_rows)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _assigned(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The sum of the unit vectors that each centre is nearest to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, starts, entries in _entries(batches):
            rows = _matrix(starts, entries)
            own = _cosines(rows, centres).argmax(1)
            yield ((own == np.arange(len(centres))[:, None]).astype(float) @ rows).astype(np.int64).ravel()

    return _sums(vectors, run, len(centres) * BINS).reshape(-1, BINS)


def _drawn(vectors: DataFrame, centres: np.ndarray, k: int) -> np.ndarray | None:
    """A text's unit vector: of all texts that with the least exponential draw, at a rate of its distance (1 - cosine)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None
        for rows, starts, entries in _entries(batches):
            far = 1 - _cosines(_matrix(starts, entries), centres).max(1)
            h = np.asarray(rows.column("h")).astype(np.uint64) >> np.uint64(11)
            draw = np.where(far > 1e-9, -np.log((h + 0.5) / (1 << 53)) / np.maximum(far, 1e-9), np.inf)
            at = int(draw.argmin())
            found = min((float(draw[j]), rows.column("v")[j].as_py()) for j in np.flatnonzero(draw == draw[at]))
            least = min(least or found, found)
        if least:
            yield pa.RecordBatch.from_arrays([pa.array([least[0]]), pa.array([least[1]], pa.binary())], ["draw", "v"])

    keyed = vectors.select("v", F.xxhash64("v", F.lit(k)).alias("h"))
    found = keyed.mapInArrow(run, "draw double, v binary").collect()
    if not found:
        return None
    _, v = min((r["draw"], bytes(r["v"])) for r in found)
    own, out = np.frombuffer(v, COMPONENT), np.zeros(BINS)
    out[own["bin"]] = own["n"]
    return _unit(out)


def _centres(vectors: DataFrame) -> np.ndarray:
    """k-means on the sphere."""
    centres = _unit(_assigned(vectors, np.zeros((1, BINS))).astype(float))
    for k in range(1, TOPICS):
        new = _drawn(vectors, centres, k)
        if new is None:
            return np.zeros((TOPICS, BINS))
        centres = np.vstack([centres, new])
    for _ in range(ROUNDS):
        total = _assigned(vectors, centres)
        new = np.where(total.any(1, keepdims=True), _unit(total.astype(float)), centres)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    return centres


def topics_of(model: Topics, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Each text's topic, and its number of words."""
    found, bins, n = counted(texts)
    codes, firsts = np.asarray(found.codes), found.starts[:-1]
    padded = np.hstack([model.weights, np.zeros((TOPICS, 1), np.float32)])
    score = np.stack([np.add.reduceat(row[bins][codes].astype(np.float64), firsts) for row in padded]) if len(firsts) else np.zeros((TOPICS, 0))
    return [f"topic {k}" for k in np.round(score, 9).argmax(0)], n
