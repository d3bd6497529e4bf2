"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of their key. Keys in a block are prefix-compressed against the key before
them; blocks are compressed; a sparse index has each block's first key and place; a Bloom filter tells which keys are
absent; a footer of fixed size points at both. A lookup reads footer, filter and index, searches the index by
bisection, and reads one block.

Shard layout, integers little-endian:
  block*   zstd of entries, each: u16 shared key bytes, u16 further key bytes, u32 number of ids, key bytes, ids as u32
  index    per block: u16 key length, first key, u64 offset, u32 size, u32 documents
  filter   u32 hashes, then the bits
  footer   u64 index offset, u32 index size, u64 filter offset, u32 filter size, u64 documents, u64 ids, 8 bytes magic

Defined results: null text counts as empty, so its document has only the end id; rows of the same identifier are all
kept, next to each other, in an order given by their text (and the same ids where that is the same); a null identifier comes before all others; an empty table
gives no shard and no rows; a very long text is one entry of a block of its own; other columns are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orefield.llm import words
from orefield.llm.bpe import byte_alphabet
from orefield.llm.common import kept_by_worker, materialize, scratch, slices

MAGIC = b"ORESST01"
FOOTER = struct.Struct("<QIQIQQ8s")
ENTRY = struct.Struct("<HHI")
#: A block is closed once its entries take this many bytes.
BLOCK_BYTES = 1 << 18
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
ROWS_PER_BATCH = 8192
PIECES_AT_ONCE = 16_384


class WordIds:
    """Ids of whole texts, for files that drop white space and cut at it.

    Such a file's pieces never span a blank or a line break, and its normaliser changes no character across one, so a
    text's ids are those of its words. Of each batch the library gets every different piece of a word once.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # the merges alone, for pieces that need neither normalising nor cutting
        self.merges = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "truncation": None, "padding": None}))
        shown = {b: c for c, b in byte_alphabet().items()}
        self.as_bytes = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0x80, 0x100)}

    def encode_texts(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Packed ids of each text."""
        found = words.split_words(texts, " \n\t")
        codes, pieces = words.parts(found.words)
        # the file encodes in lower case, and these letters have theirs whatever stands beside them in such a piece
        low = pc.if_else(pc.match_substring_regex(pieces, words.LATIN), pc.utf8_lower(pieces), pieces).dictionary_encode()
        codes, pieces = low.indices.take(codes), low.dictionary
        bare = pc.match_substring_regex(pieces, words.BARE)
        order = np.argsort(~np.asarray(bare), kind="stable")
        n = pc.sum(bare).as_py() or 0
        sorted_pieces = pieces.take(pa.array(order))
        ids = self._of(self.merges, "\n".join(sorted_pieces[:n].to_pylist()).translate(self.as_bytes).split("\n") if n else [])
        ids += self._of(self.library, sorted_pieces[n:].to_pylist())
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        of_words = words.assembled(words.packed(ids).take(pa.array(place)), codes, words.every(3, len(found.words)))
        return words.assembled(of_words, found.codes, found.starts).to_pylist()

    @staticmethod
    def _of(library: Tokenizer, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(pieces), PIECES_AT_ONCE):
            some = pieces[at : at + PIECES_AT_ONCE]
            e = library.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids, ends = np.array(e.ids, "<u4").tobytes(), np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(some) + 1)) * 4
            out += [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
        return out


def word_ids(path: str) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return kept_by_worker(f"word ids of {path}", lambda: WordIds(path))


def key_bytes(doc_id: int | None) -> bytes:
    """Identifiers as bytes that sort as they do: nothing for null, else the number from the least one on."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def key_value(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack(">QQ", xxhash.xxh3_128_digest(key))
    return [(a + k * (b | 1)) % (1 << 64) % bits for k in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes entries, given in key order, to a stream."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.block, self.first, self.last, self.in_block = bytearray(), None, b"", 0
        self.index, self.hashes = [], bytearray()
        self.docs = self.ids = 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: bytes) -> None:
        if self.first is None:
            self.first, shared = key, 0
        else:
            shared = len(os.path.commonprefix([key, self.last]))
        self.block += ENTRY.pack(shared, len(key) - shared, len(ids) // 4) + key[shared:] + ids
        self.hashes += xxhash.xxh3_128_digest(key)
        self.last, self.in_block = key, self.in_block + 1
        self.docs, self.ids = self.docs + 1, self.ids + len(ids) // 4
        if len(self.block) >= BLOCK_BYTES:
            self._close_block()

    def _write(self, data: bytes) -> tuple[int, int]:
        place = (self.at, len(data))
        self.out.write(data)
        self.at += len(data)
        return place

    def _close_block(self) -> None:
        if self.in_block:
            offset, size = self._write(self.zstd.compress(bytes(self.block)))
            self.index.append(struct.pack("<H", len(self.first)) + self.first + struct.pack("<QII", offset, size, self.in_block))
        self.block, self.first, self.last, self.in_block = bytearray(), None, b"", 0

    def _bloom(self) -> bytes:
        n = max(64, -(-self.docs * BLOOM_BITS_PER_KEY // 8) * 8)
        a, b = np.frombuffer(bytes(self.hashes), ">u8").reshape(-1, 2).astype(np.uint64).T
        bits = np.zeros(n, np.uint8)
        for k in range(BLOOM_HASHES):
            bits[(a + np.uint64(k) * (b | np.uint64(1))) % np.uint64(n)] = 1
        return struct.pack("<I", BLOOM_HASHES) + np.packbits(bits, bitorder="little").tobytes()

    def close(self) -> None:
        self._close_block()
        index = self._write(b"".join(self.index))
        bloom = self._write(self._bloom())
        self._write(FOOTER.pack(*index, *bloom, self.docs, self.ids, MAGIC))


class ShardReader:
    """Reads a shard: all entries in order, or one key's."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        at = self.file.size() - FOOTER.size
        i_at, i_size, b_at, b_size, self.docs, self.ids, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, at))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a shard")
        self.first_keys, self.places = [], []
        raw, k = self.file.read_at(i_size, i_at), 0
        while k < len(raw):
            (n,) = struct.unpack_from("<H", raw, k)
            self.first_keys.append(raw[k + 2 : k + 2 + n])
            self.places.append(struct.unpack_from("<QI", raw, k + 2 + n))
            k += 2 + n + 16
        self.bloom_at = (b_at, b_size)
        self._bloom = None

    def entries_of(self, block: int) -> Iterator[tuple[bytes, memoryview]]:
        offset, size = self.places[block]
        raw = memoryview(zstandard.ZstdDecompressor().decompress(self.file.read_at(size, offset)))
        key, k = b"", 0
        while k < len(raw):
            shared, more, n = ENTRY.unpack_from(raw, k)
            k += ENTRY.size
            key = key[:shared] + bytes(raw[k : k + more])
            yield key, raw[k + more : k + more + 4 * n]
            k += more + 4 * n

    def __iter__(self) -> Iterator[tuple[bytes, memoryview]]:
        for block in range(len(self.places)):
            yield from self.entries_of(block)

    def may_hold(self, key: bytes) -> bool:
        if self._bloom is None:
            self._bloom = self.file.read_at(self.bloom_at[1], self.bloom_at[0])[4:]
        bits = self._bloom
        return all(bits[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, len(bits) * 8))

    def lookup(self, key: bytes) -> list[list[int]]:
        """The id lists of all documents with this key."""
        if not self.may_hold(key):
            return []
        found, block = [], max(0, bisect.bisect_left(self.first_keys, key) - 1)
        while block < len(self.places) and self.first_keys[block] <= key:
            found += [np.frombuffer(ids, "<u4").tolist() for k, ids in self.entries_of(block) if k == key]
            block += 1
        return found


def write_shards(df: DataFrame, path: str, end_id: int, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Encode, sort by identifier and write one shard per partition; a table of the shards that count.

    A retried task writes under another name, and only names in the returned table (itself written once) are shards.
    """
    folder = folder or scratch(df.sparkSession, "sstable")
    rows = df.select(F.col(doc_id).cast("long").alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    keys = [F.col("key").asc_nulls_first(), F.xxhash64("text")]  # rows of one identifier may fill more than one shard
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        shard = task.partitionId()
        fs, base = pafs.FileSystem.from_uri(folder)
        place = f"{base}/shard-{shard:06d}-{task.taskAttemptId()}.sst"
        own, writer = word_ids(path), None
        end = np.array([end_id], "<u4").tobytes()
        for part in slices(batches, "text", rows=1 << 16, most=32 << 20):  # the more at once, the fewer pieces are met again
            if writer is None:
                fs.create_dir(base, recursive=True)
                writer = ShardWriter(fs.open_output_stream(place))
            for key, ids in zip(part.column("key").to_pylist(), own.encode_texts(part.column("text"))):
                writer.add(key_bytes(key), ids + end)
        if writer:
            writer.close()
            writer.out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": place, "docs": writer.docs, "ids": writer.ids, "bytes": writer.at}], schema=SHARDS)

    return materialize(ordered.mapInArrow(run, "shard long, path string, docs long, ids long, bytes long").withColumn("folder", F.lit(folder)), "shards")


SHARDS = pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _open(folder: str, path: str) -> ShardReader:
    return ShardReader(pafs.FileSystem.from_uri(folder)[0], path)


def read_shards(shards: DataFrame) -> DataFrame:
    """A row per stored document: its place in the whole sequence of ids, its length, and a checksum, all from the files.

    The window without a key runs over one row per shard.
    """
    before = F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    placed = shards.select("shard", "folder", "path", F.coalesce(before, F.lit(0)).alias("start")).repartition(F.col("shard"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                at, out = row["start"], []
                for key, ids in _open(row["folder"], row["path"]):
                    n = len(ids) // 4
                    out.append((key_value(key), at, n, zlib.crc32(ids)))
                    at += n
                    if len(out) == ROWS_PER_BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=DOCS)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=DOCS)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, doc_ids: list[int]) -> dict[int, list[list[int]]]:
    """The ids of some documents by bisection in the shards; each shard's filter is asked first."""
    keys = sorted({key_bytes(d) for d in doc_ids})

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader = _open(row["folder"], row["path"])
                for key in keys:
                    for ids in reader.lookup(key):
                        yield pa.RecordBatch.from_pydict({"doc_id": [key_value(key)], "ids": [ids]}, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    rows = shards.mapInArrow(run, "doc_id long, ids array<long>").collect()
    return {k: [list(r.ids) for r in g] for k, g in groupby(sorted(rows, key=lambda r: key_bytes(r.doc_id)), key=lambda r: r.doc_id)}
