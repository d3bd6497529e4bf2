"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

A byte-level BPE tokenizer file gives a vocabulary and an ordered merge list. `MergeTable.lookahead` is the number of
bytes to the right of a token boundary that can still change it, computed from the merge list. Every piece goes
through the transducer, with a memo of pieces before it. It keeps one token per byte position (the last token of that prefix's encoding) over a window of that size, and hands a token
on once that many bytes after it have been read. Decoding maps ids to bytes and feeds an incremental UTF-8 decoder.

Defined results: a null text counts as empty and has no ids and an empty decoded text; special tokens in a text become
their own ids, as in the tokenizers library; repeated rows are each encoded; other columns are kept, and an output
column that has the name of an input column takes its place; a text of any length, and a piece of any length, is
encoded whole, a part at a time; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import codecs
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from orefield.llm import words
from orefield.llm.common import CACHE_ENTRIES, kept_by_worker, slices

#: Fixed value: the split pattern of byte-level BPE files that name no pattern of their own.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters at a buffer's end that may still join a piece before them (an apostrophe and two letters).
HOLD = 3
#: A piece longer than this many characters is fed to the transducer part by part.
LONG_PIECE = 4096
FEED = 1 << 16
#: Pairs of tokens (two numbers each) of which a worker remembers whether they can be neighbours.
FITS_ENTRIES = 400_000
#: Bytes of text that are encoded at once: the more, the fewer pieces are met again.
TEXT_AT_ONCE = 32 << 20
#: White space that a text can't be cut at word by word: at its ends, next to other white space, or rare.
ODD = "  |\n | \n|^[ \n]|[ \n]$|[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level files: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeTable:
    """A byte-level BPE file: tokens as bytes, merges by rank, special tokens, and the sufficient lookahead."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        raw = {t: bytes(alphabet[c] for c in t) for t in ids}
        self.bytes_of = [b""] * (max([*ids.values(), *self.specials.values()]) + 1)
        for t, i in ids.items():
            self.bytes_of[i] = raw[t]
        for t, i in self.specials.items():
            self.bytes_of[i] = t.encode()
        self.byte_id = [0] * 256
        for t, b in raw.items():
            if len(b) == 1:
                self.byte_id[b[0]] = ids[t]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(self.merges)}
        self.id_of = {raw[t]: i for t, i in ids.items()}
        self.longest = max(map(len, self.id_of))
        self._fits: dict[int, bool] = {}
        self.parts = {c: (r, a, b) for r, (a, b, c) in reversed(list(enumerate(self.merges)))}
        # a token that the merges never make can end no prefix
        made = {self.byte_id[b] for b in range(256)} | {c for _, _, c in self.merges}
        self.id_of = {b: i for b, i in self.id_of.items() if i in made and self.greedy(b) == [i]}
        self._index_endings()
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self.lookahead = self._sufficient_lookahead()

    def greedy(self, piece: bytes) -> list[int]:
        """The definition: merge the neighbouring pair of lowest rank until none is left."""
        ids = [self.byte_id[b] for b in piece]
        while len(ids) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            k = best[1]
            ids[k : k + 2] = [self.rank[ids[k], ids[k + 1]][1]]
        return ids

    def _sufficient_lookahead(self) -> int:
        """Bytes after a boundary that can decide what happens before it.

        A merge (u, v) can be undone from the right only by a merge of lower rank that takes v, or a part on v's right
        edge before that part is used. That rival in turn depends on its own right operand. Ranks fall along such a
        chain, so it ends; the longest chain, in bytes, plus the longest token is enough to read.
        """
        size = [len(b) for b in self.bytes_of]
        used_in: dict[int, tuple[int, int, int]] = {}
        for r, (a, b, c) in enumerate(self.merges):
            used_in.setdefault(c, (r, a, b))
        ranks: dict[int, list[int]] = {}
        deepest: dict[int, list[int]] = {}
        longest = 0
        for r, (a, b, c) in enumerate(self.merges):
            reach, part, limit = 0, b, r
            while True:
                if part in ranks and (k := bisect.bisect_left(ranks[part], limit)):
                    reach = max(reach, deepest[part][k - 1])
                if part not in used_in:
                    break
                limit, _, part = used_in[part]
            here = size[b] + reach
            ranks.setdefault(a, []).append(r)
            best = deepest.setdefault(a, [])
            best.append(max(here, best[-1] if best else 0))
            longest = max(longest, here)
        return longest + self.longest

    def _index_endings(self) -> None:
        """A trie of the tokens read backwards: a step leads from a node and the byte before it to another node."""
        self.step: dict[int, int] = {}
        self.ends_at: list[int] = [-1]  # the token that a node spells, if any
        for token, i in self.id_of.items():
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                node = self.step.get(key, 0)
                if not node:
                    node = self.step[key] = len(self.ends_at)
                    self.ends_at.append(-1)
            self.ends_at[node] = i
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size = np.array([len(b) for b in self.bytes_of])
        self.at = np.cumsum(self.size) - self.size

    def fits(self, a: int, b: int) -> bool:
        """Whether b can follow a: no merge joins an ending of a to a beginning of b before both are whole."""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= FITS_ENTRIES:
                self._fits.clear()
            known = self._fits[key] = self._never_joined(a, b)
        return known

    def _never_joined(self, a: int, b: int) -> bool:
        """Undo the later of the two tokens' last merges, again and again; a merge across must come after both."""
        rank, parts = self.rank, self.parts
        left_until = right_until = len(self.merges)  # the merges that use up the two ends
        while True:
            across = rank.get((a, b))
            if across and across[0] < left_until and across[0] <= right_until:  # of equal ranks the leftmost is first
                return False
            ra, rb = parts[a][0] if a in parts else -1, parts[b][0] if b in parts else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                left_until, a = ra, parts[a][2]
            else:
                right_until, b = rb, parts[b][1]


class PieceTransducer:
    """Encodes one piece, whole or in parts, then the next; holds a window of some lookahead + longest token positions.

    A token is out once `lookahead` bytes after it are here. That is looked at once the window is half full of such
    tokens, or at the piece's end, so a piece within one window is handed on at its end.
    """

    def __init__(self, table: MergeTable):
        self.table = table
        self.window = 2 * (table.lookahead + table.longest)
        self.data = bytearray()  # bytes that no token handed on covers
        self.last: list[int] = [-1]  # last token of the prefix that ends before data, after its first byte, ...

    def feed(self, part: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(part), self.window):
            self._read(part[at : at + self.window])
            if len(self.data) >= self.window:
                out += self._emit(len(self.data) - self.table.lookahead)
        return out

    def _read(self, part: bytes) -> None:
        table, data, last, end = self.table, self.data, self.last, len(self.data)
        step, ends_at, known, fits = table.step.get, table.ends_at, table._fits.get, table.fits
        data += part
        for end in range(end + 1, len(data) + 1):
            node, start, found = 0, end, -2
            while start and (node := step(node << 8 | data[start - 1])):
                start -= 1
                token = ends_at[node]
                if token >= 0 and (before := last[start]) != -2:
                    if before == -1 or (ok := known(before << 32 | token)) or (ok is None and fits(before, token)):
                        found = token
                        break
            last.append(found)

    def encode(self, piece: bytes) -> list[int]:
        return self.feed(piece) + self.flush()

    def _path(self) -> list[tuple[int, int]]:
        path, end = [], len(self.data)
        while end > 0:
            token = self.last[end]
            path.append((end, token))
            end -= len(self.table.bytes_of[token])
        return path[::-1]

    def _emit(self, upto: int) -> list[int]:
        done = [(end, token) for end, token in self._path() if end <= upto]
        if done:
            cut = done[-1][0]
            del self.data[:cut]
            self.last = [done[-1][1], *self.last[cut + 1 :]]
            self._hide_crossing()
        return [token for _, token in done]

    def _hide_crossing(self) -> None:
        """Positions whose last token began before the new base can't lie on the path any more."""
        for end in range(1, min(len(self.last), self.table.longest + 1)):
            if self.last[end] >= 0 and len(self.table.bytes_of[self.last[end]]) > end:
                self.last[end] = -2

    def flush(self) -> list[int]:
        out = [token for _, token in self._path()]
        self.data, self.last = bytearray(), [-1]
        return out


class StreamingEncoder:
    """Text in parts to ids: pieces are cut once no later character can change them, then encoded."""

    def __init__(self, table: MergeTable, memo: dict[str, bytes] | None = None):
        self.table, self.memo = table, {} if memo is None else memo
        self.buffer, self.own = "", PieceTransducer(table)
        self.long: tuple[PieceTransducer, regex.Pattern] | None = None
        self.split = regex.compile(SPLIT)
        self.kinds = [regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+")]

    def piece(self, piece: str) -> bytes:
        out = self.memo.get(piece)
        if out is None:
            out = array("i", self.own.encode(piece.encode())).tobytes()
            if len(piece) <= 64:
                if len(self.memo) >= CACHE_ENTRIES:
                    self.memo.clear()
                self.memo[piece] = out
        return out

    def _go_on(self, final: bool) -> list[int]:
        """More of a long piece; its last character waits, since white space may lose it to what follows."""
        t, kind = self.long
        m = kind.match(self.buffer)
        end = m.end() if m else 0
        over = end < len(self.buffer) or final
        white = kind is self.kinds[2]
        take = end
        if not over:
            take = max(0, end - 1)
        elif white and end < len(self.buffer):
            take = end - 1  # the last one goes with, or stands before, what follows
        out = t.feed(self.buffer[:take].encode())
        self.buffer = self.buffer[take:]
        if over:
            self.long = None
            out += t.flush()
        return out

    def feed(self, text: str, final: bool = False) -> Iterator[bytes]:
        """Packed little-endian 32-bit ids of what has become certain."""
        self.buffer += text
        while True:
            if self.long:
                yield np.asarray(self._go_on(final), np.int32).tobytes()
                if self.long:
                    return
            sure, start = len(self.buffer) if final else len(self.buffer) - HOLD, 0
            for m in self.split.finditer(self.buffer):
                if m.end() > sure or (m.end() == len(self.buffer) and not final):
                    break
                yield self.piece(m.group())
                start = m.end()
            self.buffer = self.buffer[start:]
            if final or len(self.buffer) <= LONG_PIECE:
                return
            piece = self.split.match(self.buffer).group()
            lead = 1 if piece[0] == " " and len(piece) > 1 and not piece[1].isspace() else 0
            kind = next(k for k in self.kinds if k.match(piece, lead))
            t = PieceTransducer(self.table)
            t.feed(piece[:lead].encode())
            self.buffer = self.buffer[lead:]
            self.long = (t, kind)

    def encode(self, text: str) -> bytes:
        out = []
        for at in range(0, len(text), FEED):
            out += self.feed(text[at : at + FEED])
        out += self.feed("", final=True)
        return b"".join(out)


class Codec:
    """Encoder and decoder of one tokenizer file, with memos of bounded size."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.encoder = StreamingEncoder(self.table)
        special = "|".join(map(re.escape, self.table.specials))
        self.apart = f"{ODD}|{special}" if special else ODD

    def encode_texts(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text.

        A space between two characters that aren't white space always begins a piece, so a text whose spaces all stand
        so is encoded word by word, each different piece of a batch once. Others go through the transducer one by one.
        """
        texts = pc.fill_null(texts, "")
        odd = np.asarray(pc.match_substring_regex(texts, self.apart))
        found = words.split_words(texts.filter(pa.array(~odd)))
        codes, pieces = words.parts(found.words, " ")
        single = pc.match_substring_regex(pieces, words.ONE_PIECE)
        ids = [self.encoder.piece(p) if one else self.encoder.encode(p) if p else b"" for p, one in zip(pieces.to_pylist(), single.to_pylist())]
        of_words = words.assembled(words.packed(ids), codes, words.every(3, len(found.words)))
        # a text's first word has no blank before it
        firsts = found.words.take(found.codes.take(pa.array(found.starts[:-1]))).to_pylist()
        bounds = np.stack([found.starts[:-1] + 1, found.starts[1:]], 1).ravel()
        rest = words.assembled(of_words, found.codes, np.append(bounds, found.starts[-1]))[::2].to_pylist() if firsts else []
        plain = (self.encoder.encode(a) + b for a, b in zip(firsts, rest))
        return [self.encode(t.as_py()) if o else np.frombuffer(next(plain), np.int32) for t, o in zip(texts, odd)]

    def encode(self, text: str) -> np.ndarray:
        special = self.table.special_pattern
        if not special or not special.search(text):
            packed = self.encoder.encode(text) if text else b""
        else:
            parts, at = [], 0
            for m in special.finditer(text):
                if m.start() > at:
                    parts.append(self.encoder.encode(text[at : m.start()]))
                parts.append(np.int32(self.table.specials[m.group()]).tobytes())
                at = m.end()
            if at < len(text):
                parts.append(self.encoder.encode(text[at:]))
            packed = b"".join(parts)
        return np.frombuffer(packed, np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        ids, table, out = np.asarray(ids, np.int64), self.table, []
        for at in range(0, len(ids), FEED):
            part = ids[at : at + FEED]
            size = table.size[part]
            ends = np.cumsum(size)
            out.append(machine.decode(table.flat[np.arange(ends[-1]) + np.repeat(table.at[part] - ends + size, size)].tobytes()))
        out.append(machine.decode(b"", final=True))
        return "".join(out)


def codec(path: str) -> Codec:
    return kept_by_worker(f"codec of {path}", lambda: Codec(path))


def _with(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in columns]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + [*columns.values()], [n for n, _ in kept] + [*columns])


def _schema(df: DataFrame, drop: list[str], **columns: T.DataType) -> T.StructType:
    kept = [f for f in df.schema.fields if f.name not in columns and f.name not in drop]
    return T.StructType([*kept, *(T.StructField(n, t) for n, t in columns.items())])


def _ids_array(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))


def encode_documents(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None, drop_text: bool = False, at_once: int = TEXT_AT_ONCE) -> DataFrame:
    """Add the ids of `text` as array<int>; with `decoded`, also the text that these ids decode to.

    at_once: bytes of text that a task encodes at once, or one row; less takes less memory and more time.
    """

    def run(batches):
        own = codec(path)
        for batch in slices(batches, text, rows=1 << 16, most=at_once):
            encoded = own.encode_texts(batch.column(text))
            columns = {ids: _ids_array(encoded)}
            if decoded:
                columns[decoded] = pa.array([own.decode(x) for x in encoded], pa.string())
            if drop_text and text not in columns:
                batch = batch.drop_columns([text])
            yield _with(batch, **columns)

    added = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    return df.mapInArrow(run, _schema(df, [text] if drop_text else [], **added))


def decode_documents(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text that `ids` (null: none) decode to."""

    def run(batches):
        own = codec(path)
        for batch in batches:
            yield _with(batch, **{text: pa.array([own.decode(x or []) for x in batch.column(ids).to_pylist()], pa.string())})

    return df.mapInArrow(run, _schema(df, [], **{text: T.StringType()}))
