"""Texts as words, in Arrow: each different word of a batch, and each different piece of these words, is worked on once.

`Words` has a batch's texts as codes of its different words; `parts()` cuts words of letters or digits that have marks
around them into those three; `assembled()` puts bytes given per word, or per part, together for the words or texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks that are never part of a run of letters or digits, and never begin or end something special.
MARK = r'[!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]'
#: Letters that every library at hand takes for letters, but for the one whose lower case has a mark of its own.
LETTER = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]"
#: Letters whose case is a matter of one character, and pieces of them in lower case, or of marks.
LATIN = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
BARE = rf"^([a-zß-öø-ÿ]+|{MARK}+)$"
ONE_PIECE = rf"^ ?({LETTER}+|[0-9]+|{MARK}+)$"
PARTS = rf"^(?P<before>{MARK}*)(?P<core>{LETTER}+|[0-9]+)(?P<after>{MARK}*)$"


@dataclass
class Words:
    codes: pa.Array  # of each word in turn its place in `words`
    starts: np.ndarray  # of each text its first word; one more at the end
    words: pa.Array  # the different words


def split_words(texts: pa.Array | list[str], blanks: str = " ") -> Words:
    """Texts (null: empty) cut at each of the blanks, so a text without any is one word."""
    texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
    for other in blanks[1:]:
        texts = pc.replace_substring(texts, other, blanks[0])
    lists = pc.split_pattern(texts, blanks[0])
    offsets = np.asarray(lists.offsets)
    flat = lists.flatten().dictionary_encode()
    return Words(flat.indices, (offsets - offsets[0]).astype(np.int64), flat.dictionary)


def parts(words: pa.Array, lead: str = "") -> tuple[pa.Array, pa.Array]:
    """(codes, pieces): each word as three of the different pieces, of which the second is the word itself if the word
    isn't letters or digits between marks; codes has three entries a word. What the word begins with is led by `lead`."""
    found = pc.extract_regex(words, PARTS)
    before, core, after = (pc.fill_null(pc.struct_field(found, k), "") for k in range(3))
    core = pc.if_else(pc.is_valid(found), core, words)
    if lead:
        marked = pc.not_equal(before, "")
        before, core = pc.if_else(marked, pc.binary_join_element_wise(lead, before, ""), ""), pc.if_else(marked, core, pc.binary_join_element_wise(lead, core, ""))
    coded = pa.concat_arrays([before, core, after]).dictionary_encode()
    codes = np.asarray(coded.indices).reshape(3, len(words)).T.ravel()
    return pa.array(codes, pa.int32()), coded.dictionary


def packed(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.large_binary())


def assembled(values: pa.Array, codes: pa.Array, starts: np.ndarray) -> pa.Array:
    """Per group the values of its codes, one after the other; starts: of each group its first code, and the end."""
    taken = values.take(codes)
    offsets = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(offsets[starts].tobytes()), taken.buffers()[2]])


def every(n: int, count: int) -> np.ndarray:
    """Starts of `count` groups of n codes each."""
    return np.arange(0, n * (count + 1), n)


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes: a polynomial in an odd number, from running sums over all the bytes."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words) or offsets[-1] == offsets[0]:
        return np.zeros(len(words), np.uint64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    offsets = offsets - offsets[0]
    base, n = 0x9E3779B97F4A7C15, len(data) + 1
    powers, inverse = (np.multiply.accumulate(np.append(np.uint64(1), np.full(n - 1, x, np.uint64))) for x in (base, pow(base, -1, 1 << 64)))
    sums = np.append(np.uint64(0), np.cumsum(data * powers[:-1], dtype=np.uint64))
    x = (sums[offsets[1:]] - sums[offsets[:-1]]) * inverse[offsets[:-1]]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))
