import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from orefield.llm.sstable import key_bytes, key_value, lookup, read_shards, word_ids, write_shards

PATH = P.path("word_bpe_49k.json")
BITS = ["a", "B", " ", "  ", "\n", "'s", "'", "É", "é", "日本", "1", "23", "!!", "<|endoftext|>", "The", "\t", "́", " ́", "\x1c", "\xa0", "'ll", " hello", "İ", "Σ", "\r\n", " ", "#"]


def test_parts_give_the_ids_of_the_whole_text():
    library, own, rng = Tokenizer.from_file(PATH), word_ids(PATH), random.Random(1)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for text, packed in zip(texts, own.encode_texts(texts)):
        assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_keys_sort_as_identifiers():
    ids = [None, -(2**63), -5, 0, 7, 2**63 - 1]
    assert sorted(map(key_bytes, reversed(ids))) == [key_bytes(i) for i in ids]
    assert [key_value(key_bytes(i)) for i in ids] == ids


def test_files_hold_all_documents_in_order(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(k, f"Word{k % 7} some text {k}" * (k % 5), None) for k in range(300)] + [(None, "no id", 1), (5, None, 2), (5, "Again", 3), (5, "Again", 3), (7, "long " * 30000, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long").repartition(7)
    shards = write_shards(df, PATH, end_id=1)
    got = read_shards(shards).orderBy("start").collect()
    wanted = sorted(((k, t or "") for k, t, _ in rows), key=lambda r: (key_bytes(r[0]), r[1]))
    at = 0
    for r, (k, t) in zip(got, wanted, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (k, at, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    found = lookup(shards, [5, 299, 12345])
    assert sorted(found) == [5, 299] and len(found[5]) == 4
    assert found[299] == [library.encode(dict((r[0], r[1]) for r in rows[:300])[299], add_special_tokens=False).ids + [1]]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert read_shards(write_shards(df, PATH, end_id=1)).count() == 0
