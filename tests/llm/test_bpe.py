import hashlib
import itertools
import json
import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from orefield.llm.bpe import MergeTable, PieceTransducer, StreamingEncoder, codec, decode_documents, encode_documents

PATH = P.path("byte_bpe_50k.json")
BITS = ["a", "b", " ", "  ", "\n", "'s", "'", "re", "é", "日本", "1", "23", "!!", "<|endoftext|>", "the", "\t", "́", "𝒳", "-", "----", "\x1c", "\xa0", "'ll", " hello"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_random_texts_match_library(library):
    own, rng = codec(PATH), random.Random(2)
    for _ in range(800):
        text = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_any_parts_give_the_same_ids(library):
    own, rng = codec(PATH), random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(BITS) for _ in range(40)).replace("<|endoftext|>", "x")
        encoder, out, at = StreamingEncoder(own.table), [], 0
        while at < len(text):
            n = rng.randint(1, 6)
            out += encoder.feed(text[at : at + n])
            at += n
        out += encoder.feed("", final=True)
        assert np.frombuffer(b"".join(out), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a" * 20000, "the" * 7000, " " * 9000 + "x", "x" + " " * 8001 + "\n\n y", "-" * 5000 + "'s", "é" * 9000])
def test_long_pieces_stream_in_bounded_state(library, text):
    assert codec(PATH).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_pairs_agree_with_greedy_merging():
    table, rng = codec(PATH).table, random.Random(5)
    ids = list(table.id_of.values())
    for _ in range(3000):
        a, b = rng.choice(ids), rng.choice(ids[:2000])
        assert table.fits(a, b) == (table.greedy(table.bytes_of[a] + table.bytes_of[b]) == [a, b])
    assert table.longest < table.lookahead < 10_000


def test_broken_ids_decode_as_the_library_does(library):
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(8)]
        assert codec(PATH).decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_frames(spark, library):
    rows = [(1, "Hello there", "x"), (None, None, "y"), (2, "", None), (1, "Hello there", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a clashing name
    coded = encode_documents(df, PATH, decoded="decoded")
    got = sorted((r.doc_id or 0, list(r.ids), r.decoded) for r in coded.collect())
    ids = library.encode("Hello there", add_special_tokens=False).ids
    assert got == [(0, [], ""), (1, ids, "Hello there"), (1, ids, "Hello there"), (2, [], "")]
    assert {r.again for r in decode_documents(coded, PATH, text="again").collect()} == {"", "Hello there"}
    assert encode_documents(df.limit(0), PATH).count() == 0


def test_query_matches_library(spark, library):
    from orefield.llm.queries import op1_bpe_codec

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op1_bpe_codec(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_batches_of_texts_match_library(library):
    own, rng = codec(PATH), random.Random(6)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [" ".join(rng.choice(["(word)", "a", "12", "it's", "é!", "#x", "日本", "²", "a\nb", "don't?"]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for text, ids in zip([*texts, None], own.encode_texts(pa.array([*texts, None]))):
        assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("merges", ["a b;b a;ab a;c c;b c;ab c;cc a;a cc", "b c;a b;c a;bc a;ab c;abc a", "a a;aa a;aa aa;a b;aa b;b aa"])
def test_lookahead_is_sufficient_for_every_text(tmp_path, merges):
    """All texts of up to nine letters: no token that lies `lookahead` before the end changes, whatever follows; and
    some token does change within it, so that tokens can't be handed on at once."""
    vocab = {c: k for k, c in enumerate(["a", "b", "c", *(m.replace(" ", "") for m in merges.split(";"))])}
    path = tmp_path / "toy.json"
    path.write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": merges.split(";")}}))
    table, changed = MergeTable(str(path)), 0
    for size in range(1, 8):
        for letters in itertools.product(b"abc", repeat=size):
            now = table.greedy(bytes(letters))
            sure, end = [], 0
            for token in now:
                end += len(table.bytes_of[token])
                if end <= size - table.lookahead:
                    sure.append(token)
            for more in itertools.product(b"abc", repeat=2):
                later = table.greedy(bytes([*letters, *more]))
                assert later[: len(sure)] == sure
                changed += later[: len(now)] != now
            assert PieceTransducer(table).encode(bytes(letters)) == now
    assert changed


def test_tokens_leave_before_the_piece_ends(library):
    table = codec(PATH).table
    own, rng = PieceTransducer(table), random.Random(7)
    piece = "".join(rng.choice(["the", "ing", "a", "x", "tion", "qu"]) for _ in range(2000)).encode()
    early, most = [], 0
    for at in range(0, len(piece), 50):
        early += own.feed(piece[at : at + 50])
        most = max(most, len(own.data))
    assert len(early) > 1000 and most <= own.window + 50
    assert early + own.flush() == table.greedy(piece) == library.encode(piece.decode(), add_special_tokens=False).ids


def test_texts_at_once_change_nothing(spark):
    rng = random.Random(5)
    rows = [(k, "".join(rng.choice(BITS) for _ in range(200))) for k in range(60)] + [(60, None), (61, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    some, whole = (sorted(encode_documents(df, PATH, decoded="decoded", **given).collect(), key=lambda r: r.doc_id) for given in ({"at_once": 1000}, {}))
    assert some == whole and len(some) == 62
