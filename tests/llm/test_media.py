import hashlib
import struct
import zlib

import numpy as np
import pytest
from pyarrow import fs as pafs

from orefield.llm import media

SF = "/root/testdata/sf0.001"


def test_whole_table_round_trip(spark):
    from orefield.llm.queries import op8_media_archive

    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_media_archive(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id]
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        stored = media.to_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature.startswith("mean=") and r.error is None


@pytest.mark.parametrize("kind", range(5))
def test_all_row_filters(kind):
    rng = np.random.default_rng(kind)
    image = rng.integers(0, 256, (5, 192)).astype(np.int64)
    left, up = np.pad(image, ((0, 0), (1, 0)))[:, :-1], np.pad(image, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(image, ((1, 0), (1, 0)))[:-1, :-1]
    base = left + up - corner
    far = [abs(base - x) for x in (left, up, corner)]
    paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
    line = (image - [np.zeros_like(image), left, up, (left + up) // 2, paeth][kind]) % 256
    lines = np.concatenate([np.full((5, 1), kind), line], axis=1).astype(np.uint8)
    head = struct.pack(">IIBBBBB", 192, 5, 8, 0, 0, 0, 0)
    png = media.PNG_HEAD + media._chunk(b"IHDR", head) + media._chunk(b"IDAT", zlib.compress(lines.tobytes())) + media._chunk(b"IEND", b"")
    assert (media.from_png(png) == image).all()


def test_ranges_take_each_member_once_and_broken_ones_stay_alone(spark):
    rows = [(k, f"text {k} " * (k % 50)) for k in range(400)] + [(None, None), (7, ""), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    written, folder = media.write_archives(df)
    fs, base = pafs.FileSystem.from_uri(folder)
    assert media.read_archives(written).count() == len(rows)
    planned = media.plan(spark, folder, 4000)
    assert {r.path.rsplit("/", 1)[1] for r in planned.collect()} == {r.path.rsplit("/", 1)[1] for r in written.collect()}
    parts = [r.asDict() for r in planned.collect()]
    assert len(parts) > 5
    read = lambda: [r for p in parts for b in media.read_range(**p) for r in b.to_pylist()]
    got = read()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in rows) and all(r["error"] is None for r in got)
    assert sorted(str(r.doc_id) for r in media.read_archives(planned).collect()) == sorted(str(r[0]) for r in rows)
    # spoil one member
    bad = got[17]
    place = pafs.FileSystem.from_uri(bad["path"])[1]
    data = bytearray(fs.open_input_file(place).read())
    at = data.index(bytes(bad["media"][-30:]), bad["offset"])
    data[at] ^= 255
    with fs.open_output_stream(place) as f:
        f.write(bytes(data))
    again = read()
    broken = [r for r in again if r["error"]]
    assert len(again) == len(rows) and [(r["path"], r["offset"]) for r in broken] == [(bad["path"], bad["offset"])] and broken[0]["media"] is None
    assert media.digest(media.describe(media.read_archives(planned))).where("error is not null").count() == 1


def test_member_is_tried_again(monkeypatch):
    calls = []

    def flaky(fs, path, m):
        calls.append(m)
        if len(calls) < 3:
            raise OSError("gone")
        return b"here"

    monkeypatch.setattr(media, "read_member", flaky)
    assert media.with_retries(None, "", media.Member("", 0, 0, 0)) == (b"here", None) and len(calls) == 3


def test_empty_table(spark):
    assert media.digest(media.describe(media.stored(spark.createDataFrame([], "doc_id long, text string")))).count() == 0


def test_long_text_and_clashing_columns(spark):
    rows = [(1, "é\n" * 400_000, "a", 0), (1, "é\n" * 400_000, "a", 0), (2, None, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string, media int")
    got = sorted(media.digest(media.describe(media.stored(df))).collect(), key=lambda r: r.doc_id)
    assert [r.n_bytes for r in got] == [1_200_000, 1_200_000, 0] and got[0].media_sha256 == got[1].media_sha256
    assert got[0].payload_sha256 == hashlib.sha256(media.padded(rows[0][1].encode())).hexdigest()


def test_empty_texts_without_identifiers(spark):
    rows = [(None, ""), (None, None), (None, " " * 192), (3, ""), (3, None)]
    got = media.digest(media.describe(media.stored(spark.createDataFrame(rows, "doc_id long, text string")))).collect()
    assert len(got) == 5 and {r.n_bytes for r in got} == {0, 192} and {r.payload_bytes for r in got} == {192}
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == 1  # all are blanks once padded
