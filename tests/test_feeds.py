"""The paged feed: where it ends, restarts in mid-feed, records that come twice."""

import json

import pytest
from pyspark.sql import functions as F

from orefield.operators.bucketed import BucketedTable
from orefield.sources import feeds

KIND = "id long, offset long, ord int, name string"


def put(folder, records, rows, total=None, **more):
    for offset in range(0, len(records), rows):
        feeds.write_page(str(folder), offset, json.dumps({"total": len(records) if total is None else total, "items": records[offset : offset + rows], **more}).encode())


def cursor(tmp_path, rows=10, **how):
    asked = []

    def fetch(offset):
        asked.append(offset)
        return feeds.read_page(str(tmp_path / "feed"), offset)

    return feeds.FeedCursor(fetch, str(tmp_path / "cache"), "items", rows, **how), asked


def test_ends_at_total_empty_missing_or_limit(tmp_path):
    records = [{"id": k} for k in range(45)]
    put(tmp_path / "feed", records, 10)
    c, asked = cursor(tmp_path)
    assert c.advance() == 45 and asked == [0, 10, 20, 30, 40]
    for name, how, end in (("total", {"total": 25}, 30), ("none", {"total": None}, 45)):
        put(tmp_path / name / "feed", records, 10, **how)
        assert cursor(tmp_path / name)[0].advance() == end
    put(tmp_path / "l" / "feed", records, 10)
    assert cursor(tmp_path / "l", limit=25)[0].advance() == 30
    put(tmp_path / "e" / "feed", records[:20], 10, total=99)
    feeds.write_page(str(tmp_path / "e" / "feed"), 20, b'{"total": 99, "items": []}')
    feeds.write_page(str(tmp_path / "e" / "feed"), 30, b'{"total": 99, "items": [{"id": 7}]}')
    assert cursor(tmp_path / "e")[0].advance() == 20  # an empty page is the last
    put(tmp_path / "m" / "feed", records[:20], 10, total=99)
    assert cursor(tmp_path / "m")[0].advance() == 20  # and so is the one before a missing page
    assert cursor(tmp_path / "nothing")[0].advance() == 0
    feeds.write_page(str(tmp_path / "c" / "feed"), 0, b'{"count": "1", "items": [{"id": 1}]}')
    assert cursor(tmp_path / "c")[0].advance() == 1


def test_resumes_behind_the_cache(tmp_path):
    put(tmp_path / "feed", [{"id": k} for k in range(45)], 10)
    first, asked = cursor(tmp_path, per_batch=2)
    assert first.advance() == 20 and asked == [0, 10]
    again, asked = cursor(tmp_path, per_batch=2)  # another process
    assert [again.advance(20), again.advance(40), again.advance(45)] == [40, 45, 45]
    assert asked == [20, 30, 40, 40]


def rows_of(spark, tmp_path, **how):
    stream = feeds.read_feed(spark, pages=str(tmp_path / "feed"), cache=str(tmp_path / "cache"), rows="10", **how)
    return stream.select(F.from_json("record", "id long, name string").alias("r"), "offset", "ord").select("r.id", "offset", "ord", "r.name")


@pytest.fixture
def table(spark, tmp_path):
    return BucketedTable(spark, str(tmp_path / "t"), KIND, ["id"], 4)


def test_stream_into_a_table_and_again(spark, tmp_path, table):
    # a record published while the pages are fetched shifts them by one, so 19 comes on two pages
    records = [{"id": k, "name": f"n{k}"} for k in range(20)] + [{"id": 19, "name": "again"}] + [{"id": k, "name": f"n{k}"} for k in range(20, 44)]
    put(tmp_path / "feed", records, 10)
    feeds.drain(rows_of(spark, tmp_path, per_batch="2"), table, str(tmp_path / "cp"))
    got = {r.id: (r.name, r.offset, r.ord) for r in table.read().collect()}
    assert {k: v[0] for k, v in got.items()} == {k: f"n{k}" for k in range(44)} and got[19] == ("n19", 10, 9)
    versions = table.versions()
    feeds.drain(rows_of(spark, tmp_path, per_batch="2"), table, str(tmp_path / "cp"))
    assert table.versions() == versions


def test_restart_in_mid_feed_gives_the_same(spark, tmp_path, table):
    records = [{"id": k, "name": f"n{k}"} for k in range(60)]
    put(tmp_path / "feed", records[:34], 10)
    feeds.drain(rows_of(spark, tmp_path), table, str(tmp_path / "cp"))
    assert table.read().count() == 34
    put(tmp_path / "feed", records, 10)  # the feed has grown, its last page too
    feeds.drain(rows_of(spark, tmp_path), table, str(tmp_path / "cp"))
    assert sorted(r.id for r in table.read().collect()) == list(range(60))


def test_the_table_is_written_once_a_run_however_many_batches(spark, tmp_path, table):
    records = [{"id": k, "name": f"n{k}"} for k in range(95)] + [{"id": 3, "name": "again"}]
    put(tmp_path / "feed", records, 10)
    feeds.drain(rows_of(spark, tmp_path, per_batch="2"), table, str(tmp_path / "cp"))
    assert table.versions() == [1] and {r.id: r.name for r in table.read().collect()} == {k: f"n{k}" for k in range(95)}
    assert not (tmp_path / "t" / "pending").exists()


def test_nothing_is_lost_with_a_run_or_its_checkpoint(spark, tmp_path, table, monkeypatch):
    records = [{"id": k, "name": f"n{k}"} for k in range(60)]
    put(tmp_path / "feed", records[:34], 10)
    with monkeypatch.context() as lost:
        lost.setattr(table, "upsert", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            feeds.drain(rows_of(spark, tmp_path, per_batch="1"), table, str(tmp_path / "cp"))
    feeds.drain(rows_of(spark, tmp_path, per_batch="1"), table, str(tmp_path / "cp"))
    assert table.read().count() == 34
    put(tmp_path / "feed", records, 10)
    # the first batch of a new checkpoint has what is cached, and what is new
    feeds.drain(rows_of(spark, tmp_path), table, str(tmp_path / "cp2"))
    assert sorted(r.id for r in table.read().collect()) == list(range(60))


def test_a_task_reads_some_pages(tmp_path):
    put(tmp_path / "feed", [{"id": k} for k in range(195)], 10)
    reader = feeds.PagedFeed({"pages": str(tmp_path / "feed"), "cache": str(tmp_path / "cache"), "rows": "10"}).streamReader(None)
    parts = reader.partitions({"offset": 3}, reader.latestOffset())
    assert len(parts) == 3
    got = [(r["offset"], r["ord"], json.loads(r["record"])["id"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert got == [(k // 10 * 10, k % 10, k) for k in range(3, 195)]
