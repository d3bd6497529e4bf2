"""A paged feed as a streaming data source: pages fetched in turn by offset into a cache, which is where a stream resumes.

A page is a JSON object with the feed's `total` (or `count`) and a list of records. Fetching is sequential by nature: a
page says whether there is another. It ends at the total, at an empty or missing page, or at the limit. Each page is kept
in the cache once it is whole, so a stream that starts again goes on behind the last record, also where the last page has
grown since, and tasks read pages from there, some each.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from orefield.operators.bucketed import BucketedTable
from orefield.storage import delete, names

#: Records of a page, and pages fetched for a micro-batch at most.
ROWS, PAGES_PER_BATCH = 500, 200
#: Pages that a task reads at most; it starts a Python worker's work anew, which takes longer than to read a page.
PAGES_PER_TASK = 8
FEED = "offset long, ord int, record string"
FEED_ARROW = pa.schema([("offset", pa.int64()), ("ord", pa.int32()), ("record", pa.string())])


def page_name(offset: int) -> str:
    return f"page-{offset:09d}.json"


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def read_page(folder: str, offset: int) -> bytes | None:
    """A page's bytes, or none if there is no such page."""
    system, path = _at(f"{folder}/{page_name(offset)}")
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(path) as f:
        return f.read()


def write_page(folder: str, offset: int, body: bytes) -> None:
    """A page that is there only once it is whole."""
    system, path = _at(f"{folder}/{page_name(offset)}")
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{path}.part") as f:
        f.write(body)
    system.move(f"{path}.part", path)


class FeedCursor:
    """How many records a feed's cache has, and how it grows. `fetch` gets a page's bytes for an offset, or none."""

    def __init__(self, fetch, cache: str, items: str, rows: int = ROWS, limit: int | None = None, per_batch: int = PAGES_PER_BATCH):
        self.fetch, self.cache, self.items, self.rows, self.limit, self.per_batch = fetch, cache, items, rows, limit, per_batch

    def _items(self, body: bytes) -> list:
        return json.loads(body).get(self.items) or []

    def _ends(self, body: bytes, offset: int) -> bool:
        """Whether no page comes behind this one."""
        page = json.loads(body)
        total = int(page.get("total") or page.get("count") or 0)
        behind = offset + self.rows
        return not page.get(self.items) or behind >= total or bool(self.limit and behind >= self.limit)

    def advance(self, start: int = 0) -> int:
        """Fetch what comes behind the cache's records, a batch of pages at most; how many records there are then.

        start: a number of records that are known to be cached. The last page is fetched again, since it may have grown.
        """
        page = max(0, start - 1) // self.rows * self.rows
        body = read_page(self.cache, page)
        while body is not None and (further := read_page(self.cache, page + self.rows)) is not None:
            page, body = page + self.rows, further
        if body is not None and self._ends(body, page):
            again = self.fetch(page)
            if again is not None and again != body and len(self._items(again)) >= len(self._items(body)):
                write_page(self.cache, page, again)
                body = again
        for _ in range(self.per_batch):
            if body is not None and self._ends(body, page):
                break
            behind = page if body is None else page + self.rows
            further = self.fetch(behind)
            if further is None:
                break
            write_page(self.cache, behind, further)
            page, body = behind, further
        return 0 if body is None else page + len(self._items(body))


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        source = options["pages"]
        self.items, self.cache, self.rows = options.get("items", "items"), options["cache"], int(options.get("rows", ROWS))
        limit = int(options["limit"]) if options.get("limit") else None
        self.cursor = FeedCursor(lambda offset: read_page(source, offset), self.cache, self.items, self.rows, limit, int(options.get("per_batch", PAGES_PER_BATCH)))
        self.known = 0

    def initialOffset(self) -> dict:
        return {"offset": 0}

    def latestOffset(self) -> dict:
        self.known = self.cursor.advance(self.known)
        return {"offset": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        pages = range(start["offset"] // self.rows * self.rows, end["offset"], self.rows)
        parts = [(page, max(0, start["offset"] - page), min(self.rows, end["offset"] - page)) for page in pages]
        return [InputPartition(parts[k : k + PAGES_PER_TASK]) for k in range(0, len(parts), PAGES_PER_TASK)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for page, first, behind in partition.value:
            records = (json.loads(read_page(self.cache, page)).get(self.items) or [])[first:behind]
            columns = [[page] * len(records), range(first, first + len(records)), [json.dumps(r) for r in records]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FEED_ARROW)], schema=FEED_ARROW)


class PagedFeed(DataSource):
    """Format `paged_feed`. Options: pages (folder of the feed's pages), cache, items, rows, limit, per_batch."""

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return FEED

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def read_feed(spark: SparkSession, **options: str) -> DataFrame:
    """(offset, ord, record) of a feed, as a stream."""
    spark.dataSource.register(PagedFeed)
    return spark.readStream.format("paged_feed").options(**options).load()


def drain(stream: DataFrame, table: BucketedTable, checkpoint: str) -> None:
    """Read a stream of records to its present end into a table of (its key, offset, ord, ...): of a record that pages
    bring more than once, as they shift while they are fetched, the first stays.

    A micro-batch writes its own records beside the table, so its work follows the batch; at the end they go into the table
    at once. What a run that was lost has written goes with the next one; records that come again change nothing.
    """
    pending = f"{table.folder}/pending"

    def aside(batch: DataFrame, number: int) -> None:
        batch.select(*table.columns).write.mode("overwrite").parquet(f"{pending}/{number:012d}")

    _take_in(table, pending)
    started = stream.writeStream.foreachBatch(aside).option("checkpointLocation", checkpoint).start()
    try:
        started.processAllAvailable()
    finally:
        started.stop()
    _take_in(table, pending)


def _take_in(table: BucketedTable, pending: str) -> None:
    """Put into the table what micro-batches have written; deleted only then."""
    batches = names(table.spark, pending)
    if not batches:
        return
    first = lambda old, new: F.struct(new("offset"), new("ord")) < F.struct(old("offset"), old("ord"))
    rows = table.spark.read.schema(table.schema).parquet(*(f"{pending}/{n}" for n in batches))
    best = rows.groupBy(*table.keys).agg(F.min(F.struct("offset", "ord", *(c for c in table.columns if c not in (*table.keys, "offset", "ord")))).alias("b"))
    table.upsert(best.select(*table.keys, "b.*"), take=first)
    delete(table.spark, pending)
