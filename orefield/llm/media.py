"""Media columns: a Spark data source over archives of images.

Writing packs each text's bytes as an 8-bit grey image (PNG, 192 samples a row) into zip archives. The data source
`media_archive` reads them back. Its partitions are byte ranges of archives. The ranges are planned by tasks and written as
a table (path, range, where the archive's directory is); the driver lists that table's files only. A task then reads the
directory, takes the members that begin in its ranges, and streams their payloads in Arrow batches. A member that can't be read is tried again by
its own offset, without those around it; one that stays broken is a row with its error instead of a lost partition.

Defined results: null text counts as empty, which is one row of blanks; equal texts give equal files; a null identifier
is kept; rows alike are stored each; a very long text is one image of many rows, and a batch of its own; other columns
are not read; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orefield.llm.common import materialize, scratch, slices

#: Fixed values of the PNG and zip formats.
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
ZIP_END, ZIP_ENTRY, ZIP_MEMBER = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
END_SIZE, ENTRY_SIZE, MEMBER_SIZE = 22, 46, 30
ROW = 192
PAD = b" "
#: An archive is closed after this many bytes; a partition covers this many.
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
TRIES = 3


def padded(raw: bytes) -> bytes:
    """raw with blanks up to a positive multiple of a row."""
    return raw + PAD * (max(ROW, -(-len(raw) // ROW) * ROW) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A grey image whose samples are the payload, row by row, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return PNG_HEAD + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey image, one row each; any of the format's row filters."""
    if data[:8] != PNG_HEAD:
        raise ValueError("not a PNG")
    at, packed, shape = 8, [], None
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("broken chunk")
        if kind == b"IHDR":
            width, height, bits, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            if (bits, colour, interlace) != (8, 0, 0):
                raise ValueError("not plain 8-bit grey")
            shape = (height, width)
        elif kind == b"IDAT":
            packed.append(body)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[0], shape[1] + 1)
    if not lines[:, 0].any():
        return lines[:, 1:]
    return _unfilter(lines)


def _unfilter(lines: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lines) + 1, lines.shape[1] - 1), np.int64)
    for y, line in enumerate(lines, 1):
        kind, row, above = line[0], line[1:].astype(np.int64), out[y - 1]
        if kind == 0:
            out[y] = row
        elif kind == 1:
            out[y] = np.cumsum(row) % 256
        elif kind == 2:
            out[y] = (row + above) % 256
        else:
            left = corner = 0
            for x, value in enumerate(row.tolist()):
                up = int(above[x])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    base = left + up - corner
                    guess = min((left, up, corner), key=lambda v: (abs(base - v), (left, up, corner).index(v)))
                left, corner = (value + guess) % 256, up
                out[y, x] = left
    return out[1:].astype(np.uint8)


def features(image: np.ndarray) -> str:
    """Mean, spread and entropy of the samples, and a hash of an 8 x 8 thumbnail (each cell against their mean)."""
    flat = image.ravel()
    share = np.bincount(flat, minlength=256) / flat.size
    entropy = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    rows = np.linspace(0, len(image), 9).astype(int)
    sums = np.add.reduceat(image.astype(np.int64).reshape(len(image), 8, ROW // 8).sum(2), np.minimum(rows[:-1], len(image) - 1), axis=0)
    cells = sums / np.maximum(1, np.diff(rows))[:, None]
    bits = "".join("1" if v else "0" for v in (cells > cells.mean()).ravel())
    return f"mean={flat.mean():.4f};std={flat.std():.4f};entropy={entropy:.4f};thumb={int(bits, 2):016x}"


RANGES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("directory", pa.int64()), ("directory_size", pa.int64())])


def ranges_of(path: str, directory: int, directory_size: int, range_bytes: int = RANGE_BYTES) -> list[dict]:
    """The byte ranges of an archive, as rows of a plan."""
    return [{"path": path, "start": at, "end": min(directory, at + range_bytes), "directory": directory, "directory_size": directory_size} for at in range(0, max(directory, 1), range_bytes)]


def write_archives(df: DataFrame, text: str = "text", doc_id: str = "doc_id", folder: str | None = None) -> tuple[DataFrame, str]:
    """Store each row's text; a plan (RANGES) of the archives that count, written once, and their folder.

    A retried task writes under other names, and only names in that table are read.
    """
    folder = folder or scratch(df.sparkSession, "media")
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        task, n, stream, archive, members = TaskContext.get(), 0, None, None, 0

        def close() -> pa.RecordBatch:
            directory = stream.tell()  # it comes after the last member, and before a record of fixed size
            archive.close()
            size = stream.tell() - directory - END_SIZE
            stream.close()
            return pa.RecordBatch.from_pylist(ranges_of(f"{folder}/{name}", directory, size), schema=RANGES)

        for batch in batches:
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if archive is None:
                    fs.create_dir(base, recursive=True)
                    name = f"media-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.zip"
                    stream = fs.open_output_stream(f"{base}/{name}")
                    archive, members = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=False), 0
                raw = value.encode("utf-8", "surrogatepass")
                # the member's name has what the samples can't tell: the identifier and the length before padding
                info = zipfile.ZipInfo(f"{members:06d}/{'' if doc is None else doc}/{len(raw)}.png")
                archive.writestr(info, to_png(padded(raw)))
                members += 1
                if stream.tell() >= ARCHIVE_BYTES or members >= 60_000:
                    yield close()
                    archive, n = None, n + 1
        if archive is not None:
            yield close()

    return materialize(rows.mapInArrow(run, PLAN), "archives"), folder


PLAN = "path string, start long, end long, directory long, directory_size long"


def plan(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The plan of all archives in a folder: Spark lists them, and tasks read their last bytes."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, own = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(own) as file:
                    yield pa.RecordBatch.from_pylist(ranges_of(path, *directory_place(file), range_bytes), schema=RANGES)

    return materialize(found.mapInArrow(run, PLAN), "plan")


def stored(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Write df's texts as archives and read them back: read_archives() of what write_archives() made."""
    return read_archives(write_archives(df, text, doc_id)[0])


@dataclass
class Share(InputPartition):
    """A file of a plan: the byte ranges that one task reads."""

    file: str


@dataclass
class Member:
    name: str
    offset: int
    size: int
    crc: int


def directory_place(file) -> tuple[int, int]:
    """Where an archive's directory is, from its last bytes."""
    size = file.size()
    tail = file.read_at(min(size, END_SIZE + 0xFFFF), max(0, size - END_SIZE - 0xFFFF))
    at = tail.rfind(ZIP_END)
    if at < 0:
        raise ValueError("no archive directory")
    n, place = struct.unpack_from("<II", tail, at + 12)
    return place, n


def members_of(raw: bytes) -> Iterator[Member]:
    at = 0
    while raw[at : at + 4] == ZIP_ENTRY:
        crc, size, _, name, extra, comment = struct.unpack_from("<IIIHHH", raw, at + 16)
        (offset,) = struct.unpack_from("<I", raw, at + 42)
        yield Member(raw[at + ENTRY_SIZE : at + ENTRY_SIZE + name].decode(), offset, size, crc)
        at += ENTRY_SIZE + name + extra + comment


def read_member(fs: pafs.FileSystem, path: str, m: Member) -> bytes:
    """One member by its offset; its checksum must fit."""
    with fs.open_input_file(path) as file:
        head = file.read_at(MEMBER_SIZE, m.offset)
        if head[:4] != ZIP_MEMBER:
            raise ValueError("no member at this offset")
        name, extra = struct.unpack_from("<HH", head, 26)
        data = file.read_at(m.size, m.offset + MEMBER_SIZE + name + extra)
    if zlib.crc32(data) != m.crc:
        raise ValueError("checksum of a member")
    return data


def with_retries(fs: pafs.FileSystem, path: str, m: Member, tries: int = TRIES) -> tuple[bytes | None, str | None]:
    error = None
    for _ in range(tries):
        try:
            return read_member(fs, path, m), None
        except (OSError, ValueError) as e:
            error = f"{type(e).__name__}: {e}"
    return None, error


class MediaReader(DataSourceReader):
    def __init__(self, plan: str):
        self.plan = plan

    def partitions(self) -> list[InputPartition]:
        fs, base = pafs.FileSystem.from_uri(self.plan)
        root = self.plan.removesuffix(base)
        return [Share(root + f.path) for f in sorted(fs.get_file_info(pafs.FileSelector(base)), key=lambda f: f.path) if f.path.endswith(".parquet")] or [Share("")]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        if partition.file:
            fs, path = pafs.FileSystem.from_uri(partition.file)
            for r in pq.read_table(path, filesystem=fs).to_pylist():
                yield from read_range(**r)


def read_range(path: str, start: int, end: int, directory: int, directory_size: int) -> Iterator[pa.RecordBatch]:
    """The members of an archive that begin in a byte range."""
    fs, own = pafs.FileSystem.from_uri(path)
    with fs.open_input_file(own) as file:
        listed = [m for m in members_of(file.read_at(directory_size, directory)) if start <= m.offset < end]
    rows, size = [], 0
    for m in listed:
        data, error = with_retries(fs, own, m)
        _, doc, n = m.name.removesuffix(".png").split("/")
        rows.append({"doc_id": int(doc) if doc else None, "n_bytes": int(n), "path": path, "offset": m.offset, "media": data, "error": error})
        size += m.size
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)


ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
SCHEMA = "doc_id long, n_bytes long, path string, offset long, media binary, error string"


class MediaSource(DataSource):
    """spark.read.format("media_archive").option("plan", folder of a written plan).load()"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options["plan"])


def read_archives(planned: DataFrame) -> DataFrame:
    """One row per member: identifier, length before padding, place, the stored bytes, and what went wrong if they're null.

    planned: of write_archives() or plan(). Each of its files is one task's share.
    """
    spark = planned.sparkSession
    spark.dataSource.register(MediaSource)
    return spark.read.format("media_archive").option("plan", planned.written_to).load()


def describe(media: DataFrame) -> DataFrame:
    """Decode the stored bytes and add payload (the samples) and feature."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", BATCH_ROWS, BATCH_BYTES):
            payload, feature = [], []
            for data in part.column("media").to_pylist():
                image = from_png(data) if data is not None else None
                payload.append(None if image is None else image.tobytes())
                feature.append(None if image is None else features(image))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payload, pa.binary()), pa.array(feature, pa.string())], [*part.schema.names, "payload", "feature"])

    return media.mapInArrow(run, f"{SCHEMA}, payload binary, feature string")


def digest(described: DataFrame) -> DataFrame:
    """Sizes and checksums of what was read back."""
    payload = F.col("payload")
    tail = F.substring(payload, F.greatest(F.length(payload) - 15, F.lit(1)), F.lit(16))
    return described.select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "error",
    )


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
