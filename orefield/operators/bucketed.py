"""A table in buckets of its key, of which a batch rewrites only those that it changes.

Data lie under data/v=<version>/bucket=<number>; a manifest per version names, for each bucket, the version that wrote it
and its rows. A version counts once its manifest is complete, so a job that is lost half-way changes nothing, and what it
has written goes with the next batch. One writer at a time; readers see the last complete version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orefield.operators.upsert import last_wins
from orefield.storage import delete, exists, names, written

BUCKETS = 64
#: So many versions can still be read; files that only older ones name are deleted.
KEPT_VERSIONS = 2
MANIFEST = "bucket int, written long, rows long, batch long"
#: A task writes about so many rows of a bucket.
TASK_ROWS = 500_000

Side = Callable[[str], Column]


@dataclass(frozen=True)
class Change:
    """What a batch did: rows inserted, updated and deleted, and buckets rewritten."""

    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    buckets: int = 0


class BucketedTable:
    """keys name a row; bucket_by, some of the keys, say which bucket it is in (all of them, if not given)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], buckets: int = BUCKETS, bucket_by: list[str] | None = None):
        self.spark, self.folder, self.schema, self.keys, self.buckets = spark, folder.rstrip("/"), schema, keys, buckets
        self.bucket_by = bucket_by or keys
        self.columns = spark.createDataFrame([], schema).columns

    def bucket(self) -> Column:
        """The bucket of a row with the table's key columns."""
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    # ---- versions ----

    def _path(self, version: int) -> str:
        return f"{self.folder}/manifest/v={version:012d}"

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        found = (n for n in names(self.spark, f"{self.folder}/manifest") if n.startswith("v="))
        return [int(n[2:]) for n in found if exists(self.spark, f"{self.folder}/manifest/{n}/_SUCCESS")]

    def manifest(self, version: int | None = None) -> dict[int, tuple[int, int]]:
        """{bucket: (version that wrote it, rows)} of the last complete version, or of a given one."""
        return {r["bucket"]: (r["written"], r["rows"]) for r in self._entries(version) if r["bucket"] >= 0}

    def _entries(self, version: int | None = None) -> list:
        if version is None:
            version = next(reversed(self.versions()), None)
        return [] if version is None else self.spark.read.schema(MANIFEST).json(self._path(version)).collect()  # a row per bucket

    def last_batch(self) -> int:
        """The number of the last batch that was applied; -1 before any."""
        return max((r["batch"] for r in self._entries()), default=-1)

    def _commit(self, entries: dict[int, tuple[int, int]], version: int, batch: int) -> None:
        rows = [(-1, version, 0, batch)] + [(b, w, n, batch) for b, (w, n) in sorted(entries.items())]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(self._path(version))
        kept = self.versions()[-KEPT_VERSIONS:]
        live = {w for v in kept for w, _ in self.manifest(v).values()}
        stale = [f"{self.folder}/manifest/{n}" for n in names(self.spark, f"{self.folder}/manifest") if int(n[2:]) not in kept]
        stale += [f"{self.folder}/data/{n}" for n in names(self.spark, f"{self.folder}/data") if int(n[2:]) not in live]
        delete(self.spark, *stale, f"{self.folder}/staged", f"{self.folder}/incoming")

    # ---- reading ----

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets only: no file of another bucket is opened."""
        entries = self.manifest()
        wanted = sorted(entries) if buckets is None else sorted(set(buckets) & set(entries))
        paths = [f"{self.folder}/data/v={entries[b][0]:012d}/bucket={b}" for b in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read_for(self, keys: DataFrame) -> DataFrame:
        """The rows of all buckets that some keys (a bounded frame with the bucket columns) are in."""
        return self.read([r[0] for r in keys.select(self.bucket()).distinct().collect()])  # at most a row per bucket

    # ---- writing ----

    def upsert(self, rows: DataFrame, order: list[str] | None = None, batch: int | None = None, merge: dict[str, Callable[[Column, Column], Column]] | None = None, take: Callable[[Side, Side], Column] | None = None) -> Change:
        """Insert and update rows; those that change nothing aren't written, and without any there is no new version.

        order: of rows of one key in the batch the last one counts; without it, keys must be distinct. merge: what a
        column becomes from its old and new value (the new one, if not given; an absent old value is null). take: whether
        a stored row may change, from the old and the new side. batch: a number; one that isn't over the last applied
        batch's changes nothing, so batches may be delivered again.
        """
        if batch is not None and batch <= self.last_batch():
            return Change()
        fresh = last_wins(rows.select(*self.columns), self.keys, order) if order else rows.select(*self.columns)
        # written once: the buckets are asked for first, and what made the batch may be dear
        delete(self.spark, f"{self.folder}/incoming")
        fresh = written(fresh.withColumn("__bucket", self.bucket()), f"{self.folder}/incoming")
        if not self.manifest():
            value = {c: (merge or {}).get(c, lambda _, x: x)(F.lit(None).cast(fresh.schema[c].dataType), F.col(c)) for c in self.columns if c not in self.keys}
            return self._apply(fresh.select("__bucket", F.lit(True).alias("__new"), *(value.get(c, F.col(c)).alias(c) for c in self.columns)), batch, dropped=False)
        stored = self.read([r[0] for r in fresh.select("__bucket").distinct().collect()])  # at most a row per bucket
        o, n = stored.withColumn("__there", F.lit(True)).alias("o"), fresh.alias("n")
        joined = n.join(o, _same("o", "n", self.keys), "left")
        old, new = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
        rest = [c for c in self.columns if c not in self.keys]
        value = {c: (merge or {}).get(c, lambda _, x: x)(old(c), new(c)) for c in rest}
        absent = F.col("__there").isNull()
        differs = F.lit(False)
        for c in rest:
            differs = differs | ~value[c].eqNullSafe(old(c))
        allowed = F.coalesce(take(old, new), F.lit(False)) if take else F.lit(True)
        changed = joined.where(absent | (allowed & differs))
        delta = changed.select(F.col("__bucket"), absent.alias("__new"), *(new(c).alias(c) if c in self.keys else value[c].alias(c) for c in self.columns))
        return self._apply(delta, batch, dropped=False)

    def delete(self, keys: DataFrame, batch: int | None = None) -> Change:
        """Take out the rows of some keys; keys that aren't there change nothing."""
        if batch is not None and batch <= self.last_batch():
            return Change()
        gone = keys.select(*self.keys).distinct().withColumn("__bucket", self.bucket())
        stored = self.read([r[0] for r in gone.select("__bucket").distinct().collect()])
        there = stored.select(*self.keys).withColumn("__bucket", self.bucket())
        found = there.alias("t").join(gone.alias("g"), _same("t", "g", self.keys), "left_semi")
        return self._apply(found.withColumn("__new", F.lit(False)), batch, dropped=True)

    def rework(self, made: Callable[[DataFrame], DataFrame]) -> Change:
        """Every row anew from what is in it alone: made() gives each row of a frame with other values in columns that are
        no keys, and keeps its further columns. Nothing is joined or shuffled, and only buckets with a row that changes
        are written."""
        rest, entries = [c for c in self.columns if c not in self.keys], self.manifest()

        def anew(buckets: list[int]) -> DataFrame:
            return made(self.read(buckets).withColumns({"__bucket": self.bucket(), "__old": F.struct(*rest)}))

        rows = anew(sorted(entries))
        differs = reduce(lambda x, y: x | y, (~F.col(c).eqNullSafe(F.col("__old")[c]) for c in rest), F.lit(False))
        per = {r["__bucket"]: (r["n"], r["changed"]) for r in rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if(differs).alias("changed")).collect()}
        if {b: n for b, (n, _) in per.items()} != {b: n for b, (_, n) in entries.items()}:
            raise ValueError("made() must give each row once")
        changed = {b: n for b, (_, n) in per.items() if n}
        if not changed:
            return Change()
        version = max(self.versions()) + 1
        delete(self.spark, f"{self.folder}/data/v={version:012d}")  # of a writer that was lost
        data = rows if len(changed) == len(entries) else anew(sorted(changed))
        # a file has rows of one bucket, so tasks write few files each
        data.select(*self.columns, F.col("__bucket").alias("bucket")).write.partitionBy("bucket").parquet(f"{self.folder}/data/v={version:012d}")
        self._commit({b: (version if b in changed else w, n) for b, (w, n) in entries.items()}, version, self.last_batch())
        return Change(0, sum(changed.values()), 0, len(changed))

    def _apply(self, delta: DataFrame, batch: int | None, dropped: bool) -> Change:
        version = max(self.versions(), default=0) + 1
        number = self.last_batch() if batch is None else batch
        delete(self.spark, f"{self.folder}/staged", f"{self.folder}/data/v={version:012d}")  # of a writer that was lost
        if self.manifest():
            delta = written(delta, f"{self.folder}/staged")
        per = {r["__bucket"]: (r["n"], r["new"]) for r in delta.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("__new").alias("new")).collect()}
        entries = self.manifest()
        if not per:
            delete(self.spark, f"{self.folder}/staged", f"{self.folder}/incoming")
            if batch is not None:
                self._commit(entries, version, number)
            return Change()
        stays = self.read(list(per)).alias("o").join(delta.alias("d"), _same("o", "d", self.keys), "left_anti") if entries else None
        rows = stays if dropped else delta.select(*self.columns)
        if entries and not dropped:
            rows = stays.unionByName(rows)
        most = max(entries.get(b, (0, 0))[1] + new for b, (_, new) in per.items())
        pieces = most // TASK_ROWS + 1
        data = rows.withColumn("bucket", self.bucket()).repartition(len(per) * pieces, "bucket", F.pmod(F.xxhash64(F.lit(1), *self.keys), F.lit(pieces)))
        data.write.partitionBy("bucket").parquet(f"{self.folder}/data/v={version:012d}")
        inserted, total = sum(new for _, new in per.values()), sum(n for n, _ in per.values())
        for b, (n, new) in per.items():
            left = entries.get(b, (0, 0))[1] + (-n if dropped else new)
            if left:
                entries[b] = (version, left)
            else:
                entries.pop(b, None)
        self._commit(entries, version, number)
        return Change(0, 0, total, len(per)) if dropped else Change(inserted, total - inserted, 0, len(per))


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def upsert_stream(rows: DataFrame, table: BucketedTable, order: list[str], checkpoint: str, **how):
    """Apply each micro-batch of a stream to the table: files written follow the batch, not the table."""


    def apply(batch: DataFrame, number: int) -> None:
        table.upsert(batch, order=order, batch=number, **how)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
