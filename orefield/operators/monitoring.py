"""What is known of sources and crawls: coverage, health, plans walked from the newest, bidders' shares, outcomes kept in step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.operators.bucketed import BucketedTable, Change
from orefield.operators.contracts import outcome_rows

SUCCEEDED = "succeeded"
#: How many plans in a row may bring nothing new, or nothing at all, before older ones are left unread.
MOST_REDUNDANT, MOST_EMPTY = 2, 3
#: Fixed value: numbers of bidders are told apart up to this one.
MOST_BIDDERS = 30


def coverage(registry: DataFrame, tenders: DataFrame, runs: DataFrame, as_of: str, scheduled: list[str] | None = None) -> DataFrame:
    """A row per registered source (key, enabled, ...): open_tenders, last_run, last_success, and whether it is enabled and
    scheduled. A source without tenders has none open, one without runs no last run.

    tenders: source, closes_at. runs: run_id, source, status, started, finished, new, updated. Runs that haven't begun
    count as the newest. Each side is one aggregate by source, which meets the registry.
    """
    now = F.lit(as_of).cast("timestamp")
    open_ = tenders.where(F.col("closes_at") >= now).groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("open_tenders"))
    newest = F.max(F.struct(F.col("started").isNull().alias("waits"), "started", "run_id", "status", "finished", "new", "updated"))
    last = runs.groupBy(F.col("source").alias("key")).agg(newest.alias("r"), F.max(F.when(F.col("status") == SUCCEEDED, F.col("finished"))).alias("last_success"))
    last = last.select("key", F.struct("r.status", "r.finished", "r.new", "r.updated").alias("last_run"), "last_success")
    joined = registry.join(open_, "key", "left").join(last, "key", "left")
    on = F.col("enabled") if scheduled is None else F.col("enabled") & F.col("key").isin(scheduled)
    return joined.select(*(c for c in registry.columns if c != "enabled"), on.alias("enabled"), F.coalesce("open_tenders", F.lit(0)).alias("open_tenders"), "last_run", "last_success")


def health(runs: DataFrame, dead_letters: DataFrame, quarantine: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """One row: runs_24h (a map of status to count), last_run_id, last_success_at, open_dead_letters, quarantined_24h."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")
    by_status = runs.where(F.col("started") >= since).groupBy("status").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("runs_24h"))
    last = runs.agg(F.max_by("run_id", F.struct("started", "run_id")).alias("last_run_id"), F.max(F.when(F.col("status") == SUCCEEDED, F.col("finished"))).alias("last_success_at"))
    dead = dead_letters.agg(F.count_if(~F.col("resolved")).alias("open_dead_letters"))
    bad = quarantine.agg(F.count_if(F.col("created_at") >= since).alias("quarantined_24h"))
    return reduce(lambda a, b: a.join(F.broadcast(b)), (last, dead, bad), by_status)  # a row each


def plan_walk(documents: DataFrame, since: int | None = None) -> DataFrame:
    """(project, ref, doc_id): for each reference the newest plan that lists it, by reading a project's plans from the
    newest on until MOST_REDUNDANT in a row bring nothing new, MOST_EMPTY in a row nothing at all, or one is from before
    `since`.

    documents: project, doc_id, doc_date, refs (an array; plans that can't be read are null and count for nothing). A
    project's plans, some dozens, are one value; the walk over them is a fold.
    """
    plans = F.reverse(F.array_sort(F.collect_list(F.struct("doc_date", "doc_id", "refs"))))
    per = documents.groupBy("project").agg(plans.alias("plans"))
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<struct<ref: string, doc_id: bigint>>").alias("found"), F.lit(0).alias("redundant"), F.lit(0).alias("empty"), F.lit(False).alias("done"))

    def step(s: Column, d: Column) -> Column:
        new = F.array_except(F.filter(d["refs"], lambda r: r != ""), s["seen"])
        none, nothing = F.size(d["refs"]) == 0, F.size(new) == 0
        empty, redundant = F.when(none, s["empty"] + 1).otherwise(0), F.when(none, s["redundant"]).when(nothing, s["redundant"] + 1).otherwise(0)
        found = F.transform(new, lambda r: F.struct(r.alias("ref"), d["doc_id"].cast("bigint").alias("doc_id")))
        after = F.struct(F.concat(s["seen"], new).alias("seen"), F.concat(s["found"], found).alias("found"), redundant.alias("redundant"), empty.alias("empty"), ((empty >= MOST_EMPTY) | (redundant >= MOST_REDUNDANT)).alias("done"))
        old = F.coalesce(F.year(d["doc_date"]) < F.lit(since), F.lit(False)) if since is not None else F.lit(False)
        stopped = F.struct(s["seen"].alias("seen"), s["found"].alias("found"), s["redundant"].alias("redundant"), s["empty"].alias("empty"), F.lit(True).alias("done"))
        return F.when(s["done"] | old, stopped).when(d["refs"].isNull(), s).otherwise(after)

    walked = per.select("project", F.explode(F.aggregate("plans", start, step, lambda s: s["found"])).alias("f"))
    return walked.select("project", "f.ref", "f.doc_id")


def bidder_shares(awards: DataFrame, by: list[str], bidders: str = "num_bidders", most: int = MOST_BIDDERS) -> DataFrame:
    """(by, shares): an array of most + 1 shares of awards by how many bid; more than `most` count with the last. Awards
    without a bidder, or of an unknown number, tell nothing."""
    known = awards.where(F.col(bidders) >= 1).select(*by, F.least(F.col(bidders), F.lit(most)).cast("int").alias("n"))
    counts = known.groupBy(*by).agg(*(F.count_if(F.col("n") == k).alias(f"__{k}") for k in range(most + 1)), F.count(F.lit(1)).alias("__all"))
    return counts.select(*by, F.array(*(F.col(f"__{k}") / F.col("__all") for k in range(most + 1))).alias("shares"))


def keep_outcomes(table: BucketedTable, changed: DataFrame, removed: DataFrame, today: str) -> tuple[Change, Change]:
    """Training rows in step with tracks: those of changed tracks are written or, where they no longer qualify, deleted;
    those of removed tracks are deleted. Returns what was written and what deleted; only the buckets of these are touched.

    table: keyed by source_id, with the columns of outcome_rows(). changed: tracks as outcome_rows() takes them. removed:
    org_id, tender_id. A row that is there keeps its first award date.
    """
    source = F.concat_ws(":", F.col("org_id").cast("string"), F.col("tender_id").cast("string")).alias("source_id")
    touched = changed.select(source)
    rows = outcome_rows(changed, table.read_for(touched).select("source_id", "award_date"), today)
    kept = table.upsert(rows)
    return kept, table.delete(touched.join(rows.select("source_id"), "source_id", "left_anti").union(removed.select(source)))
