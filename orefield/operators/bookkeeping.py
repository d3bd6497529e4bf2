"""Bookkeeping around crawls, documents, alerts and tracked tenders: who may run, what is kept, what is new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: After so many hours a running crawl counts as lost; when crawls begin, in minutes.
STALE_HOURS = 6
HOURLY_FIRST, HOURLY_WINDOW, NIGHTLY_FIRST, NIGHTLY_STEP = 5, 50, 60, 4
PREFIX = r"^[1-9]\d{1,5}$"


def walk(listings: DataFrame, organisations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, totals): each tender's first listing row, and per organisation what it claims against what it lists.

    listings: organisation, ord (order of arrival over all), tender_id, and more. organisations: organisation, claimed.
    The first row is an aggregate over structs, so a tender that many list isn't gathered.
    """
    rest = [c for c in listings.columns if c not in ("tender_id", "ord")]
    named = listings.where(F.coalesce("tender_id", F.lit("")) != "")
    first = named.groupBy("tender_id").agg(F.min(F.struct("ord", *rest)).alias("b")).select("tender_id", "b.*")
    listed = listings.groupBy("organisation").agg(F.count(F.lit(1)).alias("listed"))
    totals = organisations.join(listed, "organisation", "left").select("organisation", "claimed", F.coalesce("listed", F.lit(0)).alias("listed"))
    return first, totals.withColumn("mismatch", F.col("claimed") != F.col("listed"))


def free_sources(asked: DataFrame, runs: DataFrame, now: str) -> DataFrame:
    """asked (source) without those that have a running crawl younger than STALE_HOURS."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {STALE_HOURS} HOURS")
    busy = runs.where((F.col("status") == "running") & (F.col("started") >= since)).select("source").distinct()
    return asked.join(busy, "source", "left_anti")


def resolve_sources(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """(source, ord, known): asked keys in order, each once; 'all' stands for the registry's enabled ones; blanks go.

    asked: pos, key. registry: source, ord, enabled. Unknown keys stay, with known = false, for the caller to refuse.
    """
    keys = asked.select("pos", F.trim("key").alias("key")).where("key <> ''")
    every = keys.where("key = 'all'").crossJoin(registry.where("enabled").select("source", "ord"))  # the keys named 'all', at most a few, with each source
    named = keys.where("key <> 'all'").select("pos", F.col("key").alias("source"), F.lit(0).alias("ord"))
    wanted = every.select("pos", "source", "ord").unionByName(named).groupBy("source").agg(F.min(F.struct("pos", "ord")).alias("at"))
    return wanted.join(registry.select("source", F.lit(True).alias("known")), "source", "left").select("source", "at.pos", "at.ord", F.coalesce("known", F.lit(False)).alias("known"))


def schedule(sources: DataFrame) -> DataFrame:
    """sources (source, place, n) with the minute of the hourly crawl and the time of the nightly one."""
    nightly = NIGHTLY_FIRST + F.col("place") * NIGHTLY_STEP
    return sources.select("source", (HOURLY_FIRST + F.floor(F.col("place") * HOURLY_WINDOW / F.greatest("n", F.lit(1)))).cast("int").alias("hourly_minute"), (F.floor(nightly / 60) % 24).cast("int").alias("nightly_hour"), (nightly % 60).cast("int").alias("nightly_minute"))


def dead_letters(attempts: DataFrame, most: int) -> DataFrame:
    """(task_id, attempts, error): tasks whose every attempt failed, `most` times or more, with their last error."""
    done = F.bool_or(F.col("error").isNull())
    last = F.max_by("error", "attempt")
    return attempts.groupBy("task_id").agg(F.count(F.lit(1)).alias("attempts"), last.alias("error"), done.alias("done")).where(~F.col("done") & (F.col("attempts") >= most)).drop("done")


def kept_pages(loaded: DataFrame, current: DataFrame, retention_days: int) -> DataFrame:
    """loaded (item, tender_id, page_id, outcome) with the page that is kept: that of an unchanged tender is the one it was
    loaded from, if fetched pages aren't retained; `discarded` says that the fetched one goes."""
    known = current.select("tender_id", F.col("page_id").alias("own"))
    same = (F.col("outcome") == "unchanged") & F.lit(retention_days == 0)
    kept = F.when(same, F.coalesce("own", "page_id")).otherwise(F.col("page_id"))
    return loaded.join(known, "tender_id", "left").select("item", "tender_id", kept.alias("page_id"), "outcome", (kept != F.col("page_id")).alias("discarded"))


def replace_chunks(stored: DataFrame, fresh: DataFrame, doc: str = "doc_id") -> DataFrame:
    """stored with all chunks of the documents in fresh replaced by those there."""
    return stored.join(fresh.select(doc).distinct(), doc, "left_anti").unionByName(fresh)


def register(stored: DataFrame, uploads: DataFrame) -> DataFrame:
    """The documents after some uploads: one per organisation and content hash.

    stored and uploads: org_id, sha256, doc_id, status, tender_id. A new hash is added, as its first upload. One that is
    there stays, but a failed one is replaced, and one without a tender gets the upload's.
    """
    first = uploads.groupBy("org_id", "sha256").agg(F.min(F.struct("doc_id", "status", "tender_id")).alias("u"))
    old = stored.select("org_id", "sha256", F.struct("doc_id", "status", "tender_id").alias("s"))
    both = old.join(first, ["org_id", "sha256"], "full")
    replaced = F.col("s").isNull() | (F.col("u").isNotNull() & (F.col("s.status") == "failed"))
    pick = lambda c: F.when(replaced, F.col(f"u.{c}")).otherwise(F.col(f"s.{c}"))
    return both.select("org_id", "sha256", pick("doc_id").alias("doc_id"), pick("status").alias("status"), F.when(replaced, F.col("u.tender_id")).otherwise(F.coalesce("s.tender_id", "u.tender_id")).alias("tender_id"))


def track(stored: DataFrame, asked: DataFrame, keys: tuple[str, ...] = ("org_id", "tender_id")) -> DataFrame:
    """stored and the asked rows that it has no row for; a row that is there stays as it is."""
    return stored.unionByName(asked.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti"))


def alert_counts(members: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(org_id, alerts): active subscriptions of an organisation's members; membership is unique, so nothing multiplies."""
    per_user = subscriptions.where("active").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return members.join(per_user, "user_id").groupBy("org_id").agg(F.sum("n").alias("alerts"))


def seats(members: DataFrame, invites: DataFrame, now: str) -> DataFrame:
    """(org_id, seats): members, and invitations that are neither accepted nor expired."""
    open_ = invites.where(~F.col("accepted") & (F.col("expires_at") > F.lit(now).cast("timestamp")))
    return members.select("org_id").union(open_.select("org_id")).groupBy("org_id").agg(F.count(F.lit(1)).alias("seats"))


def criteria(asked: DataFrame, states: list[str], sectors: list[str]) -> DataFrame:
    """asked (id, states, sectors, pin_prefixes) in order and without repeats, and what is wrong with it."""
    tidy = lambda c: F.array_sort(F.array_distinct(c))
    unknown = lambda c, known: F.array_except(c, F.array(*map(F.lit, known)))
    bad = F.filter("pin_prefixes", lambda p: ~p.rlike(PREFIX))
    said = F.array_compact(F.array(
        F.when(F.size(unknown("states", states)) > 0, F.concat(F.lit("unknown state: "), F.array_join(tidy(unknown("states", states)), ", "))),
        F.when(F.size(unknown("sectors", sectors)) > 0, F.concat(F.lit("unknown sector: "), F.array_join(tidy(unknown("sectors", sectors)), ", "))),
        F.when(F.size(bad) > 0, F.concat(F.lit("not a PIN prefix: "), F.array_join(tidy(bad), ", "))),
    ))
    return asked.select("id", tidy("states").alias("states"), tidy("sectors").alias("sectors"), tidy("pin_prefixes").alias("pin_prefixes"), said.alias("errors"))


def in_area(states: list[str], prefixes: list[str], state: str = "state", pin: str = "pincode") -> Column:
    """In any of the states, or under any of the prefixes; nothing named is everywhere."""
    named = ([F.col(state).isin(states)] if states else []) + [F.col(pin).startswith(p) for p in prefixes]
    out = named[0] if named else F.lit(True)
    for c in named[1:]:
        out = out | c
    return F.coalesce(out, F.lit(False))


def rank_errors(stored: DataFrame, patch: DataFrame) -> DataFrame:
    """stored tracks with a patch on them (null: unchanged), and whether our rank is over the number of bidders."""
    p = patch.select("id", F.col("our_rank").alias("r"), F.col("num_bidders").alias("b"))
    new = stored.join(p, "id").select("id", F.coalesce("r", "our_rank").alias("our_rank"), F.coalesce("b", "num_bidders").alias("num_bidders"))
    out = (F.col("our_rank") < 1) | (F.col("num_bidders") < 1) | (F.col("our_rank") > F.col("num_bidders"))
    return new.withColumn("refused", F.coalesce(out, F.lit(False)))


def outcome_method(tender_type: Column) -> Column:
    low = F.lower(F.coalesce(tender_type, F.lit("")))
    return F.when(low.contains("limited"), "limited").when(low.contains("single"), "single").when(low.rlike("open|global|competitive"), "open").otherwise("")


def outcome_category(label: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(low.startswith("consult"), "consultancy").when(low.isin("works", "goods", "services", "consultancy"), low).otherwise("")


def yearly_files(distributions: DataFrame, since: int, first: int, last: int, pattern: str) -> DataFrame:
    """(year, url): a catalogue's yearly files from a year on; by the store's pattern where the catalogue has none.

    distributions: title, download_url and access_url (arrays). A zip comes before other links.
    """
    year = F.regexp_extract(F.trim("title"), r"(\d{4})\s*$", 1).try_cast("int")
    links = F.concat(F.coalesce("download_url", F.array().cast("array<string>")), F.coalesce("access_url", F.array().cast("array<string>")))
    best = F.coalesce(F.get(F.filter(links, lambda u: u.endswith(".zip")), 0), F.get(links, 0))
    listed = distributions.select(year.alias("year"), best.alias("url")).where("year is not null and url is not null").groupBy("year").agg(F.max("url").alias("url"))
    spark = distributions.sparkSession
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    made = years.select("year", F.format_string(pattern, "year").alias("url"))
    some = listed.agg(F.count(F.lit(1)).alias("n"))
    fallback = made.join(F.broadcast(some)).where("n = 0").drop("n")
    return listed.unionByName(fallback).where(F.col("year") >= since)
