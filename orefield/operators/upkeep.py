"""Work over what is stored: amounts stated anew, sectors found anew, chunks indexed anew, pages replayed; requests judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions.sectors import classify
from orefield.operators import answers, contracts, notices, prices, search
from orefield.operators.bucketed import BucketedTable, Change
from orefield.operators.documents import passage


def restate(table: BucketedTable, index: DataFrame, target: int, amount: str = "award_value", out: str = "inr_real") -> Change:
    """Amounts of a table in rupees of the target year, after the index has changed: only rows whose amount differs are
    written, and only their buckets."""
    return table.rework(lambda rows: prices.to_real(rows.drop(out), index, target, amount, out=out))


def reclassify(table: BucketedTable, title: str = "title", product: str = "product_category", category: str = "category", out: str = "sector") -> Change:
    """Sectors of a table, after the rules have changed: only rows whose sector differs are written."""
    return table.rework(lambda rows: rows.withColumn(out, classify(F.col(title), F.col(product), F.col(category))))


def replay(table: BucketedTable, pages: DataFrame, since: str, until: str, source: str | None = None, order: tuple[str, ...] = ("fetched_at", "page_id")) -> Change:
    """What pages that were fetched from `since` to before `until`, of one source or all, say of each key, the last one over
    the ones before it; a stored row that a later page has made stays."""
    at = F.col(order[0])
    some = pages.where((at >= F.lit(since).cast("timestamp")) & (at < F.lit(until).cast("timestamp")))
    some = some.where(F.col("source") == source) if source else some
    return table.upsert(some, order=list(order), take=lambda old, new: old(order[0]).isNull() | (new(order[0]) >= old(order[0])))


def reindex(chunks: DataFrame, pages: DataFrame, tenders: DataFrame | None = None, size: int = 384) -> DataFrame:
    """Chunks with their context and vector made anew from the pages that are stored, without reading files again: after a
    document was linked to a tender, or the rules or the model have changed. Chunks of documents without pages stay."""
    told = notices.contexts(pages, tenders).select("doc_id", F.col("context").alias("__context"))
    columns = [c for c in chunks.columns if c not in ("context", "embedding")]
    rows = chunks.join(told, "doc_id", "left").select(*columns, F.coalesce("__context", "context").alias("context"))
    made = rows.withColumn("__said", passage(F.col("context"), F.when(~F.startswith("text", "heading"), F.col("heading")).otherwise(""), F.col("text")))
    return answers.embed(made, "__said", size).drop("__said")


#: Words of a feed's own labels, the first that one has, and the categories they stand for.
HINTS = [("non.*consult|consult.*non", "services"), ("consult", "consultancy"), ("work", "works"), ("good", "goods"), ("service", "services")]


def category_of(ref: Column, *hints: Column) -> Column:
    """A contract's category: by its reference, else by the first label that tells one; '' if none does."""
    groups = F.create_map(*[F.lit(x) for kv in contracts.GROUPS.items() for x in kv])

    def told(hint: Column) -> Column:
        low = F.lower(F.trim(F.coalesce(hint, F.lit(""))))
        out = F.when(groups[F.upper(low)].isNotNull(), groups[F.upper(low)])
        for pattern, category in HINTS:
            out = out.when(low.rlike(pattern), category)
        return out

    own = contracts.reference_category(ref)
    return F.coalesce(F.when(own != "", own), *map(told, hints), F.lit(""))


#: The longest texts of a request, its orderings, and the rows of a page.
TEXTS = {"q": 200, "state": 64, "sector": 32, "category": 64, "source": 32}
SORTS = ("relevance", "closing", "newest", "value")
WHOLE = r"^\s*\+?\d{1,9}\s*$"


def request_errors(given: Column) -> Column:
    """What is wrong with a request's parameters (a map of texts by name), as an array of (parameter, error), by name."""
    v = lambda k: given[k]
    err = lambda k, bad, said: F.when(v(k).isNotNull() & F.coalesce(bad, F.lit(True)), F.struct(F.lit(k).alias("parameter"), F.lit(said).alias("error")))
    n = lambda k: v(k).try_cast("int")
    money = lambda k: ~F.trim(v(k)).rlike(r"^\d{1,16}(\.\d{1,2})?$")
    found = [err(k, F.length(v(k)) > most, f"more than {most} characters") for k, most in TEXTS.items()]
    found += [err(k, F.trim(v(k)) == "", "empty") for k in TEXTS if k != "q"]
    found += [err("pin", ~v("pin").rlike(r"^[1-9]\d{1,5}$"), "not a PIN prefix"), err("sort", ~v("sort").isin(*SORTS), "not an ordering")]
    found += [err(k, ~v(k).rlike(WHOLE) | (n(k) < 1), "not a whole number from 1 on") for k in ("buyer", "page")]
    found += [err("page_size", ~v("page_size").rlike(WHOLE) | ~n("page_size").between(1, search.MOST_PER_PAGE), f"not a whole number from 1 to {search.MOST_PER_PAGE}")]
    found += [err(k, money(k), "not an amount") for k in ("min_value", "max_value")]
    found += [err(k, v(k).try_cast("timestamp").isNull(), "not a time") for k in ("closes_before", "closes_after")]
    return F.array_sort(F.array_compact(F.array(*found)))


def run_summary(rows: DataFrame, stored: str = "reconciliation") -> DataFrame:
    """rows with expected, accounted and problems from a run's stored JSON; no JSON, or one without problems, has none."""
    told = F.from_json(F.coalesce(stored, F.lit("{}")), "expected_from_index long, accounted long, problems array<string>")
    return rows.withColumn("__told", told).select(*rows.columns, F.col("__told.expected_from_index").alias("expected"), F.col("__told.accounted").alias("accounted"), F.coalesce("__told.problems", F.array().cast("array<string>")).alias("problems")).drop(stored)


def reconciled(runs: DataFrame) -> DataFrame:
    """runs with `reconciliation`, a JSON text, and the status that it makes of them.

    runs: run_id, expected, listed, pending, failed, done, force.
    """
    c = F.col
    problems = F.array_compact(F.array(
        F.when(c("expected") != c("listed"), F.format_string("index claims %d tenders, listings show %d", "expected", "listed")), F.when(c("pending") > 0, F.format_string("%d tenders never finished", "pending")),
        F.when(c("failed") > 0, F.format_string("%d tenders dead-lettered", "failed")),
    ))
    body = F.to_json(F.struct(c("expected").alias("expected_from_index"), c("listed").alias("listed_rows"), (c("done") + c("failed")).alias("accounted"), c("pending"), problems.alias("problems")))
    status = F.when(c("force") & (c("pending") > 0), "incomplete").when(F.size(problems) > 0, "mismatch").otherwise("succeeded")
    return runs.withColumn("reconciliation", body).withColumn("status", status)
