"""What a tender's documents say about it: the name of the work, their context, the pre-bid meeting; states of processing;
eligibility by bands; reviewed merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.operators import documents
from orefield.operators.fulltext import _let

#: Labels of a work's name, gaps of table columns, published identifiers, clock times, and lengths.
TITLE_LABEL = r"(?i)^\s*(?:\d{1,2}[.)]\s*)?(?:(?:name|title|description|nature)\s+of\s+(?:the\s+)?(?:work|project|tender|assignment|services?|supply|contract)s?|subject|sub\.?|work\s+name|tender\s+title|title)\b\s*[:\-–.]*\s*"
COLUMN_GAP = r"\S\s{3,}\S"
PUBLISHED_ID = r"\b20\d\d_[A-Za-z0-9]+_\d+_\d+\b"
CLOCK = r"(?i)(?<![\d.:])\d{1,2}[:.]\d{2}(?![\d.:])\s*(?:[ap]\.?\s*m\b\.?|hrs\b|hours\b)?"
TITLE_CHARS, CONTEXT_CHARS, INDENT, LABEL_PAGES, WRAPPED_LINES, MENTION_CHARS, MOST_PAGES = 250, 400, 8, 2, 3, 6, 500


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def title_of(lines: Column) -> Column:
    """The name of the work from a page's lines: after its label, or on the next line, with what is wrapped below; '' if
    no label has one."""
    n = F.size(lines)

    def at(i: Column) -> Column:
        raw = F.get(lines, i)
        own = F.regexp_replace(F.regexp_replace(raw, TITLE_LABEL, ""), r"^[ :\-–\t]+|[ :\-–\t]+$", "")
        below = own == ""
        value = F.when(below, F.trim(F.coalesce(F.get(lines, i + 1), F.lit("")))).otherwise(own)
        first = i + 1 + below.cast("int")
        rest = F.slice(lines, first + 1, F.greatest(F.lit(0), i + 1 + WRAPPED_LINES - first))
        good = (F.length(value) >= 6) & (F.length(F.regexp_replace(value, r"\P{L}", "")) >= 4)
        return F.struct(good.alias("good"), value.alias("value"), rest.alias("rest"))

    def wrapped(acc: Column, line: Column) -> Column:
        s, indent = F.trim(line), F.length(line) - F.length(F.ltrim(line))
        over = acc["over"] | (s == "") | (indent < INDENT) | s.rlike(COLUMN_GAP) | documents.is_heading(s)
        return F.struct(F.when(over, acc["text"]).otherwise(F.concat(acc["text"], F.lit(" "), s)).alias("text"), over.alias("over"))

    # few lines have a label: what follows it is looked at there only, and of the first good one only what is wrapped
    labelled = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(lines, i).rlike(TITLE_LABEL))
    first = F.get(F.filter(F.transform(labelled, at), lambda x: x["good"]), 0)
    whole = _let(first, lambda found: F.aggregate(found["rest"], F.struct(found["value"].alias("text"), F.lit(False).alias("over")), wrapped)["text"])
    return F.when(n > 0, F.coalesce(F.left(_tidy(whole), F.lit(TITLE_CHARS)), F.lit(""))).otherwise("")


def contexts(pages: DataFrame, tenders: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, context): the name of the work from a document's first pages, and one line of what it is about.

    pages: doc_id, page, text. tenders: doc_id, title, reference, buyer. The title comes from the first of the two pages
    that has one; identifiers printed on the first page follow, unless they are named already.
    """
    first = pages.where(F.col("page") <= LABEL_PAGES).select("doc_id", "page", "text", title_of(F.split("text", r"\r?\n")).alias("title"))
    named = first.groupBy("doc_id").agg(F.min(F.when(F.col("title") != "", F.struct("page", "title")))["title"].alias("own"), F.min(F.struct("page", "text"))["text"].alias("text"))
    if tenders is not None:
        named = named.join(tenders.select("doc_id", F.filter(F.array("title", "reference", "buyer"), lambda x: F.trim(x) != "").alias("said")), "doc_id", "left")
    said = F.coalesce("said", F.array().cast("array<string>")) if tenders is not None else F.array().cast("array<string>")
    head = F.lower(F.left("own", F.lit(60)))
    known = F.isnull("own") | F.exists(said, lambda x: F.lower(x).contains(head))
    parts = F.when(known, said).otherwise(F.concat(said, F.array("own")))
    ids = F.array_distinct(F.regexp_extract_all("text", F.lit(PUBLISHED_ID), F.lit(0)))
    new = F.filter(ids, lambda i: ~F.exists(parts, lambda x: x.contains(i)))
    line = F.array_join(F.transform(F.concat(parts, new), lambda x: F.trim(x)), " · ")
    return named.select("doc_id", F.coalesce("own", F.lit("")).alias("title"), F.left(line, F.lit(CONTEXT_CHARS)).alias("context"))


def meeting_time(value: Column, facts: Column | None = None) -> Column:
    """The moment of a text with exactly one date and one clock time, in India's time; null for any other. facts: those of
    the text, if they are known."""
    dates = F.filter(documents.facts_of(value) if facts is None else facts, lambda f: f["kind"] == "date")
    day = F.get(dates, 0)
    clocks = F.regexp_extract_all(F.replace(value, day["text"], F.lit(" ")), F.lit(CLOCK), F.lit(0))
    clock = F.lower(F.get(clocks, 0))
    hour, minute = F.regexp_extract(clock, r"^(\d{1,2})", 1).try_cast("int"), F.regexp_extract(clock, r"^\d{1,2}[:.](\d{2})", 1).try_cast("int")
    half = F.regexp_extract(clock, r"([ap])\.?\s*m\b", 1)
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    local = F.concat(day["value"], F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.lpad(minute.cast("string"), 2, "0"), F.lit(":00")).try_cast("timestamp")
    good = (F.size(dates) == 1) & (F.size(clocks) == 1) & (hour <= 23) & (minute <= 59)
    return F.when(good, F.to_utc_timestamp(local, "Asia/Kolkata"))


def with_meetings(tenders: DataFrame, fields: DataFrame) -> DataFrame:
    """tenders whose pre-bid meeting is filled from a document, where none is stored and the document can be trusted.

    tenders: id, reference, published_at, closes_at, prebid. fields: id, value (of the field), text (of the document).
    The time must be exact, between a day before publication and closing, and the text must name the tender's reference.
    """
    told = fields.select("id", "value", "text", documents.facts_once("value").alias("facts"))
    when = meeting_time(F.col("value"), F.col("facts"))
    found = told.select("id", when.alias("at"), F.lower(_tidy(F.col("text"))).alias("text")).where("at is not null")
    mine = tenders.where("prebid is null").join(found, "id")
    named = (F.length("reference") >= MENTION_CHARS) & F.contains("text", F.lower(_tidy(F.col("reference"))))
    inside = (F.col("at") >= F.col("published_at") - F.expr("INTERVAL 1 DAY")) & (F.col("at") <= F.col("closes_at"))
    first = mine.where(named & inside).groupBy("id").agg(F.min("at").alias("filled"))
    return tenders.join(first, "id", "left").withColumn("prebid", F.coalesce("prebid", "filled")).drop("filled")


def processed(docs: DataFrame, pages: DataFrame, force: bool = False) -> DataFrame:
    """docs (doc_id, status) with the state that processing leaves them in, and why if it failed.

    Ready ones stay as they are unless forced; those without a page, with too many, or without any text fail.
    """
    count = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.bool_or(F.trim(F.coalesce("text", F.lit(""))) != "").alias("said"))
    both = docs.join(count, "doc_id", "left")
    n = F.coalesce("pages", F.lit(0))
    error = F.when(n == 0, "no pages").when(n > MOST_PAGES, "too many pages").when(~F.col("said"), "no text")
    idle = (F.col("status") == "ready") & F.lit(not force)
    return both.select("doc_id", F.when(idle, "ready").when(error.isNotNull(), "failed").otherwise("ready").alias("status"), F.when(~idle, error).alias("error"), (~idle).alias("worked"))


def similar_work(required: Column, own: Column) -> Column:
    """met from the highest of the required amounts on, not met under the lowest, unknown between them or if either is."""
    return F.when(F.size(required) <= 0, "unknown").when(own.isNull(), "unknown").when(own >= F.array_max(required), "met").when(own < F.array_min(required), "not_met").otherwise("unknown")


def reviewed(assigned: DataFrame, reviews: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(assigned, entities) after reviews: an approved one moves all of an entity to the candidate, a rejected one changes
    nothing; entities that nothing is assigned to any more go.

    assigned: id, entity. reviews: entity, candidate, approved.
    """
    moves = reviews.where("approved").select("entity", "candidate").dropDuplicates(["entity"])
    moved = assigned.join(moves, "entity", "left").select("id", F.coalesce("candidate", "entity").alias("entity"))
    return moved, entities.join(moved.select("entity").distinct(), "entity", "left_semi")
