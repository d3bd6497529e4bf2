"""Sinks: spreadsheet CSV, nested release JSON, calendar text, retention."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefield.functions.scalars import safe_cell

#: The most rows of a spreadsheet, as the feature promises; the full count goes beside it.
CSV_ROWS = 10_000
FOLD_OCTETS = 75


def csv_rows(df: DataFrame, order: list, zone: str = "Asia/Kolkata") -> DataFrame:
    """df's first rows by order as text cells: local ISO times, no formulas."""
    cell = lambda f: F.date_format(F.from_utc_timestamp(f.name, zone), "yyyy-MM-dd'T'HH:mm:ss") if f.dataType.typeName() == "timestamp" else safe_cell(F.col(f.name).cast("string"))
    return df.orderBy(*order).limit(CSV_ROWS).select(*(F.coalesce(cell(f), F.lit("")).alias(f.name) for f in df.schema.fields))


def write_csv(df: DataFrame, order: list, path: str) -> None:
    csv_rows(df, order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


#: The columns of a spreadsheet of tenders, as they are headed, and where each comes from.
SHEET = {
    "tender_id": "tender_id", "reference_no": "reference", "title": "title", "buyer": "buyer", "organisation_chain": "org_chain", "category": "category", "sector": "sector", "state": "state",
    "location": "location", "pincode": "pincode", "value_inr": "value_inr", "emd_inr": "emd_inr", "fee_inr": "fee_inr", "published_at": "published_at", "closes_at": "closes_at",
    "bid_opening_at": "opens_at", "source_portal": "source", "source_url": "url", "page_url": "page_url",
}
#: What tells a spreadsheet that a file is UTF-8: it begins with this.
BOM = "\ufeff"


def sheet(df: DataFrame, order: list, zone: str = "Asia/Kolkata", offset: str = "+05:30") -> DataFrame:
    """The first CSV_ROWS rows by order, as the columns of SHEET in text: local ISO times with their offset, plain
    numbers, no formulas; what a row lacks is empty."""
    def cell(source: str) -> Column:
        if source not in df.columns:
            return F.lit("")
        kind = df.schema[source].dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            text = F.concat(F.date_format(F.from_utc_timestamp(F.col(source).cast("timestamp"), zone), "yyyy-MM-dd'T'HH:mm:ss"), F.lit(offset))
        else:
            text = F.col(source).cast("string") if kind != "string" else safe_cell(F.col(source))
        return F.coalesce(text, F.lit(""))

    return df.orderBy(*order).limit(CSV_ROWS).select(*(cell(source).alias(name) for name, source in SHEET.items()))


def write_sheet(df: DataFrame, order: list, path: str) -> None:
    """sheet() as one CSV file that begins with BOM; it has at most CSV_ROWS rows."""
    rows = sheet(df, order)
    headed = rows.withColumnRenamed(rows.columns[0], BOM + rows.columns[0])
    headed.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def releases(tenders: DataFrame, awards: DataFrame) -> DataFrame:
    """(id, release): open contracting JSON; what is unknown is left out, not null.

    awards: (id, award_id, supplier, amount); grouped once, then joined to their tender.
    """
    grouped = awards.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(F.col("award_id").alias("id"), F.struct(F.col("amount"), F.lit("INR").alias("currency")).alias("value"), F.array(F.struct(F.col("supplier").alias("name"))).alias("suppliers")))).alias("awards"))
    unless = lambda c: F.when(F.col(c).cast("string") != "", F.col(c))
    body = F.struct(
        F.concat(F.lit("ocds-orefield-"), F.col("id").cast("string")).alias("ocid"), F.lit("tender").alias("initiationType"),
        F.struct(unless("buyer").alias("name")).alias("buyer"),
        F.struct(F.col("id").cast("string").alias("id"), F.when(F.col("value_inr").isNotNull(), F.struct(F.col("value_inr").alias("amount"), F.lit("INR").alias("currency"))).alias("value"), F.struct(F.col("published_at").alias("startDate"), F.col("closes_at").alias("endDate")).alias("tenderPeriod")).alias("tender"),
        F.col("awards"),
    )
    return tenders.join(grouped, "id", "left").select("id", F.to_json(body, {"ignoreNullFields": "true"}).alias("release"))


#: Which categories releases know.
RELEASE_CATEGORIES = ("works", "goods", "services")


def packages(tenders: DataFrame, awards: DataFrame, prefix: str, now: str) -> DataFrame:
    """(id, release): open contracting JSON of a tender as last seen, with its parties, notice and awards; what is unknown
    isn't there.

    tenders: id, source, tender_id, title, buyer, buyer_id, state, pincode, category, value_inr, published_at, closes_at,
    content_hash, and as far as there are such columns url, tender_type, emd_inr, opens_at, last_seen. awards: id,
    award_id, supplier, supplier_key, amount, award_date. An award's supplier is a party once.
    """
    have = set(tenders.columns)
    c = lambda name: F.col(name) if name in have else F.lit(None).cast("string")
    some = lambda x: F.when(x.cast("string") != "", x)
    iso = lambda x: F.date_format(x.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    rupees = lambda x: F.when(x.isNotNull(), F.struct(x.cast("double").alias("amount"), F.lit("INR").alias("currency")))
    name = F.coalesce(some(F.col("supplier")), F.lit("Unknown bidder"))
    supplier = F.concat(F.lit("supplier-"), F.coalesce(some(F.col("supplier_key")), name))
    one = F.struct("award_id", F.struct(supplier.alias("id"), name.alias("name")).alias("who"), rupees(F.col("amount")).alias("value"), F.col("award_date").cast("string").alias("date"))
    grouped = awards.groupBy("id").agg(F.sort_array(F.collect_list(one)).alias("__won"))
    rows = tenders.join(grouped, "id", "left")
    key, ocid = F.col("tender_id"), F.concat_ws("-", F.lit(prefix), "source", "tender_id")
    buyer_id = F.concat(F.lit("buyer-"), F.coalesce(c("buyer_id").cast("string"), F.concat("source", F.lit("-raw"))))
    there = (some(c("state")).isNotNull()) | (some(c("pincode")).isNotNull())
    address = F.when(there, F.struct(some(c("state")).alias("region"), some(c("pincode")).alias("postalCode"), F.lit("India").alias("countryName")))
    party = lambda i, n, role, place: F.struct(i.alias("id"), n.alias("name"), F.array(F.lit(role)).alias("roles"), place.alias("address"))
    nowhere = F.lit(None).cast("struct<region: string, postalCode: string, countryName: string>")
    suppliers = F.transform(F.array_distinct(F.transform("__won", lambda a: a["who"])), lambda w: party(w["id"], w["name"], "supplier", nowhere))
    parties = F.concat(F.array(party(buyer_id, F.col("buyer"), "buyer", address)), F.coalesce(suppliers, F.array().cast("array<struct<id: string, name: string, roles: array<string>, address: struct<region: string, postalCode: string, countryName: string>>>")))
    notice = F.when(some(c("url")).isNotNull(), F.array(F.struct(F.concat(key, F.lit("-notice")).alias("id"), F.lit("tenderNotice").alias("documentType"), F.concat(F.lit("Tender notice on "), F.col("source")).alias("title"), c("url").alias("url"), F.lit("text/html").alias("format"), F.lit("en").alias("language"))))
    low = F.lower(c("category"))
    emd = c("emd_inr")
    tender = F.struct(
        key.alias("id"), F.col("title"), F.when(F.col("closes_at") >= F.lit(now).cast("timestamp"), "active").alias("status"), rupees(c("value_inr")).alias("value"), some(c("tender_type")).alias("procurementMethodDetails"),
        F.when(low.isin(*RELEASE_CATEGORIES), low).alias("mainProcurementCategory"), F.struct(iso(c("published_at")).alias("startDate"), iso(c("closes_at")).alias("endDate")).alias("tenderPeriod"), notice.alias("documents"),
        F.when(emd.isNotNull(), F.struct(F.lit("Earnest money deposit (EMD)").alias("description"), emd.cast("double").alias("amount"), F.lit("INR").alias("currency"))).alias("guarantee"),
        F.when(c("opens_at").isNotNull(), F.struct(iso(c("opens_at")).alias("startDate"))).alias("awardPeriod"),
    )
    won = F.transform("__won", lambda a: F.struct(F.concat(key, F.lit("-award-"), a["award_id"].cast("string")).alias("id"), F.lit("active").alias("status"), F.array(a["who"]).alias("suppliers"), a["value"].alias("value"), a["date"].alias("date")))
    tags = F.when(F.size("__won") > 0, F.array(F.lit("tender"), F.lit("award"))).otherwise(F.array(F.lit("tender")))
    body = F.struct(
        ocid.alias("ocid"), F.concat_ws("-", ocid, F.left("content_hash", F.lit(16))).alias("id"), iso(c("last_seen")).alias("date"), tags.alias("tag"), F.lit("tender").alias("initiationType"), F.lit("en").alias("language"), parties.alias("parties"),
        F.struct(buyer_id.alias("id"), F.col("buyer").alias("name")).alias("buyer"), tender.alias("tender"), won.alias("awards"),
    )
    return rows.select("id", F.to_json(body, {"ignoreNullFields": "true"}).alias("release"))


def fold(line: str) -> str:
    """A calendar line in pieces of at most 75 octets, none of which cuts a character."""
    out, now = [], b""
    for char in line:
        raw = char.encode()
        if len(now) + len(raw) > FOLD_OCTETS - (1 if out else 0):
            out.append(now)
            now = b""
        now += raw
    out.append(now)
    return "\r\n ".join(x.decode() for x in out)


@F.pandas_udf(T.StringType())
def folded(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: None if x is None else fold(x))


def escaped(text):
    """Text as a calendar's value."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\;,])", r"\\$1")
    return F.regexp_replace(plain, r"\r\n|\n|\r", r"\\n")


def calendar(df: DataFrame) -> DataFrame:
    """One row per event: a tender's closing, opening and meeting before bids, as far as they are known.

    df: id, title, closes_at, opens_at, prebid_meeting.
    """
    kinds = [("closes_at", "Closes"), ("opens_at", "Bids open"), ("prebid_meeting", "Pre-bid meeting")]
    events = F.array_compact(F.array(*(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("kind"), F.lit(label).alias("label"), F.col(c).alias("at"))) for c, label in kinds)))
    rows = df.select("id", "title", F.explode(events).alias("e"))
    line = lambda name, value: folded(F.concat(F.lit(name), value))
    stamp = F.date_format("e.at", "yyyyMMdd'T'HHmmss'Z'")
    body = F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), line("UID:", F.concat_ws("-", F.col("id").cast("string"), "e.kind")), line("DTSTART:", stamp), line("SUMMARY:", F.concat(F.col("e.label"), F.lit(": "), escaped(F.col("title")))), F.lit("END:VEVENT"))
    return rows.select("id", F.col("e.kind").alias("kind"), F.col("e.at").alias("at"), body.alias("event"))


def retained(pages: DataFrame, references: list[DataFrame], as_of: str, listing_days: int = 7, detail_days: int = 30) -> DataFrame:
    """Pages that stay: young ones, and old detail pages that a table still refers to (anti joins, null-safe)."""
    age = F.datediff(F.lit(as_of).cast("timestamp"), "fetched_at")
    old = (F.col("kind") == "listing") & (age > listing_days) | (F.col("kind") == "detail") & (age > detail_days)
    stale = pages.where(old)
    unused = stale.where("kind = 'listing'").select("page_id")
    details = stale.where("kind = 'detail'").select("page_id")
    for r in references:
        details = details.join(r.where("page_id is not null").select("page_id").distinct(), "page_id", "left_anti")
    return pages.join(unused.union(details), "page_id", "left_anti")
