"""Award datasets as sources: each reads its files into one record type. Admission and derivation are columns."""

from __future__ import annotations

import csv
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.csv as pacsv
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefield.functions import scalars

RATIO_MIN, RATIO_MAX = 0.2, 3.0
MONEY = "decimal(20,2)"
#: The record that every source gives.
RECORD = T.StructType([T.StructField(n, t) for n, t in (
    ("source", T.StringType()), ("source_id", T.StringType()), ("country", T.StringType()), ("state", T.StringType()), ("district", T.StringType()), ("buyer", T.StringType()), ("title", T.StringType()),
    ("category", T.StringType()), ("sector", T.StringType()), ("method", T.StringType()), ("currency", T.StringType()), ("estimated_value", T.DecimalType(20, 2)), ("award_value", T.DecimalType(20, 2)),
    ("num_bidders", T.IntegerType()), ("bids", T.ArrayType(T.DoubleType())), ("winner", T.StringType()), ("tender_date", T.DateType()), ("award_date", T.DateType()), ("year", T.IntegerType()),
)])
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(key: str):
    """Make a reader known under a key; a key can be given once."""

    def keep(f):
        if key in SOURCES:
            raise ValueError(f"two sources are called {key}")
        SOURCES[key] = f
        return f

    return keep


def read(spark: SparkSession, key: str, path: str, since: int | None = None, limit: int | None = None) -> DataFrame:
    if key not in SOURCES:
        raise ValueError(f"no source {key}; there are {', '.join(sorted(SOURCES))}")
    df = SOURCES[key](spark, path)
    if since:
        df = df.where(F.coalesce("year", F.lit(0)) >= since)
    return df.limit(limit) if limit else df


def conform(df: DataFrame, source: str) -> DataFrame:
    """df in the shape of RECORD: absent texts are '', the rest null."""
    have = set(df.columns)
    text = lambda f: F.coalesce(F.col(f.name), F.lit("")) if f.name in have else F.lit("")
    pick = lambda f: F.lit(source) if f.name == "source" else text(f) if isinstance(f.dataType, T.StringType) else F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
    return df.select(*(pick(f).alias(f.name) for f in RECORD.fields))


def require(df: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def zipped_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of the CSV files in zip archives, as strings, with their file and line; headers in any case, quoted or not.

    An archive is one task's, since zip can't be split. It is opened by its path and its files are streamed block by
    block, so its size doesn't matter.
    """
    names = [c.upper() for c in columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in batch.column("path").to_pylist():
                fs, own = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", place))
                with fs.open_input_file(own) as archive, zipfile.ZipFile(archive) as z:
                    for member in z.namelist():
                        if not member.lower().endswith(".csv"):
                            continue
                        line = 1
                        with z.open(member) as raw:
                            head = next(csv.reader([raw.readline().decode("utf-8-sig", "replace").strip()]), [])
                            header = [h.strip().upper() for h in head]
                            options = pacsv.ConvertOptions(column_types={h: pa.string() for h in header}, strings_can_be_null=False)
                            for part in pacsv.open_csv(raw, read_options=pacsv.ReadOptions(column_names=header), parse_options=pacsv.ParseOptions(newlines_in_values=True), convert_options=options):
                                n = part.num_rows
                                cols = [part.column(header.index(c)) if c in header else pa.nulls(n, pa.string()) for c in names]
                                yield pa.RecordBatch.from_arrays([*cols, pa.array([f"{place}!{member}"] * n), pa.array(range(line, line + n), pa.int64())], [*names, "file", "line"])
                                line += n

    schema = ", ".join(f"`{c}` string" for c in names) + ", file string, line long"
    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, schema)


def plain_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows of CSV files that are plain or compressed by gzip, as strings, headers in any case."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    have = {c.strip().upper(): c for c in read.columns}
    return read.select(*((F.col(f"`{have[c.upper()]}`") if c.upper() in have else F.lit(None).cast("string")).alias(c.upper()) for c in columns), F.col("_metadata.file_path").alias("file"))


#: Codes of the European award notices.
TED_COLUMNS = "ID_NOTICE_CAN YEAR DT_DISPATCH DT_AWARD CANCELLED INFO_ON_NON_AWARD CAE_NAME ISO_COUNTRY_CODE TYPE_OF_CONTRACT B_FRA_AGREEMENT B_DYN_PURCH_SYST B_FRA_CONTRACT FRA_ESTIMATED CPV ID_LOT ID_AWARD TOP_TYPE WIN_NAME TITLE NUMBER_OFFERS AWARD_EST_VALUE_EURO AWARD_VALUE_EURO".split()
TED_COUNTRY = {"UK": "GB", "EL": "GR"}
TED_CATEGORY = {"W": "works", "S": "services", "U": "goods"}
TED_METHOD = {"OPE": "open", "RES": "limited", "NOC": "single", "NOP": "single", "AWP": "single", "COD": "other", "INP": "other", "NIC": "other", "NIP": "other", "NEC": "other", "NEG": "other"}
MOST_BIDDERS = 999


def mapped(code: Column, names: dict[str, str], other: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(table[F.trim(code)], F.lit("") if other is None else other)


def ted_reason(df: DataFrame) -> DataFrame:
    """df with est, award, iso and the first reason against a notice's row, 'emitted' if there is none."""
    yes = lambda c, v: F.coalesce(F.trim(c), F.lit("")) == v
    given = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    code = F.upper(F.trim("ISO_COUNTRY_CODE"))
    a = df.withColumns({"est": scalars.plausible_amount(F.trim("AWARD_EST_VALUE_EURO")), "award": scalars.plausible_amount(F.trim("AWARD_VALUE_EURO")), "iso": mapped(code, TED_COUNTRY, code)})
    ratio = F.col("award").cast("double") / F.col("est").cast("double")
    reason = (
        F.when(yes("CANCELLED", "1") | given("INFO_ON_NON_AWARD"), "cancelled_or_not_awarded")
        .when(yes("B_FRA_AGREEMENT", "Y") | yes("B_DYN_PURCH_SYST", "Y") | yes("B_FRA_CONTRACT", "Y") | given("FRA_ESTIMATED"), "framework_or_dps")
        .when(F.col("est").isNull() | F.col("award").isNull(), "no_estimate_or_award").when(F.col("est") == F.col("award"), "award_equals_estimate")
        .when(~ratio.between(RATIO_MIN, RATIO_MAX), "ratio_out_of_band").when(~F.coalesce(F.col("iso").rlike("^[A-Z]{2}$"), F.lit(False)), "no_country")
        .when(~given("ID_NOTICE_CAN"), "no_id").otherwise("emitted")
    )
    return a.withColumn("reason", reason)


def ted_records(df: DataFrame) -> DataFrame:
    """Admitted rows of European notices as records. df: TED_COLUMNS and line."""
    offers, year = F.trim("NUMBER_OFFERS").try_cast("int"), F.trim("YEAR").try_cast("int")
    first = lambda *cs: F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in cs))
    spoken = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "---", "; "))
    rows = ted_reason(df).where("reason = 'emitted'").select(
        F.concat_ws(":", F.trim("ID_NOTICE_CAN"), F.coalesce(first("ID_AWARD", "ID_LOT"), F.col("line").cast("string"))).alias("source_id"), F.col("iso").alias("country"), F.trim("CAE_NAME").alias("buyer"),
        spoken("TITLE").alias("title"), mapped(F.col("TYPE_OF_CONTRACT"), TED_CATEGORY).alias("category"), scalars.cpv_sector(F.col("CPV")).alias("sector"), mapped(F.col("TOP_TYPE"), TED_METHOD).alias("method"),
        F.lit("EUR").alias("currency"), F.col("est").alias("estimated_value"), F.col("award").alias("award_value"), F.when(offers.between(1, MOST_BIDDERS), offers).alias("num_bidders"), spoken("WIN_NAME").alias("winner"),
        F.when(year.isNull(), scalars.parse_award_date(F.col("DT_AWARD"))).otherwise(scalars.plausible_award_date(F.col("DT_AWARD"), year, F.col("DT_DISPATCH"))).alias("award_date"), year.alias("year"),
    )
    return conform(rows, "ted")


@register("ted")
def ted(spark: SparkSession, path: str) -> DataFrame:
    return ted_records(zipped_csv(spark, path, TED_COLUMNS))


#: Columns and empty marks of the rural roads file; what isn't a contractor.
ROAD_COLUMNS = "id state_name state_code district_name road_name packages upgrade_or_new contractor_name company_name sanctioned_year work_award_date total_cost".split()
ROAD_NULLS = ("", "none", "nan", "na", "n/a", "null", "0", "0.0", "-")
NO_WINNER = r"(?i)^(bms(?!.*\b(private|pvt|ltd|limited)\b).*|.*expenditure.*|project\s*and\s*design|no|nil|n\.?a\.?)$"
FIRST_DAY, LEAST_COST = "2000-04-01", 100_000


def road_value(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when(F.lower(t).isin(*ROAD_NULLS), "").otherwise(t)


def road_winner(text: Column) -> Column:
    """A contractor's name without trailing marks; '' for budget heads and other noise."""
    plain = road_value(text)
    for ref, char in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")):
        plain = F.replace(plain, F.lit(ref), F.lit(char))
    name = F.regexp_replace(F.regexp_replace(plain, r"\s+", " "), r"[\s.,;:-]+$", "")
    return F.when((F.length(F.regexp_replace(name, "[^A-Za-z]", "")) < 3) | name.rlike(NO_WINNER), "").otherwise(name)


def road_records(df: DataFrame, today: str, row: str = "id") -> DataFrame:
    """One record per award of a road: habitation rows grouped by state, package, road and award date.

    The winner is the most frequent one, of equals the first by row order; sanction year and cost are the latest pair
    not after the award, else the latest, priced pairs first, of a year the most frequent cost.
    """
    require(df, ROAD_COLUMNS, "rural roads file")
    road = road_value(F.col("road_name"))
    day = scalars.day_month_year(road_value(F.col("work_award_date")), FIRST_DAY, today)
    part = F.when(road != "", F.substring(F.sha1(F.regexp_replace(F.lower(road), r"\s+", " ")), 1, 12)).otherwise(F.concat(F.lit("row"), F.col(row)))
    dash = lambda c: F.when(c == "", "-").otherwise(c)
    key = F.concat_ws(":", dash(road_value(F.col("state_code"))), dash(road_value(F.col("packages"))), part, F.coalesce(day.cast("string"), F.lit("-")))
    since = F.regexp_extract(road_value(F.col("sanctioned_year")), r"^(\d{4})", 1).try_cast("int")
    cost = scalars.parse_amount(F.when(road_value(F.col("total_cost")) != "", F.col("total_cost")), unit="lakh")
    company = road_value(F.col("company_name"))
    rows = df.select(
        key.alias("key"), F.col(row).try_cast("long").alias("ord"), day.alias("award_date"), F.when(company != "", road_winner(company)).otherwise(road_winner(F.col("contractor_name"))).alias("winner"),
        F.when(since.between(2000, F.year(F.lit(today).cast("date"))), since).alias("since"), F.when(cost >= LEAST_COST, cost).alias("cost"),
        F.struct(road_value(F.col("state_name")).alias("state"), road_value(F.col("district_name")).alias("district"), road.alias("road"), F.lower(road_value(F.col("upgrade_or_new"))).alias("kind")).alias("about"),
    )
    heads = rows.groupBy("key").agg(F.min_by("about", "ord").alias("about"), F.first("award_date").alias("award_date"))
    winners = rows.where("winner <> ''").groupBy("key", "winner").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    winner = winners.groupBy("key").agg(F.min(F.struct(-F.col("n"), "first", "winner"))["winner"].alias("winner"))
    pairs = rows.groupBy("key", "award_date", "since", "cost").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    before = F.coalesce(F.col("since") <= F.year("award_date"), F.lit(False))
    best = F.max(F.struct(F.col("cost").isNotNull().alias("priced"), before.alias("before"), F.coalesce("since", F.lit(0)).alias("y"), "n", (-F.col("first")).alias("f"), "since", "cost"))
    sanction = pairs.groupBy("key").agg(best.alias("s")).select("key", "s.since", "s.cost")
    joined = heads.join(winner, "key", "left").join(sanction, "key", "left")
    named = F.when((F.col("about.road") != "") & (F.col("about.kind") != ""), F.concat("about.road", F.lit(" ("), "about.kind", F.lit(")"))).when(F.col("about.road") != "", F.col("about.road")).otherwise("PMGSY rural road")
    return conform(joined.select(
        F.col("key").alias("source_id"), F.lit("IN").alias("country"), F.col("about.state").alias("state"), F.col("about.district").alias("district"), named.alias("title"), F.lit("works").alias("category"), F.lit("roads").alias("sector"),
        F.lit("open").alias("method"), F.lit("INR").alias("currency"), F.col("cost").alias("estimated_value"), "winner", "award_date", F.coalesce(F.year("award_date"), F.col("since")).alias("year"),
    ), "pmgsy")


@register("pmgsy")
def pmgsy(spark: SparkSession, path: str) -> DataFrame:
    return road_records(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), today="2026-12-31")


_VALUE = "struct<amount:double,currency:string>"
_ITEM = f"struct<id:string,description:string,quantity:double,classification:struct<scheme:string,id:string>,unit:struct<value:{_VALUE}>,totalValue:{_VALUE}>"
RELEASE = (
    f"ocid string, id string, buyer struct<id:string,name:string>, parties array<struct<id:string,roles:array<string>,address:struct<region:string,department:string>>>, "
    f"tender struct<title:string,description:string,procurementMethod:string,procurementMethodDetails:string,mainProcurementCategory:string,numberOfTenderers:int,tenderers:array<struct<id:string,name:string>>,datePublished:string,"
    f"procuringEntity:struct<name:string>,value:{_VALUE},lots:array<struct<id:string,value:{_VALUE}>>,items:array<{_ITEM}>>, "
    f"awards array<struct<id:string,status:string,date:string,value:{_VALUE},relatedLots:array<string>,suppliers:array<struct<name:string>>,items:array<{_ITEM}>>>"
)
OCDS_CATEGORY = {"works": "works", "goods": "goods", "services": "services", "consultingServices": "consultancy"}
OCDS_METHOD = {"open": "open", "selective": "limited", "limited": "limited", "direct": "single"}
MOST_AMOUNT = 1e12


def releases(spark: SparkSession, path: str) -> DataFrame:
    """Releases from JSON lines (gzip too), bare or wrapped in a record; lines that aren't JSON keep their text in `bad`."""
    fields = [f.name for f in T.StructType.fromDDL(RELEASE).fields]
    raw = spark.read.schema(f"{RELEASE}, compiledRelease struct<{', '.join(f'{p}' for p in _as_struct(RELEASE))}>, bad string").option("columnNameOfCorruptRecord", "bad").json(path)
    return raw.select(*(F.coalesce(F.col(f"compiledRelease.{f}"), F.col(f)).alias(f) for f in fields), "bad")


def _as_struct(ddl: str) -> list[str]:
    return [f"{f.name}:{f.dataType.simpleString()}" for f in T.StructType.fromDDL(ddl).fields]


def _money(v: Column) -> Column:
    return F.when(v["amount"] > 0, v["amount"])


def _item_total(i: Column) -> Column:
    return F.coalesce(_money(i["totalValue"]), F.when(i["quantity"] > 0, _money(i["unit"]["value"]) * i["quantity"]))


def scopes(df: DataFrame) -> DataFrame:
    """df (release columns) with active (its valued awards), estimate, and scopes: per award the estimate of what it
    covers and whether that is the whole tender; null where awards and estimate can't be matched for certain.

    One lot and one award, or lots that one award each names, are matched by lots; else one award of all items; else
    awards of disjoint items, if the items' totals make up the estimate.
    """
    t = F.col("tender")
    active = F.filter("awards", lambda a: (F.coalesce(a["status"], F.lit("active")) == "active") & _money(a["value"]).isNotNull())
    base = df.withColumns({"active": F.coalesce(active, F.array().cast(df.schema["awards"].dataType)), "estimate": _money(t["value"]), "lots": F.coalesce(t["lots"], F.array().cast(df.schema["tender"].dataType["lots"].dataType)), "items": F.filter(F.coalesce(t["items"], F.array().cast(df.schema["tender"].dataType["items"].dataType)), lambda i: i["id"].isNotNull())})
    scope = lambda a, estimate, whole: F.struct(a.alias("award"), estimate.cast("double").alias("estimate"), whole.alias("whole"))
    lot = lambda a: F.get(F.filter("lots", lambda x: x["id"] == F.get(a["relatedLots"], 0)), 0)
    no_award, one_award, one_lot = F.size("active") == 0, F.size("active") == 1, F.size("lots") == 1
    only = F.get("active", 0)
    single = one_award & one_lot & (F.coalesce(F.get(only["relatedLots"], 0), F.get("lots", 0)["id"]) == F.get("lots", 0)["id"]) & (F.coalesce(F.size(only["relatedLots"]), F.lit(0)) <= 1)
    named = F.transform("active", lambda a: F.get(a["relatedLots"], 0))
    by_lot = F.forall("active", lambda a: (F.size(a["relatedLots"]) == 1) & _money(lot(a)["value"]).isNotNull()) & (F.size(F.array_distinct(named)) == F.size("active"))
    ids = lambda a: F.coalesce(F.array_distinct(F.transform(a["items"], lambda i: i["id"])), F.array().cast("array<string>"))
    all_ids = F.array_distinct(F.transform("items", lambda i: i["id"]))
    whole = one_award & ((F.size(all_ids) <= 1) | ((F.size(ids(only)) > 0) & (F.size(F.array_except(all_ids, ids(only))) == 0)))
    sum_of = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, b: a + b)
    totals = F.transform("items", _item_total)
    priced = (F.size("items") > 0) & F.forall(totals, lambda x: x.isNotNull()) & (F.abs(sum_of(totals) - F.col("estimate")) <= F.col("estimate") / 100)
    every = F.flatten(F.transform("active", ids))
    apart = priced & F.forall("active", lambda a: F.size(ids(a)) > 0) & (F.size(F.array_distinct(every)) == F.size(every)) & (F.size(F.array_except(every, all_ids)) == 0)
    part = lambda a: sum_of(F.transform(F.filter("items", lambda i: F.array_contains(ids(a), i["id"])), _item_total))
    found = (
        F.when(F.col("estimate").isNull() | no_award, F.lit(None))
        .when((F.size("lots") > 0) & single, F.array(scope(only, F.coalesce(_money(F.get("lots", 0)["value"]), F.col("estimate")), F.lit(True))))
        .when((F.size("lots") > 0) & by_lot, F.transform("active", lambda a: scope(a, _money(lot(a)["value"]), one_lot)))
        .when(F.size("lots") > 0, F.lit(None)).when(whole, F.array(scope(only, F.col("estimate"), F.lit(True))))
        .when(apart, F.transform("active", lambda a: scope(a, part(a), F.size(F.array_except(all_ids, ids(a))) == 0)))
    )
    return base.withColumn("scopes", found)


def ocds_reasoned(df: DataFrame, currency: str, since: int | None = None) -> DataFrame:
    """One row per release without a scope and per scope, with the first reason against it, 'emitted' if none."""
    allowed = [currency, "USD", "EUR"]
    paid = F.upper(F.coalesce("tender.value.currency", F.lit("")))
    # a release that is refused as a whole is one row
    rows = scopes(df.where("ocid is not null or id is not null")).select("*", F.explode_outer(F.when(paid.isin(*allowed), F.col("scopes"))).alias("s"), paid.alias("paid"))
    value = _money(F.col("s.award.value"))
    awarded, published = F.left("s.award.date", F.lit(10)).try_cast("date"), F.left("tender.datePublished", F.lit(10)).try_cast("date")
    year = F.year(F.coalesce(awarded, published))
    reason = (
        F.when(F.col("estimate").isNull(), "no_estimate").when(~paid.isin(*allowed), "other_currency").when(F.size("active") == 0, "no_award").when(F.col("s").isNull(), "ambiguous_scope")
        .when(F.upper(F.coalesce("s.award.value.currency", F.lit(""))) != paid, "currency_mismatch").when(F.greatest(value, F.col("s.estimate")) > MOST_AMOUNT, "implausible_amount")
        .when(~(value / F.col("s.estimate")).between(RATIO_MIN, RATIO_MAX), "ratio_out_of_band").when(year < since if since else F.lit(False), "before_since").otherwise("emitted")
    )
    return rows.withColumns({"reason": reason, "award_date": awarded, "tender_date": published, "year": year})


def ocds_records(df: DataFrame, country: str, currency: str, source: str, since: int | None = None) -> DataFrame:
    """Emitted scopes as records."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    title = text(F.coalesce(F.when(F.trim("tender.title") != "", F.col("tender.title")), F.col("tender.description")))
    parts = F.array_join(F.array_distinct(F.filter(F.transform("s.award.items", lambda i: F.trim(i["description"])), lambda d: d.isNotNull())), "; ")
    bidders = F.coalesce("tender.numberOfTenderers", F.size(F.array_distinct(F.transform("tender.tenderers", lambda t: F.coalesce(t["id"], t["name"])))))
    party = F.get(F.filter("parties", lambda p: (p["id"] == F.col("buyer.id")) | F.array_contains(p["roles"], "buyer")), 0)
    cpv = F.get(F.filter(F.coalesce("s.award.items", "items"), lambda i: F.upper(i["classification"]["scheme"]) == "CPV"), 0)["classification"]["id"]
    rows = ocds_reasoned(df, currency, since).where("reason = 'emitted'").select(
        F.concat_ws(":", F.coalesce("ocid", "id"), F.coalesce("s.award.id", F.lit("award"))).alias("source_id"), F.lit(country).alias("country"), F.left(F.initcap(text(party["address"]["region"])), F.lit(64)).alias("state"),
        text(F.coalesce("buyer.name", "tender.procuringEntity.name")).alias("buyer"), F.when(F.col("s.whole") | (F.coalesce(parts, F.lit("")) == ""), title).otherwise(F.left(parts, F.lit(1000))).alias("title"),
        mapped(F.col("tender.mainProcurementCategory"), OCDS_CATEGORY).alias("category"), F.when(cpv.isNotNull(), scalars.cpv_sector(cpv)).alias("sector"), mapped(F.col("tender.procurementMethod"), OCDS_METHOD).alias("method"), F.col("paid").alias("currency"),
        F.col("s.estimate").cast(MONEY).alias("estimated_value"), _money(F.col("s.award.value")).cast(MONEY).alias("award_value"), F.when(F.col("s.whole") & bidders.between(1, MOST_BIDDERS), bidders).alias("num_bidders"),
        F.array_join(F.transform("s.award.suppliers", lambda x: F.trim(x["name"])), "; ").alias("winner"), "tender_date", "award_date", "year",
    )
    return conform(rows, source)


def price_observations(df: DataFrame, value: str = "value") -> DataFrame:
    """(country, year, value) from a statistics service's replies: a two-element array whose second lists rows."""
    rows = df.select(F.from_json(F.get_json_object(value, "$[1]"), "array<struct<country:struct<id:string>,date:string,value:double>>").alias("r")).select(F.inline("r"))
    return rows.where("value is not null and length(country.id) = 2 and date rlike '^[0-9]+$'").select(F.upper("country.id").alias("country"), F.col("date").cast("int").alias("year"), "value").where("year >= 1995")
