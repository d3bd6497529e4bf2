"""What a notice asks for beyond single fields: similar works, exemptions, documents to be submitted; and who can bid."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefield.operators import documents
from orefield.operators.answers import SENTENCE_END, _places, brief_fields
from orefield.operators.fulltext import _let

#: Who may be exempted, from what, and words that deny it.
MSE = r"(?i)\bMSEs?\b|\bMSMEs?\b|micro,?\s+(?:and|&)\s+small\s+enterprises?|\bNSIC\b|\budyam\b|start-?ups?\b|DPIIT"
EXEMPT = r"(?i)exempt"
NOT_EXEMPT = r"(?i)\b(?:not|no|nor)\b[^.]{0,40}exempt|exemption[^.]{0,30}\bnot\b[^.]{0,20}(?:allowed|available|applicable|admissible)"
EXEMPT_FROM = [("EMD", r"\bEMD\b|earnest|bid security"), ("tender fee", r"tender\s+(?:document\s+)?fee|cost of (?:the )?tender"), ("experience and turnover criteria", r"turnover|prior experience|experience")]
#: What heads a list of documents, an item of it, a heading that ends it, and documents known by name.
DOC_HEADING = r"(?i)(?:list\s+of\s+)?documents?\s+(?:to\s+be\s+|required\s+to\s+be\s+)?(?:uploaded|submitted|required|enclosed|furnished)|check\s*-?\s*list\s+of\s+documents|list\s+of\s+documents"
ITEM = r"^\s*(?:\(?[0-9]{1,2}[.)]|\(?[a-zA-Z][.)]|\(?[ivx]{1,4}[.)]|[•\-–*·])\s*(.+)$"
HEADING_LINE = r"^\s*(?:\d{1,2}(?:\.\d{1,2})*\.?\s+)?[A-Z][A-Z &/,\-()]{5,}$"
HEADING_CHARS, ITEM_CHARS, LINES_AHEAD, MOST_ITEMS, LEAST_ITEMS = 120, 200, 39, 25, 2
KNOWN_DOCS = [
    ("PAN card", r"\bPAN\b"), ("GST registration", r"\bGST(?:IN)?\b[^.]{0,30}registration|\bGSTIN\b|GST registration"), ("EPF registration", r"\bEPF\b|Employees'?\s*Provident\s+Fund"),
    ("ESI registration", r"\bESIC?\b|Employees'?\s*State\s+Insurance"), ("MSE / Udyam certificate", r"\budyam\b|\bNSIC\b[^.]{0,30}certificate|MSE certificate"),
    ("Experience / completion certificates", r"(?:experience|completion|performance)\s+certificates?"), ("Audited balance sheets", r"audited\s+(?:balance\s+sheets?|accounts|financial\s+statements)"),
    ("Income tax returns", r"income\s+tax\s+returns?|\bITRs?\b"), ("CA turnover certificate", r"chartered\s+accountant|CA\s+certificate"), ("Bank solvency certificate", r"solvency\s+certificate"),
    ("Affidavit", r"\baffidavit\b"), ("Contractor registration certificate", r"registration\s+certificate|enlistment"), ("Power of attorney", r"power\s+of\s+attorney"),
    ("Joint venture agreement", r"joint\s+venture\s+agreement|JV\s+agreement"), ("Labour licence", r"labour\s+licen[cs]e"),
]
#: How far around an amount its clause goes, what else ends it, and how long its sentence may be before it.
CLAUSE, CLAUSE_LEAD, CLAUSE_LEAST, SENTENCE_CHARS = 400, 100, 40, 250
CLAUSE_ENDS = r"(?i)\b(?:turnover|solvency|EMD|earnest)\b"
YEARS = r"(?i)(?:minimum|at\s+least|not\s+less\s+than)\s+(\d{1,2})\s+years?\s+(?:of\s+)?(?:experience|existence|standing|in\s+(?:the\s+)?business)|(?:experience|existence)\s+of\s+(?:at\s+least\s+|minimum\s+)?(\d{1,2})\s+years"
CERTIFIED = r"(?i)\bMSEs?\b|MSME|udyam|NSIC|micro|small enterprise|start-?up|DPIIT"
PASS, FAIL, UNKNOWN = "pass", "fail", "unknown"


def flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


@F.pandas_udf(T.ArrayType(T.DecimalType(20, 2)))
def amounts_of(texts: pd.Series) -> pd.Series:
    """The different amounts of money in a text, the least first."""
    return texts.map(lambda t: sorted({documents._number(v) for k, v, _ in documents.facts(t) if k == "money"}))


# ---- similar works ----------------------------------------------------------------------------------------------------


def _clause(text: Column, at: Column) -> Column:
    """What stands around an amount: from a little before `similar` to where something else is asked for."""
    around = F.substring(text, F.greatest(F.lit(1), at - CLAUSE), F.lit(CLAUSE) + F.least(at, F.lit(CLAUSE)))

    def cut(c: Column) -> Column:
        lead = F.instr(F.lower(c), "similar")
        begun = F.when(lead > 0, F.substring(c, F.greatest(F.lit(1), lead - CLAUSE_LEAD), F.length(c))).otherwise(c)
        return _let(begun, lambda b: F.concat(F.left(b, F.lit(CLAUSE_LEAST)), F.regexp_replace(F.substring(b, F.lit(CLAUSE_LEAST + 1), F.length(b)), rf"(?s){CLAUSE_ENDS}.*$", "")))

    return _let(around, cut)


def similar_work(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' columns with (value, amounts): the whole requirement from the start of its sentence, and all amounts of its
    clause: notices offer options (three works of 40 %, two of 60 % or one of 80 %)."""
    kept = [c for c in docs.columns if c != text]
    found = brief_fields(docs.withColumn(text, flat(F.col(text))), text).where("key = 'similar_work'")
    at = F.instr(F.col(text), F.col("value"))
    rows = found.select(*kept, text, "value", at.alias("__at"))
    before = F.substring(F.col(text), F.greatest(F.lit(1), F.col("__at") - 150), F.least(F.col("__at") - 1, F.lit(150)))
    # behind the last sentence end, or colon, before the amount
    own = F.regexp_replace(before, rf"(?s)^.*(?:{SENTENCE_END}|:)", "")
    rows = rows.select(*kept, "value", own.alias("__own"), _clause(F.col(text), F.col("__at")).alias("__clause"))
    rows = rows.withColumn("__all", amounts_of("__clause"))
    whole = F.when(F.length("__own") < SENTENCE_CHARS, F.trim(F.concat("__own", "value"))).otherwise(F.col("value"))
    return rows.select(*kept, whole.alias("value"), F.when(F.size("__all") > 0, F.col("__all")).otherwise(amounts_of("value")).alias("amounts"))


# ---- exemptions -------------------------------------------------------------------------------------------------------


def sentences(text: Column) -> Column:
    """A flat text cut where its sentences end."""
    ends = _places(text, f"(?={SENTENCE_END})")

    def cut(at: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda x: x + 1))
        stops = F.concat(F.transform(at, lambda x: x + 1), F.array(F.length(text)))
        return F.transform(F.zip_with(starts, stops, lambda a, b: F.substring(text, a + 1, b - a)), lambda s: F.trim(s))

    return _let(ends, cut)


def exemption(text: Column) -> Column:
    """`Exempted` or `No exemption`, and from what, by the first sentence that says so of small enterprises or start-ups."""
    told = F.get(F.filter(sentences(flat(text)), lambda s: s.rlike(MSE) & s.rlike(EXEMPT)), 0)

    def said(s: Column) -> Column:
        what = F.array_compact(F.array(*(F.when(s.rlike(f"(?i){pattern}"), name) for name, pattern in EXEMPT_FROM)))
        verdict = F.when(s.rlike(NOT_EXEMPT), "No exemption").otherwise("Exempted")
        return F.when(s.isNotNull(), F.concat(verdict, F.when(F.size(what) > 0, F.concat(F.lit(" from "), F.array_join(what, ", "))).otherwise("")))

    return _let(told, said)


# ---- documents --------------------------------------------------------------------------------------------------------


def _listed(lines: Column) -> Column:
    """The items below a heading: numbered or marked lines, with what is wrapped; a heading or any other line ends them."""
    start = F.struct(F.array().cast("array<string>").alias("items"), F.lit(False).alias("done"))

    def step(s: Column, line: Column) -> Column:
        items, some = s["items"], F.size(s["items"]) > 0
        item = F.regexp_extract(line, ITEM, 1)
        added = F.concat(items, F.array(F.left(F.regexp_replace(F.trim(item), r"[;.,]+$", ""), F.lit(ITEM_CHARS))))
        wrapped = F.concat(F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), F.array(F.left(F.concat(F.element_at(items, -1), F.lit(" "), F.trim(line)), F.lit(ITEM_CHARS))))
        goes_on = some & line.rlike(r"^\p{Ll}")
        ends = some & (line.rlike(HEADING_LINE) | ((item == "") & ~goes_on))
        now = F.when(ends, items).when(item != "", added).when(goes_on, wrapped).otherwise(items)
        return F.when(s["done"], s).otherwise(F.struct(now.alias("items"), (ends | (F.size(now) >= MOST_ITEMS)).alias("done")))

    return F.aggregate(lines, start, step, lambda s: s["items"])


def required_documents(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """(doc, documents, page, listed): what a document's first list of documents names, or else the well-known ones that
    it mentions, in order; documents with neither have no row.

    pages: a row per page. Lines that run on most pages count for nothing. A page's lines are one value, and each of its
    headings is followed by one walk over the lines below it.
    """
    kept = documents.lines(pages, doc, page, text).groupBy(doc, page).agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("__lines"))
    heads = F.filter(F.transform("__lines", lambda line, i: F.when(line.rlike(DOC_HEADING) & (F.length(line) <= HEADING_CHARS), i)), lambda i: i.isNotNull())
    made = F.transform(heads, lambda i: _listed(F.slice("__lines", i + 2, F.lit(LINES_AHEAD))))
    rows = kept.select(doc, page, F.get(F.filter(made, lambda x: F.size(x) >= LEAST_ITEMS), 0).alias("items"), F.array_join("__lines", " ").alias("flat"))
    lists = rows.where("items is not null").groupBy(doc).agg(F.min_by(F.struct(F.col("items").alias("documents"), F.col(page).alias("page")), F.col(page)).alias("b"))
    # each known document's first place, over pages in order
    places = F.array_compact(F.array(*(F.when(F.regexp_instr("flat", F.lit(f"(?i){p}")) > 0, F.struct(F.regexp_instr("flat", F.lit(f"(?i){p}")).alias("at"), F.lit(k).alias("k"), F.lit(name).alias("name"))) for k, (name, p) in enumerate(KNOWN_DOCS))))
    seen = rows.select(doc, page, F.explode(places).alias("x")).groupBy(doc, "x.name").agg(F.min(F.struct(F.col(page).alias("page"), F.col("x.at").alias("at"), F.col("x.k").alias("k"))).alias("first"))
    known = seen.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("first", "name"))).alias("all"))
    known = known.select(doc, F.transform("all", lambda x: x["name"]).alias("documents"), F.get("all", 0)["first"]["page"].alias("page"), F.lit(False).alias("listed"))
    listed = lists.select(doc, "b.documents", "b.page", F.lit(True).alias("listed"))
    return listed.unionByName(known.join(lists, doc, "left_anti"))


# ---- who can bid ------------------------------------------------------------------------------------------------------


def years_required(text: Column) -> Column:
    """The least number of years of experience that a text asks for; null if it asks for none."""
    found = flat(text)
    first, second = (F.regexp_extract(found, YEARS, k) for k in (1, 2))
    return F.when(first != "", first).when(second != "", second).cast("int")


def assessed(df: DataFrame) -> DataFrame:
    """df with checks, an array of (key, status), and a verdict: not_eligible if one fails, eligible if all pass.

    df: turnover_amounts and similar_amounts (amounts asked for; null if nothing was found, empty if no amount is stated),
    years_asked, exemption, and own_turnover, own_similar, own_years, certifications. A turnover must reach the largest
    amount. One similar work of the largest amount meets every option, one below the least meets none, between them it
    depends. Years count only where they are asked for. An exemption is told, and counts for nothing in the verdict.
    """
    c = F.col

    def against(own: str, asked: str, middle: str) -> Column:
        told = F.coalesce(F.size(asked) > 0, F.lit(False)) & c(own).isNotNull()
        return F.when(~told, UNKNOWN).when(c(own) >= F.array_max(asked), PASS).when(c(own) < F.array_min(asked), FAIL).otherwise(middle)

    years = F.when(c("years_asked").isNotNull(), F.when(c("own_years").isNull(), UNKNOWN).when(c("own_years") >= c("years_asked"), PASS).otherwise(FAIL))
    certified = F.array_join(F.coalesce("certifications", F.array().cast("array<string>")), " ").rlike(CERTIFIED)
    free = F.when(c("exemption").isNotNull(), F.when(c("exemption").startswith("Exempted") & certified, PASS).otherwise(UNKNOWN))
    one = lambda key, status: F.when(status.isNotNull(), F.struct(F.lit(key).alias("key"), status.alias("status")))
    rows = df.withColumn("__counted", F.array_compact(F.array(one("min_turnover", against("own_turnover", "turnover_amounts", FAIL)), one("similar_work", against("own_similar", "similar_amounts", UNKNOWN)), one("years", years))))
    verdict = F.when(F.exists("__counted", lambda x: x["status"] == FAIL), "not_eligible").when(F.forall("__counted", lambda x: x["status"] == PASS), "eligible").otherwise("unknown")
    return rows.withColumn("checks", F.concat("__counted", F.array_compact(F.array(one("mse_exemption", free))))).withColumn("verdict", verdict).drop("__counted")


def requirements(docs: DataFrame, by: str, text: str = "text") -> DataFrame:
    """(by, turnover_amounts, similar_amounts, years_asked, exemption) of each document, for assessed()."""
    turnover = brief_fields(docs.select(by, text), text).where("key = 'min_turnover'").select(by, amounts_of("value").alias("turnover_amounts"))
    similar = similar_work(docs.select(by, text), text).select(by, F.col("amounts").alias("similar_amounts"))
    own = docs.select(by, years_required(F.col(text)).alias("years_asked"), exemption(F.col(text)).alias("exemption"))
    return reduce(lambda a, b: a.join(b, by, "left"), (turnover, similar), own)
