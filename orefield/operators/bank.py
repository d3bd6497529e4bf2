"""A development bank's award feeds: scalars, bidders' prices, payments, and the rows that notices, payments and plans give."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orefield.operators.contracts import bank_method, reference, reference_category

#: How far an evaluated price may be from the opening one; formats of dates; plausible rupees a dollar.
TRUSTED = (0.5, 2.0)
DATES = ("yyyy/MM/dd", "yyyy-MM-dd", "dd-MMM-yyyy")
RUPEES_A_DOLLAR = (20.0, 150.0)
AWARDED = ("signed", "awarded", "completed", "terminated")


def plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"\s+", " "))


def bank_date(text: Column) -> Column:
    """Three formats in the first eleven characters, or a time's date in front."""
    head = F.trim(F.left(F.trim(text), F.lit(11)))
    iso = F.regexp_extract(F.trim(text), r"^(\d{4}-\d{2}-\d{2})", 1)
    return F.coalesce(*(F.try_to_timestamp(F.initcap(F.lower(head)) if "MMM" in f else head, F.lit(f)).cast("date") for f in DATES), iso.try_cast("date"))


def bank_amount(text: Column) -> Column:
    """Digits, point and minus of a text as a positive number."""
    value = F.regexp_replace(text.cast("string"), r"[^\d.\-]", "").try_cast("decimal(28,6)")
    return F.when(value > 0, value)


def bidder_price(evaluated: Column, opening: Column, signed: Column) -> Column:
    """The evaluated price unless the opening one tells that digits are missing; then the opening, then the signed one."""
    wrong = (evaluated > 0) & (opening > 0) & ~(evaluated / opening).between(*TRUSTED)
    some = lambda c: F.when(c > 0, c)
    return F.when(wrong, opening).otherwise(F.coalesce(some(evaluated), some(opening), some(signed)))


def with_roles(bidders: Column, *roles: str) -> Column:
    return F.filter(bidders, lambda b: b["role"].isin(*roles))


def payment_rows(records: DataFrame, country: str | None = None) -> DataFrame:
    """Payment records as rows; those without a reference go, and those of other countries if one is asked for."""
    amount = F.coalesce(*(F.col(c) for c in ("supplier_contract_amount_usd", "supplier_contract_amount") if c in records.columns))
    rows = records.select(
        reference(F.col("borrower_contract_reference_number")).alias("ref"), plain(F.col("project_id")).alias("project_id"), plain(F.col("supplier")).alias("supplier"),
        bank_date(F.col("contract_signing_date")).alias("signing_date"), bank_amount(amount).alias("amount_usd"), plain(F.coalesce("wb_contract_number", "contract_number")).alias("contract_no"),
        F.col("borrower_country").alias("country"),
    )
    kept = rows.where("ref <> ''")
    return kept if country is None else kept.where(F.col("country") == country)


def first_by_id(pages: DataFrame, by: str = "id", order: str = "offset") -> DataFrame:
    """Of a paged feed's records that come more than once the one of the first page."""
    rest = [c for c in pages.columns if c not in (by, order)]
    return pages.groupBy(by).agg(F.min(F.struct(order, *rest)).alias("b")).select(by, "b.*")


def joined_wraps(lines: Column, known: Column | None = None) -> Column:
    """Lines that were wrapped mid-word, joined; with known words, a wrap between two of them that make no known one
    together gets its blank back."""

    def join(out: Column, line: Column) -> Column:
        tail, head = F.lower(F.regexp_extract(out, r"([A-Za-z]+)$", 1)), F.lower(F.regexp_extract(F.trim(line), r"^([A-Za-z]+)", 1))
        has = lambda w: F.array_contains(known, w)
        apart = (tail != "") & (head != "") & ~has(F.concat(tail, head)) & has(tail) & has(head) if known is not None else F.lit(False)
        return F.concat(out, F.when(apart, " ").otherwise(""), F.trim(line))

    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.when(F.size(lines) > 0, plain(F.aggregate(rest, F.trim(F.get(lines, 0)), join))).otherwise("")


def award_rows(notices: DataFrame, payments: DataFrame, plans: DataFrame, rates: DataFrame) -> DataFrame:
    """One row per contract key of three feeds.

    notices: key, notice_id, ref, project, title, method, group, signed_on, noticed_on, currency, signed_inr, bidders (array
    of name, role, evaluated, opening, signed). payments: key, amount_usd, signed_on, supplier. plans: key, status, actual_usd,
    estimated_usd, title. rates: year, rupees.
    The award is the plan's actual amount if its status is one of an award, else the payments' sum, else the signed
    rupees at the year's rate. Bids are given only for one notice with one winner, one currency and a plausible rate.
    """
    paid = payments.groupBy("key").agg(F.sum("amount_usd").alias("paid_usd"), F.min("signed_on").alias("paid_on"), F.min("supplier").alias("supplier"))
    one = notices.groupBy("key").agg(F.count(F.lit(1)).alias("n_notices"), F.min(F.struct("notice_id", *[c for c in notices.columns if c not in ("key", "notice_id")])).alias("n"))
    plan = plans.groupBy("key").agg(F.max(F.struct("status", "actual_usd", "estimated_usd", F.col("title").alias("plan_title"))).alias("p"))
    both = one.join(paid, "key", "full").join(plan, "key", "full").withColumn("date", F.coalesce("n.signed_on", "paid_on", "n.noticed_on"))
    priced = both.join(rates, F.year("date") == F.col("year"), "left")  # one row a year; Spark checks its size
    actual = F.when(F.lower("p.status").isin(*AWARDED) & (F.col("p.actual_usd") > 0), F.col("p.actual_usd"))
    award = F.coalesce(actual, F.when(F.col("paid_usd") > 0, F.col("paid_usd")), F.try_divide("n.signed_inr", "rupees"))
    winners, bidders = with_roles(F.col("n.bidders"), "awarded"), with_roles(F.col("n.bidders"), "awarded", "evaluated")
    prices = F.transform(bidders, lambda b: bidder_price(b["evaluated"], b["opening"], b["signed"]))
    rate = F.try_divide("n.signed_inr", award)
    ladder = (F.col("n_notices") == 1) & (F.size(winners) == 1) & (F.col("n.currency") == "INR") & rate.between(*RUPEES_A_DOLLAR) & F.forall(prices, lambda p: p > 0)
    rows = priced.select(
        "key", F.coalesce("n.ref", F.col("key").cast("string")).alias("ref"), F.coalesce("n.project", F.lit("")).alias("project"), F.coalesce("n.title", "p.plan_title", F.lit("")).alias("title"),
        bank_method(F.coalesce("n.method", F.lit(""))).alias("method"), F.coalesce(F.nullif(reference_category(F.coalesce("n.ref", F.col("key").cast("string"))), F.lit("")), F.lower("n.group"), F.lit("")).alias("category"),
        "date", award.alias("award_usd"), F.col("p.estimated_usd").alias("estimated_usd"), F.coalesce(F.get(winners, 0)["name"], "supplier", F.lit("")).alias("winner"),
        F.when(ladder, F.array_sort(F.transform(prices, lambda p: F.try_divide(p, rate)))).alias("bids_usd"),
    ).where("award_usd > 0")
    # a reference that more than one key has gets the key after it
    twice = F.count(F.lit(1)).over(W.partitionBy("ref")) > 1
    return rows.withColumn("source_id", F.when(twice, F.concat_ws("#", "ref", "key")).otherwise(F.col("ref")))


#: What marks a section of bidders, the labels of prices and of anything else, and money.
SECTION = re.compile(r"^(awarded|evaluated|rejected)\b[^:]{0,40}:$", re.I | re.A)
PRICE_LABELS = [("opening", re.compile(r"^(bid price at opening|read out price)\b", re.I | re.A)), ("evaluated", re.compile(r"^(evaluated bid price|final evaluation price)\b", re.I | re.A)), ("signed", re.compile(r"^(signed contract price|contract price)\b", re.I | re.A))]
OTHER_LABELS = re.compile(r"^(scores|price:?|currency:?|amount:?|reason for rejection|technical:?|financial:?|combined:?|rank:?|country:)", re.I | re.A)
NAMED = re.compile(r"^name\s*:\s*", re.I | re.A)
MONEY = re.compile(r"\b([A-Z]{3})\s*(\d[\d,]*(?:\.\d+)?)", re.A)
#: Sums from here on have more digits than a decimal(28,6).
MOST = Decimal(10) ** 22
NOTICE_DATE = r"\s*:?\s*(?:\(YYYY/MM/DD\))?\s*(\d{4}/\d{2}/\d{2}|\d{1,2}-[A-Za-z]{3}-\d{4})"


class _Said(HTMLParser):
    """Stretches of text, and whether they are bold."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.bold, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.bold += tag in ("b", "strong")

    def handle_endtag(self, tag):
        self.bold -= tag in ("b", "strong") and self.bold > 0

    def handle_data(self, data):
        if text := " ".join(data.split()):
            self.out.append({"text": text, "bold": self.bold > 0})


def _money_in(text: str) -> tuple[str, float] | None:
    """The first sum in rupees, else the first of any currency."""
    some = [(c, Decimal(a.replace(",", ""))) for c, a in MONEY.findall(text)]
    some = [(c, float(a.quantize(Decimal("0.000001"), ROUND_HALF_UP))) for c, a in some if Decimal("0.0000005") <= a < MOST]
    return next((m for m in some if m[0] == "INR"), some[0] if some else None)


class _Bidders:
    """The bidders of a notice, from its stretches of text in order.

    A stretch is a section, a price's label, a name, another label, or a value. A section holds for what follows, a name
    begins a bidder, and a sum belongs to the label that it stands in or right after; sums after another section's head are
    no bidder's.
    """

    def __init__(self):
        self.role, self.since, self.waiting, self.out = None, 0, None, []

    def take(self, text: str, bold: bool) -> None:
        if section := SECTION.search(text):
            self.role, self.since, self.waiting = section[1].lower(), self.since + 1, None
            return
        if self.role is None:
            return
        label = next((kind for kind, rx in PRICE_LABELS if rx.search(text)), None)
        if label:
            inside = _money_in(text.split(":", 1)[1]) if ":" in text else None
            self.waiting = None if inside else label
            self._price(label, inside)
            return
        waiting, self.waiting = self.waiting, None
        other = OTHER_LABELS.search(text)
        if NAMED.search(text) or (bold and not other):
            self.out.append({"name": _called(text), "role": self.role, "since": self.since, "prices": []})
        elif waiting and not other:
            self._price(waiting, _money_in(text))

    def _price(self, of: str, money: tuple[str, float] | None) -> None:
        if money and self.out and self.out[-1]["since"] == self.since:
            self.out[-1]["prices"].append((of, *money))

    def found(self) -> list[dict] | None:
        return [self._told(b) for b in self.out] or None

    @staticmethod
    def _told(b: dict) -> dict:
        """A bidder with its last prices, in one currency: that of the evaluated price if there is one."""
        currency = next((c for of, c, _ in b["prices"] if of == "evaluated"), b["prices"][0][1] if b["prices"] else "")
        own = {of: amount for of, c, amount in b["prices"] if c == currency}
        return {"name": b["name"], "role": b["role"], "currency": currency} | {kind: own.get(kind) for kind, _ in PRICE_LABELS}


def _called(text: str) -> str:
    """A bidder's name without its label, number and kind."""
    bare = re.sub(r"\s*\[[^\]]*\]\s*$", "", re.sub(r"\s*\(\d+\)\s*$", "", NAMED.sub("", text), flags=re.A))
    return " ".join(bare.split())


_BIDDER = T.StructType([T.StructField(c, T.StringType()) for c in ("name", "role", "currency")] + [T.StructField(kind, T.DoubleType()) for kind, _ in PRICE_LABELS])
TOLD = T.StructType([T.StructField("text", T.StringType()), T.StructField("bidders", T.ArrayType(_BIDDER))])


@F.pandas_udf(TOLD)
def _read(html: pd.Series) -> pd.DataFrame:
    """What a notice's page says, a stretch a line, and its bidders."""

    def one(page: str | None) -> tuple:
        own, bidders = _Said(), _Bidders()
        own.feed(page or "")
        own.close()
        for x in own.out:
            bidders.take(x["text"], x["bold"])
        return "\n".join(x["text"] for x in own.out), bidders.found()

    return pd.DataFrame([one(page) for page in html], columns=["text", "bidders"])


#: Each page is read once, whatever is asked of what it says.
read_page = _read.asNondeterministic()


def read_notices(pages: DataFrame, by: str = "id", html: str = "html") -> DataFrame:
    """(by, project_id, ref, version, signed_on, notified_on, bidders) of award notices in either layout; null bidders
    where a page names none. A page is read in the row where it is, once, and nothing is shuffled."""
    told = pages.select(by, read_page(F.col(html)).alias("told")).select(by, "told.text", "told.bidders")
    find = lambda rx, k=1: F.regexp_extract(F.col("text"), rx, k)
    return told.select(
        by, find(r"Project\s*:\s*(P\d{5,7})").alias("project_id"), plain(find(r"Bid/Contract Reference No\s*:[ \t]*\n?[ \t]*([^\n]+)")).alias("ref"), F.coalesce(find(r"Notice Version No\s*:\s*(\d+)").try_cast("int"), F.lit(0)).alias("version"),
        bank_date(find(r"Contract Signature Date" + NOTICE_DATE)).alias("signed_on"), bank_date(find(r"Date Notification of Award Issued" + NOTICE_DATE)).alias("notified_on"), "bidders",
    )
