"""Scalar functions on columns: text cleaning, sectors, money, dates, hashes, lists."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as no value.
MISSING = ("", "na", "n/a", "nil", "-", "--", "none", "null")
#: Date formats of portals, and of one award source.
PORTAL_DATES = ("dd-MMM-yyyy hh:mm a", "dd-MMM-yyyy HH:mm", "dd-MMM-yyyy")
AWARD_DATES = ("dd/MM/yy", "dd-MMM-yy", "dd/MM/yyyy", "yyyy-MM-dd", "dd-MMM-yyyy")


def clean(text: Column) -> Column:
    """Non-breaking blanks as blanks, runs of white space as one, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, " ", " "), r"\s+", " "))


def blank(text: Column) -> Column:
    return text.isNull() | F.lower(F.trim(text)).isin(*MISSING)


def buyer_from_chain(chain: Column) -> Column:
    """The two top levels of 'a||b||c' that aren't empty."""
    parts = F.filter(F.transform(F.split(chain, r"\|\|"), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_join(F.slice(parts, 1, 2), " || ")


def parse_inr(text: Column) -> Column:
    """'4,91,87,00,000', '₹ 1,234.50', 'Rs. 5,000/-' as decimal; null for no value and for what isn't money."""
    digits = F.regexp_replace(F.trim(text), r"(?i)[,\s₹]|^rs\.?|/-$", "")
    return F.when(~blank(text), digits.try_cast("decimal(18,2)"))


def parse_inr_error(text: Column) -> Column:
    """Why parse_inr has no value: null if there is one, or none was given."""
    return F.when(~blank(text) & parse_inr(text).isNull(), "not a money amount")


def parse_amount(text: Column, unit: str = "") -> Column:
    """The first number, times its unit (crore, lakh) or else the one given; null unless positive."""
    low = F.regexp_replace(F.lower(F.trim(text)), ",", "")
    number = F.regexp_extract(low, r"-?\d+(?:\.\d+)?", 0).try_cast("decimal(28,6)")
    scale = {"crore": 10_000_000, "lakh": 100_000}
    times = F.when(low.rlike(r"\bcr(ore)?s?\b"), scale["crore"]).when(low.rlike(r"\b(lakh|lac|lacs|lakhs)\b"), scale["lakh"]).otherwise(scale.get(unit, 1))
    value = (number * times).cast("decimal(20,2)")
    return F.when(value > 0, value)


def plausible_amount(text: Column, most: float = 5e10) -> Column:
    value = text.try_cast("decimal(20,2)")
    return F.when((value > 0) & (value < most), value)


def _first_date(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.initcap(F.lower(text)) if "MMM" in f and " a" not in f else _am_pm(text) if " a" in f else text, F.lit(f)) for f in formats))


def _am_pm(text: Column) -> Column:
    """Month names as Jan and halves of the day as AM, whatever case they come in."""
    return F.concat(F.initcap(F.lower(F.regexp_replace(text, r"(?i)\s*[ap]m$", ""))), F.lit(" "), F.upper(F.regexp_extract(text, r"(?i)([ap]m)$", 1)))


def parse_portal_time(text: Column) -> Column:
    """A portal's local time (India) as an instant; null for no value and for what isn't a date."""
    local = _first_date(F.trim(text), PORTAL_DATES)
    return F.when(~blank(text), F.to_utc_timestamp(local, "Asia/Kolkata"))


def parse_portal_time_error(text: Column) -> Column:
    return F.when(~blank(text) & parse_portal_time(text).isNull(), "unrecognised date")


def parse_award_date(text: Column) -> Column:
    return F.when(~blank(text), _first_date(F.trim(text), AWARD_DATES).cast("date"))


def plausible_award_date(text: Column, year: Column, dispatch: Column) -> Column:
    """The award date if its year is within ten before the notice's; else the date of dispatch."""
    day = parse_award_date(text)
    return F.when(F.year(day).between(year - 10, year), day).otherwise(parse_award_date(dispatch))


def day_month_year(text: Column, low: str, high: str) -> Column:
    """'7-4-2011' as a date within the range; null for impossible and placeholder days."""
    part = lambda k: F.regexp_extract(F.trim(text), r"^(\d{1,2})-(\d{1,2})-(\d{4})", k)
    day = F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")).try_cast("date")
    return F.when(day.between(F.lit(low).cast("date"), F.lit(high).cast("date")), day)


def month_in_india(at: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(at, "Asia/Kolkata"), "yyyy-MM")


#: CPV code prefixes and their sectors; the first that fits is taken.
CPV = [
    ("45233", "roads"), ("45221", "roads"), ("45234", "roads"), ("45231", "water"), ("45232", "water"), ("45240", "water"), ("45247", "water"), ("45252", "water"),
    ("4531", "electrical"), ("4533", "water"), ("45", "buildings"), ("904", "water"), ("909", "facility"), ("90", "facility"), ("79710", "security"), ("79714", "security"),
    ("795", "facility"), ("796", "facility"), ("555", "facility"), ("77", "facility"), ("71", "consultancy"), ("73", "consultancy"), ("79", "consultancy"), ("72", "it"),
    ("48", "it"), ("30", "it"), ("32", "it"), ("33", "health"), ("85", "health"), ("38", "lab"), ("35", "security"), ("09", "electrical"), ("31", "electrical"),
    ("65", "electrical"), ("34", "transport"), ("60", "transport"), ("63", "transport"), ("50", "facility"),
]
CPV_SUPPLIES = ("03", "14", "15", "18", "19", "22", "24", "39", "44")


def cpv_sector(code: Column) -> Column:
    digits = F.regexp_replace(F.coalesce(code, F.lit("")), r"\D", "")
    chain = reduce(lambda c, x: (F.when if c is None else c.when)(digits.startswith(x[0]), x[1]), CPV, None)
    return chain.otherwise(F.when(F.left(digits, F.lit(2)).isin(*CPV_SUPPLIES), "supplies").otherwise(""))


def pincode_state(pin: Column, table: dict[str, str]) -> Column:
    """State of a six-digit PIN by its longest known prefix of 4, 3 or 2 digits; '' if none is known."""
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    valid = F.trim(pin).rlike(r"^[1-9]\d{5}$")
    return F.when(valid, F.coalesce(*(known[F.left(F.trim(pin), F.lit(n))] for n in (4, 3, 2)), F.lit(""))).otherwise("")


def safe_cell(text: Column) -> Column:
    """A spreadsheet cell that can't be taken for a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def indian_grouping(value: Column) -> Column:
    """1234567 as 12,34,567: the last three digits, then pairs."""
    digits = F.abs(value).cast("decimal(38,0)").cast("string")
    head, tail = F.regexp_extract(digits, r"^(\d*?)(\d{1,3})$", 1), F.regexp_extract(digits, r"^(\d*?)(\d{1,3})$", 2)
    pairs = F.regexp_replace(head, r"(\d)(?=(\d\d)+$)", "$1,")
    return F.concat(F.when(value < 0, "-").otherwise(""), F.when(head != "", F.concat(pairs, F.lit(","))).otherwise(""), tail)


def format_inr(value: Column) -> Column:
    """'₹12.50 Cr', '₹3.00 L', or grouped rupees below a lakh."""
    return (
        F.when(value >= 10_000_000, F.concat(F.lit("₹"), F.format_string("%.2f", (value / 10_000_000).cast("double")), F.lit(" Cr")))
        .when(value >= 100_000, F.concat(F.lit("₹"), F.format_string("%.2f", (value / 100_000).cast("double")), F.lit(" L")))
        .otherwise(F.concat(F.lit("₹"), indian_grouping(value)))
    )


def content_hash(**fields: Column) -> Column:
    """sha256 of a record's fields in the order of their names, as JSON; absent values don't count."""
    return F.sha2(F.to_json(F.struct(*(c.cast("string").alias(n) for n, c in sorted(fields.items())))), 256)


def cited_numbers(text: Column) -> Column:
    """Numbers in [1], [1,3] and [2-4], each once, in order."""
    marks = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\[([\d,\s–-]+)\]"), F.lit(1)), lambda m: F.split(m, ",")))
    ends = lambda p: F.transform(F.split(F.regexp_replace(p, r"\s", ""), "[–-]"), lambda x: x.try_cast("int"))
    spread = lambda p: F.when((F.size(ends(p)) == 2) & (ends(p)[0] <= ends(p)[1]), F.sequence(ends(p)[0], ends(p)[1])).otherwise(F.array(ends(p)[0]))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(marks, spread))))


def approx_tokens(text: Column) -> Column:
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.bround(words * 1.3, 0).cast("int"))


def sorted_bids(bids: Column) -> Column:
    """Positive bids in order, or null if there is none."""
    kept = F.array_sort(F.filter(bids, lambda b: b > 0))
    return F.when(F.size(kept) > 0, kept)


def window_used(published: Column, closes: Column, now: Column) -> Column:
    """How much of the time for bids is over, from 0 to 1."""
    seconds = lambda a, b: (F.unix_timestamp(b) - F.unix_timestamp(a)).cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(seconds(published, now), seconds(published, closes))))


#: A text with so many Devanagari letters is garbled if it has over this share of stray ones beside them.
GARBLE_LEAST, GARBLE_SHARE = 20, 0.05


@F.pandas_udf(T.StringType())
def compatible(texts: pd.Series) -> pd.Series:
    """Unicode's compatibility form (NFKC), which has no built-in function."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def clean_page(text: Column) -> Column:
    """A page's text with ligatures as letters, and words that a line's end cuts at a hyphen put together again."""
    return F.regexp_replace(compatible(text), r"(?U)(\w)-\n(?=\w)", "$1-")


def garbled_devanagari(text: Column) -> Column:
    """Whether a page's Devanagari is broken: its font has put stray letters, marks or private ones in place of conjuncts.

    To be asked before clean_page(), which changes these.
    """
    count = lambda letters: F.length(F.regexp_replace(text, f"[^{letters}]", ""))
    own, stray = count(r"\u0900-\u097F"), count(r"\u0180-\u024F\uE000-\uF8FF\u0300-\u036F")
    return F.coalesce((own >= GARBLE_LEAST) & (stray > GARBLE_SHARE * own), F.lit(False))
