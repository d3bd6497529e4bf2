from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orefield.functions import scalars as S
from orefield.functions.sectors import classify


def values(spark, column, texts, kind="string"):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], f"k int, x {kind}")
    return [r.v for r in df.select("k", column.alias("v")).orderBy("k").collect()]


def on(spark, f, cases, kind="string"):
    assert values(spark, f(F.col("x")), [a for a, _ in cases], kind) == [b for _, b in cases]


def test_money(spark):
    on(spark, S.parse_inr, [("8,00,000", Decimal("800000.00")), ("4,91,87,00,000", Decimal("4918700000.00")), ("₹ 1,234.50", Decimal("1234.50")), ("Rs. 5,000/-", Decimal("5000.00")), ("NA", None), ("", None), (None, None), ("as per document", None)])
    on(spark, S.parse_inr_error, [("as per document", "not a money amount"), ("NA", None), ("5", None)])
    on(spark, S.parse_amount, [("12.5 Cr", Decimal("125000000.00")), ("3 lakhs", Decimal("300000.00")), ("1,874,075", Decimal("1874075.00")), ("0.00", None), ("NA", None), (None, None)])
    on(spark, lambda c: S.parse_amount(c, unit="lakh"), [("30.0", Decimal("3000000.00"))])
    on(spark, S.plausible_amount, [("200000", Decimal("200000.00")), ("1e15", None), ("0", None), ("x", None)])
    on(spark, S.format_inr, [(Decimal("125000000"), "₹12.50 Cr"), (Decimal("300000"), "₹3.00 L"), (Decimal("12345"), "₹12,345")], "decimal(18,2)")
    on(spark, S.indian_grouping, [(Decimal("4918700000"), "4,91,87,00,000"), (Decimal("7"), "7"), (Decimal("-1234"), "-1,234")], "decimal(18,2)")


def test_dates(spark):
    on(spark, S.parse_portal_time, [("07-Oct-2026 11:00 PM", datetime(2026, 10, 7, 17, 30)), ("07-OCT-2026 11:00 am", datetime(2026, 10, 7, 5, 30)), ("07-Oct-2026 16:00", datetime(2026, 10, 7, 10, 30)), ("07-Oct-2026", datetime(2026, 10, 6, 18, 30)), ("NA", None), ("31-Foo-2026 04:00 PM", None)])
    on(spark, S.parse_portal_time_error, [("31-Foo-2026 04:00 PM", "unrecognised date"), ("NA", None)])
    on(spark, S.parse_award_date, [("28/12/21", date(2021, 12, 28)), ("15-DEC-06", date(2006, 12, 15)), ("03/02/2015", date(2015, 2, 3)), ("2019-07-01", date(2019, 7, 1)), ("", None), ("31/02/21", None)])
    on(spark, lambda c: S.day_month_year(c, "2000-04-01", "2026-01-01"), [("3-4-2002", date(2002, 4, 3)), ("27-06-2004", date(2004, 6, 27)), ("1-1-2000", None), ("31-2-2004", None), ("None", None)])


def test_text(spark):
    on(spark, S.clean, [(" a\xa0 b\n", "a b"), (None, None)])
    on(spark, S.buyer_from_chain, [("A||B||C||D", "A || B"), ("Only", "Only"), ("A|| ||C", "A || C")])
    on(spark, S.cpv_sector, [("45233140-2", "roads"), ("45331000", "water"), ("45000000", "buildings"), ("90911200", "facility"), ("39100000", "supplies"), ("", ""), (None, "")])
    on(spark, lambda c: S.pincode_state(c, {"1": "x", "11": "Delhi", "403": "Goa", "7370": "Sikkim", "73": "West Bengal"}), [("110001", "Delhi"), ("403001", "Goa"), ("737001", "Sikkim"), ("731234", "West Bengal"), ("010001", ""), ("12345", ""), ("999999", "")])
    on(spark, S.safe_cell, [("=1+1", "'=1+1"), ("-5", "'-5"), ("plain", "plain"), (None, None)])
    on(spark, S.cited_numbers, [("x [1, 3] y [2-4]", [1, 3, 2, 4]), ("none", []), ("[2][2]", [2])])
    on(spark, S.approx_tokens, [("", 1), ("one two three four five", 6)])
    on(spark, S.sorted_bids, [([3.0, 0.0, 1.0], [1.0, 3.0]), ([0.0], None), (None, None)], "array<double>")


@pytest.mark.parametrize(
    ("title", "product", "category", "sector"),
    [
        ("Supply of CCTV System with cameras", "Electrical Works", "Works", "security"), ("Exclusive advertisement rights on a metro station", "Miscellaneous Works", "Works", "other"),
        ("Maintenance of road section of NH-216", "Civil Works - Highways", "Works", "roads"), ("Sweeping of roads and yards", "Civil Works", "Works", "facility"), ("High Voltage Relays", "Miscellaneous Goods", "Goods", "electrical"),
        ("Pressure Plate", "Laboratory and scientific equipment", "Goods", "lab"), ("Conservation of Waterbody", "Civil Works", "Works", "water"), ("Fresh vegetables", "Food Products", "Goods", "supplies"),
        ("Request for Empanelment", "Miscellaneous Services", "Services", "other"), ("Something", "", "Works", "buildings"), (None, None, None, "other"),
    ],
)
def test_sector(spark, title, product, category, sector):
    df = spark.createDataFrame([(title, product, category)], "t string, p string, c string")
    assert df.select(classify(F.col("t"), F.col("p"), F.col("c"))).first()[0] == sector


def test_content_hash(spark):
    df = spark.createDataFrame([("a", Decimal("1.50")), ("a", Decimal("1.50")), ("a", None)], "t string, v decimal(18,2)")
    a, b, c = (r[0] for r in df.select(S.content_hash(v=F.col("v"), t=F.col("t"))).collect())
    assert a == b != c
