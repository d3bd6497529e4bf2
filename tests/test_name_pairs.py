"""Changed names, their labels, cleaned pages and spreadsheets."""

import csv
import glob
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from orefield.functions import scalars
from orefield.operators import entities, exports, name_pairs

NAMES = ["Public Works Department || Division No 1", "Nagar Nigam, Bhopal - North", "Executive Engineer, Water", "PWD", "Corporation Limited of the Directorate", "", None]


def changed(spark, name, kind, seed=7):
    return spark.createDataFrame([(name,)], "n string").select(name_pairs.perturbed(F.col("n"), F.lit(kind), seed)).first()[0]


@pytest.mark.parametrize("name,kind,want", [
    ("Public Works Department || Division No 1", "abbreviation", "Public Works Deptt. || Division No 1"), ("PWD", "abbreviation", None), ("Department of Department", "abbreviation", "Deptt. of Department"),
    ("Nagar Nigam, Bhopal - North", "punctuation", "Nagar Nigam, Bhopal North"), ("Nagar Nigam,Bhopal", "punctuation", "Nagar Nigam , Bhopal"), ("PWD", "punctuation", None),
    ("Nagar Nigam", "upper_case", "NAGAR NIGAM"), ("PWD", "upper_case", None), ("PWD || Roads || North", "office_of_prefix", "PWD || Office of the Roads || North"), ("PWD", "office_of_prefix", None),
    ("PWD Roads", "typo", None), (None, "typo", None), ("", "upper_case", None),
])
def test_changes(spark, name, kind, want):
    assert changed(spark, name, kind) == want


def test_typos_are_one_swap_or_one_letter_less(spark):
    name = "Public Engineering Directorate, Jabalpur"
    seen = {changed(spark, name, "typo", seed) for seed in range(25)}
    assert len(seen) > 8 and None not in seen and changed(spark, name, "typo", 3) == changed(spark, name, "typo", 3)
    for made in seen:
        words = [(a, b) for a, b in zip(name.replace(",", " ,").split(), made.replace(",", " ,").split()) if a != b]
        ((a, b),) = words
        swaps = {a[:i] + a[i + 1] + a[i] + a[i + 2 :] for i in range(1, len(a) - 2)}
        drops = {a[:i] + a[i + 1 :] for i in range(1, len(a) - 2)}
        assert len(a) >= 7 and b in swaps | drops


def test_labels_and_figures(spark):
    df = spark.createDataFrame([(n, "A") for n in NAMES], "name string, state string")
    rows = name_pairs.labelled(df).collect()
    assert {r["source"] for r in rows} <= {"synthetic", "neighbour"} and all((r["same_entity"] == 1) == (r["source"] == "synthetic") for r in rows)
    assert {r["source"] for r in entities.evaluation(name_pairs.labelled(df)).collect()} >= {"all"}
    assert name_pairs.labelled(df.limit(0)).count() == 0


def test_clean_page(spark):
    rows = [("ﬁnancial oﬃce", "financial office"), ("e-\nprocurement and nā-\nma", "e-procurement and nā-ma"), ("a -\nb", "a -\nb"), ("a-\nb-\nc", "a-b-c"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string").select(scalars.clean_page(F.col("t")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_garbled_devanagari(spark):
    rows = [("निविदा " * 10, False), ("न ȡ व ȡ दा " * 10, True), ("ȡȡȡ", False), ("नि" * 10 + "ȡ", False), ("नि" * 10 + "ȡ\ue000", True), ("नि" * 9 + "ȡ" * 9, False), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "t string, want boolean").select(scalars.garbled_devanagari(F.col("t")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_sheet_is_one_file_that_begins_with_a_mark(spark, tmp_path):
    rows = [(2, "T2", '=HYPERLINK("x")', datetime(2026, 10, 7, 17, 30), None), (1, "T1", "सड़क, \"road\"\nline", None, 5.5)]
    df = spark.createDataFrame(rows, "id long, tender_id string, title string, closes_at timestamp, value_inr double")
    exports.write_sheet(df, [F.col("id")], str(tmp_path / "x"))
    (path,) = glob.glob(str(tmp_path / "x" / "part-*.csv"))
    assert open(path, "rb").read().startswith(b"\xef\xbb\xbftender_id,reference_no")
    with open(path, encoding="utf-8-sig", newline="") as f:
        got = list(csv.DictReader(f))
    assert list(got[0]) == list(exports.SHEET) and len(exports.SHEET) == 19
    assert [(r["tender_id"], r["title"], r["closes_at"], r["value_inr"], r["emd_inr"]) for r in got] == [("T1", 'सड़क, "road"\nline', "", "5.5", ""), ("T2", '\'=HYPERLINK("x")', "2026-10-07T23:00:00+05:30", "", "")]
