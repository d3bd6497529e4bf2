from pyspark.sql import functions as F

from orefield.operators import bank

PAGE = """<p>INR 1</p><div>Awarded Bidder(s):</div><b>First Co (12)</b><p>Bid Price at Opening</p><p>USD 9 INR 1,000.50</p><p>Contract price: INR 4</p><p>INR 5</p>
<div>Rejected Bidders:</div><p>INR 8</p><p>Name: Second  Co [JV]</p><p>Read out price</p><p>Country: India</p><p>USD 6</p><p>Evaluated Bid Price: USD 7</p><p>Read out price</p><p>INR 3</p>"""


def test_bidders_and_their_prices(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<p>Project: P12345</p>"), (3, None)], "id long, html string")
    rows = {r["id"]: r["bidders"] for r in bank.read_notices(pages).collect()}
    assert [tuple(b) for b in rows[1]] == [("First Co", "awarded", "INR", 1000.5, None, 4.0), ("Second Co", "rejected", "USD", None, 7.0, None)]
    assert rows[2] is None and rows[3] is None


def test_a_page_is_read_once_where_it_is(spark):
    pages = spark.range(10).select("id", F.lit(PAGE).alias("html"))
    plan = bank.read_notices(pages).select("id", "project_id", F.inline("bidders"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and plan.count("ArrowEvalPython") == 1
