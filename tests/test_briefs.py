"""Similar works, exemptions, documents and verdicts of notices; judged answers with quotes and their figures."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orefield.operators import briefs, judged
from orefield.operators.answers import ABSTAIN

LIST = "7. DOCUMENTS TO BE UPLOADED\n1. Scanned copy of EMD payment receipt.\n2. Registration certificate of the contractor.\n3. Audited balance sheets for the last three financial years;\n4. Experience certificates\nof similar works.\n8. GENERAL CONDITIONS\n5. Not of the list"


def required(spark, *pages):
    df = spark.createDataFrame([(1, k + 1, t) for k, t in enumerate(pages)], "doc_id int, page int, text string")
    return [(r["documents"], r["page"], r["listed"]) for r in briefs.required_documents(df).collect()]


def test_documents_of_a_list(spark):
    want = ["Scanned copy of EMD payment receipt", "Registration certificate of the contractor", "Audited balance sheets for the last three financial years", "Experience certificates of similar works."]
    assert required(spark, "First page, with PAN card", LIST) == [(want, 2, True)]
    assert required(spark, "List of documents\n(a) PAN\nb) GST\nThe rest is text.\nc) not this") == [(["PAN", "GST"], 1, True)]
    many = "Check list of documents\n" + "\n".join(f"- paper {k}" for k in range(60))
    ((items, _, _),) = required(spark, many)
    assert len(items) == 25 and items[-1] == "paper 24"


def test_known_documents_else(spark):
    text = "Bidders give an affidavit, a solvency certificate and GST registration.\nDocuments to be submitted\n1. only one item"
    assert required(spark, text, "PAN of the bidder") == [(["Affidavit", "Bank solvency certificate", "GST registration", "PAN card"], 1, False)]
    assert required(spark, "Nothing is asked for.") == [] == required(spark, "")


@pytest.mark.parametrize("text,value", [
    ("All is well. MSEs are exempted from EMD and tender fee. More.", "Exempted from EMD, tender fee"),
    ("Startups: no exemption from turnover is given.", "No exemption from experience and turnover criteria"),
    ("Exemption for udyam holders is not available.", "No exemption"),
    ("MSEs may bid. Others are exempted from EMD.", None),
    ("", None),
])
def test_exemption(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(briefs.exemption(F.col("t"))).first()[0] == value


def test_similar_work_has_all_its_options(spark):
    text = "General. Three similar completed works each costing not less than Rs. 40,00,000 or two similar works of Rs. 60,00,000 or one of Rs. 80,00,000. Average annual turnover of Rs. 1.20 crore."
    df = spark.createDataFrame([(1, text), (2, "Similar works are welcome."), (3, None)], "id int, text string")
    (r,) = briefs.similar_work(df).collect()
    assert r["value"].startswith("Three similar completed works") and r["amounts"] == [Decimal(4000000), Decimal(6000000), Decimal(8000000)]


def test_verdict_uses_the_bands(spark):
    text = "Minimum 5 years of experience. Three similar works of Rs. 40 lakh or one similar work of Rs. 80 lakh. Annual turnover of Rs. 1 crore. MSEs are exempted from EMD."
    asked = briefs.requirements(spark.createDataFrame([(1, text), (2, "Nothing is asked.")], "id int, text string"), "id")
    own = spark.createDataFrame([(1, "a", 2e7, 9e6, 7, ["Udyam"]), (1, "b", 2e7, 5e6, 7, None), (1, "c", 2e7, 3e6, 7, None), (1, "d", 9e6, 9e6, 7, None), (1, "e", 2e7, 9e6, 4, None), (1, "f", None, 9e6, None, None), (2, "g", 2e7, 9e6, 7, None)], "id int, who string, own_turnover double, own_similar double, own_years int, certifications array<string>")
    got = {r["who"]: (r["verdict"], {x["key"]: x["status"] for x in r["checks"]}) for r in briefs.assessed(own.join(asked, "id")).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "eligible", "b": "unknown", "c": "not_eligible", "d": "not_eligible", "e": "not_eligible", "f": "unknown", "g": "unknown"}
    assert got["a"][1] == {"min_turnover": "pass", "similar_work": "pass", "years": "pass", "mse_exemption": "pass"}
    assert got["b"][1]["similar_work"] == "unknown" and got["b"][1]["mse_exemption"] == "unknown" and "years" not in got["g"][1]


HITS = ["2. EARNEST MONEY DEPOSIT\nEarnest Money Deposit (EMD): Rs. 22,316/- (Rupees 0.22 lakh\nonly), payable online.\nThe EMD of unsuccessful bidders shall be refunded.", "Security deposit shall be recovered at the rate of 5% of each running bill."]
SAID = [("right", "The EMD is Rs. 22,316/- [1]."), ("wrong", "The EMD is Rs. 25,000 [1]."), ("uncited", "It is payable online."), ("refused", "I could not find this in the tender documents"), ("thinks", "<think>5%?</think>The rate is 5% [2]. It is on each bill [2][1]."), ("beyond", "The rate is 5% [7]."), ("nothing", None), ("empty", "")]


def test_judged(spark):
    answers = spark.createDataFrame(SAID, "answer_id string, answer string")
    passages = answers.select("answer_id").join(spark.createDataFrame([(k + 1, t) for k, t in enumerate(HITS)], "n int, text string"))
    got = {r["answer_id"]: r for r in judged.judged(answers, passages).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"right": "answered", "wrong": "rejected", "uncited": "rejected", "refused": "abstained", "thinks": "answered", "beyond": "rejected", "nothing": "rejected", "empty": "rejected"}
    (c,) = got["right"]["citations"]
    assert c["n"] == 1 and "22,316" in c["quote"]
    assert [x["n"] for x in got["thinks"]["citations"]] == [1, 2] and got["thinks"]["citations"][1]["quote"].startswith("Security deposit")
    assert got["wrong"]["shown"] == ABSTAIN and got["wrong"]["citations"] == []


def test_best_quote_prefers_values_then_words_then_the_first(spark):
    claims = spark.createDataFrame([(1, 1, "The fee is Rs. 500 for roads."), (2, 1, "roads and bridges of the state")], "answer_id int, n int, claim string")
    text = "Roads and fees of many kinds. Rs. 500 is asked for at first. Rs. 500 is asked for roads too. Bridges of the state."
    told = spark.createDataFrame([(1, 1, text), (2, 1, text), (3, 1, text)], "answer_id int, n int, text string")
    assert {r["answer_id"]: r["quote"] for r in judged.best_quotes(claims, told).collect()} == {1: "Rs. 500 is asked for roads too.", 2: "Bridges of the state."}


def test_figures(spark):
    rows = [("answered", "It is Rs. 5 [1].", True, "Rs. 5/-"), ("answered", "It is Rs. 6 [1].", True, "Rs. 5"), ("rejected", ABSTAIN, True, "Rs. 5"), ("abstained", ABSTAIN, False, None), ("answered", "Rs. 9 [1].", False, None), ("answered", "At the  Town Hall [1].", True, "town hall")]
    r = judged.figures(spark.createDataFrame(rows, "status string, shown string, answerable boolean, expected string")).first()
    assert (r["questions"], r["answerable"], r["exact_match"], r["grounding_rate"], r["false_abstentions"], r["confident_wrong"]) == (6, 4, 0.5, 1.0, 1, 2)
    assert round(r["abstention_accuracy"], 6) == round(4 / 6, 6)
    empty = judged.figures(spark.createDataFrame([], "status string, shown string, answerable boolean, expected string")).first()
    assert empty["questions"] == 0 and empty["exact_match"] is None
