from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from orefield.operators import documents, entities, exports, fulltext, prices, retrieval, rules, upsert
from orefield.sources import awards, pages


# --- names ---


@pytest.mark.parametrize(("raw", "norm"), [("PWD Bhopal", "public works department bhopal"), ("Roads & Buildings", "roads buildings"), ("P.W.D.", "p w d"), ("Min of X || Office of the EE", "min x | executive engineer"), ("", "")])
def test_normal_form(raw, norm):
    assert entities.normal_form(raw) == norm


def test_scores_and_guards():
    n = entities.normal_form
    a, b = n("Municipal Corporation Bhopal || Engineering Wing"), n("Municipal Corporation Bhopal || Health Wing")
    assert entities.score(a, b, guards=False) >= 90 > 80 > entities.score(a, b)
    assert entities.score(n("PWD || Division No 1"), n("PWD || Division No 2")) <= 85
    assert entities.score(n("PWD || Bhopal Division"), n("Public Works Deptt. || Bhopal Divison")) >= 90
    assert entities.ratio("abcd", "abcd") == 100 and entities.ratio("", "") == 100 and entities.token_set_ratio("", "a") == 0


def test_resolve_and_evaluate(spark):
    rows = [("Public Works Department || Bhopal Division", "MP", 9), ("PWD || Bhopal Division", "MP", 5), ("Public Works Deptt. || Bhopal Divison", "MP", 2), ("PWD || Bhopal Division ", "RJ", 1), ("Municipal Corporation Bhopal || Engineering Wing", "MP", 4), ("Municipal Corpn Bhopal || Engineering Wing", "MP", 1)]
    got = {(r.name, r.state): r for r in entities.resolve(spark.createDataFrame(rows, "name string, state string, n long")).collect()}
    first = rows[0][0]
    assert {got[(r[0], "MP")].entity for r in rows[:3]} == {first}
    assert [got[(r[0], "MP")].method for r in rows[:3]] == ["new", "exact", "fuzzy"]
    assert got[(rows[3][0], "RJ")].method == "new"
    assert got[(rows[5][0], "MP")].candidate == rows[4][0] and got[(rows[5][0], "MP")].entity == rows[5][0]
    labels = spark.createDataFrame([("real", 0, 85.0), ("real", 0, 20.0), ("made", 1, 95.0), ("made", 1, 70.0)], "source string, same_entity int, score double")
    m = {r.source: r for r in entities.evaluation(labels).collect()}
    assert m["real"].precision is None and (m["made"].precision, m["made"].recall) == (1.0, 0.5) and m["all"].tn == 2


# --- rules and prices ---


def test_additional_security(spark):
    cases = {1.0: 0.0, 0.9: 0.0, 0.896: 0.0, 0.89: 0.1, 0.85: 0.5, 0.81: 0.9, 0.8: 1.0, 0.75: 2.0, 1.1: 0.0}
    df = spark.createDataFrame([(k,) for k in cases], "r double")
    for r in df.select("r", rules.additional_security_percent(F.col("r")).alias("p")).collect():
        assert r.p == pytest.approx(cases[r.r])


BID = dict(category="works", method="open", buyer="PWD", title="Road", state="Odisha", source="p", on_date=date(2026, 2, 1), estimated_value_inr=2e6, is_mse=False, is_class1_local=None, ratio=0.85)
SCHEMA = "category string, method string, buyer string, title string, state string, source string, on_date date, estimated_value_inr double, is_mse boolean, is_class1_local boolean, ratio double"


@pytest.mark.parametrize(
    ("change", "keys"),
    [
        ({}, ["aps", "odisha_cap_abolished"]), ({"ratio": 0.95}, ["aps_free_band", "odisha_cap_abolished"]), ({"on_date": date(2025, 1, 1)}, ["odisha_floor", "state_aps"]), ({"ratio": 0.7}, ["aps", "odisha_cap_abolished", "abnormally_low"]),
        ({"state": "Kerala"}, ["state_aps"]), ({"state": "Kerala", "buyer": "NHAI"}, ["aps"]), ({"category": "consultancy", "state": "", "ratio": None}, ["qcbs"]), ({"category": "goods", "state": "", "ratio": None, "source": "gem"}, ["mse_preference", "make_in_india", "reverse_auction"]),
        ({"category": "goods", "state": "", "ratio": None, "is_class1_local": True}, ["mse_preference"]), ({"state": "", "ratio": None}, []),
    ],
)
def test_findings(spark, change, keys):
    row = BID | change
    df = spark.createDataFrame([tuple(row.values())], SCHEMA)
    assert [f.key for f in rules.findings(df).first().findings] == keys


def test_eligibility(spark):
    df = spark.createDataFrame([(10, 20, 5, None, 3, 4), (10, 5, None, None, None, None), (10, None, 1, 2, None, None)], "required_turnover int, own_turnover int, required_similar_work int, own_similar_work int, required_years int, own_years int")
    assert [r.verdict for r in rules.eligibility(df).collect()] == ["unknown", "not_eligible", "unknown"]


def test_real_amounts(spark):
    index = spark.createDataFrame([("cpi", "IN", 2000, 50.0), ("cpi", "IN", 2024, 200.0), ("fx", "IN", 2000, 45.0), ("fx", "UA", 2000, 5.0), ("fx", "XC", 2000, 0.9)], "series string, country string, year int, value double")
    rows = [(1, 100.0, "INR", "IN", 2000), (2, 1.0, "USD", "IN", 2000), (3, 10.0, "UAH", "UA", 2000), (4, 9.0, "EUR", "PL", 2000), (5, 1.0, "PLN", "PL", 2000), (6, None, "INR", "IN", 2000), (7, 5.0, "INR", "IN", None), (8, 100.0, "INR", "IN", 1990), (9, 1.0, "INR", "IN", 2010)]
    got = {r.k: r.inr_real for r in prices.to_real(spark.createDataFrame(rows, "k int, amount double, currency string, country string, year int"), index, 2024, "amount").collect()}
    assert got == {1: 400.0, 2: 180.0, 3: 360.0, 4: 1800.0, 5: None, 6: None, 7: None, 8: 400.0, 9: None}
    grown = prices.extended(spark.createDataFrame([("cpi", "IN", y, 100 * 1.1 ** (y - 2021)) for y in range(2021, 2025)], "series string, country string, year int, value double"), 2026)
    assert {r.year: r.value for r in grown.collect()}[2026] == pytest.approx(100 * 1.1**5)
    stored = prices.upsert_index(index, spark.createDataFrame([("cpi", "IN", 2000, 60.0, 0), ("cpi", "IN", 2000, 70.0, 1), ("cpi", "US", 2000, 1.0, 0)], "series string, country string, year int, value double, ord int"))
    assert {(r.series, r.country, r.year): r.value for r in stored.collect()}[("cpi", "IN", 2000)] == 70.0 and stored.count() == 6


# --- upserts ---


def test_upsert_is_idempotent_and_ignores_late_pages(spark):
    kind = "k int, fetched_at int, v string, content_hash string, prebid string"
    stored = spark.createDataFrame([(1, 5, "a", "a", "p"), (2, 5, "b", "b", None)], kind).withColumns({"first_seen": F.col("fetched_at"), "last_seen": F.col("fetched_at")})
    batch = spark.createDataFrame([(1, 9, "A", "A", None), (2, 3, "B", "B", None), (3, 9, "c", "c", None)], kind)
    once = upsert.upsert(stored, batch, ["k"], keep_known=("prebid",))
    rows = {r.k: r for r in once.collect()}
    assert [(rows[k].v, rows[k].outcome, rows[k].first_seen, rows[k].last_seen) for k in (1, 2, 3)] == [("A", "updated", 5, 9), ("b", "unchanged", 5, 5), ("c", "new", 9, 9)]
    assert rows[1].prebid == "p"
    again = upsert.upsert(once.drop("outcome"), batch, ["k"], keep_known=("prebid",))
    assert {(r.k, r.v, r.first_seen, r.last_seen) for r in again.collect()} == {(r.k, r.v, r.first_seen, r.last_seen) for r in rows.values()}
    assert {r.outcome for r in again.collect()} == {"unchanged"}
    ignored = upsert.insert_ignore(batch, spark.createDataFrame([(1, 1, "x", "x", None), (4, 1, "y", "y", None)], kind), ["k"])
    assert {(r.k, r.v) for r in ignored.collect()} == {(1, "A"), (2, "B"), (3, "c"), (4, "y")}


# --- texts ---


def test_facts():
    assert documents.facts("Due 07-Oct-2026, EMD ₹16 lakh, 5 % of 2,500 [3]") == [("date", "2026-10-07", "07-Oct-2026"), ("money", "1600000", "₹16 lakh"), ("percent", "5", "5 %"), ("number", "2500", "2,500")]
    assert documents.values_match("Rs. 9,38,100/-", "it is ₹9,38,100") and not documents.values_match("Rs. 5", "Rs. 6") and documents.values_match("Mr  Rao", "by mr rao.")
    assert documents.sentences("The EMD is Rs. 5/-. [2] The fee is due. it goes on.\nEnd") == ["The EMD is Rs. 5/-. [2]", "The fee is due. it goes on.", "End"]


def test_grounding(spark):
    p = [(n, 1, "EMD of Rs. 16,00,000/- by 07-Oct-2026; security 5 %.") for n in range(1, 6)] + [(n, 2, "Tender fee: Rs. 500/-.") for n in range(1, 6)]
    a = [(1, "The EMD is ₹16 lakh [1], due 7 October 2026 [1]."), (2, "The EMD is Rs. 16,00,000 [2]."), (3, "The EMD is Rs. 5."), (4, "The fee is Rs. 500 [7]."), (5, "The fee is Rs. 500. It is paid once [2].")]
    got = {r.answer_id: r for r in documents.grounding(spark.createDataFrame(a, "answer_id int, answer string"), spark.createDataFrame(p, "answer_id int, n int, text string")).collect()}
    assert [got[k].ok for k in range(1, 6)] == [True, False, False, False, True]
    assert (got[2].unsupported, got[3].uncited, got[4].invalid) == (1, 1, 1)


def test_chunks(spark):
    long = " ".join(f"Clause number {k} says what is to be done about it." for k in range(200))
    text = f"NOTICE INVITING TENDER\nshort words here\n1. Scope\n{long}\n2. Payment\nas agreed"
    rows = [(1, p, f"{text}\nPage {p} of 3" if p == 1 else f"more of it\nPage {p} of 3") for p in (1, 2, 3)]
    got = documents.chunk(spark.createDataFrame(rows, "doc_id int, page int, text string")).orderBy("ord").collect()
    assert all(r.tokens <= 830 for r in got) and len(got) >= 4
    assert not any("Page" in r.text for r in got)
    assert [r.heading for r in got][1] == "1. Scope" and got[2].text.startswith("1. Scope (continued)")
    heads = spark.createDataFrame([("2. EARNEST MONEY",), ("Section IV",), ("ELIGIBILITY CRITERIA",), ("an ordinary line",), ("NIT",), ("",)], "x string")
    assert [r[0] for r in heads.select(documents.is_heading(F.col("x"))).collect()] == [True, True, True, False, False, False]


def test_running_lines_by_share_and_with_tabs(spark):
    rows = [(1, p, f"body {'abcde'[p]}\n\tHeader of {p}\t\r" + ("\nnow and then" if p < 3 else "")) for p in range(5)]
    pages = spark.createDataFrame(rows, "doc_id int, page int, text string")
    lines = lambda **k: {(r.line, r.n) for r in fulltext.running_lines(pages, "doc_id", "page", "text", **k).collect()}
    assert lines() == {("Header of #", 5), ("now and then", 3)} and lines(share=0.8) == {("Header of #", 5)}
    assert [r.line for r in documents.lines(pages).orderBy("page", "ord").collect()] == [f"body {c}" for c in "abcde"]


def test_queries_over_the_whole_of_their_operators(spark):
    from orefield import registry

    sf = "/root/testdata/sf0.001"
    query = registry.queries()
    assert {r.q for r in query["ratio_quantiles_all"](spark, sf).collect()} == set(range(1, 20))
    sectors = "roads buildings water electrical it security health lab facility transport consultancy supplies other"
    assert {r.sector for r in query["sector_cascade"](spark, sf).collect()} == set(sectors.split())
    chunks = query["chunk_pack_turns"](spark, sf).collect()
    assert any(r.page_to > r.page_from for r in chunks)
    turns = {r.conv_id: r["count"] for r in spark.read.parquet(f"{sf}/conversations.parquet").groupBy("conv_id").count().collect()}
    assert {r.doc_id for r in chunks} == set(turns) and not any("Turn" in r.text for r in chunks if turns[r.doc_id] >= 3)


def test_search(spark):
    rows = [(1, "Road repair", "PWD"), (2, "Bridge", "Road works office"), (3, "Repair of roads and drains", "X"), (4, "Drain cleaning", "Y")]
    posted = fulltext.postings(spark.createDataFrame(rows, "id int, title string, buyer string"), "id", {"title": "A", "buyer": "C"})
    ids = lambda q, **k: [r.id for r in fulltext.search(posted, fulltext.parse_question(q), "id", **k).collect()]
    assert set(ids("road")) == {1, 2, 3} and ids("road")[-1] == 2
    assert ids('"road repair"') == [1] and set(ids("road -drain")) == {1, 2} and set(ids("bridge or cleaning")) == {2, 4} and ids("repairing road") != [] and ids("") == []
    assert set(ids("bridge cleaning", any_term=True)) == {2, 4} and ids("bridge cleaning") == []
    assert fulltext.parse_question('or a "b c" -d or e').clauses == ((("a",),), (("b", "c"), ("e",)))


def test_corrections(spark):
    vocabulary = spark.createDataFrame([("toilet", 5), ("road", 9), ("roads", 2)], "word string, ndoc long")
    assert {(r.word, r.fixed) for r in fulltext.corrections(["toliet", "rod", "roa", "xyzzy"], vocabulary).collect()} == {("toliet", "toilet"), ("rod", "road")}


def test_similarity(spark):
    df = spark.createDataFrame([("toilet", "toliet")], "a string, b string")
    assert df.select(fulltext.trigram_similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(3 / 11)


def test_fusion(spark):
    lists = [spark.createDataFrame(x, "id int, rank int") for x in ([(1, 1), (2, 2), (3, 3)], [(3, 1), (1, 2)])]
    assert [r.id for r in retrieval.fuse(*lists).collect()] == [1, 3, 2]


# --- sources and sinks ---

NOTICE = dict(zip(awards.TED_COLUMNS, [""] * len(awards.TED_COLUMNS))) | dict(
    ID_NOTICE_CAN="202243", YEAR="2022", DT_DISPATCH="29/12/21", DT_AWARD="28/12/21", CAE_NAME="Gmina", ISO_COUNTRY_CODE="PL", TYPE_OF_CONTRACT="W", CPV="45233140", ID_LOT="1", ID_AWARD="13", TOP_TYPE="OPE", WIN_NAME="A---B", TITLE="T", NUMBER_OFFERS="4", AWARD_EST_VALUE_EURO="200000", AWARD_VALUE_EURO="150000.50",
)


def notice(spark, **change):
    return spark.createDataFrame([(*(NOTICE | change).values(), 7)], ", ".join(f"{c} string" for c in awards.TED_COLUMNS) + ", line long")


def test_notice_record(spark):
    r = awards.ted_records(notice(spark)).first()
    assert (r.source_id, r.country, r.category, r.method, r.sector, r.num_bidders, r.award_date, r.year, r.winner) == ("202243:13", "PL", "works", "open", "roads", 4, date(2021, 12, 28), 2022, "A; B")
    assert awards.ted_records(notice(spark, ID_AWARD="", ID_LOT="", ISO_COUNTRY_CODE="UK", DT_AWARD="01/01/95", NUMBER_OFFERS="40000")).select("source_id", "country", "award_date", "num_bidders").first() == ("202243:7", "GB", date(2021, 12, 29), None)


@pytest.mark.parametrize(
    ("change", "reason"),
    [({"CANCELLED": "1"}, "cancelled_or_not_awarded"), ({"FRA_ESTIMATED": "A"}, "framework_or_dps"), ({"AWARD_VALUE_EURO": "1e15"}, "no_estimate_or_award"), ({"AWARD_VALUE_EURO": "200000.00"}, "award_equals_estimate"), ({"AWARD_VALUE_EURO": "2000"}, "ratio_out_of_band"), ({"ISO_COUNTRY_CODE": ""}, "no_country"), ({"ID_NOTICE_CAN": ""}, "no_id")],
)
def test_notice_reasons(spark, change, reason):
    assert awards.ted_reason(notice(spark, **change)).first().reason == reason


def test_zipped_csv(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("a.csv", "﻿id,Name,extra\n1,\"x, y\",z\n2,q,w\n")
        z.writestr("note.txt", "no")
    got = awards.zipped_csv(spark, str(tmp_path / "y.zip"), ["ID", "NAME", "MISSING"]).orderBy("line").collect()
    assert [(r.ID, r.NAME, r.MISSING, r.line) for r in got] == [("1", "x, y", None, 1), ("2", "q", None, 2)]


def test_road_records(spark):
    base = dict(id="1", state_name="Goa", state_code="30", district_name="North", road_name="A to B", packages="P1", upgrade_or_new="New", contractor_name="None", company_name="M/s X Co..", sanctioned_year="2008-2009", work_award_date="3-4-2010", total_cost="30.0")
    rows = [base, base | {"id": "2", "company_name": "Y Builders", "sanctioned_year": "2011-2012", "total_cost": "40.0"}, base | {"id": "3", "company_name": "Y Builders"}, base | {"id": "4", "road_name": "", "company_name": "BMS EXPENDITURE"}]
    got = sorted(awards.road_records(spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in base)), "2026-01-01").collect(), key=lambda r: r.title)
    assert len(got) == 2 and got[0].title == "A to B (new)" and got[0].winner == "Y Builders" and got[0].estimated_value == Decimal("3000000.00") and got[0].year == 2010
    assert got[1].title == "PMGSY rural road" and got[1].winner == ""
    with pytest.raises(ValueError, match="lacks columns"):
        awards.road_records(spark.createDataFrame([("1",)], "id string"), "2026-01-01")


def release(**tender):
    value = lambda x: {"amount": x, "currency": "PEN"}
    lots = [{"id": "L1", "value": value(100.0)}, {"id": "L2", "value": value(200.0)}]
    base = {"title": "T", "value": value(300.0), "lots": lots, "datePublished": "2020-01-02T00:00:00Z"}
    return {"ocid": "o1", "buyer": {"id": "b", "name": "B"}, "tender": base | tender, "awards": [{"id": "a1", "status": "active", "value": value(90.0), "relatedLots": ["L1"], "date": "2020-05-01"}, {"id": "a2", "value": value(150.0), "relatedLots": ["L2"]}]}


def test_release_records(spark, tmp_path):
    import json

    cases = [release(), release(value={"amount": 0, "currency": "PEN"}), release(value={"amount": 300.0, "currency": "XXX"}), release() | {"awards": []}, release() | {"awards": [release()["awards"][0] | {"relatedLots": ["L1", "L2"]}]}]
    single = release(lots=None) | {"awards": [release()["awards"][0] | {"relatedLots": None}]}
    items = release(lots=None, items=[{"id": "i1", "quantity": 2, "unit": {"value": {"amount": 50.0, "currency": "PEN"}}}, {"id": "i2", "totalValue": {"amount": 200.0, "currency": "PEN"}}])
    items["awards"] = [{"id": "a", "value": {"amount": 95.0, "currency": "PEN"}, "items": [{"id": "i1"}]}, {"id": "b", "value": {"amount": 1.0, "currency": "PEN"}, "items": [{"id": "i2"}]}]
    lines = [json.dumps(c if k % 2 else {"compiledRelease": c}) for k, c in enumerate([*cases, single, items])] + ["{not json"]
    (tmp_path / "r.jsonl").write_text("\n".join(lines))
    df = awards.releases(spark, str(tmp_path / "r.jsonl"))
    assert sum(r.bad is not None for r in df.collect()) == 1
    reasons = sorted(r.reason for r in awards.ocds_reasoned(df, "PEN").collect())
    assert reasons == sorted(["emitted", "emitted", "no_estimate", "other_currency", "no_award", "ambiguous_scope", "emitted", "emitted", "ratio_out_of_band"])
    got = {r.source_id: r for r in awards.ocds_records(df, "PE", "PEN", "peru").collect()}
    assert (got["o1:a2"].estimated_value, got["o1:a2"].award_value, got["o1:a2"].year) == (Decimal("200.00"), Decimal("150.00"), 2020)
    assert got["o1:a"].estimated_value == Decimal("100.00")
    with pytest.raises(ValueError, match="no source"):
        awards.read(spark, "nowhere", "x")


def test_portal_pages():
    index = '<table><tr><td>1</td><td>Org A</td><td><a href="x?page=FrontEndTendersByOrganisation&sp=1">12</a></td></tr><tr><td>2</td><td>Org A</td><td><a href="x?page=FrontEndTendersByOrganisation&sp=2">3</a></td></tr></table>'
    assert pages.organisations(index) == [{"name": "Org A", "tenders": 12, "href": "x?page=FrontEndTendersByOrganisation&sp=1"}]
    row = '<table id="table"><tr><td>1</td><td>p</td><td>c</td><td>o</td><td><a href="FrontEndViewTender?1">[Road [x] work]</a> [REF/1][2026_A_1]</td><td>A||B</td></tr></table>'
    (got,) = pages.listing(row)
    assert (got["title"], got["ref_no"], got["tender_id"], got["org_chain"]) == ("Road [x] work", "REF/1", "2026_A_1", "A||B")
    page = '<table><tr><td class="td_caption">Tender ID</td><td>T1</td></tr><tr><td class="td_caption">Name</td><td>First</td></tr><tr><td class="td_caption">Name</td><td>Second</td></tr><tr><td class="td_caption">EMD Amount in Rs.</td><td> 5&nbsp;0 </td></tr></table><a href="d">nit.pdf</a>'
    got = pages.detail(page)
    assert got["tender_id"] == "T1" and got["inviting_authority"] == "First" and got["emd"] == "5 0" and got["documents"] == "nit.pdf"
    assert pages.detail("<p>nothing</p>") is None


def test_exports(spark):
    df = spark.createDataFrame([(1, "=SUM(A1)", None), (2, "fine", None)], "id int, title string, x string")
    assert [r.title for r in exports.csv_rows(df, ["id"]).collect()] == ["'=SUM(A1)", "fine"]
    folded = exports.fold("SUMMARY:" + "é" * 100)
    assert all(len(p.encode()) <= 75 for p in folded.split("\r\n")) and folded.replace("\r\n ", "") == "SUMMARY:" + "é" * 100
    t = spark.sql("select 1 as id, 'a,b' as title, timestamp'2026-01-01 10:00:00' as closes_at, cast(null as timestamp) as opens_at, cast(null as timestamp) as prebid_meeting")
    (e,) = exports.calendar(t).collect()
    assert "SUMMARY:Closes: a\\,b" in e.event and "DTSTART:20260101T100000Z" in e.event
    tenders = spark.sql("select 1 as id, '' as buyer, cast(null as decimal(18,2)) as value_inr, timestamp'2026-01-01' as published_at, timestamp'2026-02-01' as closes_at")
    out = exports.releases(tenders, spark.sql("select 1 as id, 'a' as award_id, 's' as supplier, 5.0 as amount")).first().release
    assert '"awards":[{"id":"a"' in out and "null" not in out and '"value":{"amount":5.0' in out and '"name":""' not in out
    stored = spark.sql("select stack(4, 1, 'listing', timestamp'2026-01-01', 2, 'detail', timestamp'2025-01-01', 3, 'detail', timestamp'2025-01-01', 4, 'listing', timestamp'2026-01-30') as (page_id, kind, fetched_at)")
    refs = spark.sql("select 2 as page_id union all select cast(null as int)")
    assert {r.page_id for r in exports.retained(stored, [refs], "2026-01-31").collect()} == {2, 4}


def test_csv_heads_may_be_quoted_and_files_plain_or_compressed(spark, tmp_path):
    import gzip
    import zipfile

    body = '"A","B, with comma",c\n1,"x, y",2\n3,"line\nend",4\n'
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.csv", body)
    (tmp_path / "b.csv").write_text(body)
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(body.encode()))
    from orefield.sources import awards

    wanted = [("1", "x, y", "2", None), ("3", "line\nend", "4", None)]
    names = ["a", "b, with comma", "C", "missing"]
    for got in (awards.zipped_csv(spark, str(tmp_path / "a.zip"), names), awards.plain_csv(spark, str(tmp_path / "b.csv"), names), awards.plain_csv(spark, str(tmp_path / "c.csv.gz"), names)):
        assert sorted(tuple(r)[:4] for r in got.collect()) == wanted
