"""Release packages, literally: what is there, and what isn't because it is unknown."""

import json
from datetime import date, datetime

from orefield.operators import exports

TENDER = "id long, source string, tender_id string, title string, buyer string, buyer_id long, state string, pincode string, category string, value_inr double, published_at timestamp, closes_at timestamp, content_hash string, url string, emd_inr double, opens_at timestamp, last_seen timestamp"
AWARD = "id long, award_id long, supplier string, supplier_key string, amount double, award_date date"


def test_packages(spark):
    full = (1, "up", "T1", "Bridge", "PWD", 5, "Delhi", "110001", "Works", 5e6, datetime(2026, 1, 1), datetime(2026, 3, 1, 10), "0123456789abcdefXX", "https://example.org/t1", 1e4, datetime(2026, 3, 2), datetime(2026, 1, 3))
    bare = (2, "up", "T2", "Road", "Board", None, "", None, "Other", None, datetime(2025, 1, 1), datetime(2025, 2, 1), "ff", None, None, None, None)
    awards = [(1, 11, "Builder Ltd", "builder", 4.5e6, date(2026, 4, 1)), (1, 12, "Builder Ltd", "builder", None, None), (1, 13, None, None, 1.0, None), (9, 14, "Nobody's", "x", 1.0, None)]
    made = exports.packages(spark.createDataFrame([full, bare], TENDER), spark.createDataFrame(awards, AWARD), "ocds-x", "2026-02-01")
    got = {r["id"]: json.loads(r["release"]) for r in made.collect()}
    assert got[2] == {
        "ocid": "ocds-x-up-T2", "id": "ocds-x-up-T2-ff", "tag": ["tender"], "initiationType": "tender", "language": "en", "parties": [{"id": "buyer-up-raw", "name": "Board", "roles": ["buyer"]}], "buyer": {"id": "buyer-up-raw", "name": "Board"},
        "tender": {"id": "T2", "title": "Road", "tenderPeriod": {"startDate": "2025-01-01T00:00:00Z", "endDate": "2025-02-01T00:00:00Z"}},
    }
    one = got[1]
    assert one["id"] == "ocds-x-up-T1-0123456789abcdef" and one["tag"] == ["tender", "award"] and one["date"] == "2026-01-03T00:00:00Z"
    assert one["parties"] == [
        {"id": "buyer-5", "name": "PWD", "roles": ["buyer"], "address": {"region": "Delhi", "postalCode": "110001", "countryName": "India"}}, {"id": "supplier-builder", "name": "Builder Ltd", "roles": ["supplier"]}, {"id": "supplier-Unknown bidder", "name": "Unknown bidder", "roles": ["supplier"]},
    ]
    t = one["tender"]
    assert t["status"] == "active" and t["value"] == {"amount": 5e6, "currency": "INR"} and t["mainProcurementCategory"] == "works" and t["awardPeriod"] == {"startDate": "2026-03-02T00:00:00Z"}
    assert t["guarantee"] == {"description": "Earnest money deposit (EMD)", "amount": 1e4, "currency": "INR"} and t["documents"][0]["url"] == "https://example.org/t1" and t["documents"][0]["id"] == "T1-notice"
    assert one["awards"][0] == {"id": "T1-award-11", "status": "active", "suppliers": [{"id": "supplier-builder", "name": "Builder Ltd"}], "value": {"amount": 4.5e6, "currency": "INR"}, "date": "2026-04-01"}
    assert set(one["awards"][1]) == {"id", "status", "suppliers"} and len(one["awards"]) == 3
    assert exports.packages(spark.createDataFrame([], TENDER), spark.createDataFrame(awards, AWARD), "p", "2026-02-01").count() == 0
