"""The composed funnel (G1) on a small hand-made batch."""
import json

from vetline.plans import profiles

LONG = "<p>" + "Finance role in Lisbon. " * 20 + "</p>"


def test_full_profile(spark):
    links = spark.createDataFrame([
        ("20260131_CFO - Acme - LinkedIn", "u1"), ("20260131_Dev - Foo - LinkedIn", "u2"),
        ("20260131_Head - Bar - LinkedIn", "u3"), ("20260131_Gone - Baz - LinkedIn", "u4"),
        ("20260131_Old - Qux - LinkedIn", "u5"), ("20260131_Student Job - X - LinkedIn", "u6")],
        "name string, url string")
    pages = spark.createDataFrame([(u, f"<h1>T{u}</h1><article>{LONG}</article>") for u in ["u1", "u2", "u3", "u6"]],
                                  "url string, html string")
    ext = {"u1": {"language": "en"}, "u2": {"language": "de"}, "u3": {"language": "es"}}
    extract = spark.createDataFrame([(u, 1, json.dumps(v)) for u, v in ext.items()],
                                    "url string, attempt int, text string")
    sco = {"u1": {"job_title": "CFO", "company_name": "Acme", "city_code": "LISBON", "date_published": "20260120",
                  "additions": [{"criterion": "Industry", "points": 10}], "deductions": []},
           "u3": {"job_title": "Head", "disqualifiers": ["Role disqualifier: x"]}}
    score = spark.createDataFrame([(u, 1, "```json\n" + json.dumps(v) + "\n```") for u, v in sco.items()],
                                  "url string, attempt int, text string")
    seen = spark.createDataFrame([("u5",)], "url string")
    out = profiles.run({"links": links, "seen": seen, "pages": pages, "extract_attempts": extract,
                        "score_attempts": score}, profile="full", today="20260131")
    dedup = {r.url: r.outcome for r in out["dedup"].collect()}
    assert dedup["u5"] == "deleted"
    kw = {r.url: r.matched_keyword for r in out["keyword"].collect()}
    assert kw["u6"] == "student"
    s05 = {r.url: r.stage05 for r in out["extraction"].collect()}
    assert s05 == {"u1": "accepted", "u2": "lang_rejects", "u3": "accepted", "u4": "pending"}
    s06 = {r.url: (r.stage06, r.ref_nr, r.scored.fit_score) for r in out["scoring"].collect()}
    assert s06 == {"u1": ("accepted", 1, 110), "u3": ("rejected_role", 2, 100)}
    rows = {r.url: (r.status, r.fit_score, r.date_published, r.reject_reason) for r in out["new_rows"].collect()}
    assert rows == {"u1": ("new", 110, "20/01/2026", None), "u3": ("rejected", 100, "31/01/2026", "Role")}
    names = {r.url: r.stage05_name for r in out["scoring"].collect()}
    assert names["u1"].startswith("20260131_UNKN_") and names["u1"] != names["u3"]
    final = {r.url: r.final_stem for r in out["scoring"].collect()}
    assert final["u1"] == "0001_110_20260120_LISBON_CFO_Acme_LinkedIn"
    assert {r.url for r in out["quarantine"].collect()} == {"u4"}


def test_equal_stage05_stems_get_suffixes(spark):
    links = spark.createDataFrame([("20260131_A - X - LinkedIn", "v1"), ("20260131_B - X - LinkedIn", "v2")],
                                  "name string, url string")
    pages = spark.createDataFrame([(u, f"<h1>T</h1><article>{LONG}</article>") for u in ["v1", "v2"]],
                                  "url string, html string")
    same = json.dumps({"language": "en", "title": "CFO", "company": "Acme", "city": "Porto",
                       "published_date": "20260101"})
    extract = spark.createDataFrame([(u, 1, same) for u in ["v1", "v2"]], "url string, attempt int, text string")
    score = spark.createDataFrame([(u, 1, json.dumps({"job_title": "CFO"})) for u in ["v1", "v2"]],
                                  "url string, attempt int, text string")
    out = profiles.run({"links": links, "seen": spark.createDataFrame([], "url string"), "pages": pages,
                        "extract_attempts": extract, "score_attempts": score}, today="20260131")
    names = {r.url: (r.stage05_name, r.ref_nr) for r in out["scoring"].collect()}
    assert names == {"v1": ("20260101_PORT_CFO_-_Acme_-_LinkedIn", 1),
                     "v2": ("20260101_PORT_CFO_-_Acme_-_LinkedIn_01", 2)}


def test_name_collisions_in_intake(spark):
    links = spark.createDataFrame([("20260131_CFO - Acme - LinkedIn", "w1"), ("20260131_CFO - Acme - LinkedIn", "w2")],
                                  "name string, url string")
    empty = spark.createDataFrame([], "url string, attempt int, text string")
    out = profiles.run({"links": links, "seen": spark.createDataFrame([], "url string"),
                        "pages": spark.createDataFrame([], "url string, html string"),
                        "extract_attempts": empty, "score_attempts": empty}, today="20260131")
    names = {r.url: r.name for r in out["keyword"].collect()}
    assert names == {"w1": "20260131_CFO - Acme - LinkedIn", "w2": "20260131_CFO - Acme - LinkedIn (00)"}
