"""Criteria text to rules, sidecar files, whole responses in reports."""
import json

from pyspark.sql import functions as F

from vetline.functions import json_fields as jf
from vetline.operators import board as bd
from vetline.operators import criteria as cr
from vetline.operators import scoring as sc

TEXT = """# A title line
# CRITERION 1 — TARGET ROLES
# ====
PREFERRED TITLES — no deduction:
  - CFO / Chief Financial Officer
  - VP of Finance
    (e.g. anything here)
DISCOUNTED TITLES — deduct 10 points each:
  - Chief of Staff (standalone)
  - Fractional CFO / Fractional Finance roles

OUT OF SCOPE — HARD DISQUALIFIER:
  - Any title that does not match any of the above tiers

# CRITERION 2 — LOCATIONS
SCORING RULES:

  Berlin, Germany: deduct 30 points
  Atlantis: HARD DISQUALIFIER

# CRITERION 3 — INDUSTRIES
PREFERRED INDUSTRIES — add 10 points ONCE in total, whatever matches
  - Deeptech
  - SaaS
ACCEPTABLE INDUSTRIES — neutral, no deduction:
  - Steel
DISLIKES — deduct 5 points each (apply all that match):
  - E-commerce
  - Quantum computing
"""


def test_criteria_become_rules(spark):
    rules = cr.parse_criteria(spark.createDataFrame([(TEXT,)], "criteria string")).orderBy("pos", "phrase").collect()
    got = [(r.criterion, r.section, r.phrase, r.points, r.once, r.flag) for r in rules]
    assert ("TARGET ROLES", "PREFERRED TITLES", "chief financial officer", 0, False, False) in got
    assert ("TARGET ROLES", "DISCOUNTED TITLES", "chief of staff", -10, False, False) in got
    assert ("TARGET ROLES", "OUT OF SCOPE", None, 0, False, True) in got
    assert ("LOCATIONS", None, "berlin germany", -30, False, False) in got
    assert ("LOCATIONS", None, "atlantis", 0, False, True) in got
    assert ("INDUSTRIES", "PREFERRED INDUSTRIES", "saas", 10, True, False) in got
    assert ("INDUSTRIES", "DISLIKES", "e commerce", -5, False, False) in got
    assert len(got) == 14
    two = spark.createDataFrame([("a", TEXT), ("b", "# no rules"), ("c", None)], "who string, criteria string")
    assert cr.parse_criteria(two, by=["who"]).groupBy("who").count().collect() == [("a", 14)]


def test_rules_apply_to_texts(spark):
    rules = cr.parse_criteria(spark.createDataFrame([(TEXT,)], "criteria string"))
    rows = [(1, "Fractional CFO (interim)", "a SaaS and deeptech shop", "Berlin, Germany"), (2, "Group CFO", "e-commerce; quantum  computing, E-COMMERCE", ""),
            (3, "Gardener", None, "ATLANTIS"), (4, None, "cfos and saasy", "Berlin")]
    df = spark.createDataFrame(rows, "id long, title string, about string, place string")
    out = cr.apply_rules(df, "id", {"TARGET ROLES": "title", "INDUSTRIES": "about", "LOCATIONS": "place"}, rules)
    got = {r.id: r for r in out.withColumn("score", jf.fit_score(F.col("additions"), F.col("deductions"))).collect()}
    assert [got[i].score for i in (1, 2, 3, 4)] == [100 - 10 + 10 - 30, 100 - 10, 100, 100]
    assert [d.criterion for d in got[1].deductions] == ["berlin germany", "fractional cfo"] and len(got[1].additions) == 1
    assert got[2].disqualifiers == [] and len(got[2].deductions) == 2
    assert got[3].disqualifiers == ["Location disqualifier: atlantis", "Role disqualifier: Gardener does not match any accepted tier"]
    assert got[4].disqualifiers == ["Role disqualifier:  does not match any accepted tier"]
    assert cr.apply_rules(df.where("false"), "id", {"TARGET ROLES": "title"}, rules).count() == 0


def test_sidecars_follow_the_longest_stem(spark):
    files = spark.createDataFrame([(n,) for n in ("a.md", "a_b.md", "a_b_SCORING.md", "a_c.x", "ab.md", "a", "_x", None, "a_b", "a.md")], "name string")
    cards = spark.createDataFrame([("a",), ("a_b",), ("",), (None,), ("a",)], "stem string")
    got = sorted(((r.name, r.stem) for r in bd.sidecar_groups(files, cards).collect()), key=str)
    assert got == sorted([("a.md", "a"), ("a.md", "a"), ("a_b.md", "a_b"), ("a_b_SCORING.md", "a_b"), ("a_c.x", "a"), ("ab.md", None), ("a", None),
                          ("_x", None), (None, None), ("a_b", "a")], key=str)


def test_reports_keep_the_whole_response(spark):
    responses = [{"company_name": "Søren & Cie", "additions": [{"criterion": "x", "points": "7", "why": "日本"}, "loose"],
                  "deductions": [], "my key": {"a": [1, {"b": {"c": {"d": [None, True, 1.5]}}}], "empty": {}, "none": []},
                  "quote\"d": "line\nbreak \"q\" \\", "zero": 0, "nothing": None}, {}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(responses)], "id long, text string")
    scored = sc.score_responses(df.withColumn("given", jf.strict_parse("text")), F.col("given"), "20260131", out="r")
    rows = scored.select("id", sc.scoring_report(F.col("id"), F.col("r"), F.col("given")).alias("rep")).select("id", sc.report_json("rep").alias("raw")).collect()
    for r in rows:
        back, sent = json.loads(r.raw), responses[r.id]
        known = {"fit_score", "additions", "deductions", "disqualifiers", "date_published", "city_code", "job_title", "company_name", "client_company", "source", "notes"}
        assert {k: v for k, v in back.items() if k not in known} == {k: v for k, v in sent.items() if k not in known}
        assert known <= set(back) and back["company_name"] == sent.get("company_name", "")
    raw = rows[0].raw
    assert "Søren" in raw and "\\u" not in raw and raw.startswith("{\n  \"") and '\n  "my key": {\n    "a": [\n      1,' in raw
    assert json.loads(rows[0].raw)["additions"][0] == {"criterion": "x", "detail": "", "points": 7}


def test_values_of_a_report_are_worked_out_once(spark):
    df = spark.createDataFrame([('{"b": {"x": [1, {"y": []}, "{"]}, "a": "[", "c": {}, "d": null, "e": [[2.5, true], []]}',)], "t string")
    got = df.select(jf.pretty(F.parse_json("t")).alias("p")).first().p
    assert json.loads(got) == json.loads(df.first().t)
    assert got == json.dumps({"a": "[", "b": {"x": "X"}, "c": {}, "d": None, "e": "E"}, indent=2).replace(
        '"X"', '[\n      1,\n      {"y":[]},\n      "{"\n    ]').replace('"E"', '[\n    [\n      2.5,\n      true\n    ],\n    []\n  ]')
    text = df.select(jf.pretty(F.parse_json("t")).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert text.count("parse_json(") == 1 and len(text) < 20_000, len(text)
