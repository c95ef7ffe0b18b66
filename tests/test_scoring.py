"""Scores, points coercion, routing, requirements (FIXTURES B7, B9, B10)."""
import json

from pyspark.sql import functions as F

from vetline.functions import json_fields as jf
from vetline.operators import filters as flt
from vetline.operators import responses as rsp
from vetline.operators import scoring as sc

B9 = [
    ({"additions": [{"criterion": "Industry", "points": 10}, {"criterion": "industry fintech", "points": 10}],
      "deductions": [{"criterion": "a", "points": "30"}, {"criterion": "b", "points": -50}]}, 30, "accepted"),
    ({"additions": [{"criterion": "Industry", "points": 10}],
      "deductions": [{"criterion": "a", "points": 30}, {"criterion": "b", "points": 50},
                     {"criterion": "c", "points": 1}]}, 29, "rejected_score"),
    ({"deductions": [{"criterion": "a", "points": 150}]}, 0, "rejected_score"),
    ({"additions": [{"criterion": "x", "points": 15}]}, 115, "accepted"),
    ({"additions": ["plain text"]}, 100, "accepted"),
    ({"disqualifiers": ["ROLE disqualifier: x"]}, 100, "rejected_role"),
    ({"disqualifiers": ["Location disqualifier: x"]}, 100, "disqualified"),
    ({"disqualifiers": ["Role disqualifier: x", "location disqualifier: y"]}, 100, "disqualified"),
]


def test_b9_scores_and_routes(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _, _) in enumerate(B9)], "i int, t string")
    out = sc.score_responses(df, jf.parse_response(F.col("t")), "20260131", out="r")
    out = out.withColumn("route", sc.route_scored(F.col("r.fit_score"), F.col("r.disqualifiers")))
    got = {x.i: (x.r.fit_score, x.route) for x in out.collect()}
    assert got == {i: (s, o) for i, (_, s, o) in enumerate(B9)}
    forced = out.select(sc.route_scored(F.col("r.fit_score"), F.col("r.disqualifiers"), force=True)).distinct()
    assert [r[0] for r in forced.collect()] == ["accepted"]
    # second industry item: 0 points plus a note; the column form agrees
    r0 = out.where("i = 0").first().r
    assert r0.additions[1].points == 0 and "once only" in r0.additions[1].detail
    col = df.select(sc.score_response(jf.parse_response(F.col("t")), "20260131").fit_score.alias("s"))
    assert [r.s for r in col.collect()] == [s for _, s, _ in B9]


def test_points_coercion(spark):
    vals = ['10.7', '"10.5"', 'null', 'true', '" -5 "', '"30"', '[1]']
    adds = [10, 0, 0, 1, 5, 30, 0]
    df = spark.createDataFrame([(i, '{"additions":[{"criterion":"c","points":%s}],"deductions":[{"criterion":"d","points":%s}]}' % (v, v))
                                for i, v in enumerate(vals)], "i int, t string")
    out = sc.score_responses(df, jf.parse_response(F.col("t")), "20260131", out="r").orderBy("i").collect()
    assert [r.r.additions[0].points for r in out] == adds
    assert [r.r.deductions[0].points for r in out] == [-a for a in adds]


def test_b10_raw_text_status(spark):
    texts = ['```json\n{"a":{"b":1}}\n``` tail', '{"a":"x\ny"}', '', 'no braces', '{"a":1} text {"b":2}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.s for r in df.select(jf.parse_status("t").alias("s")).collect()]
    assert got == ["ok", "ok", "empty", "no_json", "bad_json"]


def test_attempt_rules(spark):
    rows = [("L1", 1, ""), ("L1", 2, '{"k":1} x {"k":2}'), ("L1", 3, '{"k":3}'),
            ("L2", 1, "none"), ("L2", 2, '{"k":5}'), ("L3", 1, '{"k":7}')]
    df = spark.createDataFrame(rows, "listing string, n int, text string")
    s6 = {r.listing: r.picked_attempt for r in rsp.pick_attempt(df, "listing", ["n"]).collect()}
    assert s6 == {"L1": 3, "L2": 2, "L3": 1}
    s5 = {r.listing: r.picked_attempt for r in
          rsp.pick_attempt(df, "listing", ["n"], max_attempts=2, stop_on_bad_json=True).collect()}
    assert s5 == {"L1": None, "L2": 2, "L3": 1}


def test_chunk_assembly(spark):
    rows = [("r", 1, '{"message":{"content":"{\\"a\\""},"done":false}'), ("r", 2, "not json"),
            ("r", 3, '{"message":{"content":":1}"},"done":true}'), ("r", 4, '{"message":{"content":"late"},"done":false}')]
    df = spark.createDataFrame(rows, "resp_id string, seq int, line string")
    r = rsp.assemble_chunks(df).first()
    assert r.content == '{"a":1}'


B7 = [
    ({"language": "German", "level": "C2", "required": True}, False),
    ({"language": "Français", "level": "B2"}, True),
    ({"language": "French", "level": "B1"}, False),
    ({"language": "Italian", "level": "B1"}, True),
    ({"language": "Italian", "level": "A2"}, False),
    ({"language": "Dutch", "level": "fluent", "required": False}, False),
    ({"language": "Polish", "level": "C1 level"}, False),
    ({"language": "Polish", "level": "C1"}, True),
    ({"language": "Polish", "level": "C1", "required": None}, False),
    ("Polish C1", False),
]


def test_b7_language_requirements(spark):
    df = spark.createDataFrame([(i, json.dumps({"language_requirements": [r]})) for i, (r, _) in enumerate(B7)],
                               "i int, t string")
    chk = flt.requirement_check(flt.requirements_from_variant(jf.parse_response(F.col("t"))))
    got = {r.i: r.c.disqualified for r in df.select("i", chk.alias("c")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(B7)}
    r = df.where("i = 1").select(chk.alias("c")).first().c
    assert r.reason == "Français at B2 required"


def test_b7_extraction_normalise(spark):
    rows = [('{"published_date": "2026-01-05", "language": " EN ", "source": ""}',),
            ('{"published_date": "20260230"}',)]
    df = spark.createDataFrame(rows, "t string")
    out = df.select(sc.normalize_extraction(jf.parse_response(F.col("t")), F.lit("stem"), "20260131").alias("n")).collect()
    assert (out[0].n.published_date, out[0].n.language, out[0].n.source) == ("20260131", "en", "LinkedIn")
    assert (out[1].n.published_date, out[1].n.language, out[1].n.title) == ("20260230", "other", "stem")


def test_duplicate_keys_keep_last(spark):
    df = spark.createDataFrame([('{"additions":[{"criterion":"a","points":1,"points":9}]}',)], "t string")
    out = sc.score_responses(df, jf.parse_response(F.col("t")), "20260131", out="r").first()
    assert out.r.fit_score == 109
