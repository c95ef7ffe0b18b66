"""Property tests: column implementations against plain-Python statements of
the same rules, on many random cases per Spark job."""
import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions import json_fields as jf
from vetline.operators import filters as flt
from vetline.operators import pages as pg
from vetline.operators import scoring as sc

HEADS = ["# A", "## B", "### C", "## Use AI to assess how you fit", "### people you can reach out to",
         "# People You Can Reach Out To ", "#### deep"]
LINES = st.lists(st.sampled_from(HEADS + ["x", "y", "", "text line", "#nospace"]), max_size=14)


def strip_rule(md: str) -> str:
    """The section rule in plain Python: a listed heading starts a skip at its
    level; a heading of the same or higher level ends it."""
    kept, skip, level = [], False, 0
    for line in md.split("\n"):
        m = __import__("re").match(r"^(#{1,6})\s+(.*)", line)
        if m:
            lv, txt = len(m.group(1)), m.group(2).strip().lower()
            if txt in fixed.STRIP_HEADINGS:
                skip, level = True, lv
                continue
            if skip and lv <= level:
                skip = False
        if not skip:
            kept.append(line)
    return "\n".join(kept).strip()


@settings(max_examples=4, deadline=None)
@given(st.lists(LINES, min_size=20, max_size=40))
def test_strip_sections_matches_rule(spark, docs):
    rows = [(i, "\n".join(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "i int, md string")
    got = {r.i: r.m for r in df.select("i", pg.strip_sections(F.col("md")).alias("m")).collect()}
    assert got == {i: strip_rule(md) for i, md in rows}


def score_rule(resp: dict) -> int:
    def pts(x):
        try:
            return abs(int(x.get("points", 0)))
        except (ValueError, TypeError):
            return 0
    total, once = 0, False
    for a in resp.get("additions") or []:
        a = a if isinstance(a, dict) else {"points": 0, "criterion": str(a)}
        if "industr" in str(a.get("criterion", "")).lower():
            if once:
                continue
            once = True
        total += pts(a)
    for d in resp.get("deductions") or []:
        d = d if isinstance(d, dict) else {"points": 0}
        total -= pts(d)
    return max(0, 100 + total)


ITEM = st.one_of(
    st.fixed_dictionaries({"criterion": st.sampled_from(["Industry", "industry x", "Stack", "Pay"]),
                           "points": st.one_of(st.integers(-60, 60), st.sampled_from(["12", "x", None, 7.9]))}),
    st.sampled_from(["loose text", "industry note"]))
RESP = st.fixed_dictionaries({"additions": st.lists(ITEM, max_size=4), "deductions": st.lists(ITEM, max_size=4)})


@settings(max_examples=4, deadline=None)
@given(st.lists(RESP, min_size=30, max_size=60))
def test_score_matches_rule(spark, resps):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(resps)], "i int, t string")
    out = sc.score_responses(df, jf.parse_response(F.col("t")), "20260131", out="r")
    got = {r.i: r.r.fit_score for r in out.collect()}
    assert got == {i: score_rule(r) for i, r in enumerate(resps)}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.text(alphabet="abcstudentpwcPW -", max_size=20), min_size=20, max_size=50))
def test_keyword_paths_agree(spark, names):
    kws = ["pwc", "student", "ab", "c"]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    inline = {r.id: r.matched_keyword for r in flt.keyword_route(df, "name", kws).collect()}
    py = {i: next((k for k in kws if k in n.lower()), None) for i, n in enumerate(names)}
    assert inline == py
    kwdf = spark.createDataFrame(list(enumerate(kws)), "pos long, kw string")
    joined = {r.id: r.matched_keyword for r in flt.keyword_route(df, "name", kwdf).collect()}
    assert joined == py


def test_input_order_does_not_change_output(spark):
    from vetline.operators import intake
    rnd = random.Random(7)
    rows = [(f"n{i:03d}", f"u{rnd.randint(0, 20)}") for i in range(200)]
    seen = spark.createDataFrame([("u3",), ("u5",)], "url string")
    a = intake.dedup_against_seen(spark.createDataFrame(rows, "name string, url string"), seen)
    rnd.shuffle(rows)
    b = intake.dedup_against_seen(spark.createDataFrame(rows, "name string, url string").repartition(5), seen)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_rule_tables(spark):
    from vetline.operators import rules as rl
    df = spark.createDataFrame([
        ("Fractional CFO", "Berlin", ["SaaS", "Fintech", "E-commerce"], "German", "B2", "on behalf of our client"),
        ("Chief of Staff", "Lisbon", [], "Italian", "A2", ""),
        ("Janitor", "São Paulo", None, "English", "C2", ""),
        ("Head of Finance", "Recife, Brazil", ["deeptech"], "German", "C1", "")],
        "title string, city string, ind array<string>, lang string, lvl string, text string")
    df = rl.location_items(df, "city")
    rows = df.select(
        rl.role_rule("title")["tier"].alias("tier"),
        rl.role_items("title")["disqualifiers"].alias("role_flags"),
        rl.industry_items("ind").alias("ind"),
        rl.language_points(F.col("lang"), F.col("lvl")).alias("lp"),
        rl.profile_items("text").alias("prof"), "loc_deductions", "loc_flags").collect()
    assert [r.tier for r in rows] == ["discounted", "discounted", None, "acceptable"]
    assert [len(r.role_flags) for r in rows] == [0, 0, 1, 0]
    assert [len(r.ind.additions) for r in rows] == [1, 0, 0, 1]
    assert [len(r.ind.deductions) for r in rows] == [1, 0, 0, 0]
    assert [r.lp for r in rows] == [-30, -15, 0, -50]
    assert [len(r.prof) for r in rows] == [1, 0, 0, 0]
    assert [r.loc_deductions[0].points if r.loc_deductions else 0 for r in rows] == [-30, 0, 0, 0]
    assert [len(r.loc_flags) for r in rows] == [0, 0, 0, 1]
    assert "Brazilian" in rows[3].loc_flags[0]
    comp = spark.createDataFrame([(["Finance strategy", "unknown", "HR oversight"],)], "a array<string>")
    assert len(comp.select(rl.competency_items("a").alias("c")).first().c) == 2
