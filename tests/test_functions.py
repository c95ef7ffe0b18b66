"""Column functions (FIXTURES B4, B8; P5-P21, C23, D1)."""
import unicodedata

import pytest
from pyspark.sql import functions as F

from vetline.functions import text as tx
from vetline.operators import intake


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_city_codes(spark):
    rows = [("São Paulo", "SAOP", "SAOPAUL"), ("Den Haag", "DENH", "DENHAAG"),
            ("munich", "MUNI", "MUNICH"), ("Amsterdam", "AMST", "AMSTERD"),
            ("Fully Remote", "RMTE", "REMOTE"), ("", "UNKN", "REMOTE")]
    df = spark.createDataFrame([(r[0],) for r in rows], "v string")
    got = df.select("v", tx.city_code4("v").alias("c4"), tx.validated_city_code("v").alias("c7")).collect()
    assert [(r.v, r.c4, r.c7) for r in got] == rows


def test_accent_fold_matches_python(spark):
    vals = ["São Paulo", "Ønskeskyen łß Ünal", "Ça ñ ü", "x҃y֑z", None, "Bragança Paulista", "한국 서울 가"]
    letters = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c <= 0xDFFF]
    vals += ["a".join(letters[i:i + 500]) for i in range(0, len(letters), 500)]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(tx.strip_accents("v")).collect()]
    want = [None if v is None else "".join(c for c in unicodedata.normalize("NFD", v)
                                          if unicodedata.category(c) != "Mn") for v in vals]
    assert got == want
    plan = df.select(tx.strip_accents("v").alias("v")).where("v = 'x'")._jdf.queryExecution().optimizedPlan().toString()
    assert "reflect" not in plan and "Python" not in plan


def test_sanitize_safe_name_and_dates(spark):
    assert one(spark, tx.sanitize(F.col("v")), ' _a b:c?"d_ ') == "a_bcd"
    assert one(spark, tx.safe_name(F.col("v")), ' CFO <x>/y ') == "CFO xy"
    assert one(spark, tx.format_dmy(F.col("v")), "20250131") == "31/01/2025"
    assert one(spark, tx.format_dmy(F.col("v")), "2025013") == "2025013"


def test_parse_stem(spark):
    r = one(spark, tx.parse_stem(F.col("v")), "20250101_CFO - Group - Acme - LinkedIn")
    assert (r.title, r.company) == ("CFO - Group", "Acme")
    r = one(spark, tx.parse_stem(F.col("v")), "20250101_CFO - LinkedIn")
    assert (r.title, r.company) == ("", "")


def test_stems(spark):
    df = spark.createDataFrame([(7, 85, "20250101", "LISBON", "CFO / x", "Acme Co", "LinkedIn", "")],
                               "r int, s int, d string, c string, t string, co string, so string, cl string")
    got = df.select(tx.scored_stem("r", "s", "d", "c", "t", "co", "so", "cl")).first()[0]
    assert got == "0007_085_20250101_LISBON_CFO__x_Acme_Co_LinkedIn"
    assert one(spark, tx.restem_score(F.col("v"), F.lit(9)), got) == "0007_009_20250101_LISBON_CFO__x_Acme_Co_LinkedIn"
    e = one(spark, tx.enriched_stem(F.col("v"), F.lit("Ünal GmbH"), "20260131"), "Café Lead")
    assert e == "20260131_Cafe Lead - Unal GmbH - LinkedIn"
    assert one(spark, tx.enriched_stem(F.col("v"), F.lit(""), "20260131"), "Lead") == "20260131_Lead - LinkedIn"
    assert one(spark, tx.enriched_stem(F.col("v"), F.lit("x"), "20260131"), "") == ""


def test_shortcut_and_markdown_urls(spark):
    txt = "[InternetShortcut]\nURL= https://x/1 \nURL=https://x/2\n"
    assert one(spark, tx.shortcut_url(F.col("v")), txt) == "https://x/1"
    assert one(spark, tx.shortcut_url(F.col("v")), "nothing") is None
    assert one(spark, tx.shortcut_url(F.col("v"), loose=True), "nothing") == ""
    assert one(spark, tx.url_from_markdown(F.col("v")), "**URL:** https://a/b))\n") == "https://a/b"


def test_job_ids_first_seen_order(spark):
    html = ("<a href='https://linkedin.com/comm/jobs/view/22?trk=a'></a>"
            "<a href='https://linkedin.com/jobs/view/11/'></a><a href='linkedin.com/jobs/view/22'></a>")
    df = spark.createDataFrame([("m1", html), ("m2", "linkedin.com/jobs/search/?x=1")], "path string, html string")
    links = intake.links_from_messages(df, "20260131").collect()
    assert [(r.pos, r.url) for r in links] == [
        (1, "https://www.linkedin.com/jobs/view/22/"), (2, "https://www.linkedin.com/jobs/view/11/")]
    assert links[0].name == "20260131_Job_22 - Email - LinkedIn"


def test_relative_dates(spark):
    f = lambda t: one(spark, tx.relative_published_date(F.col("v"), "20260131"), t)
    assert f("Posted 3 days ago") == "20260128"
    assert f("2 weeks ago") == "20260117"
    assert f("1 month ago") == "20251231"
    assert f("5 hours ago") == "20260131"
    assert f("no date") == "20260131"


def test_strict_json_takes_one_value_only(spark):
    from vetline.functions import json_fields as jf
    rows = [('{"a":1}', "ok"), ('{"a":1},{"b":2}', "bad_json"), ('x {"a":1} y', "ok"), ("", "empty"), ("none", "no_json")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.where(jf.parse_status("t") != F.col("want")).count() == 0


def test_long_refs_and_odd_dates(spark):
    from vetline.operators.board import board_sort
    df = spark.createDataFrame([("12345_050_20260101_X",), ("0001_100_20260101_Y",)], "s string")
    assert [r[0] for r in df.select(tx.restem_score("s", F.lit(77))).collect()] == ["12345_077_20260101_X", "0001_077_20260101_Y"]
    none = F.lit(None).cast("bigint")
    assert df.select(tx.scored_stem(none, F.lit(5), *[F.lit("a")] * 6)).first()[0] is None
    big = df.select(tx.scored_stem(F.lit(5_000_000_000), F.lit(5), *[F.lit("a")] * 5, F.lit(""))).first()[0]
    assert big.startswith("5000000000_005_")
    d = spark.createDataFrame([("30/02/2026",), ("01/02/2026",)], "date_published string")
    assert d.orderBy(*board_sort("date_desc")).first()[0] == "01/02/2026"
    ago = spark.createDataFrame([("99999999999 days ago",), ("3 days ago",)], "t string")
    assert [r[0] for r in ago.select(tx.relative_published_date("t", "20260110")).collect()] == ["20260110", "20260107"]


def test_last_comment_wins_by_order(spark):
    from vetline.operators import board, listing_db as ldb
    db = ldb.upgrade_schema(spark.createDataFrame([(1,)], "ref_nr bigint"))
    edits = spark.createDataFrame([(1, "zzz first", 1), (1, "aaa last", 2)], "ref_nr bigint, text string, ts int")
    assert board.save_comments(db, edits).first()["comment"] == "aaa last"


def test_one_page_per_url(spark):
    from vetline.plans.profiles import latest_pages
    pages = spark.createDataFrame([("u", "old", 1), ("u", "new", 2), ("v", "x", 1), ("v", "x", 1)], "url string, html string, crawled_at int")
    assert sorted((r.url, r.html) for r in latest_pages(pages).collect()) == [("u", "new"), ("v", "x")]


def test_unreadable_seen_list_is_an_error(spark, tmp_dir):
    from vetline.sources import seen
    assert not seen.exists(spark, f"{tmp_dir}/none")
    seen.create(spark, f"{tmp_dir}/seen", "url", 2, spark.createDataFrame([("u",)], "url string"))
    with open(f"{tmp_dir}/seen/keys/batch_id=-1/part-0_00000.c000.snappy.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        seen.read(spark, f"{tmp_dir}/seen").collect()


def test_enriched_name(spark):
    rows = [("20260131_Job_7 - Email - LinkedIn", "CFO", "Acme"), ("20260131_Job_7 - Email - LinkedIn", "?", "Acme"),
            ("20260131_Job_7 - Email - LinkedIn", None, None), ("20260131_Named - X - LinkedIn", "CFO", "Acme")]
    df = spark.createDataFrame(rows, "name string, title string, company string")
    got = [r.n for r in df.select(tx.enriched_name("name", "title", "company", "20260131").alias("n")).collect()]
    assert got == ["20260131_CFO - Acme - LinkedIn", rows[1][0], rows[2][0], rows[3][0]]


def test_a_competency_counts_once(spark):
    from vetline.operators import rules
    absent = F.array(F.lit("HR oversight"), F.lit("HR oversight"), F.lit("Juggling"))
    items = spark.range(1).select(rules.competency_items(absent).alias("i")).first().i
    assert [(i.detail, i.points) for i in items] == [("HR oversight", -1)]
