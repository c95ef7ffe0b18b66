"""Dedup, keyword routing, collision names (FIXTURES B2, B3, B12)."""
import pyarrow as pa
from pyspark.sql import functions as F

from vetline.operators import filters as flt
from vetline.operators import intake
from vetline.operators.sequence import global_sequence, sequence_within


def test_dedup_normal_and_force(spark):
    links = spark.createDataFrame([("a", "u1"), ("b", "u2"), ("c", "u2"), ("d", None)], "name string, url string")
    seen = spark.createDataFrame([("u1",)], "url string")
    r = {x.name: (x.outcome, x.is_new) for x in intake.dedup_against_seen(links, seen).collect()}
    assert r == {"a": ("deleted", False), "b": ("moved", True), "c": ("deleted", False), "d": ("skipped", False)}
    f = {x.name: x.outcome for x in intake.dedup_against_seen(links, seen, force=True).collect()}
    assert f == {"a": "moved", "b": "moved", "c": "moved", "d": "skipped"}
    added = [x.url for x in intake.seen_additions(intake.dedup_against_seen(links, seen)).collect()]
    assert added == ["u2"]


def test_rerun_with_new_seen_yields_nothing_new(spark):
    links = spark.createDataFrame([(f"n{i}", f"u{i % 7}") for i in range(50)], "name string, url string")
    seen0 = spark.createDataFrame([], "url string")
    r1 = intake.dedup_against_seen(links, seen0)
    seen1 = intake.seen_additions(r1)
    r2 = intake.dedup_against_seen(links, seen1)
    assert r2.where("is_new").count() == 0
    assert r1.groupBy("outcome").count().count() >= 1
    assert r1.count() == 50  # every input gets exactly one outcome


def test_keywords_first_in_list_order(spark):
    names = ["20250101_CFO - Acme - LinkedIn.url", "20250101_Student Lead - PWC - LinkedIn.url",
             "20250101_Studentenwerk Chef - X - LinkedIn.url", "20250101_Job_22 - Email - LinkedIn.url"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.matched_keyword for r in flt.keyword_route(df, "name", ["pwc", "praktikum", "student"]).collect()]
    assert got == [None, "pwc", "student", None]
    kw = spark.createDataFrame([(1, "pwc"), (2, "praktikum"), (3, "student")], "pos long, kw string")
    got2 = {r.name: r.matched_keyword for r in flt.keyword_route(df, "name", kw).collect()}
    assert got2 == dict(zip(names, got))
    forced = flt.keyword_route(df, "name", ["pwc"], force=True).where("matched_keyword is not null").count()
    assert forced == 0


def test_keyword_table_of_any_size(spark):
    df = spark.createDataFrame([(1, "a Student PWC"), (2, "none"), (3, None), (4, ""), (1, "a Student PWC"), (5, "x1y")],
                               "id long, name string")
    many = [(i + 10, f"long keyword {i}") for i in range(3000)]
    kw = spark.createDataFrame([(1, "pwc"), (2, " Praktikum "), (3, "student"), (4, "1"), (5, "x1"), (6, " ")] + many,
                               "pos long, kw string")
    got = sorted((r.id, r.matched_keyword) for r in flt.keyword_route(df, "name", kw).collect())
    assert got == [(1, "pwc"), (1, "pwc"), (2, None), (3, None), (4, None), (5, "1")]


def test_keyword_grams_of_few_names_leave_python(spark, monkeypatch):
    monkeypatch.setattr(flt, "PIECE", 4)  # names lie over the ends of pieces, keywords over those of names
    texts = ["xxa", "bcé", None, "", "abcabc é", "日本語", "b", "本"]
    of = lambda kw: [int.from_bytes(kw[:3], "big") + (min(3, len(kw)) << 24)]
    for kw in ("abc", "bcé", "é", "本語", "b", "日本語"):
        kw = kw.encode()
        grams = flt.name_grams([of(kw)[0] % flt.GRAM_SLOTS], [min(3, len(kw))])
        got = grams(pa.array([t if t is None else t.encode() for t in texts], pa.binary())).to_pylist()
        assert got == [of(kw) if t and kw[:3] in t.encode() else [] for t in texts], kw
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, name string")
    kw = spark.createDataFrame([(1, "本語"), (2, "É"), (3, "abc")], "pos long, kw string")
    got = {r.id: r.matched_keyword for r in flt.keyword_route(df, "name", kw).collect()}
    assert got == {0: None, 1: "é", 2: None, 3: None, 4: "é", 5: "本語", 6: None, 7: None}


def test_collision_suffixes(spark):
    df = spark.createDataFrame([("X", 1), ("X", 2), ("X", 3), ("Y", 4)], "stem string, k int")
    p = {r.k: r.final_name for r in intake.collision_suffix(df, "stem", ["k"], "paren").collect()}
    assert p == {1: "X", 2: "X (00)", 3: "X (01)", 4: "Y"}
    u = {r.k: r.final_name for r in intake.collision_suffix(df, "stem", ["k"], "under").collect()}
    assert u == {1: "X", 2: "X_01", 3: "X_02", 4: "Y"}
    taken = spark.createDataFrame([("X",)], "stem string")
    t = {r.k: r.final_name for r in intake.collision_suffix(df, "stem", ["k"], "under", taken).collect()}
    assert t == {1: "X_01", 2: "X_02", 3: "X_03", 4: "Y"}


def test_sequence_equals_row_number_with_hot_key(spark):
    from pyspark.sql import Window
    rows = [("hot" if i % 3 else f"k{i % 11}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o long")
    want = sorted(df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("o"))).collect())
    got = sequence_within(df, ["g"], ["o"], col="rn")
    assert sorted(got.select("g", "o", "rn").collect()) == want
    gs = global_sequence(df, ["o"], col="s")
    assert [r.s for r in gs.orderBy("o").collect()] == list(range(1, 3001))


def test_suffixes_skip_numbers_that_are_gone(spark, monkeypatch):
    monkeypatch.setattr(intake, "_SLOT_BLOCK_BITS", 2)  # several blocks on few rows
    rows = [("X", i) for i in range(20)] + [("X (00)", 50), ("X (00)", 51), ("Y", 60), (None, 70), (None, 71), ("X (07", 80)]
    stored = ["X", "X (01)", "X (02)", "X (09)", "X (013)", "X_05", "Y (00)", "Z"]
    df = spark.createDataFrame(rows, "stem string, k int")
    taken = spark.createDataFrame([(n,) for n in stored], "stem string")
    got = {r.k: r.final_name for r in intake.collision_suffix(df, "stem", ["k"], "paren", taken).collect()}
    numbers = [n for n in range(40) if n not in (0, 1, 2, 9)]
    assert [got[k] for k in range(20)] == [f"X ({n:02d})" for n in numbers[:20]]
    assert (got[50], got[51], got[60], got[70], got[71], got[80]) == ("X (00)", "X (00) (00)", "Y", None, None, "X (07")
    names = [n for n in got.values() if n]
    assert len(set(names)) == len(names) and not set(names) & set(stored)


def test_equal_rows_give_one_new_link(spark):
    links = spark.createDataFrame([("n", "u"), ("n", "u"), ("n", "u"), ("m", "v"), ("x", None)], "name string, url string")
    got = intake.dedup_against_seen(links, spark.createDataFrame([], "url string"))
    assert sorted((r.outcome, r.is_new) for r in got.collect()) == [
        ("deleted", False), ("deleted", False), ("moved", True), ("moved", True), ("skipped", False)]
    first = intake.flag_first_per_key(links, "url", "name")
    assert first.where("is_first").count() == 2
