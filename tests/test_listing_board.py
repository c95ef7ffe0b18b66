"""Listing table and board (FIXTURES B11, B13, B14)."""
import datetime as dt

from pyspark.sql import functions as F

from vetline.operators import board as bd
from vetline.operators import listing_db as ldb


def test_b11_next_ref_text_and_numbers(spark):
    db = spark.createDataFrame([("0277",), ("277",), (None,), ("x",)], "ref_nr string")
    assert ldb.next_ref(db).first()[0] == 278
    assert ldb.next_ref(spark.createDataFrame([], "ref_nr string")).first()[0] == 1


def test_assign_refs_gap_free_in_name_order(spark):
    db = spark.createDataFrame([("0010",)], "ref_nr string")
    rows = spark.createDataFrame([(n, n != "c") for n in ["d", "a", "c", "b"]], "name string, ok boolean")
    out = {r.name: r.ref_nr for r in ldb.assign_refs(rows, db, ["name"], needs_ref=F.col("ok")).collect()}
    assert out == {"a": 11, "b": 12, "c": None, "d": 13}


def test_rescore_keeps_tag_when_empty(spark):
    db = ldb.upgrade_schema(spark.createDataFrame([(5, "old", "applied", 40)], "ref_nr long, tag string, status string, fit_score int"))
    res = spark.createDataFrame([(5, 80, "20260101", "LISBON", "", "T", "C", "LinkedIn"),
                                 (9, 1, "20260101", "X", "", "T", "C", "LinkedIn")],
                                "ref_nr long, fit_score int, date_published string, city string, tag string, job_title string, company_name string, source string")
    r = ldb.rescore(db, res, "31/01/2026").first()
    assert (r.tag, r.status, r.fit_score, r.date_found, r.date_published) == ("old", "new", 80, "31/01/2026", "01/01/2026")
    assert ldb.updates_not_found(db, res).first().ref_nr == 9


def test_schema_upgrade(spark):
    narrow = spark.createDataFrame([(1, "new")], "ref_nr long, status string")
    up = ldb.upgrade_schema(narrow)
    assert len(up.columns) == 20 and up.first().reject_reason is None


def _d(day):
    return dt.datetime(2026, 1, day)


def test_b13_board_fold(spark):
    ev = spark.createDataFrame([
        (1, "consider", _d(1), None, 1), (1, "priorities", _d(2), None, 2),
        (2, "rejects", _d(1), "Pay", 3), (2, "new", _d(2), None, 4),
        (3, "consider", _d(1), None, 5), (3, "new", _d(2), None, 6), (3, "consider", _d(3), None, 7),
        (4, "unknown", _d(1), None, 8)], "ref_nr long, to_col string, ts timestamp, reason string, event_id long")
    f = {r.ref_nr: r for r in bd.fold_events(ev, ["ts", "event_id"]).collect()}
    assert (f[1].status, f[1].date_considered, f[1].date_priorities) == ("priorities", "01/01/2026", "02/01/2026")
    assert (f[2].status, f[2].date_rejected, f[2].reject_reason) == ("new", "01/01/2026", "Pay")
    assert f[3].date_considered == "03/01/2026"
    assert 4 not in f
    assert bd.invalid_moves(ev).first().ref_nr == 4
    alone = spark.createDataFrame([(1, None, "note"), (2, None, None), (3, "archive", "note"), (4, "new", None)],
                                  "ref_nr long, to_col string, comment string")
    assert sorted(r.ref_nr for r in bd.invalid_moves(alone).collect()) == [2, 3]


def test_comment_without_a_move(spark):
    ev = spark.createDataFrame([
        (1, "consider", _d(1), None, " a ", 1), (1, None, _d(2), None, " b ", 2), (2, None, _d(1), None, "c", 3)],
        "ref_nr long, to_col string, ts timestamp, reason string, comment string, event_id long")
    folded = bd.fold_events(ev, ["ts", "event_id"])
    f = {r.ref_nr: (r.status, r.comment, r.n_events) for r in folded.collect()}
    assert f == {1: ("in_consideration", "b", 1), 2: (None, "c", 0)}
    db = ldb.upgrade_schema(spark.createDataFrame([(1, "new"), (2, "applied")], "ref_nr long, status string"))
    got = {r.ref_nr: (r.status, r.comment) for r in bd.sync(db, folded).collect()}
    assert got == {1: ("in_consideration", "b"), 2: ("applied", "c")}


def test_expiry_of_stored_dates(spark):
    db = spark.createDataFrame([(1, "31/12/2025", "new"), (2, "01/01/2026", "new"), (3, "30/02/2025", "new"),
                                (4, None, "new")], "ref_nr long, date_published string, status string") \
        .withColumn("date_rejected", F.lit(None).cast("string")).withColumn("reject_reason", F.lit(None).cast("string"))
    out = bd.expire_old(db, "date_published", "20260131", "31/01/2026")
    assert {r.ref_nr: r.status for r in out.collect()} == {1: "rejected", 2: "new", 3: "new", 4: "new"}


def test_b14_expiry(spark):
    db = spark.createDataFrame([
        (1, "20260101", "new"), (2, "20251231", "in_process"), (3, "20251231", "applied"),
        (4, "20251131", "new"), (5, "2025123", "new")],
        "ref_nr long, published string, status string").withColumn("date_rejected", F.lit(None).cast("string")) \
        .withColumn("reject_reason", F.lit(None).cast("string"))
    out = {r.ref_nr: (r.status, r.reject_reason) for r in bd.expire_old(db, "published", "20260131", "31/01/2026").collect()}
    assert out == {1: ("new", None), 2: ("rejected", "Expired"), 3: ("applied", None),
                   4: ("new", None), 5: ("new", None)}


def test_neighbours(spark):
    b = spark.createDataFrame([(1, "new", 5), (2, "new", 9), (3, "new", 7), (4, "priorities", 1)],
                              "ref_nr long, status string, fit_score int")
    n = {r.ref_nr: (r.prev_ref, r.next_ref) for r in bd.neighbours(b, bd.board_sort("score_desc")).collect()}
    assert n == {2: (None, 3), 3: (2, 1), 1: (3, None), 4: (None, None)}


def test_board_listing_and_content(spark):
    db = ldb.upgrade_schema(spark.createDataFrame(
        [(1, "new", 50, " note "), (2, "new", 80, None), (3, "applied", 90, None), (4, "priorities", 10, "")],
        "ref_nr long, status string, fit_score int, comment string"))
    lst = {r.ref_nr: (r.position, r.has_comment) for r in bd.board_listing(db).collect()}
    assert set(lst) == {1, 2, 4}
    assert lst[2][0] < lst[1][0] and lst[1][1] and not lst[2][1] and not lst[4][1]
    assert [r.ref_nr for r in bd.board_column(db, "consider").collect()] == []
    c = {r.ref_nr: (r.comment, r.url, r.jd) for r in bd.card_content(db).collect()}
    assert c[1] == (" note ", "", "") and c[2] == ("", "", "")
    saved = {r.ref_nr: r.comment for r in bd.save_comments(db, spark.createDataFrame([(2, "  hi \n")], "ref_nr long, text string")).collect()}
    assert saved[2] == "hi" and saved[1] == " note "


def test_pair_documents(spark):
    from vetline.sources import files
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "stem string, body_md string")
    sc = spark.createDataFrame([("a", "u1")], "name string, url string")
    assert [r.stem for r in files.pair_documents(docs, sc, "extract").collect()] == ["a"]
    assert sorted((r.stem, r.url) for r in files.pair_documents(docs, sc, "score").collect()) == [("a", "u1"), ("b", None)]


def test_latest_folder_state(spark):
    snap = spark.createDataFrame([(1, "new", "0001_a"), (1, "consider", "0001_a"), (2, "applied", "0002_b"),
                                  (2, "rejects", "0002_c"), (3, "new", "0003_a"), (3, "new", "0003_b"),
                                  (4, "bogus", "x")], "ref_nr long, board_col string, stem string")
    got = {r.ref_nr: (r.board_col, r.stem, r.status) for r in bd.latest_folder_state(snap).collect()}
    assert got == {1: ("consider", "0001_a", "in_consideration"), 2: ("applied", "0002_b", "applied"),
                   3: ("new", "0003_b", "new")}
