"""The job entry point over folders and tables."""
import json
import os
from email.mime.text import MIMEText

from vetline import run, run_board
from vetline.operators import listing_db as ldb
from vetline.sources import seen


def test_run_job(spark, tmp_dir):
    emails, links = os.path.join(tmp_dir, "emails"), os.path.join(tmp_dir, "links")
    os.makedirs(emails)
    os.makedirs(links)
    with open(os.path.join(emails, "m.eml"), "wb") as f:
        f.write(MIMEText("<a href='https://www.linkedin.com/jobs/view/42/'>x</a>", "html").as_bytes())
    with open(os.path.join(links, "20260131_CFO - Acme - LinkedIn.url"), "w") as f:
        f.write("[InternetShortcut]\nURL=https://www.linkedin.com/jobs/view/7/\n")
    body = "<p>" + "Finance role. " * 30 + "</p>"
    spark.createDataFrame([("https://www.linkedin.com/jobs/view/7/", f"<h1>CFO</h1><article>{body}</article>"),
                           ("https://www.linkedin.com/jobs/view/42/", f"<h1>VP Finance</h1><article>{body}</article>")],
                          "url string, html string").write.parquet(os.path.join(tmp_dir, "pages"))
    ext = [(u, 1, json.dumps({"language": "en", "city": "Lisbon"})) for u in
           ["https://www.linkedin.com/jobs/view/7/", "https://www.linkedin.com/jobs/view/42/"]]
    spark.createDataFrame(ext, "url string, attempt int, text string").write.parquet(os.path.join(tmp_dir, "ext"))
    sco = [(u, 1, json.dumps({"job_title": t, "company_name": "Acme", "city_code": "LISBON",
                              "additions": [{"criterion": "Industry", "points": 10}]}))
           for u, t in [("https://www.linkedin.com/jobs/view/7/", "CFO"), ("https://www.linkedin.com/jobs/view/42/", "VP")]]
    spark.createDataFrame(sco, "url string, attempt int, text string").write.parquet(os.path.join(tmp_dir, "sco"))
    out = os.path.join(tmp_dir, "out")
    run.main(["--profile", "full", "--today", "20260131", "--emails", emails, "--links", links,
              "--pages", os.path.join(tmp_dir, "pages"), "--extract", os.path.join(tmp_dir, "ext"),
              "--score", os.path.join(tmp_dir, "sco"), "--seen", os.path.join(tmp_dir, "seen"),
              "--out", out])
    rows = spark.read.parquet(os.path.join(out, "new_rows")).orderBy("ref_nr").collect()
    assert [(r.ref_nr, r.fit_score, r.status) for r in rows] == [(1, 110, "new"), (2, 110, "new")]
    assert spark.read.parquet(os.path.join(out, "seen_additions")).count() == 2
    assert spark.read.parquet(os.path.join(out, "seen")).count() == 2
    stored = spark.read.parquet(os.path.join(out, "listing_db"))
    assert sorted(r.ref_nr for r in stored.collect()) == [1, 2]
    docs = spark.read.parquet(os.path.join(out, "documents")).collect()
    assert len(docs) == 2 and all("Finance role." in r.body_md for r in docs)
    assert spark.read.parquet(os.path.join(out, "scoring")).where("outcome = 'accepted'").count() == 2
    counts = {(r.stage, r.outcome): r.n for r in spark.read.parquet(os.path.join(out, "counts")).collect()}
    assert counts["dedup", "moved"] == counts["scoring", "accepted"] == 2 and counts["dedup", "deleted"] == 0
    # with a bucketed seen list: one URL is known, the other is added where the list lies, and a repeated run does the same
    stored = os.path.join(tmp_dir, "seen-buckets")
    seen.create(spark, stored, "url", 4, spark.createDataFrame([("https://www.linkedin.com/jobs/view/7/",)], "url string"))
    for attempt in ("a", "b"):
        again = os.path.join(tmp_dir, f"out-{attempt}")
        run.main(["--profile", "full", "--today", "20260131", "--emails", emails, "--links", links,
                  "--pages", os.path.join(tmp_dir, "pages"), "--extract", os.path.join(tmp_dir, "ext"),
                  "--score", os.path.join(tmp_dir, "sco"), "--seen", stored, "--run", "5", "--out", again])
        assert [r.url for r in spark.read.parquet(os.path.join(again, "seen_additions")).collect()] == ["https://www.linkedin.com/jobs/view/42/"]
        assert not os.path.exists(os.path.join(again, "seen")) and seen.read(spark, stored).count() == 2


def test_board_job(spark, tmp_dir):
    at = {k: os.path.join(tmp_dir, k) for k in ("db", "events", "edits", "confirmed", "board")}
    ldb.upgrade_schema(spark.createDataFrame(
        [(1, "new", 50, "30/01/2026"), (2, "new", 60, "30/01/2026"), (3, "new", 70, "01/01/2025"), (4, "new", 80, "30/01/2026")],
        "ref_nr long, status string, fit_score int, date_published string")).write.parquet(at["db"])
    spark.sql("""SELECT * FROM VALUES (1L, 1L, timestamp'2026-01-30 10:00:00', 'consider', '', 'call'),
                                      (9L, 2L, timestamp'2026-01-30 10:00:00', 'applied', '', NULL),
                                      (2L, 3L, timestamp'2026-01-30 11:00:00', 'archive', '', NULL)
                 t(ref_nr, event_id, ts, to_col, reason, comment)""").write.parquet(at["events"])
    good = json.dumps({"additions": [{"criterion": "Industry", "points": 10}]})
    spark.createDataFrame([(2, "0002_060_x", good, 1), (2, "0002_060_x", "{}, {}", 2)],
                          "ref_nr long, stem string, content string, ts int").write.parquet(at["edits"])
    spark.createDataFrame([(4,)], "ref_nr long").write.parquet(at["confirmed"])
    run_board.main(["--today", "20260131", "--db", at["db"], "--events", at["events"], "--edits", at["edits"],
                    "--confirmed", at["confirmed"], "--out", at["board"]])
    rows = {r.ref_nr: r for r in spark.read.parquet(os.path.join(at["board"], "listing_db")).collect()}
    assert (rows[1].status, rows[1].comment) == ("in_consideration", "call")
    assert (rows[2].status, rows[2].fit_score) == ("new", 110)
    assert [(rows[k].status, rows[k].reject_reason) for k in (3, 4)] == [("rejected", "Expired")] * 2
    assert [r.ref_nr for r in spark.read.parquet(os.path.join(at["board"], "refused")).collect()] == [2]
    counts = spark.read.parquet(os.path.join(at["board"], "counts")).first()
    assert (counts.updated, counts.not_found) == (1, 1)
    assert sorted(r.error or "" for r in spark.read.parquet(os.path.join(at["board"], "edits")).collect()) == ["", "Invalid JSON"]
