"""Streaming forms equal batch results; file sources (FIXTURES B1, T1-T3)."""
import os
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

from pyspark.sql import functions as F

from vetline.operators import board as bd
from vetline.operators import intake
from vetline.sources import files, seen
from vetline.streaming import alerts
from vetline.streaming import board as sboard
from vetline.streaming import intake as sintake

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_board_stream_equals_batch(spark, tmp_dir):
    ev = spark.read.parquet(EVENTS).select(
        F.col("user_id").alias("ref_nr"), "event_id", "ts",
        F.when(F.col("event_type") == "error", "rejects").otherwise("consider").alias("to_col"),
        F.lit("").alias("reason"))
    ev.write.parquet(os.path.join(tmp_dir, "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(os.path.join(tmp_dir, "ev"))
    q = sboard.start_board_stream(stream, os.path.join(tmp_dir, "ck"), os.path.join(tmp_dir, "state"))
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in sboard.read_board_state(spark, os.path.join(tmp_dir, "state"))
                 .select("ref_nr", "status", "date_considered", "n_events").collect())
    want = sorted(tuple(r) for r in bd.fold_events(ev, ["ts", "event_id"])
                  .select("ref_nr", "status", "date_considered", "n_events").collect())
    assert got == want


def test_intake_stream_equals_batch(spark, tmp_dir):
    links = spark.createDataFrame([(f"n{i:03d}", f"u{i % 13}") for i in range(60)], "name string, url string")
    src = os.path.join(tmp_dir, "links")
    # one file per arrival, arrivals in name order: then stream == batch
    links.where("name < 'n030'").coalesce(1).write.parquet(os.path.join(src, "p1"))
    seen0 = spark.createDataFrame([("u1",)], "url string")
    sintake.init_seen(seen0, os.path.join(tmp_dir, "seen"), buckets=4)
    stream = spark.readStream.schema(links.schema).option("maxFilesPerTrigger", 1) \
        .parquet(os.path.join(src, "*"))
    q = sintake.start_intake_stream(stream, os.path.join(tmp_dir, "seen"), os.path.join(tmp_dir, "out"),
                                    os.path.join(tmp_dir, "ck"))
    q.awaitTermination()
    links.where("name >= 'n030'").coalesce(1).write.parquet(os.path.join(src, "p2"))
    q = sintake.start_intake_stream(stream, os.path.join(tmp_dir, "seen"), os.path.join(tmp_dir, "out"),
                                    os.path.join(tmp_dir, "ck"))
    q.awaitTermination()
    got = {r.name: r.outcome for r in spark.read.parquet(os.path.join(tmp_dir, "out")).collect()}
    want = {r.name: r.outcome for r in intake.dedup_against_seen(links, seen0).collect()}
    assert got == want
    assert sorted(r.url for r in seen.read(spark, os.path.join(tmp_dir, "seen")).collect()) == \
        sorted({f"u{i}" for i in range(13)})


def test_closed_alert_stream_static(spark, tmp_dir):
    pages = spark.createDataFrame([("a", "x No longer accepting applications"), ("b", "open")], "url string, html string")
    pages.write.parquet(os.path.join(tmp_dir, "pages"))
    cards = spark.createDataFrame([(1, "a", "new"), (2, "b", "new"), (3, "a", "applied")],
                                  "ref_nr long, url string, status string")
    s = spark.readStream.schema(pages.schema).parquet(os.path.join(tmp_dir, "pages"))
    q = alerts.closed_alerts(s, cards).writeStream.format("memory").queryName("alerts_t") \
        .option("checkpointLocation", os.path.join(tmp_dir, "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.ref_nr for r in spark.sql("SELECT ref_nr FROM alerts_t").collect()] == [1]


def test_email_source(spark, tmp_dir):
    m = MIMEMultipart("alternative")
    m.attach(MIMEText("plain linkedin.com/jobs/view/99", "plain"))
    m.attach(MIMEText("<a href='https://linkedin.com/jobs/view/7'>é</a>", "html", "iso-8859-1"))
    with open(os.path.join(tmp_dir, "a.eml"), "wb") as f:
        f.write(m.as_bytes())
    with open(os.path.join(tmp_dir, "b.eml"), "wb") as f:
        f.write(MIMEText("only text linkedin.com/jobs/view/5", "plain").as_bytes())
    html = files.message_html(files.read_messages(spark, tmp_dir))
    got = {os.path.basename(r.path): r.html for r in html.collect()}
    assert "é" in got["a.eml"] and got["b.eml"] == ""
    links = intake.links_from_messages(html, "20260131")
    assert [r.url for r in links.collect()] == ["https://www.linkedin.com/jobs/view/7/"]


def test_shortcut_and_keyword_files(spark, tmp_dir):
    d = os.path.join(tmp_dir, "links")
    os.makedirs(d)
    with open(os.path.join(d, "20250101_CFO - Acme - LinkedIn.url"), "w") as f:
        f.write("[InternetShortcut]\nURL=https://x/1\n")
    with open(os.path.join(d, "broken.url"), "w") as f:
        f.write("nothing here\n")
    got = {r.name: r.url for r in files.read_shortcuts(spark, d).collect()}
    assert got == {"20250101_CFO - Acme - LinkedIn": "https://x/1", "broken": None}
    kw = os.path.join(tmp_dir, "kw.txt")
    with open(kw, "w") as f:
        f.write("PWC\n\n# comment\n  Student \n")
    assert [r.kw for r in files.read_keywords(spark, kw).orderBy("pos").collect()] == ["pwc", "student"]


def test_page_parse_on_a_stream(spark, tmp_dir):
    from vetline.operators import pages as pg
    pages = spark.createDataFrame([(1, "u", "<h1>Title</h1><article>" + "<p>x</p>" * 50 + "</article>")],
                                  "page_id long, url string, html string")
    pages.write.parquet(os.path.join(tmp_dir, "pages"))
    s = spark.readStream.schema(pages.schema).parquet(os.path.join(tmp_dir, "pages"))
    q = pg.parse_pages(s).select("page_id", "title_sel").writeStream.format("memory") \
        .queryName("parsed_t").option("checkpointLocation", os.path.join(tmp_dir, "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM parsed_t").collect()] == [(1, "Title")]


def test_sinks_and_small_sources(spark, tmp_dir):
    from vetline.operators import pages as pg
    routed = spark.createDataFrame([("a", "moved"), ("b", "deleted"), ("c", "moved")], "name string, outcome string")
    files.write_routed(routed, os.path.join(tmp_dir, "routed"))
    assert sorted(os.listdir(os.path.join(tmp_dir, "routed")))[-2:] == ["outcome=deleted", "outcome=moved"]
    moved = spark.read.parquet(os.path.join(tmp_dir, "routed")).where("outcome = 'moved'")
    assert sorted(r.name for r in moved.collect()) == ["a", "c"]
    seen_txt = os.path.join(tmp_dir, "seen.txt")
    with open(seen_txt, "w") as f:
        f.write(" u1 \n\nu2\nu1\n")
    assert sorted(r.url for r in files.read_seen(spark, seen_txt, fmt="text").collect()) == ["u1", "u2"]
    assert files.read_keywords(spark, os.path.join(tmp_dir, "missing.txt")).count() == 0
    df = spark.createDataFrame([(1, "u", "<div>No matching jobs found</div>")], "page_id long, url string, html string")
    r = pg.parse_pages(df).first()
    assert r.no_results and not r.results_end
