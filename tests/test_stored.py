"""What is kept between runs: the bucketed seen list, keyed streaming state,
board bases and changes, the listing table in buckets."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from vetline.operators import board as bd
from vetline.operators import intake
from vetline.operators import listing_db as ldb
from vetline.plans import q_intake
from vetline.sources import bucket_table, seen
from vetline.streaming import alerts as salerts
from vetline.streaming import board as sboard
from vetline.streaming import intake as sintake

SF = "/root/testdata/sf0.001"


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans_under_exchange(plan: str, name: str) -> list[bool]:
    """For each scan of a table: whether an exchange lies between it and the first join above."""
    lines, out = plan.split("\n"), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-|*()0123456789"))
    for i, line in enumerate(lines):
        if "FileScan" not in line or name not in line:
            continue
        at, moved = depth(line), False
        for above in reversed(lines[:i]):
            if depth(above) < at:
                at = depth(above)
                if "Join" in above:
                    break
                moved |= "Exchange" in above
        out.append(moved)
    return out


@pytest.fixture()
def links(spark):
    rows = [(f"n{i:03d}", f"u{i % 40}", "x" * 50) for i in range(300)] + [("n000", "u0", "x" * 50)] * 30 + [("z", None, "")] * 2
    return spark.createDataFrame(rows, "name string, url string, body string")


@pytest.mark.parametrize("partitions", [3, 64])
def test_seen_list_is_not_shuffled(spark, links, tmp_dir, partitions):
    seen.create(spark, f"{tmp_dir}/seen", "url", 8, spark.createDataFrame([(f"u{i}",) for i in range(0, 5000, 2)], "url string"))
    before = [spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        stored = seen.SeenList(spark, f"{tmp_dir}/seen")
        routed = intake.dedup_against_seen(links, stored)
        moved = scans_under_exchange(executed(routed), "vetline_seen_")
        assert moved and not any(moved)
        want = intake.dedup_against_seen(links, stored.keys())
        assert sorted(map(tuple, routed.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[1])


def test_no_text_is_shuffled(spark):
    from vetline.plans import catalog
    for name in ("dedup_first", "dedup_seen", "dedup_seen_force"):
        plan = executed(catalog.queries()[name](spark, SF))
        for line in plan.split("\n"):
            if "any_value" in line or "first(" in line:
                assert "text#" not in line and "first(text" not in line, line


def test_equal_rows_give_one_new(spark, links):
    routed = intake.dedup_against_seen(links, spark.createDataFrame([("u1",)], "url string"))
    assert routed.count() == links.count() == 332
    got = {(r.name, r.url, r.outcome, r.is_new): r.n for r in routed.groupBy("name", "url", "outcome", "is_new").agg(F.count("*").alias("n")).collect()}
    assert got["n000", "u0", "moved", True] == 1 and got["n000", "u0", "deleted", False] == 30
    assert got["z", None, "skipped", False] == 2 and got["n001", "u1", "deleted", False] == 1
    firsts = intake.flag_first_per_key(links, "url", "name").where("is_first").collect()
    assert sorted(r.url for r in firsts) == sorted({f"u{i}" for i in range(40)})


def test_many_equal_rows_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(intake, "COPIES", 7)
    df = spark.range(100).select(F.lit("u").alias("url"), F.lit("n").alias("name"))
    out = intake.flag_first_per_key(df, "url", "name")
    assert out.count() == 100 and out.where("is_first").count() == 1


def test_seen_batches_replace_themselves_and_compact(spark, tmp_dir):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "url string")
    path = f"{tmp_dir}/seen"
    seen.create(spark, path, "url", 4, keys("a", "b", None, "a"))
    seen.add(spark, path, keys("c"), 0)
    seen.add(spark, path, keys("d", "c"), 0)
    seen.add(spark, path, keys("e"), 1)
    rows = lambda df: sorted(r.url for r in df.collect())
    assert rows(seen.read(spark, path)) == ["a", "b", "c", "d", "e"]
    assert rows(seen.read(spark, path, before=1)) == ["a", "b", "c", "d"] and rows(seen.read(spark, path, before=0)) == ["a", "b"]
    seen.compact(spark, path, f"{tmp_dir}/next")
    assert rows(seen.read(spark, f"{tmp_dir}/next")) == ["a", "b", "c", "d", "e"]
    assert rows(seen.SeenList(spark, f"{tmp_dir}/next").known(keys("a", "x", "e").withColumnRenamed("url", "k"), "k").withColumnRenamed("k", "url")) == ["a", "e"]


def test_stateful_intake_restarts_and_replays(spark, tmp_dir):
    schema = "name string, url string, is_seen boolean"
    arrive = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")

    def run():
        s = spark.readStream.schema(schema).parquet(f"{tmp_dir}/in")
        sintake.start_stateful_intake(s, f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
        return sorted(map(tuple, sintake.read_routed(spark, f"{tmp_dir}/out").select("name", "url", "outcome", "is_new").collect()), key=str)
    arrive([(None, "a", True), ("n2", "a", False), ("n3", "b", False), ("n1", "b", False), ("n4", None, False)])
    first = run()
    assert first == [("n1", "b", "moved", True), ("n2", "a", "deleted", False), ("n3", "b", "deleted", False), ("n4", None, "skipped", False)]
    arrive([("n0", "b", False), ("n5", "c", False), ("n5", "c", False)])
    second = run()
    assert second == sorted(first + [("n0", "b", "deleted", False), ("n5", "c", "moved", True), ("n5", "c", "deleted", False)], key=str)
    for f in (f"{tmp_dir}/ck/commits/1", f"{tmp_dir}/ck/commits/.1.crc"):  # the second batch was written but not committed: it runs again
        os.unlink(f)
    assert run() == second
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == sintake.ROCKSDB


def test_stateful_intake_is_not_a_python_call_a_key(spark, tmp_dir):
    rows = spark.range(9).select(F.concat(F.lit("u"), F.col("id") % 4).alias("url"), F.lit("n").alias("name"), (F.col("id") == 3).alias("is_seen"))
    rows.write.parquet(f"{tmp_dir}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_dir}/in")
    sintake.start_stateful_intake(stream, f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
    got = sorted(map(tuple, sintake.read_routed(spark, f"{tmp_dir}/out").groupBy("url", "outcome").count().collect()))
    # u3 is in the list of the same batch; equal rows of a key give one that is new
    assert got == [("u0", "deleted", 2), ("u0", "moved", 1), ("u1", "deleted", 1), ("u1", "moved", 1), ("u2", "deleted", 1), ("u2", "moved", 1), ("u3", "deleted", 1)]
    plan = sintake.with_fresh_keys(stream)._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "Python" not in plan and "Pandas" not in plan


def test_board_changes_are_compacted(spark, tmp_dir):
    rows = [(i % 17, i, f"2026-01-{1 + i % 28:02d} 10:00:00", ["new", "consider", "rejects", None][i % 4], "Pay" if i % 3 else "", f"c{i}" if i % 5 == 0 else None)
            for i in range(200)]
    ev = spark.createDataFrame(rows, "ref_nr long, event_id long, ts string, to_col string, reason string, comment string") \
              .withColumn("ts", F.col("ts").cast("timestamp"))
    ev.repartition(7).write.parquet(f"{tmp_dir}/in")
    s = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/in")
    sboard.start_board_stream(s, f"{tmp_dir}/ck", f"{tmp_dir}/state", compact_every=2, available_now=True).awaitTermination()
    state = f"{tmp_dir}/state"
    assert sboard.bases(spark, state) == [3, 5] and sboard.changes(spark, state, -1) == [4, 5, 6]
    cols = ["ref_nr", "status", "n_events", "date_considered", "date_rejected", "reject_reason", "comment"]
    want = sorted(map(tuple, bd.fold_events(ev, ["ts", "event_id"]).select(*cols).collect()))
    assert sorted(map(tuple, sboard.read_board_state(spark, state).select(*cols).collect())) == want
    # a compaction that died counts for nothing
    os.makedirs(f"{state}/base-6")
    assert sorted(map(tuple, sboard.read_board_state(spark, state).select(*cols).collect())) == want
    with pytest.raises(FileNotFoundError):
        sboard.read_board_state(spark, f"{tmp_dir}/none")


def test_alerts_join_two_streams(spark, tmp_dir):
    t = "2026-01-%02d 00:00:00"
    pages = spark.createDataFrame([("a", "x NO LONGER accepting applications", t % 10), ("b", "open", t % 10),
                                   ("c", "no longer accepting applications", t % 2), ("d", "No longer accepting applications", t % 10)],
                                  "url string, html string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    moves = spark.createDataFrame([(1, "a", "new", t % 5), (2, "b", "new", t % 5), (3, "c", "priorities", t % 5), (4, "d", "applied", t % 5)],
                                  "ref_nr long, url string, status string, moved_at string").withColumn("moved_at", F.col("moved_at").cast("timestamp"))
    streams = []
    for name, df in (("pages", pages), ("moves", moves)):
        df.repartition(2).write.parquet(f"{tmp_dir}/{name}")
        streams.append(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/{name}"))
    salerts.start_alerts(salerts.closed_alert_stream(*streams, late="20 days"), f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
    # c was fetched before its card was on the board, d left the visible columns
    assert [r.ref_nr for r in spark.read.parquet(f"{tmp_dir}/out").collect()] == [1]


@pytest.fixture()
def db(spark):
    return ldb.upgrade_schema(spark.range(1, 1001).select(F.col("id").alias("ref_nr"), F.lit("new").alias("status"),
                                                         F.concat(F.lit("u"), "id").alias("url")))


def files_of(root):
    return {f for f in glob.glob(f"{root}/v=*/bucket=*/*.parquet")}


def test_ten_updates_write_ten_buckets_at_most(spark, db, tmp_dir):
    root = f"{tmp_dir}/db"
    bucket_table.create(db, root, buckets=128)
    before = files_of(root)
    upd = spark.createDataFrame([(i * 37 % 1000 + 1, f"s{i}", f"c{i}") for i in range(10)], "ref_nr long, status string, comment string")
    touched = bucket_table.update(spark, root, upd, ["status", "comment", "unknown"])
    assert len(touched) <= 10 and len({os.path.dirname(f) for f in files_of(root) - before}) <= 10
    assert before <= files_of(root)  # the former version is whole
    want = ldb.update_by_ref(db, upd, ["status", "comment"]).drop("updated")
    key = lambda r: r[0]
    assert sorted(map(tuple, bucket_table.read(spark, root).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)
    assert bucket_table.read(spark, root, n=0).where("status = 'new'").count() == 1000


def test_a_change_that_dies_is_not_seen(spark, db, tmp_dir):
    root = f"{tmp_dir}/db"
    bucket_table.create(db, root, buckets=8)
    bucket_table._write(db.withColumn("status", F.lit("half")), root, 1, 8)  # no pointer: never committed
    assert bucket_table.version(spark, root) == 0 and bucket_table.read(spark, root).where("status = 'half'").count() == 0
    assert bucket_table.append(spark, root, db.where("ref_nr = 9").withColumn("ref_nr", F.lit(2001).cast("long"))) == [1]
    assert bucket_table.version(spark, root) == 1 and bucket_table.read(spark, root).count() == 1001
    with pytest.raises(Exception):
        bucket_table._commit(spark, root, 1, {})  # another writer was first
    assert bucket_table.update(spark, root, db.where("false"), ["status"]) == [] and bucket_table.version(spark, root) == 1
    with pytest.raises(FileNotFoundError):
        bucket_table.read(spark, f"{tmp_dir}/none")


def test_board_folders_are_pruned_by_the_columns_table(spark, db, tmp_dir):
    statuses = ["new", "in_consideration", "priorities", "in_process", "applied", "rejected"]
    db = db.withColumn("status", F.element_at(F.array(*map(F.lit, statuses)), (F.col("ref_nr") % 6 + 1).cast("int")))
    bd.write_board(db, f"{tmp_dir}/board")
    cards = bd.read_board(spark, f"{tmp_dir}/board")
    assert "dynamicpruning" in executed(cards).lower()
    assert cards.groupBy("status").count().count() == 4 and cards.count() == db.where(bd.active("status")).count()
    assert {r.status for r in bd.read_board(spark, f"{tmp_dir}/board", "rejects").select("status").distinct().collect()} == {"rejected"}


def test_counts_are_taken_while_writing(spark, tmp_dir):
    from vetline.sources import files
    df = spark.createDataFrame([(i, ["a", "b", None][i % 3]) for i in range(10)], "id long, outcome string")
    assert files.write_routed(df, f"{tmp_dir}/out", outcomes=("a", "b", "c")) == {"": 10, "a": 4, "b": 3, "c": 0}
    assert spark.read.parquet(f"{tmp_dir}/out").count() == 10


def test_mail_is_drained_once(spark, tmp_dir):
    from vetline.sources import files
    os.makedirs(f"{tmp_dir}/mail")

    def drain(*new):
        for n in new:
            with open(f"{tmp_dir}/mail/{n}.eml", "wb") as f:
                f.write(f"body {n} \u00e9".encode())
        files.drain_messages(spark, f"{tmp_dir}/mail", f"{tmp_dir}/old", f"{tmp_dir}/out", f"{tmp_dir}/ck").awaitTermination()
        return sorted(bytes(r.raw).decode() for r in spark.read.parquet(f"{tmp_dir}/out").collect())
    assert drain("m1", "m2") == ["body m1 é", "body m2 é"]
    assert len(drain("m3")) == 3
    for f in (f"{tmp_dir}/ck/commits/1", f"{tmp_dir}/ck/commits/.1.crc"):  # killed before the batch was committed
        os.unlink(f)
    assert drain("m4") == ["body m1 é", "body m2 é", "body m3 é", "body m4 é"]
    assert glob.glob(f"{tmp_dir}/old/**/m1.eml", recursive=True) and not os.path.exists(f"{tmp_dir}/mail/m1.eml")
