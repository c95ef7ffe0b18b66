"""Queries of what is kept between runs: streams with their state, and the
listing table in buckets.

Their input is the given tables, put into folders as a stream's arrivals; each
gives the rows of the batch query whose SQL it shares."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vetline import fixed
from vetline.operators import board as bd
from vetline.operators import listing_db as ldb
from vetline.functions import json_fields as jf
from vetline.operators import criteria as cr
from vetline.operators import scoring as sc
from vetline.operators.sequence import spread
from vetline.plans import q_board, q_intake, q_rules, q_scoring
from vetline.plans.catalog import register, sql_of
from vetline.session import checkpoint_dir
from vetline.sources import bucket_table, files
from vetline.sources.tables import table
from vetline.streaming import alerts as salerts
from vetline.streaming import board as sboard
from vetline.streaming import intake as sintake


def scratch(spark, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- T1
@register("dedup_stream", sql=sql_of("dedup_seen"))
def dedup_stream(spark, sf_dir):
    """Documents arriving in three parts by id, each met by a restarted query
    whose keyed state holds the seen list and the keys so far."""
    root = scratch(spark, "dedup-stream")
    schema = "doc_id long, text_key string, is_seen boolean, part int"
    docs = q_intake.listings(spark, sf_dir).select("doc_id", "text_key", F.lit(False).alias("is_seen"))
    known = q_intake.seen_texts(spark, sf_dir).select(F.lit(None).cast("long").alias("doc_id"), "text_key", F.lit(True).alias("is_seen"))
    third = docs.agg(F.percentile_approx("doc_id", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q")).first()["q"] or [0, 0]
    part = F.when(F.col("doc_id").isNull() | (F.col("doc_id") <= third[0]), 0).when(F.col("doc_id") <= third[1], 1).otherwise(2)
    known.unionByName(docs).withColumn("part", part).write.partitionBy("part").parquet(f"{root}/parts")
    for k in range(3):
        spark.read.schema(schema).parquet(f"{root}/parts").where(F.col("part") == k).write.mode("append").parquet(f"{root}/arrivals")
        arrivals = spark.readStream.schema(schema).parquet(f"{root}/arrivals")
        sintake.start_stateful_intake(arrivals, f"{root}/routed", f"{root}/checkpoint", "text_key", "doc_id").awaitTermination()
    return sintake.read_routed(spark, f"{root}/routed").select("doc_id", "outcome", F.col("is_new").cast("int").alias("is_new"))


# ---------------------------------------------------------------- T2
@register("board_stream", sql=sql_of("board_fold"))
def board_stream(spark, sf_dir):
    """Moves arriving as six files, a micro-batch each; every second batch the
    changes are compacted into a new base."""
    root = scratch(spark, "board-stream")
    moves = q_board.board_events(spark, sf_dir)
    moves.repartition(6).write.parquet(f"{root}/moves")
    stream = spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/moves")
    sboard.start_board_stream(stream, f"{root}/checkpoint", f"{root}/state", compact_every=2, available_now=True).awaitTermination()
    return sboard.read_board_state(spark, f"{root}/state").select(
        "ref_nr", "status", "n_events", *fixed.DATE_COLUMN_FOR.values(), "reject_reason", "comment")


# ---------------------------------------------------------------- T3
@register("alert_stream", sql=sql_of("expired_pages"))
def alert_stream(spark, sf_dir):
    """Pages, fetched a second apart, joined as a stream with the moves that put
    their cards on the board an hour before; alerts confirmed like candidates."""
    root = scratch(spark, "alerts")
    given = table(spark, sf_dir, "pages")
    given.select("page_id", "url", "html").repartition(4).write.parquet(f"{root}/pages")
    pages = (spark.readStream.schema(given.select("page_id", "url", "html").schema).option("maxFilesPerTrigger", 2)
             .parquet(f"{root}/pages"))
    fetched = pages.select("url", "html", F.timestamp_seconds(F.lit(1_700_003_600) + F.col("page_id")).alias("fetched_at"))
    moves = q_board.page_cards(pages).withColumn("moved_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    stream = salerts.closed_alert_stream(fetched, moves, keep="3650 days", marker=q_board.PAGE_MARKER)
    salerts.start_alerts(stream, f"{root}/alerts", f"{root}/checkpoint").awaitTermination()
    cards = ldb.upgrade_schema(q_board.page_cards(given))
    found = spark.read.schema("ref_nr bigint").parquet(f"{root}/alerts")
    return bd.confirm_expired(cards, found, q_board.TODAY_DMY).select("ref_nr", "status", "date_rejected", "reject_reason")


# ---------------------------------------------------------------- K7 K8 J7
@register("rescore_buckets", sql=f"SELECT * EXCLUDE (updated) FROM ({sql_of('rescore_merge')})")
def rescore_buckets(spark, sf_dir):
    """Forced rescore of a table in ref buckets: touched buckets get a new version."""
    root = scratch(spark, "listing-buckets")
    db = q_scoring._db_from_orders(table(spark, sf_dir, "orders"))
    bucket_table.create(db, root, buckets=64)
    updates = ldb.rescore_updates(q_scoring.rescored(spark, sf_dir, db), q_scoring.TODAY_DMY)
    bucket_table.update(spark, root, updates, ldb.RESCORE_COLUMNS, keep_if_empty=("tag",))
    return bucket_table.read(spark, root).select("ref_nr", "fit_score", "date_published", "city", "tag", "job_title",
                                                 "company_name", "source", "date_found", "status", "url")


# ---------------------------------------------------------------- J13
@register("sidecar_groups", sql="""
WITH stems AS (SELECT c_name AS stem FROM customer UNION SELECT c_name || '_' || c_mktsegment FROM customer),
f AS (SELECT o_orderkey, c_name || (CASE WHEN o_orderkey % 2 = 0 THEN '.' ELSE '_' END) || c_mktsegment || '_' || o_orderpriority || '.md' AS name
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, max_by(stem, length(stem)) AS stem
FROM f LEFT JOIN stems ON starts_with(name, stem || '.') OR starts_with(name, stem || '_') GROUP BY o_orderkey
""")
def sidecar_groups(spark, sf_dir):
    """Files named after customers and orders, with the longest stem they follow."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders")
    cards = c.select(F.col("c_name").alias("stem")).union(c.select(F.concat_ws("_", "c_name", "c_mktsegment")))
    sep = F.when(F.col("o_orderkey") % 2 == 0, ".").otherwise("_")
    files = (o.join(c, o["o_custkey"] == c["c_custkey"], "left")
             .select("o_orderkey", F.concat("c_name", sep, "c_mktsegment", F.lit("_"), "o_orderpriority", F.lit(".md")).alias("name")))
    return bd.sidecar_groups(files, cards).select("o_orderkey", "stem")


# ---------------------------------------------------------------- S10 R1-R8
def part_criteria() -> str:
    """The rules of ``rules_score`` as a user writes them."""
    tiers = {}
    for _, tier, points, pattern in q_rules.PART_TIERS:
        tiers.setdefault((tier, points), []).extend(pattern.split("|"))
    out = ["# CRITERION 1 — TARGET ROLES", "# a comment", ""]
    for (tier, points), names in tiers.items():
        out += [f"{tier.upper()} TITLES — " + (f"deduct {-points} points each:" if points else "no deduction:")]
        out += [f"  - {' / '.join(names)} (as a word)", ""]
    out += ["OUT OF SCOPE — HARD DISQUALIFIER:", "  - Any title that does not match any of the above tiers", "",
            "# CRITERION 2 — INDUSTRIES", "PREFERRED INDUSTRIES — add 10 points ONCE in total:",
            *[f"  - {b}" for b in q_rules.PART_PREFERRED], "", "DISLIKES — deduct 10 points each (apply all that match):",
            *[f"  - {b}" for b in q_rules.PART_DISLIKED]]
    return "\n".join(out)


@register("rules_parsed", sql=sql_of("rules_score"))
def rules_parsed(spark, sf_dir):
    """Score and outcome of parts by rules read from criteria text."""
    rules = cr.parse_criteria(spark.createDataFrame([(part_criteria(),)], "criteria string"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    found = cr.apply_rules(p, "p_partkey", {"TARGET ROLES": "p_type", "INDUSTRIES": "p_brand"}, rules)
    score = jf.fit_score(F.col("additions"), F.col("deductions"))
    return found.select("p_partkey", score.cast("int").alias("fit_score"), F.size("disqualifiers").alias("n_flags"),
                        sc.route_scored(score, F.col("disqualifiers")).alias("outcome"))


# ---------------------------------------------------------------- K4 C48
@register("report_keys", sql="""
SELECT event_id, 'Señor ' || event_type AS contact, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CAST(greatest(0, 100 + abs(CAST(json_extract(props, '$.k') AS BIGINT))) AS BIGINT) AS fit_score,
       13 AS n_keys, 'User ' || user_id AS company_name FROM events
""")
def report_keys(spark, sf_dir):
    """Responses with keys that nobody knows, written into reports and read back
    from the raw JSON there: nothing is lost."""
    ev = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props"))
    content = F.format_string('{"company_name": "User %d", "additions": [{"criterion": "x", "points": %s}], '
                              '"extra": {"contact": {"name": "Señor %s"}, "list": [1, [2.5, null]]}, "props": %s}',
                              F.col("user_id"), F.get_json_object("props", "$.k"), F.col("event_type"), F.col("props"))
    given = ev.withColumn("given", jf.strict_parse(content))
    scored = sc.score_responses(given, F.col("given"), q_board.TODAY, out="r")
    raw = F.parse_json(sc.report_json(sc.scoring_report(F.col("user_id"), F.col("r"), F.col("given"))))
    out = scored.select("event_id", raw.alias("raw"))
    read = lambda path, kind: F.variant_get("raw", path, kind)
    return out.select("event_id", read("$.extra.contact.name", "string").alias("contact"), read("$.props.k", "bigint").alias("k"),
                      read("$.fit_score", "bigint").alias("fit_score"), F.size(read("$", "map<string,variant>")).alias("n_keys"),
                      read("$.company_name", "string").alias("company_name"))


# ---------------------------------------------------------------- S12 B1 K10
@register("board_partitions", sql=sql_of("board_listing"))
def board_partitions(spark, sf_dir):
    """The board stored by status and listed through its columns table, which
    prunes the folders of hidden columns."""
    root = scratch(spark, "board")
    bd.write_board(q_board.folded(spark, sf_dir).withColumnRenamed("n_events", "fit_score"), root)
    return bd.board_listing(bd.read_board(spark, root), "score_desc").select("ref_nr", "status", "position", "has_comment")


# ---------------------------------------------------------------- A1 K10
@register("routed_counts", sql=f"SELECT outcome, count(*) AS n FROM ({sql_of('dedup_seen')}) GROUP BY outcome")
def routed_counts(spark, sf_dir):
    """Documents written to outcome folders, counted by the write itself."""
    routed = q_intake.dedup_seen(spark, sf_dir)
    outcomes = ("moved", "deleted", "skipped")
    counts = files.write_routed(routed, scratch(spark, "routed"), outcomes=outcomes)
    return spark.createDataFrame([(o, counts[o]) for o in outcomes if counts[o]], "outcome string, n long")
