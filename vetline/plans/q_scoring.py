"""Scoring, listing-table and response queries: lineitem rows stand in for
score items, orders for listing rows, events for model attempts and
conversations for streamed response chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions import json_fields as jf
from vetline.functions import text as tx
from vetline.operators import listing_db as ldb
from vetline.operators import responses as rsp
from vetline.operators import scoring as sc
from vetline.plans.catalog import register
from vetline.sources.tables import table

TODAY = "20260131"
TODAY_DMY = "31/01/2026"
ORDER_COLS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def _items(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", *ORDER_COLS,
        F.when(F.col("l_linestatus") == "O", "add").otherwise("ded").alias("kind"),
        F.when(F.col("l_returnflag") == "R", "Industry: fintech").otherwise("Competency")
         .alias("criterion"),
        F.col("l_quantity").alias("points"))


def fit_by_order(spark, sf_dir, once: bool):
    items = _items(spark, sf_dir)
    if not once:
        items = items.withColumn("criterion", F.lit("Competency"))
    return sc.score_items(items, "l_orderkey", "kind", "points", "criterion", ORDER_COLS)


_PTS = "abs(CAST(trunc(l_quantity) AS INTEGER))"


# ---------------------------------------------------------------- A5 P22
@register("fit_score", sql=f"""
SELECT l_orderkey, additions, deductions,
       CAST(greatest(0, 100 + additions + deductions) AS BIGINT) AS fit_score
FROM (SELECT l_orderkey,
             CAST(sum(CASE WHEN l_linestatus = 'O' THEN {_PTS} ELSE 0 END) AS BIGINT) AS additions,
             CAST(-sum(CASE WHEN l_linestatus <> 'O' THEN {_PTS} ELSE 0 END) AS BIGINT) AS deductions
      FROM lineitem GROUP BY l_orderkey)
""")
def fit_score(spark, sf_dir):
    """Per order: open items add |int(quantity)|, closed items deduct it."""
    return fit_by_order(spark, sf_dir, once=False)


_ONCE_SQL = f"""
WITH i AS (SELECT l_orderkey, l_linestatus = 'O' AS is_add,
                  l_linestatus = 'O' AND l_returnflag = 'R' AS once, {_PTS} AS pts,
                  l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem),
j AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, once
                                   ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rk
      FROM i),
s AS (SELECT l_orderkey,
             CAST(sum(CASE WHEN is_add AND (NOT once OR rk = 1) THEN pts ELSE 0 END) AS BIGINT) AS additions,
             CAST(-sum(CASE WHEN NOT is_add THEN pts ELSE 0 END) AS BIGINT) AS deductions
      FROM j GROUP BY l_orderkey)
"""


@register("fit_once", sql=_ONCE_SQL + """
SELECT l_orderkey, additions, deductions,
       CAST(greatest(0, 100 + additions + deductions) AS BIGINT) AS fit_score FROM s
""")
def fit_once(spark, sf_dir):
    """As fit_score, with returned open items as an ``industry`` criterion that
    counts once: only the first such item (by every item column) adds."""
    return fit_by_order(spark, sf_dir, once=True)


# ---------------------------------------------------------------- F6-F8 K10
_ROUTE_SQL = _ONCE_SQL + """,
r AS (SELECT o.o_orderkey, o.o_orderdate, o.o_orderstatus, o.o_orderpriority, o.o_custkey,
             CAST(CASE WHEN s.l_orderkey IS NULL THEN 100 ELSE greatest(0, 100 + s.additions + s.deductions) END AS BIGINT) AS fit_score
      FROM orders o LEFT JOIN s ON o.o_orderkey = s.l_orderkey),
routed AS (SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'disqualified'
                          WHEN o_orderpriority = '5-LOW' THEN 'rejected_role'
                          WHEN fit_score < 30 THEN 'rejected_score'
                          ELSE 'accepted' END AS outcome FROM r)
"""


def routed_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus",
                                              "o_orderpriority", "o_custkey")
    fit = fit_by_order(spark, sf_dir, once=True).select(
        F.col("l_orderkey").alias("o_orderkey"), "fit_score")
    j = o.join(fit, "o_orderkey", "left").withColumn(
        "fit_score", F.coalesce("fit_score", F.lit(fixed.SCORE_START)).cast("long"))
    flags = F.filter(F.array(
        F.when(F.col("o_orderstatus") == "P", F.lit("Location disqualifier: order pending")),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("ROLE disqualifier: low priority"))),
        lambda x: x.isNotNull())
    return j.withColumn("flags", flags).withColumn("outcome", sc.route_scored("fit_score", "flags"))


@register("route", sql=_ROUTE_SQL + "SELECT o_orderkey, fit_score, outcome FROM routed")
def route(spark, sf_dir):
    """Score + flags -> exactly one outcome per listing, in decision order."""
    return routed_orders(spark, sf_dir).select("o_orderkey", "fit_score", "outcome")


# ---------------------------------------------------------------- A4 W2
@register("ref_seq", sql="""
WITH m AS (SELECT coalesce(max(o_orderkey), 0) AS mx FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn
      FROM orders WHERE o_orderstatus = 'O')
SELECT o.o_orderkey, CAST(CASE WHEN o.o_orderstatus = 'O' THEN m.mx + n.rn END AS BIGINT) AS ref_nr
FROM orders o CROSS JOIN m LEFT JOIN n ON o.o_orderkey = n.o_orderkey
WHERE o.o_orderstatus <> 'F'
""")
def ref_seq(spark, sf_dir):
    """Stored rows = finished orders (text refs ``%04d``); new rows = the rest,
    numbered from max+1 in name order; pending ones (location rejects) get none."""
    o = table(spark, sf_dir, "orders")
    db = o.where(F.col("o_orderstatus") == "F").select(
        F.format_string("%04d", F.col("o_orderkey")).alias("ref_nr"))
    new = o.where(F.col("o_orderstatus") != "F").select("o_orderkey", "o_orderdate",
                                                        "o_orderstatus")
    out = ldb.assign_refs(new, db, ["o_orderdate", "o_orderkey"],
                          needs_ref=F.col("o_orderstatus") != "P")
    return out.select("o_orderkey", "ref_nr")


# ---------------------------------------------------------------- K5 K6 P21
def _row_fields():
    return {
        "ref_nr": F.col("o_orderkey"),
        "fit_score": F.col("fit_score"),
        "date_published": F.date_format("o_orderdate", "yyyyMMdd"),
        "city": tx.validated_city_code(F.lit("Remote")),
        "tag": F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("urgent")).otherwise(F.lit("")),
        "job_title": F.col("o_orderpriority"),
        "company_name": F.format_string("Customer %d", F.col("o_custkey")),
        "source": F.lit(fixed.DEFAULT_SOURCE),
        "url": F.format_string("https://jobs.example.com/view/%d/", F.col("o_orderkey")),
    }


@register("row_format", sql=_ROUTE_SQL + f"""
SELECT CAST(o_orderkey AS BIGINT) AS ref_nr, CAST(fit_score AS INTEGER) AS fit_score,
       strftime(o_orderdate, '%d/%m/%Y') AS date_published, 'REMOTE' AS city,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END AS tag,
       o_orderpriority AS job_title, 'Customer ' || o_custkey AS company_name,
       'LinkedIn' AS source, '{TODAY_DMY}' AS date_found,
       CASE WHEN outcome = 'accepted' THEN 'new' ELSE 'rejected' END AS status,
       'No' AS report_produced, CAST(NULL AS VARCHAR) AS processed,
       'https://jobs.example.com/view/' || o_orderkey || '/' AS url,
       CAST(NULL AS VARCHAR) AS date_considered, CAST(NULL AS VARCHAR) AS date_priorities,
       CAST(NULL AS VARCHAR) AS date_in_process, CAST(NULL AS VARCHAR) AS date_applied,
       CASE WHEN outcome <> 'accepted' THEN '{TODAY_DMY}' END AS date_rejected,
       CAST(NULL AS VARCHAR) AS comment,
       CASE WHEN outcome <> 'accepted' THEN 'Role' END AS reject_reason
FROM routed WHERE outcome IN ('accepted', 'rejected_role', 'rejected_score')
""")
def row_format(spark, sf_dir):
    """New listing rows in the 20-column layout; disqualified rows get none."""
    return ldb.new_rows(routed_orders(spark, sf_dir), "outcome", TODAY_DMY, _row_fields())


# ---------------------------------------------------------------- K7 J6 J7
def _db_from_orders(o):
    return ldb.upgrade_schema(o.select(
        F.col("o_orderkey").alias("ref_nr"), F.lit(0).alias("fit_score"),
        F.col("o_orderpriority").alias("tag"), F.lit("applied").alias("status"),
        F.format_string("https://jobs.example.com/c/%d/", F.col("o_custkey")).alias("url")))


_RESULTS_SQL = """
res AS (SELECT 'https://jobs.example.com/c/' || c_custkey || '/' AS url,
               CAST(greatest(0, 100 + trunc(c_acctbal / 100)) AS INTEGER) AS fit_score,
               CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS tag,
               c_name AS job_title, c_mktsegment AS company_name FROM customer),
firstref AS (SELECT 'https://jobs.example.com/c/' || o_custkey || '/' AS url, min(o_orderkey) AS ref
             FROM orders GROUP BY 1),
upd AS (SELECT f.ref, r.* FROM res r JOIN firstref f ON r.url = f.url)
"""


def rescored(spark, sf_dir, db):
    """Customers as score results, with the ref of the first stored row of their URL."""
    c = table(spark, sf_dir, "customer")
    results = c.select(
        F.format_string("https://jobs.example.com/c/%d/", F.col("c_custkey")).alias("url"),
        F.greatest(F.lit(0), F.lit(100) + (F.col("c_acctbal") / 100).cast("long"))
        .cast("int").alias("fit_score"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("")).otherwise(F.col("c_mktsegment"))
         .alias("tag"),
        F.col("c_name").alias("job_title"), F.col("c_mktsegment").alias("company_name"),
        F.lit("20260115").alias("date_published"), F.lit("REMOTE").alias("city"),
        F.lit(fixed.DEFAULT_SOURCE).alias("source"))
    refs = ldb.first_ref_by_url(db, order_col="ref_nr")
    return results.join(refs, "url").withColumn("ref_nr", F.col("existing_ref"))


@register("rescore_merge", sql=f"""
WITH {_RESULTS_SQL}
SELECT CAST(o.o_orderkey AS BIGINT) AS ref_nr,
       CAST(coalesce(u.fit_score, 0) AS INTEGER) AS fit_score,
       CASE WHEN u.ref IS NOT NULL THEN '15/01/2026' END AS date_published,
       CASE WHEN u.ref IS NOT NULL THEN 'REMOTE' END AS city,
       CASE WHEN u.ref IS NOT NULL AND u.tag <> '' THEN u.tag ELSE o.o_orderpriority END AS tag,
       u.job_title AS job_title, u.company_name AS company_name,
       CASE WHEN u.ref IS NOT NULL THEN 'LinkedIn' END AS source,
       CASE WHEN u.ref IS NOT NULL THEN '{TODAY_DMY}' END AS date_found,
       CASE WHEN u.ref IS NOT NULL THEN 'new' ELSE 'applied' END AS status,
       'https://jobs.example.com/c/' || o.o_custkey || '/' AS url,
       u.ref IS NOT NULL AS updated
FROM orders o LEFT JOIN upd u ON o.o_orderkey = u.ref
""")
def rescore_merge(spark, sf_dir):
    """Forced rescore: results carry a URL; the first stored row with that URL
    gives the ref (J6); that row is updated, an empty tag keeps the old one (K7)."""
    db = _db_from_orders(table(spark, sf_dir, "orders"))
    out = ldb.rescore(db, rescored(spark, sf_dir, db), TODAY_DMY)
    return out.select("ref_nr", "fit_score", "date_published", "city", "tag", "job_title",
                      "company_name", "source", "date_found", "status", "url", "updated")


# ---------------------------------------------------------------- K9 U5
@register("schema_upgrade", sql="""
SELECT CAST(o_orderkey AS BIGINT) AS ref_nr, CAST(NULL AS INTEGER) AS fit_score,
       strftime(o_orderdate, '%d/%m/%Y') AS date_published, CAST(NULL AS VARCHAR) AS city,
       CAST(NULL AS VARCHAR) AS tag, o_orderpriority AS job_title,
       CAST(NULL AS VARCHAR) AS company_name, CAST(NULL AS VARCHAR) AS source,
       CAST(NULL AS VARCHAR) AS date_found,
       CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE 'in_process' END AS status,
       CAST(NULL AS VARCHAR) AS report_produced, CAST(NULL AS VARCHAR) AS processed,
       CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS date_considered,
       CAST(NULL AS VARCHAR) AS date_priorities,
       CASE WHEN o_orderstatus <> 'F' THEN strftime(o_orderdate, '%d/%m/%Y') END AS date_in_process,
       CAST(NULL AS VARCHAR) AS date_applied, CAST(NULL AS VARCHAR) AS date_rejected,
       CAST(NULL AS VARCHAR) AS comment, CAST(NULL AS VARCHAR) AS reject_reason
FROM orders
""")
def schema_upgrade(spark, sf_dir):
    """A 13-column legacy table and a 20-column table united by name (K9)."""
    o = table(spark, sf_dir, "orders")
    dmy = F.date_format("o_orderdate", "dd/MM/yyyy")
    narrow = o.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("ref_nr"), dmy.alias("date_published"),
        F.col("o_orderpriority").alias("job_title"), F.lit("new").alias("status"))
    wide = o.where(F.col("o_orderstatus") != "F").select(
        F.col("o_orderkey").alias("ref_nr"), dmy.alias("date_published"),
        F.col("o_orderpriority").alias("job_title"), F.lit("in_process").alias("status"),
        dmy.alias("date_in_process"))
    return ldb.union_tables(narrow, wide)


# ---------------------------------------------------------------- A11
@register("chunk_assembly", sql="""
WITH c AS (SELECT conv_id, turn, text, role = 'assistant' AS done FROM conversations),
cut AS (SELECT conv_id, min(turn) FILTER (WHERE done) AS cut_turn FROM c GROUP BY conv_id)
SELECT c.conv_id AS resp_id, count(*) AS n_chunks, string_agg(c.text, '' ORDER BY c.turn) AS content
FROM c JOIN cut ON c.conv_id = cut.conv_id
WHERE cut.cut_turn IS NULL OR c.turn <= cut.cut_turn
GROUP BY c.conv_id
""")
def chunk_assembly(spark, sf_dir):
    """Turns as streamed chunks (NDJSON lines built by Spark); an assistant
    turn marks ``done``; content up to and including it."""
    cv = table(spark, sf_dir, "conversations")
    line = F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message"),
                              (F.col("role") == "assistant").alias("done")))
    chunks = cv.select(F.col("conv_id").alias("resp_id"), F.col("turn").alias("seq"),
                       line.alias("line"))
    return rsp.assemble_chunks(chunks)


# ---------------------------------------------------------------- A12 X12-X14
def _attempt_text():
    p = F.col("props")
    return (F.when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), p, F.lit("\n```")))
            .when(F.col("event_type") == "view", F.lit(""))
            .when(F.col("event_type") == "error", F.translate(p, "{}", ""))
            .when(F.col("event_type") == "purchase", F.concat(p, F.lit(" then "), p))
            .otherwise(F.replace(p, F.lit("}"), F.lit(', "note": "line1\nline2"}'))))


_ATTEMPT_SQL = """
WITH a AS (
  SELECT user_id, event_id, ts,
         CASE event_type WHEN 'click' THEN '```json' || chr(10) || props || chr(10) || '```'
                         WHEN 'view' THEN ''
                         WHEN 'error' THEN replace(replace(props, '{', ''), '}', '')
                         WHEN 'purchase' THEN props || ' then ' || props
                         ELSE replace(props, '}', ', "note": "line1' || chr(10) || 'line2"}') END AS t
  FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM a),
c AS (SELECT *, regexp_extract(t, '(?s)\\{.*\\}', 0) AS raw FROM r WHERE attempt <= {k}),
p AS (SELECT *, CASE WHEN raw = '' THEN NULL
                     WHEN json_valid(raw) THEN raw
                     WHEN json_valid(regexp_replace(replace(replace(replace(raw, chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r'), '[\\x00-\\x1f]', '', 'g'))
                       THEN regexp_replace(replace(replace(replace(raw, chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r'), '[\\x00-\\x1f]', '', 'g')
                END AS js FROM c),
s AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN raw = '' THEN 'no_json'
                     WHEN js IS NULL THEN 'bad_json' ELSE 'ok' END AS status FROM p),
g AS (SELECT user_id, min(attempt) FILTER (WHERE status = 'ok') AS ok_first,
             min(attempt) FILTER (WHERE status = 'bad_json') AS bad_first,
             arg_min(CAST(json_extract(js, '$.k') AS BIGINT), attempt) FILTER (WHERE status = 'ok') AS k,
             count(*) AS n_attempts
      FROM s GROUP BY user_id)
"""


@register("attempt_pick", sql=_ATTEMPT_SQL.replace("{k}", "3") + """
SELECT user_id, CAST(ok_first AS INTEGER) AS picked_attempt, k, n_attempts FROM g
""")
def attempt_pick(spark, sf_dir):
    """Stage-06 rule: first ok attempt of the first three; bad JSON retries."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "props")
    att = ev.withColumn("text", _attempt_text())
    out = rsp.pick_attempt(att, "user_id", ["ts", "event_id"], max_attempts=fixed.SCORE_ATTEMPTS)
    return out.select("user_id", "picked_attempt",
                      F.try_variant_get("response", "$.k", "bigint").alias("k"), "n_attempts")


@register("attempt_pick_extract", sql=_ATTEMPT_SQL.replace("{k}", "2") + """
SELECT user_id,
       CAST(CASE WHEN ok_first IS NOT NULL AND (bad_first IS NULL OR ok_first < bad_first)
                 THEN ok_first END AS INTEGER) AS picked_attempt,
       CASE WHEN ok_first IS NOT NULL AND (bad_first IS NULL OR ok_first < bad_first) THEN k END AS k,
       n_attempts FROM g
""")
def attempt_pick_extract(spark, sf_dir):
    """Stage-05 rule: two attempts, a bad-JSON attempt ends the search (Q14)."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "props")
    att = ev.withColumn("text", _attempt_text())
    out = rsp.pick_attempt(att, "user_id", ["ts", "event_id"], max_attempts=fixed.EXTRACT_ATTEMPTS,
                           stop_on_bad_json=True)
    return out.select("user_id", "picked_attempt",
                      F.try_variant_get("response", "$.k", "bigint").alias("k"), "n_attempts")


@register("json_props", sql="""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events
""")
def json_props(spark, sf_dir):
    """Object found in free text, parsed strictly, field read."""
    ev = table(spark, sf_dir, "events").select("event_id", "props")
    return ev.select("event_id",
                     F.try_variant_get(jf.parse_response(F.col("props")), "$.k", "bigint").alias("k"))
