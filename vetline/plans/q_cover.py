"""Queries for names, document links, board snapshots and comments: orders,
parts and documents stand in for listings, events for board moves and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions import text as tx
from vetline.operators import board as bd
from vetline.operators import listing_db as ldb
from vetline.operators import rules
from vetline.operators import scoring as sc
from vetline.plans.catalog import register
from vetline.plans.q_board import _FOLD_SQL, MOVE_FOR_EVENT, _case, board_events
from vetline.sources import files
from vetline.sources.tables import table

TODAY = "20260131"
_SRC = fixed.DEFAULT_SOURCE


def _safe_sql(x):
    return f"regexp_replace(regexp_replace({x}, '[<>:\"/\\\\|?*]', '', 'g'), '^\\s+|\\s+$', '', 'g')"


def _sanitize_sql(x):
    return f"regexp_replace(replace(regexp_replace({x}, '[<>:\"/\\\\|?*]', '', 'g'), ' ', '_'), '^_+|_+$', '', 'g')"


# ---------------------------------------------------------------- P2 P3 P4
@register("link_names", sql=f"""
SELECT o_orderkey, '{fixed.CANONICAL_URL_PREFIX}' || o_orderkey || '{fixed.CANONICAL_URL_SUFFIX}' AS url,
       strftime(o_orderdate, '%Y%m%d') || '_Job_' || o_orderkey || ' - Email - {_SRC}' AS placeholder,
       strftime(o_orderdate, '%Y%m%d') || '_' || {_safe_sql("' <' || o_orderpriority || '>? '")} || ' - '
         || {_safe_sql("o_orderstatus || '/Co: '")} || ' - {_SRC}' AS card_name
FROM orders
""")
def link_names(spark, sf_dir):
    """Posting URL, placeholder name and card name of each order."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", tx.canonical_url("o_orderkey").alias("url"),
        tx.email_placeholder_name(day, F.col("o_orderkey").cast("string")).alias("placeholder"),
        tx.card_name(day, F.concat(F.lit(" <"), "o_orderpriority", F.lit(">? ")),
                     F.concat("o_orderstatus", F.lit("/Co: "))).alias("card_name"))


# ---------------------------------------------------------------- P9
@register("name_choice", sql=f"""
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 1 THEN '{TODAY}_Job_' || p_partkey || ' - Email - {_SRC}'
                                  ELSE '{TODAY}_' || p_partkey || ' - {_SRC}' END AS name,
                  CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 5 = 0 THEN '?' ELSE p_name END AS title,
                  CASE WHEN p_size % 7 <> 0 THEN p_brand END AS company FROM part),
c AS (SELECT p_partkey, name, trim(substr({_safe_sql('title')}, 1, {fixed.TITLE_CUT})) AS t,
             trim(substr({_safe_sql('company')}, 1, {fixed.COMPANY_CUT})) AS co FROM p)
SELECT p_partkey, CASE WHEN contains(name, '{fixed.EMAIL_PLACEHOLDER_MARK}') AND t <> ''
                       THEN '{TODAY}_' || t || CASE WHEN co <> '' THEN ' - ' || co ELSE '' END || ' - {_SRC}'
                       ELSE name END AS name
FROM c
""")
def name_choice(spark, sf_dir):
    """Placeholder names give way to the title found on the page, others stay."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    p = table(spark, sf_dir, "part")
    name = (F.when(size % 2 == 1, tx.email_placeholder_name(F.lit(TODAY), key))
            .otherwise(F.concat(F.lit(f"{TODAY}_"), key, F.lit(f" - {_SRC}"))))
    title = F.when(size % 3 == 0, F.lit(None)).when(size % 5 == 0, "?").otherwise(F.col("p_name"))
    company = F.when(size % 7 != 0, F.col("p_brand"))
    return p.select("p_partkey", tx.enriched_name(name, title, company, TODAY).alias("name"))


# ---------------------------------------------------------------- P12
@register("extraction_fields", sql=f"""
SELECT doc_id, coalesce(lower(trim(lang)), 'other') AS language,
       CASE WHEN n_chars % 3 = 0 THEN '20250115' ELSE '{TODAY}' END AS published_date,
       CASE WHEN n_chars % 2 = 0 THEN 'Chief of ' || source ELSE 'd' || doc_id END AS title,
       CASE WHEN n_chars % 4 = 0 OR source IS NULL THEN '{_SRC}' ELSE source END AS source
FROM (SELECT doc_id, CASE WHEN n_chars % 5 <> 0 THEN lang END AS lang, n_chars, source FROM documents)
""")
def extraction_fields(spark, sf_dir):
    """Fields of an extraction response with their defaults."""
    n = F.col("n_chars")
    response = F.parse_json(F.to_json(F.struct(
        F.when(n % 5 != 0, F.concat(F.lit(" "), F.upper("lang"))).alias("language"),
        F.when(n % 3 == 0, "20250115").when(n % 3 == 1, "15/01/2025").alias("published_date"),
        F.when(n % 2 == 0, F.concat(F.lit("Chief of "), "source", F.lit(" "))).alias("title"),
        F.when(n % 4 == 0, " ").otherwise(F.col("source")).alias("source"))))
    out = table(spark, sf_dir, "documents").select(
        "doc_id", sc.normalize_extraction(response, F.concat(F.lit("d"), F.col("doc_id").cast("string")), TODAY).alias("x"))
    return out.select("doc_id", "x.language", "x.published_date", "x.title", "x.source")


# ---------------------------------------------------------------- P18 P25
@register("scored_names", sql=f"""
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS ref, o_custkey % 131 AS score,
                  (o_custkey + 7) % 131 AS edited, strftime(o_orderdate, '%Y%m%d') AS day,
                  {_sanitize_sql("o_orderpriority || ' ?'")} AS title, {_sanitize_sql("'Clerk: ' || o_custkey")} AS company,
                  CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN '__A_B' ELSE '' END AS client
           FROM orders),
p AS (SELECT *, day || '_BERL_' || title || '_' || company || '_{_SRC}' || client AS rest FROM o)
SELECT o_orderkey, printf('%04d_%03d_', ref, score) || rest AS stem, printf('%04d_%03d_', ref, edited) || rest AS edited_stem
FROM p
""")
def scored_names(spark, sf_dir):
    """Names of scored listings, and after an edit of the score."""
    cust = F.col("o_custkey")
    client = F.when(cust % 3 == 0, "").when(cust % 3 == 1, "_A: B_")
    o = table(spark, sf_dir, "orders").select("o_orderkey", cust, tx.scored_stem(
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")), cust % 131, F.date_format("o_orderdate", "yyyyMMdd"),
        F.lit("BERL"), F.concat("o_orderpriority", F.lit(" ?")), F.concat(F.lit("Clerk: "), cust.cast("string")),
        F.lit(_SRC), client).alias("stem"))
    return o.select("o_orderkey", "stem", tx.restem_score("stem", (cust + 7) % 131).alias("edited_stem"))


# ---------------------------------------------------------------- P20
_LINK_FOR_LANG = {"en": "**URL:** https://jobs.example/", "de": "[**URL:** http://jobs.example/", "fr": "URL: https://jobs.example/"}


@register("document_urls", sql=f"""
WITH d AS (SELECT doc_id, coalesce({_case('lang', _LINK_FOR_LANG)}, '**URL:** none ') || doc_id
                  || CASE WHEN lang = 'de' THEN '))' ELSE '' END || chr(10) || coalesce(text, '') AS md FROM documents)
SELECT doc_id, regexp_replace(regexp_extract(md, '\\*\\*URL:\\*\\*\\s*(https?://\\S+)', 1), '\\)+$', '') AS url FROM d
""")
def document_urls(spark, sf_dir):
    """The URL in each listing document, '' where it holds none."""
    link = F.create_map(*[F.lit(x) for kv in _LINK_FOR_LANG.items() for x in kv])
    md = F.concat(F.coalesce(F.try_element_at(link, F.col("lang")), F.lit("**URL:** none ")), F.col("doc_id").cast("string"),
                  F.when(F.col("lang") == "de", "))").otherwise(""), F.lit("\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", tx.url_from_markdown(md).alias("url"))


# ---------------------------------------------------------------- J4 F17
@register("document_pairs", sql="""
WITH d AS (SELECT 'd' || doc_id AS stem, n_chars FROM documents),
s AS (SELECT 'd' || doc_id AS stem, 'https://jobs.example/' || doc_id AS url FROM labels)
SELECT 'extract' AS stage, stem, n_chars, url FROM d JOIN s USING (stem)
UNION ALL SELECT 'score', stem, n_chars, url FROM d LEFT JOIN s USING (stem)
""")
def document_pairs(spark, sf_dir):
    """Documents with their shortcut: extraction skips those without, scoring keeps them."""
    key = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), key).alias("stem"), "n_chars")
    links = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), key).alias("name"),
                                                  F.concat(F.lit("https://jobs.example/"), key).alias("url"))
    extract, score = (files.pair_documents(docs, links, stage).select(F.lit(stage).alias("stage"), "stem", "n_chars", "url")
                      for stage in ("extract", "score"))
    return extract.unionByName(score)


# ---------------------------------------------------------------- F15
@register("moves_refused", sql=_FOLD_SQL + """
SELECT ref_nr, event_id, to_col, 'Unknown column' AS error FROM e
WHERE to_col = 'archive' OR (to_col IS NULL AND comment IS NULL)
""")
def moves_refused(spark, sf_dir):
    """Moves to a column that does not exist; comments without a move are no moves."""
    return bd.invalid_moves(board_events(spark, sf_dir)).select("ref_nr", "event_id", "to_col", "error")


# ---------------------------------------------------------------- A7 U3
_POSITION = {c: str(i) for i, c in enumerate(fixed.BOARD_COLUMNS)}


@register("folder_state", sql=f"""
WITH s AS (SELECT user_id AS ref_nr, {_case('event_type', MOVE_FOR_EVENT)} AS board_col, printf('%012d', event_id) AS stem FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY ref_nr ORDER BY {_case('board_col', _POSITION)} DESC, stem DESC) AS k
      FROM s WHERE board_col IS NOT NULL)
SELECT ref_nr, board_col, stem, {_case('board_col', fixed.STATUS_FOR_COLUMN)} AS status FROM r WHERE k = 1
""")
def folder_state(spark, sf_dir):
    """One state a ref from a board snapshot that holds it in several columns."""
    to_col = F.create_map(*[F.lit(x) for kv in MOVE_FOR_EVENT.items() for x in kv])
    snapshot = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("ref_nr"), F.try_element_at(to_col, F.col("event_type")).alias("board_col"),
        F.format_string("%012d", "event_id").alias("stem"))
    return bd.latest_folder_state(snapshot)


# ---------------------------------------------------------------- J10
@register("card_content", sql="""
SELECT c_custkey AS ref_nr, CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE c_mktsegment END AS scoring, coalesce(text, '') AS jd,
       CASE WHEN c_nationkey % 2 = 0 THEN '' ELSE c_name END AS comment,
       CASE WHEN c_acctbal < 0 THEN '' ELSE 'https://jobs.example/' || c_custkey END AS url
FROM customer LEFT JOIN documents ON c_custkey = doc_id
""")
def card_content(spark, sf_dir):
    """Report, document, comment and URL of each card; missing ones are ''."""
    db = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("ref_nr"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_mktsegment")).alias("report"),
        F.when(F.col("c_nationkey") % 2 != 0, F.col("c_name")).alias("comment"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("https://jobs.example/"), F.col("c_custkey").cast("string"))).alias("url"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref_nr"), F.col("text").alias("body_md"))
    return bd.card_content(db, docs)


# ---------------------------------------------------------------- K11
@register("comments_saved", sql="""
WITH u AS (SELECT user_id AS ref_nr, regexp_replace(' ' || props || ' ', '^\\s+|\\s+$', '', 'g') AS comment, ts FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY ref_nr ORDER BY ts DESC NULLS LAST, comment DESC NULLS LAST) AS k FROM u)
SELECT c_custkey AS ref_nr, CASE WHEN l.ref_nr IS NULL THEN c_name ELSE comment END AS comment, l.ref_nr IS NOT NULL AS updated
FROM customer LEFT JOIN l ON c_custkey = l.ref_nr AND k = 1
""")
def comments_saved(spark, sf_dir):
    """The last comment of each ref, trimmed; the others keep theirs."""
    db = ldb.upgrade_schema(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ref_nr"), F.col("c_name").alias("comment")))
    edits = table(spark, sf_dir, "events").select(F.col("user_id").alias("ref_nr"),
                                                  F.concat(F.lit(" "), "props", F.lit(" ")).alias("text"), "ts")
    return bd.save_comments(db, edits).select("ref_nr", "comment", "updated")


@register("comments_lost", sql="""
SELECT user_id AS ref_nr, event_id FROM events WHERE user_id IS NULL OR user_id NOT IN (SELECT c_custkey + 50 FROM customer)
""")
def comments_lost(spark, sf_dir):
    """Edits whose ref the table does not hold."""
    # the first refs of the events are not in the table
    db = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 50).alias("ref_nr"))
    return ldb.updates_not_found(db, table(spark, sf_dir, "events").select(F.col("user_id").alias("ref_nr"), "event_id"))


# ---------------------------------------------------------------- R7
_NAMES_SQL = "[" + ", ".join(f"'{c}'" for c in rules.COMPETENCIES) + "]"


@register("rules_competency", sql=f"""
WITH x AS (SELECT event_id, ({_NAMES_SQL})[user_id % 16 + 1] AS a, ({_NAMES_SQL})[event_id % 16 + 1] AS b FROM events)
SELECT event_id, CASE WHEN a = b THEN a ELSE a || ', ' || b END AS absent, CASE WHEN a = b THEN -1 ELSE -2 END AS points FROM x
""")
def rules_competency(spark, sf_dir):
    """Points for absent competencies: each once, unlisted ones not at all."""
    names = F.array(*[F.lit(c) for c in rules.COMPETENCIES])
    absent = F.array(F.get(names, (F.col("user_id") % 16).cast("int")), F.get(names, (F.col("event_id") % 16).cast("int")), "event_type")
    out = table(spark, sf_dir, "events").select("event_id", rules.competency_items(absent).alias("items"))
    return out.select("event_id", F.array_join("items.detail", ", ").alias("absent"),
                      F.aggregate("items.points", F.lit(0), lambda s, x: s + x).alias("points"))


# ---------------------------------------------------------------- P19
@register("score_fields", sql=f"""
SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN '20250115' ELSE '{TODAY}' END AS date_published,
       CASE WHEN n_chars % 4 = 0 OR source IS NULL THEN '{_SRC}' ELSE source END AS source
FROM documents
""")
def score_fields(spark, sf_dir):
    """Date and source of a score response with their defaults."""
    n = F.col("n_chars")
    response = F.parse_json(F.to_json(F.struct(
        F.lit("CFO").alias("job_title"),
        F.when(n % 3 == 0, "20250115").when(n % 3 == 1, "15/01/2025").alias("date_published"),
        F.when(n % 4 != 0, F.col("source")).alias("source"))))
    docs = table(spark, sf_dir, "documents").select("doc_id", response.alias("response"))
    out = sc.score_responses(docs, F.col("response"), TODAY, out="x")
    return out.select("doc_id", "x.date_published", "x.source")
