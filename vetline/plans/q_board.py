"""Board queries: events stand in for board moves (user = listing ref,
event type = target column), orders and customers for stored listing rows,
pages for re-fetched posting pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions import json_fields as jf
from vetline.functions import text as tx
from vetline.operators import board as bd
from vetline.operators import listing_db as ldb
from vetline.operators import scoring as sc
from vetline.operators.sequence import spread
from vetline.plans.catalog import register
from vetline.sources.tables import table

TODAY = "20260131"
TODAY_DMY = "31/01/2026"
EXPIRY_TODAY = "20000101"
PAGE_MARKER = "nicht"

# event type -> board column (the target of a move)
MOVE_FOR_EVENT = {"view": "new", "click": "consider", "signup": "priorities",
                  "error": "rejects", "purchase": "in_process"}


def board_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    to_col = F.create_map(*[x for k, v in MOVE_FOR_EVENT.items() for x in (F.lit(k), F.lit(v))])
    # long views are comments without a move; the shortest clicks go to a column that does not exist
    alone = (F.col("event_type") == "view") & (F.col("value") >= 60)
    lost = (F.col("event_type") == "click") & (F.col("value") < 20)
    return ev.select(
        F.col("user_id").alias("ref_nr"), "event_id", "ts",
        F.when(lost, F.lit("archive")).when(~alone, F.element_at(to_col, F.col("event_type"))).alias("to_col"),
        F.when((F.col("event_type") == "error") & (F.col("value") >= 25), F.lit("Pay"))
         .otherwise(F.lit("")).alias("reason"),
        F.when((F.col("event_type") == "signup") | alone, F.col("props")).alias("comment"))


def folded(spark, sf_dir):
    return bd.fold_events(board_events(spark, sf_dir), ["ts", "event_id"])


def _case(col, mapping):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


_DATE_COLS = list(fixed.DATE_COLUMN_FOR.items())
_FOLD_SQL = f"""
WITH e AS (SELECT user_id AS ref_nr, event_id, ts, CASE WHEN event_type = 'click' AND value < 20 THEN 'archive'
                       WHEN event_type = 'view' AND value >= 60 THEN NULL
                       ELSE {_case('event_type', MOVE_FOR_EVENT)} END AS to_col,
                  CASE WHEN event_type = 'error' AND value >= 25 THEN 'Pay' ELSE '' END AS reason,
                  CASE WHEN event_type = 'signup' OR (event_type = 'view' AND value >= 60) THEN props END AS comment
           FROM events),
mv AS (SELECT * FROM e WHERE to_col <> 'archive'),
lst AS (SELECT ref_nr, to_col FROM (SELECT ref_nr, to_col, row_number() OVER
          (PARTITION BY ref_nr ORDER BY ts DESC, event_id DESC) AS rn FROM mv) WHERE rn = 1),
lr AS (SELECT ref_nr, reason FROM (SELECT ref_nr, reason, row_number() OVER
          (PARTITION BY ref_nr ORDER BY ts DESC, event_id DESC) AS rn FROM e
          WHERE to_col = 'rejects' AND reason <> '') WHERE rn = 1),
lc AS (SELECT ref_nr, comment FROM (SELECT ref_nr, comment, row_number() OVER
          (PARTITION BY ref_nr ORDER BY ts DESC, event_id DESC) AS rn FROM e
          WHERE comment IS NOT NULL) WHERE rn = 1),
g AS (SELECT ref_nr, count(*) FILTER (WHERE to_col <> 'archive') AS n_events,
             {", ".join(f"max(ts) FILTER (WHERE to_col = '{c}') AS {d}" for c, d in _DATE_COLS)}
      FROM e WHERE to_col <> 'archive' OR comment IS NOT NULL GROUP BY ref_nr),
fold AS (
  SELECT g.ref_nr, {_case('lst.to_col', fixed.STATUS_FOR_COLUMN)} AS status, g.n_events,
         {", ".join(f"strftime(g.{d}, '%d/%m/%Y') AS {d}" for _, d in _DATE_COLS)},
         lr.reason AS reject_reason, lc.comment
  FROM g LEFT JOIN lst ON g.ref_nr = lst.ref_nr LEFT JOIN lr ON g.ref_nr = lr.ref_nr
  LEFT JOIN lc ON g.ref_nr = lc.ref_nr)
"""


# ---------------------------------------------------------------- B2 B3 A7
@register("board_fold", sql=_FOLD_SQL + "SELECT * FROM fold")
def board_fold(spark, sf_dir):
    f = folded(spark, sf_dir)
    return f.select("ref_nr", "status", "n_events", *[d for _, d in _DATE_COLS],
                    "reject_reason", "comment")


# ---------------------------------------------------------------- A10 B1
@register("board_group", sql=_FOLD_SQL + """
SELECT status, count(*) AS n, min(ref_nr) AS min_ref, max(ref_nr) AS max_ref,
       CAST(sum(n_events) AS BIGINT) AS n_events FROM fold GROUP BY status
""")
def board_group(spark, sf_dir):
    """Board grouped by column: counts and bounds (the members themselves stay
    rows; a column is never collected into one value)."""
    f = folded(spark, sf_dir)
    return f.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.min("ref_nr").alias("min_ref"),
                                   F.max("ref_nr").alias("max_ref"),
                                   F.sum("n_events").cast("long").alias("n_events"))


# ---------------------------------------------------------------- O2 W6 F14
_ACTIVE = ", ".join(f"'{fixed.STATUS_FOR_COLUMN[c]}'" for c in fixed.ACTIVE_COLUMNS)


@register("board_sorts", sql=_FOLD_SQL + f"""
SELECT ref_nr, status,
       lag(ref_nr) OVER (PARTITION BY status ORDER BY n_events DESC, ref_nr) AS prev_ref,
       lead(ref_nr) OVER (PARTITION BY status ORDER BY n_events DESC, ref_nr) AS next_ref
FROM fold WHERE status IN ({_ACTIVE})
""")
def board_sorts(spark, sf_dir):
    """Visible cards, one sort for all columns (most events first, like
    score desc), previous/next card inside each column."""
    f = folded(spark, sf_dir).where(bd.active("status")).select("ref_nr", "status", "n_events")
    out = bd.neighbours(f, [F.col("n_events").desc()], key="ref_nr")
    return out.select("ref_nr", "status", "prev_ref", "next_ref")


# ---------------------------------------------------------------- F13 B5
_ORDER_STATUS = {"O": "new", "P": "in_process", "F": "applied"}


@register("expire_old", sql=f"""
WITH b AS (SELECT o_orderkey, {_case('o_orderstatus', _ORDER_STATUS)} AS status,
                  CAST(o_orderdate AS DATE) AS d FROM orders),
x AS (SELECT *, status IN ({_ACTIVE}) AND d < DATE '{EXPIRY_TODAY[:4]}-{EXPIRY_TODAY[4:6]}-{EXPIRY_TODAY[6:]}' - INTERVAL 30 DAY AS hit FROM b)
SELECT o_orderkey, CASE WHEN hit THEN 'rejected' ELSE status END AS status,
       CASE WHEN hit THEN '{TODAY_DMY}' END AS date_rejected,
       CASE WHEN hit THEN 'Expired' END AS reject_reason, CAST(hit AS INTEGER) AS expired
FROM x
""")
def expire_old(spark, sf_dir):
    """Active listings published more than 30 days before ``today`` expire;
    dates as the listing table stores them and as eight digits."""
    o = table(spark, sf_dir, "orders")
    st = F.create_map(*[x for k, v in _ORDER_STATUS.items() for x in (F.lit(k), F.lit(v))])
    db = o.select("o_orderkey", F.element_at(st, F.col("o_orderstatus")).alias("status"),
                  F.when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "dd/MM/yyyy"))
                   .otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("published"),
                  F.lit(None).cast("string").alias("date_rejected"),
                  F.lit(None).cast("string").alias("reject_reason"))
    out = bd.expire_old(db, "published", EXPIRY_TODAY, TODAY_DMY)
    return out.select("o_orderkey", "status", "date_rejected", "reject_reason",
                      F.col("expired").cast("int").alias("expired"))


# ---------------------------------------------------------------- B8 J8 A8
@register("sync_counts", sql=_FOLD_SQL + """
SELECT CAST(count(c.c_custkey) AS BIGINT) AS updated,
       CAST(count(*) - count(c.c_custkey) AS BIGINT) AS not_found
FROM fold f LEFT JOIN customer c ON f.ref_nr = c.c_custkey + 50 WHERE f.status IS NOT NULL
""")
def sync_counts(spark, sf_dir):
    # the first refs of the board are not in the table
    db = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 50).alias("ref_nr"))
    return bd.sync_counts(db, folded(spark, sf_dir))


@register("sync_apply", sql=_FOLD_SQL + f"""
SELECT CAST(c.c_custkey AS BIGINT) AS ref_nr, coalesce(f.status, 'new') AS status,
       {", ".join(f"f.{d} AS {d}" for _, d in _DATE_COLS)},
       f.reject_reason, f.comment, f.ref_nr IS NOT NULL AS updated
FROM customer c LEFT JOIN fold f ON c.c_custkey = f.ref_nr
""")
def sync_apply(spark, sf_dir):
    """Customers as stored listings (status new); the board state is applied
    in one join; refs not on the board keep their row."""
    c = table(spark, sf_dir, "customer")
    db = ldb.upgrade_schema(c.select(F.col("c_custkey").alias("ref_nr"),
                                     F.lit("new").alias("status")))
    out = bd.sync(db, folded(spark, sf_dir))
    return out.select("ref_nr", "status", *[d for _, d in _DATE_COLS], "reject_reason", "comment",
                      "updated")


# ---------------------------------------------------------------- J11 J12 B6 B7
_LANG_STATUS = {"en": "new", "fr": "in_consideration", "de": "priorities", "es": "applied"}


def page_cards(pages):
    """A card for each page, its column from the language in the URL."""
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1)
    st = F.create_map(*[x for k, v in _LANG_STATUS.items() for x in (F.lit(k), F.lit(v))])
    return pages.select(F.col("page_id").alias("ref_nr"), "url", F.coalesce(F.element_at(st, lang), F.lit("new")).alias("status"))


@register("expired_pages", sql=f"""
WITH cards AS (SELECT page_id AS ref_nr, url,
                      coalesce({_case("regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1)", _LANG_STATUS)}, 'new') AS status
               FROM pages),
closed AS (SELECT DISTINCT url FROM pages WHERE contains(lower(html), '{PAGE_MARKER}')),
cand AS (SELECT c.ref_nr FROM cards c JOIN closed USING (url)
         WHERE c.status IN ({_ACTIVE}) AND c.url IS NOT NULL AND c.url <> '')
SELECT c.ref_nr, CASE WHEN x.ref_nr IS NOT NULL THEN 'rejected' ELSE c.status END AS status,
       CASE WHEN x.ref_nr IS NOT NULL THEN '{TODAY_DMY}' END AS date_rejected,
       CASE WHEN x.ref_nr IS NOT NULL THEN 'Expired' END AS reject_reason
FROM cards c LEFT JOIN cand x ON c.ref_nr = x.ref_nr
""")
def expired_pages(spark, sf_dir):
    """Pages as cards (column from the URL language); the re-fetched page
    holding the marker makes an active card a candidate; confirmed
    candidates are rejected with reason Expired."""
    p = table(spark, sf_dir, "pages")
    cards = ldb.upgrade_schema(page_cards(p))
    cand = bd.expiry_candidates(cards, p.select("url", "html"), PAGE_MARKER)
    out = bd.confirm_expired(cards, cand, TODAY_DMY)
    return out.select("ref_nr", "status", "date_rejected", "reject_reason")


# ---------------------------------------------------------------- B4 K4 S13
def _edit_json():
    """Score JSON of an event: one industry entry counts, text points are
    converted, fractional text is 0, whole points of the value are deducted."""
    k = F.get_json_object("props", "$.k")
    return F.format_string(
        '{"job_title": "Event %d", "company_name": "User %d", "additions": '
        '[{"criterion": "Industry: SaaS", "points": %s}, {"criterion": "industry again", '
        '"points": 5}, "loose note"], "deductions": [{"criterion": "Stack", "points": "%s"}, '
        '{"criterion": "Years", "points": %d}, 7], "disqualifiers": []}',
        F.col("event_id"), F.col("user_id"), k, F.col("value").cast("string"), F.floor("value").cast("long"))


_EDIT_SQL = """
WITH x AS (SELECT event_id, event_type, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events),
y AS (SELECT *, CAST(greatest(0, 100 + abs(k) - CAST(floor(value) AS BIGINT) -
                  CASE WHEN regexp_full_match(CAST(value AS VARCHAR), '\\s*[-+]?[0-9]+\\s*')
                       THEN abs(CAST(value AS BIGINT)) ELSE 0 END) AS INTEGER) AS fit_score FROM x)
"""


@register("edit_score", sql=_EDIT_SQL + """
SELECT event_id, CASE WHEN event_type <> 'error' THEN fit_score END AS fit_score,
       CASE WHEN event_type <> 'error' THEN printf('%04d_%03d_20260131_REMOTE_x', user_id * 1000, fit_score) END AS new_stem,
       CASE WHEN event_type = 'error' THEN 'Invalid JSON' END AS error FROM y
""")
def edit_score(spark, sf_dir):
    """Edited score JSON per event (of errors it is broken): recomputed score
    and the restemmed name, refs of more than four digits included, or an error."""
    ev = spread(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props", "value"))
    content = F.when(F.col("event_type") == "error", F.concat(_edit_json(), F.lit(", {}"))).otherwise(_edit_json())
    edits = ev.select("event_id", "user_id", "props", "value", content.alias("content"),
                      F.format_string("%04d_000_20260131_REMOTE_x", F.col("user_id") * 1000).alias("stem"))
    out = bd.edit_score(edits, "content", "stem", TODAY)
    return out.select("event_id", "fit_score", "new_stem", "error")


@register("report_roundtrip", sql=_EDIT_SQL + """
SELECT event_id, 'Event ' || event_id AS job_title, 'User ' || user_id AS company,
       CAST(fit_score AS VARCHAR) AS fit_score_text FROM y
""")
def report_roundtrip(spark, sf_dir):
    """Render the scoring report (K4) and read the table fields back."""
    ev = spread(table(spark, sf_dir, "events").select("event_id", "user_id", "props", "value"))
    scored = sc.score_responses(ev.select("event_id", "user_id", "props", "value"),
                                jf.strict_parse(_edit_json()), TODAY, out="r")
    rep = scored.select("event_id", sc.scoring_report(F.col("user_id"), F.col("r")).alias("report"))
    return rep.select("event_id", sc.report_field("report", "Job Title").alias("job_title"),
                      sc.report_field("report", "Company").alias("company"),
                      sc.report_field("report", "Fit Score").alias("fit_score_text"))


# ---------------------------------------------------------------- B1 S12 J9
@register("board_listing", sql=_FOLD_SQL + f"""
SELECT ref_nr, status,
       CAST(row_number() OVER (ORDER BY status, n_events DESC, ref_nr) AS BIGINT) AS position,
       coalesce(regexp_replace(comment, '^\\s+|\\s+$', '', 'g') <> '', FALSE) AS has_comment
FROM fold WHERE status IN ({_ACTIVE})
""")
def board_listing(spark, sf_dir):
    """Visible cards in board order (most events first inside each column)
    with a has-comment flag; positions from the skew-safe sequence."""
    f = folded(spark, sf_dir).withColumnRenamed("n_events", "fit_score")
    out = bd.board_listing(f, "score_desc")
    return out.select("ref_nr", "status", "position", "has_comment")


# ---------------------------------------------------------------- D1
_UNIT_FOR_EVENT = {"view": "hour", "click": "day", "signup": "week", "purchase": "month"}


@register("relative_dates", sql=f"""
WITH p AS (SELECT event_id, CAST(floor(value) AS BIGINT) AS n, {_case('event_type', _UNIT_FOR_EVENT)} AS unit FROM events)
SELECT event_id,
       strftime(CASE WHEN unit = 'hour' THEN DATE '2026-01-31' - CAST(floor(n / 24) AS INTEGER)
                     WHEN unit = 'day' THEN DATE '2026-01-31' - CAST(n AS INTEGER)
                     WHEN unit = 'week' THEN DATE '2026-01-31' - CAST(n * 7 AS INTEGER)
                     WHEN unit = 'month' THEN CAST(DATE '2026-01-31' - to_months(CAST(n AS INTEGER)) AS DATE)
                     ELSE DATE '2026-01-31' END, '%Y%m%d') AS published
FROM p
""")
def relative_dates(spark, sf_dir):
    """Publication dates from ``N <unit>s ago`` phrases built from each event
    (whole part of the value, unit by event type; errors carry no phrase)."""
    ev = table(spark, sf_dir, "events")
    unit = F.element_at(F.create_map(*[x for k, v in _UNIT_FOR_EVENT.items()
                                       for x in (F.lit(k), F.lit(v))]), F.col("event_type"))
    phrase = F.when(unit.isNotNull(), F.format_string("Posted %d %ss ago", F.floor("value").cast("long"), unit)) \
              .otherwise(F.lit("Posted recently"))
    return ev.select("event_id", tx.relative_published_date(phrase, TODAY).alias("published"))
