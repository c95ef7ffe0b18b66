"""Review board as an event log folded into the listing table (B1-B8, A7-A10,
F13-F16, J8-J12, O2, W6).

Board actions are rows ``(ref_nr, to_col, ts, reason, comment)``; the
current state of a listing is a fold over its events.  The fold uses only
partial aggregates (``max_by``, ``max``), so one listing with a huge number
of events is combined map-side; a new snapshot of the table is one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions import json_fields as jf
from vetline.functions import text as tx
from vetline.operators import listing_db as ldb
from vetline.operators import scoring as sc
from vetline.operators.sequence import global_sequence


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _status_map() -> Column:
    return F.create_map(*[x for k, v in fixed.STATUS_FOR_COLUMN.items()
                          for x in (F.lit(k), F.lit(v))])


def status_for(col) -> Column:
    """Board column -> stored status; unknown names map to themselves."""
    return F.coalesce(F.element_at(_status_map(), _c(col)), _c(col))


def valid_moves(events: DataFrame) -> DataFrame:
    return events.where(F.col("to_col").isin(*fixed.BOARD_COLUMNS))


def invalid_moves(events: DataFrame) -> DataFrame:
    """Moves to an unknown column, or to none, are refused (F15); a comment
    without a move is not a move."""
    nowhere = F.col("to_col").isNull()
    if "comment" in events.columns:
        nowhere = nowhere & F.col("comment").isNull()
    return events.where(~F.col("to_col").isin(*fixed.BOARD_COLUMNS) | nowhere).withColumn("error", F.lit("Unknown column"))


def packed_order(ts_col: str, id_col: str) -> Column:
    """(timestamp, integer id) packed into one DECIMAL(38,0) that sorts the
    same way: micros * 10^20 + (id + 2^63).  A single fixed-width ordering
    keeps ``max_by`` in a hash aggregate (a struct ordering would force a
    sort-based one)."""
    return F.expr(
        f"CAST(unix_micros(CAST(`{ts_col}` AS TIMESTAMP)) AS DECIMAL(38,0)) "
        f"* CAST('100000000000000000000' AS DECIMAL(38,0)) "
        f"+ (CAST(`{id_col}` AS DECIMAL(38,0)) + CAST('9223372036854775808' AS DECIMAL(38,0)))")


def fold_events(events: DataFrame, order_cols: list, date_fmt: str = "dd/MM/yyyy") -> DataFrame:
    """Per ref: status of the last move; each stage date = the latest move to
    that column; reject reason = latest non-empty reason given with a reject;
    comment = latest comment, with a move or without (B2, B3, A7, Q12).

    Moves to unknown columns are ignored; ``n_events`` counts the valid moves.
    A ref with comments only has a null status and no dates.  One scan and one
    aggregation, so the stream form is the same.  With ``order_cols =
    [timestamp, integer id]`` the order is packed into one decimal."""
    comment = F.col("comment") if "comment" in events.columns else F.lit(None).cast("string")
    moved = F.coalesce(F.col("to_col").isin(*fixed.BOARD_COLUMNS), F.lit(False))
    ev = events.where(moved | comment.isNotNull())
    packed = len(order_cols) == 2 and dict(ev.dtypes).get(order_cols[1]) in ("bigint", "int")
    order = packed_order(*order_cols) if packed else F.struct(*[_c(c) for c in order_cols])
    columns = F.array(*[F.lit(c) for c in fixed.BOARD_COLUMNS])
    ev = ev.withColumn("_ord", order).withColumn("_move", F.when(moved, F.array_position(columns, F.col("to_col")).cast("int")))
    valid = F.col("_move").isNotNull()
    reason = tx.trim_ws(F.coalesce("reason", F.lit("")))
    has_reason = valid & (F.col("to_col") == "rejects") & (reason != "")
    aggs = [F.max_by(F.col("_move"), F.when(valid, F.col("_ord"))).alias("_last"),
            F.count("_move").alias("n_events"),
            *[F.max(F.when(F.col("to_col") == col, F.col("ts"))).alias(date_col)
              for col, date_col in fixed.DATE_COLUMN_FOR.items()],
            F.max_by(reason, F.when(has_reason, F.col("_ord"))).alias("reject_reason")]
    if "comment" in events.columns:
        aggs.append(F.max_by(tx.trim_ws(comment), F.when(comment.isNotNull(), F.col("_ord"))).alias("comment"))
    g = ev.groupBy("ref_nr").agg(*aggs)
    dates = [F.date_format(d, date_fmt).alias(d) for d in fixed.DATE_COLUMN_FOR.values()]
    rest = [c for c in g.columns if c not in ("_last", *fixed.DATE_COLUMN_FOR.values())]
    last = F.when(F.col("_last").isNotNull(), F.element_at(columns, F.col("_last")))
    return g.select(*rest, *dates, status_for(last).alias("status"))


def latest_folder_state(snapshot: DataFrame, key: str = "ref_nr", col: str = "board_col",
                        stem: str = "stem") -> DataFrame:
    """A board snapshot ``(ref, board column, stem)`` in which a ref may
    appear in several columns: the later column in folder order wins, ties go
    to the last stem (A7).  One partial aggregation (max over the struct of
    folder position and stem)."""
    cols = F.array(*[F.lit(c) for c in fixed.BOARD_COLUMNS])
    pos = F.array_position(cols, F.col(col))
    g = (snapshot.where(pos > 0).groupBy(key)
                 .agg(F.max(F.struct(pos.alias("p"), F.col(stem).alias("s"))).alias("_w")))
    winner = F.element_at(cols, F.col("_w.p").cast("int"))
    return g.select(key, winner.alias(col), F.col("_w.s").alias(stem), status_for(winner).alias("status"))


def sync(db: DataFrame, folded: DataFrame, restamp_today: str | None = None) -> DataFrame:
    """Apply the folded board state to the table (B8, J8).  Stage dates are
    kept from the events; ``restamp_today`` reproduces the stamp-today-at-every
    sync behaviour (Q1).  Adds ``updated``."""
    cols = ["status", "reject_reason"] + list(fixed.DATE_COLUMN_FOR.values())
    if "comment" in folded.columns:
        cols.append("comment")
    upd = folded
    if restamp_today is not None:
        for date_col in fixed.DATE_COLUMN_FOR.values():
            upd = upd.withColumn(date_col, F.when(F.col(date_col).isNotNull(), F.lit(restamp_today)))
    return ldb.update_by_ref(db, upd, cols, keep_if_empty=tuple(cols), dedupe=False)


def sync_counts(db: DataFrame, folded: DataFrame) -> DataFrame:
    """One row: board refs found in the table (updated) and not found.
    Refs that were only commented on are not on the board."""
    refs = db.select(ldb.ref_key(db, "ref_nr").alias("_ref")).distinct() \
             .withColumn("_in_db", F.lit(True))
    j = folded.where(F.col("status").isNotNull()).select(ldb.ref_key(folded, "ref_nr").alias("_ref")).distinct() \
              .join(refs, "_ref", "left")
    return j.agg(F.count_if(F.col("_in_db").isNotNull()).alias("updated"),
                 F.count_if(F.col("_in_db").isNull()).alias("not_found"))


def active(status) -> Column:
    """Visible columns."""
    visible = [fixed.STATUS_FOR_COLUMN[c] for c in fixed.ACTIVE_COLUMNS]
    return _c(status).isin(*visible)


def board_column(db: DataFrame, column: str) -> DataFrame:
    """Cards of one board column (S12): a filter on the stored status,
    pushed to the scan when the table is partitioned by status."""
    return db.where(F.col("status") == fixed.STATUS_FOR_COLUMN[column])


def board_listing(db: DataFrame, sort: str = "score_desc") -> DataFrame:
    """Visible cards per column in one board sort, with a has-comment flag
    and the position inside the column (B1, O2, J9, F14).  The listing stays
    rows; it is never collected into one value per column."""
    cards = db.where(active("status")).withColumn(
        "has_comment", F.coalesce(tx.trim_ws("comment") != "", F.lit(False)))
    return global_sequence(cards, ["status"] + board_sort(sort) + ["ref_nr"], col="position")


def write_board(db: DataFrame, path: str) -> None:
    """The table partitioned by status (B1, K10), beside it the board's columns."""
    db.write.mode("errorifexists").partitionBy("status").parquet(f"{path}/cards")
    rows = [(fixed.STATUS_FOR_COLUMN[c], c, int(c in fixed.ACTIVE_COLUMNS)) for c in fixed.BOARD_COLUMNS]
    db.sparkSession.createDataFrame(rows, "status string, board_col string, visible int").coalesce(1) \
        .write.mode("errorifexists").parquet(f"{path}/columns")


def read_board(spark, path: str, column: str | None = None) -> DataFrame:
    """Cards of one board column, or of the visible ones (S12): the few rows of the
    columns table prune the card folders while the query runs, so which
    columns are visible is data, not code."""
    columns = spark.read.parquet(f"{path}/columns")
    wanted = columns.where(F.col("board_col") == column if column else F.col("visible") == 1).select("status")
    return spark.read.parquet(f"{path}/cards").join(F.broadcast(wanted), "status")  # a row a board column


def card_content(db: DataFrame, docs: DataFrame | None = None, key: str = "ref_nr") -> DataFrame:
    """Report, document, comment and URL of each card; missing -> '' (J10)."""
    out = db
    if docs is not None:
        out = out.join(docs.select(key, F.col("body_md").alias("_doc")), key, "left")
    else:
        out = out.withColumn("_doc", F.lit(None).cast("string"))
    rep = F.col("report") if "report" in db.columns else F.lit(None).cast("string")
    return out.select(key, F.coalesce(rep, F.lit("")).alias("scoring"),
                      F.coalesce("_doc", F.lit("")).alias("jd"),
                      F.coalesce("comment", F.lit("")).alias("comment"),
                      F.coalesce("url", F.lit("")).alias("url"))


def sidecar_groups(files: DataFrame, cards: DataFrame, name_col: str = "name", stem_col: str = "stem") -> DataFrame:
    """``files`` with the ``stem`` of the card they follow, null for none.

    A file follows a card when its name is the card's stem, then ``.`` or ``_``,
    then anything; of several such stems the longest wins.  Each name is joined
    at its separators, an equi-join on the stem, so a card with any number of
    files is split by AQE like any other key and no pair is tried in vain."""
    names = files.select(F.col(name_col).alias("_n")).where(F.col("_n").isNotNull()).distinct()
    cut = F.explode(F.filter(F.sequence(F.lit(1), F.greatest(F.length("_n"), F.lit(1))),
                             lambda i: F.substr(F.col("_n"), i, F.lit(1)).isin(".", "_")))
    prefixes = names.select("_n", cut.alias("_i")).select("_n", F.substr(F.col("_n"), F.lit(1), F.col("_i") - 1).alias("_stem"))
    stems = cards.select(F.col(stem_col).alias("_stem")).where(F.col("_stem") != "").distinct()
    owner = (prefixes.join(stems, "_stem").groupBy("_n").agg(F.max_by("_stem", F.length("_stem")).alias("_stem"))
             .select(F.col("_n").alias("_name"), F.col("_stem").alias("stem")))
    rest = files.drop("stem")
    return rest.join(owner, rest[name_col] == F.col("_name"), "left").drop("_name")


def save_comments(db: DataFrame, comments: DataFrame) -> DataFrame:
    """Comment edits ``(ref_nr, text[, ts])``: the last one of a ref is stored,
    trimmed (K11, B3)."""
    when = [c for c in ("ts",) if c in comments.columns]
    upd = comments.select("ref_nr", tx.trim_ws("text").alias("comment"), *when)
    return ldb.update_by_ref(db, upd, ["comment"], order_cols=when)


def expire_old(db: DataFrame, published_col: str, today: str, today_dmy: str) -> DataFrame:
    """Active rows whose date, ``yyyyMMdd`` or as the table stores it
    (``dd/MM/yyyy``), is a valid date strictly before today - 30 days ->
    rejected, reason Expired (F13, B5, Q16, Q17)."""
    td = F.to_date(F.lit(today), "yyyyMMdd")
    pub = _c(published_col)
    d = (F.when(pub.rlike("^[0-9]{8}$"), F.try_to_date(pub, "yyyyMMdd"))
          .when(pub.rlike("^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.try_to_date(pub, "dd/MM/yyyy")))
    hit = active("status") & F.coalesce(d < F.date_sub(td, fixed.EXPIRY_DAYS), F.lit(False))
    e = F.col("expired")
    return (db.withColumn("expired", hit)
              .withColumn("status", F.when(e, F.lit("rejected")).otherwise(F.col("status")))
              .withColumn("date_rejected", F.when(e, F.lit(today_dmy)).otherwise(F.col("date_rejected")))
              .withColumn("reject_reason", F.when(e, F.lit(fixed.EXPIRED_REASON))
                          .otherwise(F.col("reject_reason"))))


def expiry_candidates(cards: DataFrame, pages: DataFrame, marker: str = fixed.CLOSED_MARKER
                      ) -> DataFrame:
    """Active cards with a URL whose re-fetched page holds the closed marker
    (B6, J11, F16).  Equi-join on URL; the marker test runs on the page side
    before the join so only matching pages are shuffled."""
    closed = pages.where(F.lower("html").contains(marker.lower())).select("url").distinct()
    c = cards.where(active("status") & F.col("url").isNotNull() & (F.col("url") != ""))
    return c.join(closed, "url", "left_semi")


def confirm_expired(db: DataFrame, confirmed: DataFrame, today_dmy: str) -> DataFrame:
    """Confirmed candidates -> rejected with reason Expired."""
    upd = confirmed.select("ref_nr").distinct().select(
        "ref_nr", F.lit("rejected").alias("status"), F.lit(today_dmy).alias("date_rejected"),
        F.lit(fixed.EXPIRED_REASON).alias("reject_reason"))
    return ldb.update_by_ref(db, upd, ["status", "date_rejected", "reject_reason"], dedupe=False)


def neighbours(board: DataFrame, sort_cols: list, key: str = "ref_nr") -> DataFrame:
    """Previous / next card within a status for one board sort.

    Positions come from the skew-safe global sequence over (status, sort);
    neighbours are equi-joins on (status, position +- 1), so no status lands
    in a single window task however large it is."""
    seq = global_sequence(board, ["status"] + sort_cols + [key], col="_pos")
    prev = seq.select("status", (F.col("_pos") + 1).alias("_pos"), F.col(key).alias("prev_ref"))
    nxt = seq.select("status", (F.col("_pos") - 1).alias("_pos"), F.col(key).alias("next_ref"))
    return (seq.join(prev, ["status", "_pos"], "left").join(nxt, ["status", "_pos"], "left")
               .drop("_pos"))


def board_sort(name: str) -> list:
    """The five board sorts, one criterion for all columns (O2)."""
    return {
        "score_desc": lambda: [F.col("fit_score").desc()],
        "score_asc": lambda: [F.col("fit_score").asc()],
        "date_desc": lambda: [F.try_to_date("date_published", "dd/MM/yyyy").desc()],
        "date_asc": lambda: [F.try_to_date("date_published", "dd/MM/yyyy").asc()],
        "company": lambda: [F.col("company_name").asc()],
    }[name]()


def edit_score(edits: DataFrame, json_col: str, stem_col: str, today: str, ref_col: str | None = None) -> DataFrame:
    """Edited score JSON -> recomputed score and new stem, or an error row
    (B4, X15, P25).  Uses the same score rule as scoring (Q13).  With
    ``ref_col`` also the new ``report``, which keeps all keys of the JSON (K4)."""
    parsed = edits.withColumn("_given", jf.strict_parse(F.col(json_col)))
    r = sc.score_responses(parsed, F.col("_given"), today, out="_r")
    ok = F.col("_r").isNotNull()
    report = [F.when(ok, sc.scoring_report(F.col(ref_col), F.col("_r"), F.col("_given"))).alias("report")] if ref_col else []
    return r.select(
        *edits.columns, F.col("_r.fit_score").alias("fit_score"),
        F.when(ok, tx.restem_score(_c(stem_col), F.col("_r.fit_score"))).alias("new_stem"),
        F.when(~ok, F.lit("Invalid JSON")).alias("error"), F.col("_r").alias("result"), *report)
