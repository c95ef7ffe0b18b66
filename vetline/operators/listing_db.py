"""The numbered listing table.

The table is Parquet; every change produces a new snapshot written to a new
directory (never overwrite a path being read).  One append per batch, one
join per batch of updates: no per-row rewrite of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions import text as tx
from vetline.operators.sequence import global_sequence

LISTING_TYPES = {
    "ref_nr": "bigint", "fit_score": "int", "date_published": "string", "city": "string",
    "tag": "string", "job_title": "string", "company_name": "string", "source": "string",
    "date_found": "string", "status": "string", "report_produced": "string",
    "processed": "string", "url": "string", "date_considered": "string",
    "date_priorities": "string", "date_in_process": "string", "date_applied": "string",
    "date_rejected": "string", "comment": "string", "reject_reason": "string",
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ref_as_number(ref) -> Column:
    """Text or number ref -> bigint; unparsable -> null."""
    return tx.trim_ws(_c(ref).cast("string")).try_cast("bigint")


def ref_key(df: DataFrame, col: str = "ref_nr") -> Column:
    """Numeric ref of a table: integral columns as they are, text refs
    ('0277', ' 277 ') trimmed and converted, unparsable ones null."""
    if dict(df.dtypes).get(col) in ("bigint", "int", "smallint", "tinyint"):
        return F.col(col).cast("bigint")
    return ref_as_number(col)


def next_ref(db: DataFrame, ref_col: str = "ref_nr") -> DataFrame:
    """One row: max numeric ref + 1 (0 + 1 on an empty table) (A4).
    A global aggregate: partial max per task, one final row."""
    return db.agg((F.coalesce(F.max(ref_key(db, ref_col)), F.lit(0)) + 1).alias("next_ref"))


def assign_refs(rows: DataFrame, db: DataFrame, order_cols: list,
                needs_ref: Column | None = None, existing_ref: str | None = None,
                out_col: str = "ref_nr") -> DataFrame:
    """Sequential refs from max+1 in ``order_cols`` order (W2).  Rows where
    ``needs_ref`` is false get none (location rejects); rows with an
    ``existing_ref`` (forced rescore) keep it.  Numbering uses the
    range-partition + offsets scheme, never a one-partition window."""
    flag = F.lit(True) if needs_ref is None else needs_ref
    if existing_ref is not None:
        flag = flag & F.col(existing_ref).isNull()
    tagged = rows.withColumn("_needs", flag)
    todo = global_sequence(tagged.where("_needs"), order_cols, col="_seq")
    start = next_ref(db).scalar()  # scalar subquery: one value, no join
    numbered = todo.withColumn(out_col, start + F.col("_seq") - 1).drop("_seq")
    rest = tagged.where(~F.col("_needs")).withColumn(
        out_col, F.col(existing_ref).cast("bigint") if existing_ref else F.lit(None).cast("bigint"))
    return numbered.unionByName(rest).drop("_needs")


def listing_row(r: dict, status: str, today_dmy: str, reject_reason: str | None = None) -> list:
    """Column expressions of a new listing row (K5 accepted / K6 rejected)."""
    row = {
        "ref_nr": r["ref_nr"],
        "fit_score": r["fit_score"],
        "date_published": tx.format_dmy(r["date_published"]),
        "city": r["city"],
        "tag": F.nullif(r["tag"], F.lit("")),
        "job_title": r["job_title"],
        "company_name": r["company_name"],
        "source": r["source"],
        "date_found": F.lit(today_dmy),
        "status": F.lit(status),
        "report_produced": F.lit("No"),
        "processed": F.lit(None),
        "url": r["url"],
        "date_considered": F.lit(None), "date_priorities": F.lit(None),
        "date_in_process": F.lit(None), "date_applied": F.lit(None),
        "date_rejected": F.lit(today_dmy) if reject_reason else F.lit(None),
        "comment": F.lit(None),
        "reject_reason": F.lit(reject_reason) if reject_reason else F.lit(None),
    }
    return [_c(row[k]).cast(t).alias(k) for k, t in LISTING_TYPES.items()]


def new_rows(scored: DataFrame, outcome_col: str, today_dmy: str, fields: dict) -> DataFrame:
    """Accepted -> status new; role / low score -> rejected with reason Role;
    others (disqualified, closed, pending) -> no row (K5, K6)."""
    cols = {k: _c(v) for k, v in fields.items()}
    rejected = _c(outcome_col).isin("rejected_role", "rejected_score")
    acc = dict(zip(LISTING_TYPES, listing_row(cols, "new", today_dmy)))
    rej = dict(zip(LISTING_TYPES, listing_row(cols, "rejected", today_dmy, fixed.LOW_SCORE_REASON)))
    exprs = [F.when(rejected, rej[name]).otherwise(acc[name]).cast(t).alias(name)
             for name, t in LISTING_TYPES.items()]
    keep = _c(outcome_col).isin("accepted", "rejected_role", "rejected_score")
    return scored.where(keep).select(*exprs)


def upgrade_schema(df: DataFrame) -> DataFrame:
    """Add every missing listing column as null, keep extra columns, put the
    known columns first in their fixed order (K9, U5)."""
    have = set(df.columns)
    cols = [f"CAST({'`' + k + '`' if k in have else 'NULL'} AS {t}) AS {k}"
            for k, t in LISTING_TYPES.items()]
    extra = [f"`{c}`" for c in df.columns if c not in LISTING_TYPES]
    return df.selectExpr(*cols, *extra)  # one call for the whole projection


def union_tables(*frames: DataFrame) -> DataFrame:
    out = None
    for f in frames:
        f = upgrade_schema(f)
        out = f if out is None else out.unionByName(f)
    return out


def first_ref_by_url(db: DataFrame, order_col: str = "ref_nr") -> DataFrame:
    """URL -> ref of the first row (by ``order_col``) holding it (J6, W5);
    unparsable refs give none."""
    return (db.where(F.col("url").isNotNull() & (tx.trim_ws("url") != ""))
              .groupBy(tx.trim_ws("url").alias("url"))
              .agg(F.min_by(ref_key(db, "ref_nr"), F.col(order_col)).alias("existing_ref")))


def update_by_ref(db: DataFrame, updates: DataFrame, columns: list[str],
                  keep_if_empty: tuple = (), dedupe: bool = True,
                  order_cols: list | None = None) -> DataFrame:
    """Named-column update by ref (K8, J7, Q22).  ``updates`` has ``ref_nr``
    plus the columns; unknown columns are ignored; a column listed in
    ``keep_if_empty`` keeps the old value when the new one is null/empty.
    Adds ``updated`` (found flag).  One left join per batch.  Refs are unique
    in the table by construction; ``dedupe`` reduces the updates to one per
    ref first (pass False when the caller already guarantees that): the last
    by ``order_cols``, the largest values where no order is given or it ties."""
    cols = [c for c in columns if c in LISTING_TYPES]
    order = [F.col(c).alias(f"_order_{i}") for i, c in enumerate(order_cols or [])]
    u = updates.select(ref_key(updates, "ref_nr").alias("_ref"), *order,
                       *[F.col(c).alias(f"_new_{c}") for c in cols])
    if dedupe:
        # one update per ref: a deterministic winner, never a multiplied row
        new = [f"_new_{c}" for c in cols]
        u = (u.groupBy("_ref")
              .agg(F.max(F.struct(*[f"_order_{i}" for i in range(len(order))], *new)).alias("_u"))
              .select("_ref", *[F.col(f"_u.{n}").alias(n) for n in new]))
    u = u.withColumn("_hit", F.lit(True))
    joined = db.join(u, ref_key(db, "ref_nr") == F.col("_ref"), "left")
    out = []
    for name in db.columns:
        if name in cols:
            new = F.col(f"_new_{name}")
            if name in keep_if_empty:
                new = F.coalesce(F.nullif(new.cast("string"), F.lit("")).cast(LISTING_TYPES[name]),
                                 F.col(name))
            out.append(F.when(F.col("_hit"), new).otherwise(F.col(name))
                       .cast(db.schema[name].dataType).alias(name))
        else:
            out.append(F.col(name))
    return joined.select(*out, F.coalesce(F.col("_hit"), F.lit(False)).alias("updated"))


def updates_not_found(db: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates whose ref is not in the table (the found = false rows)."""
    refs = db.select(ref_key(db, "ref_nr").alias("_ref"))
    return updates.join(refs, ref_key(updates, "ref_nr") == F.col("_ref"), "left_anti")


RESCORE_COLUMNS = ["fit_score", "date_published", "city", "tag", "job_title", "company_name", "source",
                   "date_found", "status"]


def rescore_updates(results: DataFrame, today_dmy: str) -> DataFrame:
    """Stored values of rescored refs."""
    return results.select(
        "ref_nr", "fit_score", tx.format_dmy("date_published").alias("date_published"),
        F.col("city"), F.col("tag"), "job_title", "company_name", "source",
        F.lit(today_dmy).alias("date_found"), F.lit("new").alias("status"))


def rescore(db: DataFrame, results: DataFrame, today_dmy: str) -> DataFrame:
    """Forced rescore of known refs (K7): score, date, city, title, company,
    source, date_found = today, status = new; tag only when non-empty.  For a
    table in buckets, ``bucket_table.update`` takes the same updates and columns."""
    return update_by_ref(db, rescore_updates(results, today_dmy), RESCORE_COLUMNS, keep_if_empty=("tag",))
