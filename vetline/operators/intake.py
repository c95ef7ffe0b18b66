"""Intake: links from messages and result pages, de-duplication against the
seen list, collision-free names (P1-P4, J1, J2, W1, W3, U1, U2, A1, A2, A6, F1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetline import fixed
from vetline.functions import text as tx
from vetline.operators.sequence import sequence_within


def ordered_distinct_matches(text_col, pattern: str, group: int = 1):
    """All regex matches of ``group`` in first-seen order, duplicates dropped."""
    c = F.col(text_col) if isinstance(text_col, str) else text_col
    return F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), group))


def links_from_messages(messages: DataFrame, today: str, html_col: str = "html",
                        path_col: str = "path") -> DataFrame:
    """E-mail HTML -> one link row per distinct job id, in order of first
    appearance (P1, P2, P3).  Messages without HTML yield nothing."""
    ids = ordered_distinct_matches(html_col, fixed.JOB_ID_PATTERN)
    exploded = messages.select(path_col, F.posexplode(ids).alias("pos", "job_id"))
    return exploded.select(
        F.col(path_col).alias("origin_path"),
        (F.col("pos") + 1).alias("pos"),
        tx.email_placeholder_name(F.lit(today), F.col("job_id")).alias("name"),
        tx.canonical_url(F.col("job_id")).alias("url"),
        F.lit("email").alias("origin"),
    )


def links_per_message(links: DataFrame) -> DataFrame:
    """Extracted count per message plus the total, which has a null path (A2):
    one pass by rollup.  Links of a null path are counted in the total only."""
    per = links.rollup("origin_path").agg(F.count(F.lit(1)).alias("n_links"), F.grouping("origin_path").alias("_all"))
    total = F.col("_all") == 1
    out = per.where(total | F.col("origin_path").isNotNull()).drop("_all")
    return out


def links_from_cards(cards: DataFrame, today: str) -> DataFrame:
    """Harvested cards (title, company, url) -> named link rows."""
    return cards.select(
        tx.card_name(F.lit(today), F.col("title"), F.col("company")).alias("name"),
        F.col("url"),
        F.lit("search").alias("origin"),
    )


def union_intake(*frames: DataFrame) -> DataFrame:
    """One intake table from every source."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


#: Equal rows are given back by tasks of so many.
COPIES = 10_000


def _equal_rows_once(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """Each distinct row once, with ``_n`` copies and ``_at``, its place among the
    rows of its key: by ``order_col`` (nulls last), then by hashes of its other
    columns.  Equal rows meet in a partial aggregate, never in a window, and
    columns that nobody reads later are not moved: hashes stand for them."""
    def hashable(f):
        return F.to_json(F.col(f.name)) if isinstance(f.dataType, (T.MapType, T.VariantType)) else F.col(f.name)
    others = [f for f in df.schema.fields if f.name not in (key, order_col)]
    hashes = [hashable(f) for f in others] or [F.lit(0)]
    at = F.struct(F.col(order_col).isNull().alias("z"), F.col(order_col).alias("o"),
                  F.xxhash64(*hashes).alias("h"), F.hash(*hashes).alias("g"))
    return (df.groupBy(F.col(key), at.alias("_at"))
              .agg(F.count(F.lit(1)).alias("_n"), *[F.any_value(f.name).alias(f.name) for f in others])
              .withColumn(order_col, F.col("_at.o")).select(*df.columns, "_at", "_n"))


def every_copy(once: DataFrame) -> DataFrame:
    """``_n`` copies of each row with ``_copy`` from 0; many copies of one row are
    dealt over tasks."""
    few = once.where(F.col("_n") <= COPIES).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    blocks = (once.where(F.col("_n") > COPIES)
              .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long")))))
    many = blocks.repartition(F.col("_b")).withColumn(
        "_copy", F.explode(F.sequence(F.col("_b"), F.least(F.col("_b") + COPIES, F.col("_n")) - 1))).drop("_b")
    return few.unionByName(many)


def flag_first_per_key(df: DataFrame, key: str, order_col: str,
                       flag: str = "is_first") -> DataFrame:
    """Mark the first row per key in ``order_col`` order.

    The first row per key is a partial aggregate (map-side combine), joined
    back on the key; a key holding a third of the rows is split by AQE's
    skew-join handling, and equal rows are counted, so no group meets in one
    task.  Exactly one row of a non-null key is first: rows that tie in
    ``order_col`` are told apart by their other columns, equal ones are
    interchangeable; null orders come last."""
    once = _equal_rows_once(df, key, order_col)
    firsts = once.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_at").alias("_first"))
    out = every_copy(once.join(firsts, key, "left").withColumn("_win", F.coalesce(F.col("_at") == F.col("_first"), F.lit(False))))
    return out.withColumn(flag, F.col("_win") & (F.col("_copy") == 0)).select(*df.columns, flag)


def dedup_against_seen(links: DataFrame, seen, force: bool = False,
                       key: str = "url", order_col: str = "name") -> DataFrame:
    """Route each link: ``skipped`` (no key), ``deleted`` (seen before, or a later
    copy in this batch), ``moved`` (new).  In force mode duplicates are
    ``moved`` too.  Adds ``is_new`` = this row adds its key to the seen list
    (J1, J2, W1, F1, F9).  Of equal rows exactly one is new.

    ``seen`` is a stored list (``sources.seen.SeenList``), which is read in its
    buckets and not shuffled, or a DataFrame with the key column."""
    once = _equal_rows_once(links, key, order_col)
    per_key = once.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("_at").alias("_first"))
    if isinstance(seen, DataFrame):
        known = per_key.select(key).join(seen.select(key), key, "left_semi")
    else:
        known = seen.known(per_key, key)
    per_key = per_key.join(known.withColumn("_seen", F.lit(True)), key, "left")
    out = once.join(per_key, key, "left")
    in_seen = F.coalesce(F.col("_seen"), F.lit(False))
    out = every_copy(out.withColumn("_new", F.coalesce(F.col("_at") == F.col("_first"), F.lit(False)) & ~in_seen))
    is_new = F.col("_new") & (F.col("_copy") == 0)
    outcome = (F.when(F.col(key).isNull(), F.lit("skipped"))
               .when(~is_new & F.lit(not force), F.lit("deleted"))
               .otherwise(F.lit("moved")))
    return out.withColumn("outcome", outcome).withColumn("is_new", is_new).select(*links.columns, "outcome", "is_new")


def first_copy_counts(rows: DataFrame, seen: DataFrame, key: str, order_col: str,
                      code_col: str) -> DataFrame:
    """Per key: copies in the batch, whether the key was seen before, and the
    routing code of the first copy (J1, W1, A1 in aggregate form).

    The batch rows and the seen keys are united and reduced by one keyed
    aggregation, so there is no join and each side is combined map-side
    before the single shuffle.  ``code_col`` must be an integer so every
    buffer is fixed-width and the aggregate stays hash-based."""
    r = rows.select(F.col(key), F.col(order_col).alias("_o"), F.col(code_col).alias("_code"),
                    F.lit(0).alias("_seen"))
    s = seen.select(F.col(key), F.lit(None).cast(r.schema["_o"].dataType).alias("_o"),
                    F.lit(None).cast("int").alias("_code"), F.lit(1).alias("_seen"))
    return (r.unionByName(s).groupBy(key)
             .agg(F.count("_o").alias("n_copies"), F.max("_seen").alias("seen"),
                  F.min_by("_code", "_o").alias("first_code"))
             .where(F.col("n_copies") > 0))


def seen_additions(routed: DataFrame, key: str = "url") -> DataFrame:
    """Keys to append to the seen list."""
    return routed.where("is_new").select(key)


def outcome_counts(routed: DataFrame, outcome_col: str = "outcome") -> DataFrame:
    """Count per outcome (A1)."""
    return routed.groupBy(outcome_col).agg(F.count(F.lit(1)).alias("n"))


# Rows a task numbers at a time when free numbers are looked up.
_SLOT_BLOCK_BITS = 18


def collision_suffix(df: DataFrame, stem_col: str, order_cols: list,
                     style: str = "paren", taken: DataFrame | None = None,
                     out_col: str = "final_name") -> DataFrame:
    """Collision-free names (W3 ``' (00)'`` style, W4 ``'_01'`` style).

    The first row of a stem keeps the plain name unless the stem is already
    ``taken`` (stored earlier); later rows get, in ``order_cols`` order, the
    next number whose name is neither stored nor a plain name of this batch.
    So all names differ from each other and from the stored ones.  A null stem
    stays null.  Numbering and the look-up of free numbers are skew-safe."""
    first, template, suffix = ((0, " (%02d)", r" \(([0-9]{2}|[1-9][0-9]{2,})\)$") if style == "paren"
                               else (1, "_%02d", r"_([0-9]{2}|[1-9][0-9]{2,})$"))
    rn = sequence_within(df, [stem_col], order_cols, col="_rn")
    stems = rn.where(F.col("_rn") == 1).select(F.col(stem_col).alias("_s"))
    stored = taken.select(F.col(stem_col).alias("_s")).distinct() if taken is not None else stems.where("false")
    # numbers that are gone: of each stem of the batch, those in stored and plain names
    number = F.regexp_extract("_s", suffix, 1)
    gone = (stored.union(stems).where(F.length(number) > 0)
            .select(F.regexp_replace("_s", suffix, "").alias("_s"), number.try_cast("bigint").alias("_b"))
            .where(F.col("_b") >= first).distinct().join(stems, "_s", "left_semi"))
    known = stored.withColumn("_taken", F.lit(1))
    rows = rn.join(known, rn[stem_col] == known["_s"], "left").drop("_s")
    # place among the rows of the stem that need a number, from 0; the first of a free stem has -1
    rows = rows.withColumn("_j", F.col("_rn") - 2 + F.coalesce("_taken", F.lit(0))).drop("_rn", "_taken")
    # most batches meet no number that is gone; one look saves the numbering of those
    rows = rows.withColumn("_gap", F.lit(0)) if gone.isEmpty() else _add_gaps(rows, stem_col, gone, first)
    name = F.concat(F.col(stem_col), F.format_string(template, F.col("_j") + F.col("_gap") + first))
    return (rows.withColumn(out_col, F.when(F.col("_j") < 0, F.col(stem_col)).otherwise(name))
                .drop("_j", "_gap"))


def _add_gaps(rows: DataFrame, stem_col: str, gone: DataFrame, first: int) -> DataFrame:
    """``_gap``: how many gone numbers (``_s``, ``_b``) lie before the ``_j``-th
    free number of the row's stem.

    The i-th gone number b has b - i free numbers before it, so it comes before
    the j-th free one where b - i <= j.  The count is carried along ``_j`` by a
    window over blocks of bounded size, and from block to block by a window
    over one row per block."""
    block = lambda c: F.shiftright(c, _SLOT_BLOCK_BITS)
    numbered = sequence_within(gone, ["_s"], ["_b"], col="_i")
    steps = (numbered.groupBy("_s", (F.col("_b") - first - F.col("_i") + 1).alias("_c"))
             .agg(F.max("_i").alias("_n")).withColumn("_blk", block(F.col("_c"))))
    rows = rows.withColumn("_blk", block(F.col("_j")))
    blocks = (steps.select("_s", "_blk", "_n")
              .union(rows.select(stem_col, "_blk", F.lit(0).cast("long")).distinct())
              .groupBy("_s", "_blk").agg(F.max("_n").alias("_n")))
    before = Window.partitionBy("_s").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_s", F.col("_blk").alias("_k"), F.coalesce(F.max("_n").over(before), F.lit(0)).alias("_carry"))
    marks = steps.select(F.col("_s").alias(stem_col), F.col("_c").alias("_j"), "_blk", "_n")
    both = rows.withColumn("_row", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    within = Window.partitionBy(stem_col, "_blk").orderBy("_j", F.col("_row").asc_nulls_first()) \
                   .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_in", F.max("_n").over(within)).where("_row")
    out = seen.join(blocks, seen[stem_col].eqNullSafe(blocks["_s"]) & (seen["_blk"] == blocks["_k"]), "left")
    return (out.withColumn("_gap", F.greatest(F.coalesce("_in", F.lit(0)), F.coalesce("_carry", F.lit(0))))
               .drop("_s", "_k", "_carry", "_in", "_n", "_blk", "_row"))
