"""Fit score, response normalisation and routing.

Two forms of the same score rule (start 100, additions then deductions,
floor 0, no ceiling, ``industr`` addition counted once):

* ``score_response`` works on a parsed response (VARIANT) whose breakdown
  arrays are per listing and bounded by the response size;
* ``score_items`` works on exploded item rows ``(key, kind, criterion,
  points, order...)`` with partial aggregates only, so a listing with a
  huge number of items (or a hot key) is combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions import json_fields as jf
from vetline.functions import text as tx


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- responses
def normalize_extraction(resp, stem, today: str) -> Column:
    """Extraction response (VARIANT) -> struct of normalised fields (P12):
    language lower-cased, default ``other``; date today unless 8 digits;
    title default stem; source default ``LinkedIn`` also when blank."""
    v = _c(resp)
    lang = F.lower(tx.trim_ws(F.coalesce(jf.field_str(v, "language"), F.lit("other"))))
    pub = jf.eight_digits_or(F.coalesce(jf.field_str(v, "published_date"), F.lit(today)), today)
    city = tx.trim_ws(F.coalesce(jf.field_str(v, "city"), F.lit("")))
    title = tx.trim_ws(F.coalesce(jf.field_str(v, "title"), _c(stem)))
    company = tx.trim_ws(F.coalesce(jf.field_str(v, "company"), F.lit("")))
    source = tx.default_if_blank(tx.trim_ws(F.coalesce(jf.field_str(v, "source"),
                                                       F.lit(fixed.DEFAULT_SOURCE))),
                                 fixed.DEFAULT_SOURCE)
    return F.struct(lang.alias("language"), pub.alias("published_date"), city.alias("city"),
                    title.alias("title"), company.alias("company"), source.alias("source"))


def score_response(resp, today: str) -> Column:
    """Score response (VARIANT) -> struct with recomputed score and normalised
    fields (A5, P19, P22, P23, P15)."""
    v = _c(resp)
    adds = jf.breakdown_items(v, "additions", +1)
    deds = jf.breakdown_items(v, "deductions", -1)
    flags = jf.string_array(v, "disqualifiers")
    date_pub = jf.eight_digits_or(F.coalesce(jf.field_str(v, "date_published"), F.lit("")), today)
    src = jf.field_str(v, "source")
    return F.struct(
        jf.fit_score(adds, deds).alias("fit_score"),
        adds.alias("additions"), deds.alias("deductions"), flags.alias("disqualifiers"),
        date_pub.alias("date_published"),
        tx.validated_city_code(F.coalesce(jf.field_str(v, "city_code"), F.lit(""))).alias("city_code"),
        F.coalesce(jf.field_str(v, "job_title"), F.lit("")).alias("job_title"),
        F.coalesce(jf.field_str(v, "company_name"), F.lit("")).alias("company_name"),
        F.coalesce(jf.field_str(v, "client_company"), F.lit("")).alias("client_company"),
        # setdefault: only a missing key gets the default
        F.when(jf.has_key(v, "source"), F.coalesce(src, F.lit("")))
         .otherwise(F.lit(fixed.DEFAULT_SOURCE)).alias("source"),
        F.coalesce(jf.field_str(v, "notes"), F.lit("")).alias("notes"))


def score_responses(df: DataFrame, resp, today: str, out: str = "result") -> DataFrame:
    """DataFrame form of ``score_response`` that parses once: the VARIANT and
    the breakdown arrays are staged as columns, so each is computed once per
    row instead of once per field that reads it."""
    staged = (df.withColumn("_v", _c(resp))
                .withColumn("_adds0", jf.breakdown_raw(F.col("_v"), "additions", +1))
                .withColumn("_deds", jf.breakdown_raw(F.col("_v"), "deductions", -1))
                .withColumn("_adds", jf.apply_once(F.col("_adds0"))))
    v = F.col("_v")
    src = jf.field_str(v, "source")
    r = F.struct(
        jf.fit_score(F.col("_adds"), F.col("_deds")).alias("fit_score"),
        F.col("_adds").alias("additions"), F.col("_deds").alias("deductions"),
        jf.string_array(v, "disqualifiers").alias("disqualifiers"),
        jf.eight_digits_or(F.coalesce(jf.field_str(v, "date_published"), F.lit("")), today)
        .alias("date_published"),
        tx.validated_city_code(F.coalesce(jf.field_str(v, "city_code"), F.lit(""))).alias("city_code"),
        F.coalesce(jf.field_str(v, "job_title"), F.lit("")).alias("job_title"),
        F.coalesce(jf.field_str(v, "company_name"), F.lit("")).alias("company_name"),
        F.coalesce(jf.field_str(v, "client_company"), F.lit("")).alias("client_company"),
        F.when(jf.has_key(v, "source"), F.coalesce(src, F.lit("")))
         .otherwise(F.lit(fixed.DEFAULT_SOURCE)).alias("source"),
        F.coalesce(jf.field_str(v, "notes"), F.lit("")).alias("notes"))
    return staged.withColumn(out, F.when(v.isNotNull(), r)).drop("_v", "_adds0", "_deds", "_adds")


# ---------------------------------------------------------------- item rows
def score_items(items: DataFrame, key: str, kind_col: str, points_col: str,
                criterion_col: str, order_cols: list) -> DataFrame:
    """Relational A5: items ``kind`` 'add' / 'ded' -> ``(key, additions,
    deductions, fit_score)``.  Points are |int(points)| signed by kind; among
    additions whose criterion contains ``industr`` only the first in
    ``order_cols`` order counts.  All aggregates are partial (map-side)."""
    pts = F.abs(_c(points_col).cast("int"))
    is_add = _c(kind_col) == "add"
    once = is_add & F.lower(_c(criterion_col)).contains(fixed.ONCE_ONLY_CRITERION)
    # Sums stay a hash aggregate over all items.  Only the once-only subset
    # needs the (sort-based) min over a struct ordering; both results are
    # hash-partitioned on the key, so the join adds no exchange.
    sums = items.groupBy(key).agg(
        F.sum(F.when(is_add & ~once, pts).otherwise(0)).alias("_add"),
        F.sum(F.when(~is_add, pts).otherwise(0)).alias("_ded"))
    firsts = (items.where(once).groupBy(key)
                   .agg(F.min(F.struct(*[_c(o) for o in order_cols], pts.alias("p"))).alias("_first")))
    agg = sums.join(firsts, key, "left")
    additions = (F.col("_add") + F.coalesce(F.col("_first.p"), F.lit(0))).cast("long")
    deductions = (-F.col("_ded")).cast("long")
    return agg.select(key, additions.alias("additions"), deductions.alias("deductions"),
                      F.greatest(F.lit(0), F.lit(fixed.SCORE_START) + additions + deductions)
                      .cast("long").alias("fit_score"))


# ---------------------------------------------------------------- routing
def route_scored(score, flags, force: bool = False, closed=None, responded=None) -> Column:
    """Stage-06 decision order as one ``when`` chain (F3, F6, F7, F8, F9, K10):
    closed -> pending (no response) -> location -> role -> score < 30 -> accepted."""
    f = F.lit(not force)
    chain = None

    def add(cond, label):
        nonlocal chain
        chain = F.when(cond, F.lit(label)) if chain is None else chain.when(cond, F.lit(label))

    if closed is not None:
        add(_c(closed) & f, "closed")
    if responded is not None:
        add(~_c(responded), "pending")
    add(jf.any_flag(_c(flags), fixed.LOCATION_FLAG) & f, "disqualified")
    add(jf.any_flag(_c(flags), fixed.ROLE_FLAG) & f, "rejected_role")
    add((_c(score) < fixed.AUTO_REJECT_SCORE_THRESHOLD) & f, "rejected_score")
    return chain.otherwise(F.lit("accepted"))


def route_extracted(lang, reqs_check, force: bool = False, closed=None, responded=None) -> Column:
    """Stage-05 decision order: closed -> pending -> language -> requirement -> accepted."""
    f = F.lit(not force)
    chain = F.when(F.lit(False), F.lit(None))
    if closed is not None:
        chain = chain.when(_c(closed) & f, F.lit("closed"))
    if responded is not None:
        chain = chain.when(~_c(responded), F.lit("pending"))
    chain = chain.when(~_c(lang).isin(*fixed.ACCEPTED_LANGS) & f, F.lit("lang_rejects"))
    chain = chain.when(_c(reqs_check)["disqualified"] & f, F.lit("lang_req_rejects"))
    return chain.otherwise(F.lit("accepted"))


def prompt_tokens(prompt) -> Column:
    """Prompt size estimate: characters // 4."""
    return F.floor(F.length(_c(prompt)) / fixed.CHARS_PER_TOKEN).cast("int")


def whole_response(r, given) -> Column:
    """The response as JSON text with all its keys (C48): the fields that scoring
    read, as it normalised them, then every other key as received."""
    entries = F.map_entries(F.coalesce(F.try_variant_get(_c(given), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")))

    def others(fields):
        return F.transform(F.filter(entries, lambda e: ~F.array_contains(fields, e["key"])),
                           lambda e: F.concat(jf.quoted(e["key"]), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null"))))

    def whole(known):
        rest = jf.once(F.json_object_keys(known), lambda fields: jf.once(others(fields), lambda o: F.when(
            F.size(o) > 0, F.concat(F.lit(","), F.array_join(o, ","))).otherwise(F.lit(""))))
        return F.concat(F.substr(known, F.lit(1), F.length(known) - 1), rest, F.lit("}"))
    return jf.once(F.to_json(_c(r), {"ignoreNullFields": "false"}), whole)


def scoring_report(ref_nr, r, given=None) -> Column:
    """Markdown scoring report (K4): table, then Additions / Deductions /
    Disqualifier Flags / Notes sections only when non-empty, then raw JSON:
    with the VARIANT ``given`` all keys of the response, unknown ones too,
    indented, text outside ASCII kept."""
    r = _c(r)

    def section(title, arr, fmt):
        lines = F.array_join(F.transform(arr, fmt), "\n")
        return F.when(F.size(arr) > 0, F.concat(F.lit(f"## {title}\n"), lines, F.lit("\n\n")))\
                .otherwise(F.lit(""))

    head = F.concat(
        F.format_string("# Scoring Report — ref_nr %04d\n\n", _c(ref_nr).cast("bigint")),
        F.lit("| Field | Value |\n|---|---|\n"),
        F.format_string("| Job Title | %s |\n", r["job_title"]),
        F.format_string("| Company | %s |\n", r["company_name"]),
        F.format_string("| Location | %s |\n", r["city_code"]),
        F.format_string("| Published | %s |\n", r["date_published"]),
        F.format_string("| Source | %s |\n", r["source"]),
        F.format_string("| **Fit Score** | **%d** |\n\n", r["fit_score"]))
    adds = section("Additions", r["additions"], lambda a: F.format_string(
        "- **+%d** — %s: %s", a["points"], a["criterion"], a["detail"]))
    deds = section("Deductions", r["deductions"], lambda d: F.format_string(
        "- **%d** — %s: %s", d["points"], d["criterion"], d["detail"]))
    flags = section("Disqualifier Flags", r["disqualifiers"], lambda x: F.concat(F.lit("- "), x))
    notes = F.when(tx.trim_ws(r["notes"]) != "",
                   F.concat(F.lit("## Notes\n"), tx.trim_ws(r["notes"]), F.lit("\n\n"))).otherwise("")
    raw_json = F.to_json(r, {"pretty": "true"}) if given is None else jf.pretty(F.parse_json(whole_response(r, given)))
    raw = F.concat(F.lit("## Raw JSON\n```json\n"), raw_json, F.lit("\n```"))
    return F.concat(head, adds, deds, flags, notes, raw)


def report_json(report) -> Column:
    """The raw JSON block of a report."""
    return F.regexp_extract(_c(report), r"(?s)## Raw JSON\n```json\n(.*)\n```", 1)


def report_field(report, label: str) -> Column:
    """Read one value back from a report table, optional ``**``, any case."""
    pat = r"(?i)\|\s*\*{0,2}" + r"\Q" + label + r"\E" + r"\*{0,2}\s*\|\s*\*{0,2}([^|\n]+?)\*{0,2}\s*\|"
    return F.trim(F.regexp_extract(_c(report), pat, 1))
