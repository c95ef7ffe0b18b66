"""Run profiles (G1): the whole funnel as one lazily composed plan.

``run`` wires the stages the same way the original launchers chain them:

    intake (messages, result pages) -> dedup vs seen -> keyword exclusion
    -> enrich (join crawled pages, parse job) -> extraction response
    (closed, language, requirements) -> score response (location, ref,
    role, score) -> new listing rows

Inputs are DataFrames (no folders are moved); every stage output is
returned so a caller can write the snapshots it wants.  Expensive boundaries
(the page parse and the scoring) are cut with ``checkpoint()`` into the
cluster's checkpoint folder, which also makes them recovery points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions import text as tx
from vetline.operators import filters as flt
from vetline.operators import intake
from vetline.operators import listing_db as ldb
from vetline.operators import pages as pg
from vetline.operators import responses as rsp
from vetline.operators import scoring as sc
from vetline.session import checkpoint_dir
from vetline.sources import files

PROFILES = ("full", "email_only", "manual")


def _dmy(today: str) -> str:
    return f"{today[6:8]}/{today[4:6]}/{today[:4]}"


def run(inputs: dict, profile: str = "full", today: str = "20260131", force: bool = False,
        keywords=None, cut_lineage: bool = True) -> dict[str, DataFrame]:
    """Compose the funnel.

    ``inputs`` keys (DataFrames): ``messages`` (binaryFile rows), ``cards``
    (title, company, url), ``links`` (name, url; manual profile), ``seen``
    (url; a DataFrame or a stored ``SeenList``), ``pages`` (url, html), ``extract_attempts`` / ``score_attempts``
    (url, attempt, text), ``listing_db`` (20 columns), ``stored_names`` (name):
    names already in the target folders of any stage, which are not given again.
    """
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    keywords = keywords if keywords is not None else fixed.DEFAULT_EXCLUSION_KEYWORDS
    out: dict[str, DataFrame] = {}

    def named(df, col, order, **how):
        stored = inputs.get("stored_names")
        stored = None if stored is None else stored.select(F.col("name").alias(col))
        return intake.collision_suffix(df, col, order, taken=stored, **how)

    # ---- intake (stages 00/01) -------------------------------------------
    parts = []
    if profile in ("full", "email_only") and "messages" in inputs:
        parts.append(intake.links_from_messages(files.message_html(inputs["messages"]), today)
                     .select("name", "url", "origin"))
    if profile == "full" and "cards" in inputs:
        parts.append(intake.links_from_cards(inputs["cards"], today))
    if "links" in inputs and profile in ("full", "manual"):
        # shortcut files: search harvest in a full run, hand-placed in a manual one
        origin = "manual" if profile == "manual" else "search"
        parts.append(inputs["links"].select("name", "url", F.lit(origin).alias("origin")))
    links = intake.union_intake(*parts)

    # ---- dedup (02) and keywords (03); manual runs force both -------------
    forced = force or profile == "manual"
    routed = intake.dedup_against_seen(links, inputs["seen"], force=forced)
    out["dedup"] = routed
    out["seen_additions"] = intake.seen_additions(routed)
    if isinstance(inputs["seen"], DataFrame):  # a stored list grows where it lies
        out["seen_next"] = inputs["seen"].select("url").unionByName(out["seen_additions"])
    passed = routed.where(F.col("outcome") == "moved").drop("outcome", "is_new")
    # moved links sharing a name become "name (00)", "name (01)" (W3)
    passed = (named(passed, "name", ["url", "origin"], style="paren")
              .drop("name").withColumnRenamed("final_name", "name"))
    # the keyword test sees the whole file name, extension included (Q3)
    kw = flt.keyword_route(passed.withColumn("_file", F.concat("name", F.lit(".url"))), "_file",
                           keywords, force=forced).drop("_file")
    out["keyword"] = kw
    kept = kw.where(F.col("matched_keyword").isNull()).drop("matched_keyword")

    # The batch's URLs filter the (large, growing) crawl and attempt tables
    batch_urls = kept.select("url").where(F.col("url").isNotNull()).distinct()

    # ---- enrich (04): join crawled pages, one parse per page ---------------
    pages = latest_pages(inputs["pages"]).join(batch_urls, "url", "left_semi")
    parsed = pg.parse_pages(pages.withColumn("page_key", F.col("url")), key="page_key")
    if cut_lineage:
        checkpoint_dir(parsed.sparkSession)
        parsed = parsed.checkpoint()
    enriched = pg.listing_fields(kept.join(parsed.drop("page_key"), "url", "left"), stem_col="name")
    enriched = enriched.withColumn(
        "stem", tx.enriched_name("name", F.col("title"), F.col("company_final"), today))
    # equal stems after renaming get _01, _02
    enriched = (named(enriched, "stem", ["name", "url"], style="under")
                .drop("stem").withColumnRenamed("final_name", "stem"))
    out["enriched"] = enriched
    out["quarantine"] = enriched.where("quarantine")
    out["documents"] = enriched.where(~F.col("quarantine") & F.col("body_md").isNotNull()).select("stem", "url", "body_md")

    # ---- extraction response (05) ------------------------------------------
    ext = rsp.pick_attempt(inputs["extract_attempts"].join(batch_urls, "url", "left_semi"), "url", ["attempt"],
                           max_attempts=fixed.EXTRACT_ATTEMPTS, stop_on_bad_json=True)
    e = enriched.join(ext, "url", "left")
    n = sc.normalize_extraction(F.col("response"), F.col("stem"), today)
    reqs = flt.requirement_check(flt.requirements_from_variant(F.col("response")))
    e = e.withColumn("extracted", n).withColumn("req", reqs)
    e = e.withColumn("stage05_stem", tx.extraction_stem(
        F.col("extracted.published_date"), tx.city_code4(F.col("extracted.city")),
        F.col("extracted.title"), F.col("extracted.company"), F.col("extracted.source")))
    e = e.withColumn("stage05", sc.route_extracted(
        F.col("extracted.language"), F.col("req"), force=forced,
        closed=flt.is_closed(F.col("body_md")), responded=F.col("response").isNotNull()))
    out["extraction"] = e
    # accepted listings take their stage-05 name; equal stems get _01, _02
    accepted05 = named(e.where(F.col("stage05") == "accepted"), "stage05_stem", ["name", "url"],
                       style="under", out_col="stage05_name")

    # ---- score response (06) -------------------------------------------------
    sco = rsp.pick_attempt(inputs["score_attempts"].join(batch_urls, "url", "left_semi"), "url", ["attempt"],
                           max_attempts=fixed.SCORE_ATTEMPTS)
    s = sc.score_responses(accepted05.join(sco.withColumnRenamed("response", "score_resp")
                                           .drop("picked_attempt", "n_attempts"), "url", "left"),
                           F.col("score_resp"), today, out="scored")
    s = s.withColumn("stage06", sc.route_scored(
        F.col("scored.fit_score"), F.col("scored.disqualifiers"), force=forced,
        closed=flt.is_closed(F.col("body_md")), responded=F.col("scored").isNotNull()))
    db = inputs.get("listing_db")
    if db is None:
        db = ldb.upgrade_schema(s.sparkSession.createDataFrame([], "ref_nr bigint"))
    if forced:
        s = s.join(ldb.first_ref_by_url(db), "url", "left")
    else:
        s = s.withColumn("existing_ref", F.lit(None).cast("bigint"))
    needs = F.col("stage06").isin("accepted", "rejected_role", "rejected_score")
    # numbering checkpoints its input: carry only what later steps read
    s = s.select("url", "name", "stem", "stage05_stem", "stage05_name", "scored", "stage06",
                 "existing_ref")
    # refs follow the order in which stage 06 meets the files: stage-05 names
    s = ldb.assign_refs(s, db, ["stage05_name", "url"], needs_ref=needs, existing_ref="existing_ref")
    if cut_lineage:
        s = s.checkpoint()
    s = s.withColumn("final_stem", tx.scored_stem(
        F.col("ref_nr"), F.col("scored.fit_score"), F.col("scored.date_published"),
        F.col("scored.city_code"), F.col("scored.job_title"), F.col("scored.company_name"),
        F.col("scored.source"), F.col("scored.client_company")))
    s = s.withColumn("report", F.when(needs, sc.scoring_report(F.col("ref_nr"), F.col("scored"))))
    out["scoring"] = s

    fields = {"ref_nr": F.col("ref_nr"), "fit_score": F.col("scored.fit_score"),
              "date_published": F.col("scored.date_published"), "city": F.col("scored.city_code"),
              "tag": F.col("scored.client_company"), "job_title": F.col("scored.job_title"),
              "company_name": F.col("scored.company_name"), "source": F.col("scored.source"),
              "url": F.col("url")}
    fresh = s.where(F.col("existing_ref").isNull())
    out["new_rows"] = ldb.new_rows(fresh, "stage06", _dmy(today), fields)
    rescored = s.where(F.col("existing_ref").isNotNull() & (F.col("stage06") == "accepted"))
    out["rescored_db"] = ldb.rescore(
        db, rescored.select("ref_nr", F.col("scored.fit_score").alias("fit_score"),
                            F.col("scored.date_published").alias("date_published"),
                            F.col("scored.city_code").alias("city"),
                            F.col("scored.client_company").alias("tag"),
                            F.col("scored.job_title").alias("job_title"),
                            F.col("scored.company_name").alias("company_name"),
                            F.col("scored.source").alias("source")), _dmy(today))
    out["listing_db_next"] = ldb.union_tables(out["rescored_db"].drop("updated"), out["new_rows"])
    out["outcomes"] = (s.select(F.col("stage06").alias("outcome"))
                       .unionByName(e.where(F.col("stage05") != "accepted")
                                    .select(F.col("stage05").alias("outcome")))
                       .groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))
    return out


def latest_pages(pages: DataFrame) -> DataFrame:
    """One page a URL: the last by ``crawled_at`` where given, ties (and pages
    without it) by the larger HTML hash.  Only hashes are compared."""
    when = F.col("crawled_at") if "crawled_at" in pages.columns else F.lit(0)
    order = F.struct(when.alias("t"), F.xxhash64("html").alias("h"))
    keyed = pages.withColumn("_order", order)
    last = keyed.groupBy("url").agg(F.max("_order").alias("_last"))
    one = keyed.join(last, "url").where(F.col("_order") == F.col("_last"))
    n = F.row_number().over(Window.partitionBy("url").orderBy("_order"))
    return one.withColumn("_n", n).where("_n = 1").drop("_order", "_last", "_n")


def prompt_text(body, today_iso: str, criteria=None) -> "F.Column":
    """Prompt for an external scorer: instructions + date + document (+ criteria)."""
    parts = [F.lit(f"Today's date is {today_iso}.\n\n"), F.lit("Return ONLY a JSON object.\n\n---\n"), body]
    if criteria is not None:
        parts = parts[:2] + [criteria, F.lit("\n\n---\n")] + parts[2:]
    return F.concat(*parts)

