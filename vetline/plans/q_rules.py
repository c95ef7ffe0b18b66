"""Rule-table queries: part types stand in for job titles, documents with
derived language requirements for listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vetline.operators import rules as rl
from vetline.plans.catalog import register
from vetline.plans.q_intake import LANG_NAME, SECOND_LANG
from vetline.sources.tables import table

# Role tiers aimed at part types (the fixed tiers target job titles).
PART_TIERS = [(1, "discounted", -10, r"promo"), (2, "preferred", 0, r"economy|standard"),
              (3, "acceptable", 0, r"medium")]


@register("rules_role", sql="""
SELECT p_partkey,
       CASE WHEN regexp_matches(lower(p_type), 'promo') THEN 'discounted'
            WHEN regexp_matches(lower(p_type), 'economy|standard') THEN 'preferred'
            WHEN regexp_matches(lower(p_type), 'medium') THEN 'acceptable' END AS tier,
       CAST(CASE WHEN regexp_matches(lower(p_type), 'promo') THEN -10
                 WHEN regexp_matches(lower(p_type), 'economy|standard|medium') THEN 0 END AS INTEGER) AS points,
       CAST(NOT regexp_matches(lower(p_type), 'promo|economy|standard|medium') AS INTEGER) AS disqualified
FROM part
""")
def rules_role(spark, sf_dir):
    """Best-ranked matching tier per title; no tier -> role disqualifier."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    r = rl.role_rule("p_type", PART_TIERS)
    items = rl.role_items("p_type", PART_TIERS)
    return p.select("p_partkey", r["tier"].alias("tier"), r["points"].alias("points"),
                    (F.size(items["disqualifiers"]) > 0).cast("int").alias("disqualified"))


def _pts_sql(lang, level, req):
    g = "('german', 'de', 'deutsch')"
    free = ("('english', 'en', 'portuguese', 'pt', 'spanish', 'es', 'french', 'fr', 'français', "
            "'francais', 'french language', 'francês', 'frances', 'francés', 'französisch', "
            "'franzosisch', 'dutch', 'nl', 'flemish', 'vlaams', 'nederlands', 'dutch language', "
            "'flemish dutch', 'holandês', 'holandes', 'holandés', 'neerlandais', 'néerlandais', "
            "'niederländisch')")
    L, V = f"lower({lang})", f"lower({level})"
    return (f"CASE WHEN NOT {req} THEN 0 WHEN {L} IN {g} AND {V} = 'b2' THEN -30 "
            f"WHEN {L} IN {g} AND {V} IN ('c1', 'c2', 'fluent', 'native', 'mother tongue', "
            f"'full professional proficiency') THEN -50 WHEN {L} IN {g} OR {L} IN {free} THEN 0 "
            f"WHEN {V} IN ('a1', 'a2') THEN -15 ELSE 0 END")


def _case(col, mapping):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


@register("rules_lang", sql=f"""
WITH r AS (
  SELECT d.doc_id, {_case('d.lang', LANG_NAME)} AS l1,
         CASE WHEN d.n_chars >= 5000 THEN 'C1' WHEN d.n_chars >= 1000 THEN 'B2'
              WHEN d.n_chars >= 300 THEN 'B1' ELSE 'A2' END AS v1,
         {_case('d.lang', SECOND_LANG)} AS l2,
         CASE WHEN l.quality = 1 THEN 'fluent' WHEN l.quality = 0 THEN 'intermediate' ELSE 'A2' END AS v2,
         coalesce(l.toxic <> 1, TRUE) AS q2
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT doc_id, CAST(({_pts_sql('l1', 'v1', 'TRUE')}) + ({_pts_sql('l2', 'v2', 'q2')}) AS INTEGER) AS lang_points,
       CAST(greatest(0, 100 + ({_pts_sql('l1', 'v1', 'TRUE')}) + ({_pts_sql('l2', 'v2', 'q2')})) AS INTEGER) AS fit_score
FROM r
""")
def rules_lang(spark, sf_dir):
    """Language-level deductions (R6) summed into a fit score."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    lvl1 = (F.when(F.col("n_chars") >= 5000, "C1").when(F.col("n_chars") >= 1000, "B2")
            .when(F.col("n_chars") >= 300, "B1").otherwise("A2"))
    lvl2 = F.when(F.col("quality") == 1, "fluent").when(F.col("quality") == 0, "intermediate") \
            .otherwise("A2")
    m1 = F.create_map(*[x for k, v in LANG_NAME.items() for x in (F.lit(k), F.lit(v))])
    m2 = F.create_map(*[x for k, v in SECOND_LANG.items() for x in (F.lit(k), F.lit(v))])
    reqs = F.array(
        F.struct(F.element_at(m1, F.col("lang")).alias("language"), lvl1.alias("level"),
                 F.lit(True).alias("required")),
        F.struct(F.element_at(m2, F.col("lang")).alias("language"), lvl2.alias("level"),
                 F.coalesce(F.col("toxic") != 1, F.lit(True)).alias("required")))
    res = rl.combine([], [rl.language_items(reqs)], [])
    pts = F.aggregate(res["deductions"], F.lit(0), lambda a, x: a + x["points"])
    return d.join(lab, "doc_id", "left").select(
        "doc_id", pts.cast("int").alias("lang_points"), res["fit_score"].cast("int").alias("fit_score"))


# Industry lists aimed at part brands (the fixed lists target company sectors).
PART_PREFERRED = ["brand#1", "brand#2", "brand#3"]
PART_DISLIKED = ["brand#4", "brand#5", "brand#6"]


@register("rules_score", sql=f"""
WITH p AS (SELECT p_partkey, lower(p_type) AS t, lower(p_brand) AS b FROM part),
s AS (SELECT p_partkey,
             CASE WHEN b IN ({", ".join(f"'{x}'" for x in PART_PREFERRED)}) THEN 10 ELSE 0 END AS adds,
             CASE WHEN regexp_matches(t, 'promo') THEN 10 ELSE 0 END
             + CASE WHEN b IN ({", ".join(f"'{x}'" for x in PART_DISLIKED)}) THEN 10 ELSE 0 END AS deds,
             NOT regexp_matches(t, 'promo|economy|standard|medium') AS role_flag
      FROM p)
SELECT p_partkey, CAST(greatest(0, 100 + adds - deds) AS INTEGER) AS fit_score,
       CAST(role_flag AS INTEGER) AS n_flags,
       CASE WHEN role_flag THEN 'rejected_role' WHEN greatest(0, 100 + adds - deds) < 30 THEN 'rejected_score'
            ELSE 'accepted' END AS outcome
FROM s
""")
def rules_score(spark, sf_dir):
    """Role tier (R1) + industry lists (R3 once, R4 each) combined into a
    response-shaped breakdown, scored (R8) and routed like a model response."""
    from vetline.operators import scoring as sc
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    role = rl.role_items("p_type", PART_TIERS)
    ind = rl.industry_items(F.array(F.col("p_brand")), PART_PREFERRED, PART_DISLIKED)
    res = rl.combine([ind["additions"]], [role["deductions"], ind["deductions"]], [role["disqualifiers"]])
    return p.select("p_partkey", res["fit_score"].cast("int").alias("fit_score"),
                    F.size(res["disqualifiers"]).cast("int").alias("n_flags"),
                    sc.route_scored(res["fit_score"], res["disqualifiers"]).alias("outcome"))


# ---------------------------------------------------------------- R2
def _city_sql(col):
    return f"lower(regexp_replace(strip_accents({col}), '^\\s+|\\s+$', '', 'g'))"


@register("rules_location", sql=f"""
WITH a AS (SELECT doc_id, regexp_split_to_array(text, '[.,;:!?\\n]+') AS a FROM documents),
c AS (SELECT doc_id, unnest(a) AS city, generate_subscripts(a, 1) - 1 AS phrase FROM a),
k AS (SELECT doc_id, phrase, city, {_city_sql('city')} AS ck FROM c)
SELECT doc_id, CAST(phrase AS INTEGER) AS phrase,
       CAST(CASE WHEN ck = 'berlin' THEN -30 WHEN ck = 'rio de janeiro' THEN -15 ELSE 0 END AS INTEGER) AS loc_points,
       CASE WHEN ck IN ({", ".join(f"'{x}'" for x in rl.ACCEPTED_PLACES)}, 'berlin', 'rio de janeiro') THEN NULL
            WHEN contains(ck, 'brazil') THEN 'Location disqualifier: Brazilian location outside accepted areas'
            ELSE 'Location disqualifier: ' || city || ' not in acceptable locations' END AS loc_flag
FROM k
""")
def rules_location(spark, sf_dir):
    """Location rule (R2) for each phrase of each document as a city:
    city dimension joined by a size-checked broadcast, unknown places and
    other Brazilian places disqualify."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"[.,;:!?\n]+")).alias("phrase", "city"))
    out = rl.location_items(d, "city")
    pts = F.aggregate(F.col("loc_deductions"), F.lit(0), lambda a, x: a + x["points"])
    return out.select("doc_id", "phrase", pts.cast("int").alias("loc_points"), F.get("loc_flags", 0).alias("loc_flag"))


# ---------------------------------------------------------------- R5
# Culture pattern aimed at the prose (the criteria name social-impact roles).
DOC_CULTURE = r"que la|und die"


@register("rules_profile", sql=f"""
SELECT doc_id,
       CAST(CASE WHEN regexp_matches(lower(text), 'on behalf of our client|our client is looking for') THEN -10 ELSE 0 END
            + CASE WHEN regexp_matches(lower(text), '{DOC_CULTURE}') THEN -15 ELSE 0 END AS INTEGER) AS profile_points
FROM documents
""")
def rules_profile(spark, sf_dir):
    """Recruiting-agency and culture deductions over the whole text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = rl.profile_items("text", DOC_CULTURE)
    pts = F.aggregate(items, F.lit(0), lambda a, x: a + x["points"])
    return d.select("doc_id", pts.cast("int").alias("profile_points"))
