"""Scoring criteria as rule tables.

In the original workflow a language model reads the criteria text and lists
which criteria apply; code only adds the points up.  Here the criteria are
rule lists that produce the same ``additions`` / ``deductions`` /
``disqualifiers`` arrays deterministically; a caller holding real model
responses feeds those to ``scoring.score_response`` instead.

Rule lists are configuration with a bounded size, so they are compiled into
the plan as literal expressions (each regex compiled once per task), which
keeps matching inside whole-stage codegen with no join or shuffle.  The city
dimension, which may be larger, is a broadcast equi-join behind a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions import text as tx

# FIXED VALUES: criteria points and names from the scoring criteria text.
ROLE_TIERS = [
    # (rank, tier, points, case-insensitive pattern)
    (1, "discounted", -10, r"\bfractional\b"),
    (2, "preferred", 0, r"\bcfo\b|chief financial officer|finance director|director of finance"
                        r"|\bvp (of )?finance\b|finance vp|director financiero|director de finanzas"
                        r"|\bvp (de )?finanzas\b|director general (de finanzas|financiero)"
                        r"|head of finance and operations|\bcfoo\b"),
    (3, "acceptable", 0, r"head of finance|jefe de finanzas"),
    (4, "discounted", -10, r"chief of staff"),
]
ACCEPTED_PLACES = ["flanders", "randstad", "munich", "remote", "sao paulo", "braganca paulista",
                   "lisbon", "barcelona", "copenhagen", "oslo", "tettnang", "zurich"]
PLACE_POINTS = {"berlin": -30, "rio de janeiro": -15}
BRAZIL_MARK = "brazil"
PREFERRED_INDUSTRIES = ["deeptech", "saas", "robotics", "aerospace", "automation",
                        "digital transformation", "power generation technologies",
                        "pharma research", "biotech", "healthtech", "fintech",
                        "iot (internet of things)", "venture capital", "private equity"]
DISLIKED_INDUSTRIES = ["climate / sustainability", "e-commerce", "quantum computing",
                       "cryptocurrency"]
CULTURE_POINTS, AGENCY_POINTS, INDUSTRY_POINTS, DISLIKE_POINTS = -15, -10, 10, -10
AGENCY_PATTERN = r"on behalf of our client|our client is looking for"
GERMAN_B2_POINTS, GERMAN_C1_POINTS, OTHER_BASIC_POINTS = -30, -50, -15
GERMAN_NAMES = ["german", "de", "deutsch"]
GERMAN_C1_LEVELS = ["c1", "c2", "fluent", "native", "mother tongue",
                    "full professional proficiency"]
BASIC_LEVELS = ["a1", "a2"]
FREE_LANGUAGES = ["english", "en", "portuguese", "pt", "spanish", "es"]
COMPETENCIES = [
    "Finance strategy", "M&A advisory", "Financial management",
    "Financial and accounting reporting", "Stakeholder management and reporting",
    "PE/VC funded company experience", "International business", "HR oversight",
    "Legal oversight", "IT systems and cloud infrastructure oversight",
    "Digital transformation", "Sparring partner to CEOs and founders",
    "Certification programme implementations", "Tech startup fundraising",
    "AI process transformation", "AI-native company transformation",
]

_ITEM = "struct<criterion:string, detail:string, points:int>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _item(criterion, detail, points) -> Column:
    return F.struct(F.lit(criterion).alias("criterion") if isinstance(criterion, str) else criterion.alias("criterion"),
                    (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"),
                    F.lit(points).cast("int").alias("points") if isinstance(points, int)
                    else points.cast("int").alias("points"))


def _compact(items: list) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def role_rule(title, tiers=ROLE_TIERS) -> Column:
    """struct(tier, points) of the best-ranked matching tier, null when none."""
    t = F.lower(F.coalesce(_c(title), F.lit("")))
    chain = None
    for rank, tier, pts, pat in sorted(tiers):
        s = F.struct(F.lit(tier).alias("tier"), F.lit(pts).cast("int").alias("points"))
        chain = F.when(t.rlike(pat), s) if chain is None else chain.when(t.rlike(pat), s)
    return chain


def role_items(title, tiers=ROLE_TIERS) -> Column:
    r = role_rule(title, tiers)
    ded = F.when(r["points"] < 0, _item("Role tier", r["tier"], r["points"]))
    flag = F.when(r.isNull(), F.format_string(
        "Role disqualifier: %s does not match any accepted role tier", F.coalesce(_c(title), F.lit(""))))
    return F.struct(_compact([ded]).alias("deductions"),
                    F.filter(F.array(flag), lambda x: x.isNotNull()).alias("disqualifiers"))


def city_dimension(spark) -> DataFrame:
    """city_key -> (accepted, points); built from the criteria lists."""
    rows = [(c, True, 0) for c in ACCEPTED_PLACES] + [(c, True, p) for c, p in PLACE_POINTS.items()]
    return spark.createDataFrame(rows, "city_key string, accepted boolean, points int")


def city_key(city) -> Column:
    return F.lower(tx.trim_ws(tx.strip_accents(F.coalesce(_c(city), F.lit("")))))


def location_items(df: DataFrame, city_col: str, dim: DataFrame | None = None) -> DataFrame:
    """Add ``loc_deductions`` and ``loc_flags`` (R2): listed places 0, Berlin -30,
    Rio de Janeiro -15, other Brazil and anything else -> location disqualifier."""
    dim = dim if dim is not None else city_dimension(df.sparkSession)
    k = df.withColumn("_ck", city_key(city_col))
    j = k.join(dim.withColumnRenamed("city_key", "_ck"), "_ck", "left")
    brazil = F.col("_ck").contains(BRAZIL_MARK)
    flag = (F.when(F.col("accepted").isNull() & brazil,
                   F.lit("Location disqualifier: Brazilian location outside accepted areas"))
            .when(F.col("accepted").isNull(),
                  F.format_string("Location disqualifier: %s not in acceptable locations", _c(city_col))))
    ded = F.when(F.col("points") < 0, _item("Location", _c(city_col), F.col("points")))
    return (j.withColumn("loc_deductions", _compact([ded]))
             .withColumn("loc_flags", F.filter(F.array(flag), lambda x: x.isNotNull()))
             .drop("_ck", "accepted", "points"))


def industry_items(industries, preferred=None, disliked=None) -> Column:
    """Preferred industry +10 once (R3), each disliked one -10."""
    ind = F.transform(F.coalesce(_c(industries), F.array().cast("array<string>")),
                      lambda x: F.lower(tx.trim_ws(x)))
    pref = F.array(*[F.lit(x) for x in (preferred or PREFERRED_INDUSTRIES)])
    dis = F.array(*[F.lit(x) for x in (disliked or DISLIKED_INDUSTRIES)])
    first_pref = F.get(F.filter(ind, lambda x: F.array_contains(pref, x)), 0)
    add = F.when(first_pref.isNotNull(), _item("Industry", first_pref, INDUSTRY_POINTS))
    deds = F.transform(F.filter(ind, lambda x: F.array_contains(dis, x)),
                       lambda x: _item("Disliked industry", x, DISLIKE_POINTS))
    return F.struct(_compact([add]).alias("additions"), deds.alias("deductions"))


def profile_items(text, culture_pattern: str | None = None) -> Column:
    """Recruiting agency -10 and (when a pattern is given) culture -15."""
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    items = [F.when(t.rlike(AGENCY_PATTERN), _item("Recruiting agency", "", AGENCY_POINTS))]
    if culture_pattern:
        items.append(F.when(t.rlike(culture_pattern), _item("Culture", "", CULTURE_POINTS)))
    return _compact(items)


def language_points(language, level, required=None) -> Column:
    """Points for one language requirement."""
    lang = F.lower(tx.trim_ws(F.coalesce(_c(language), F.lit(""))))
    lvl = F.lower(tx.trim_ws(F.coalesce(_c(level), F.lit(""))))
    req = F.lit(True) if required is None else F.coalesce(_c(required), F.lit(True))
    german = lang.isin(*GERMAN_NAMES)
    free = lang.isin(*FREE_LANGUAGES) | lang.isin(*fixed.LANG_FRENCH) | lang.isin(*fixed.LANG_DUTCH)
    pts = (F.when(~req, 0)
           .when(german & (lvl == "b2"), GERMAN_B2_POINTS)
           .when(german & lvl.isin(*GERMAN_C1_LEVELS), GERMAN_C1_POINTS)
           .when(german | free, 0)
           .when(lvl.isin(*BASIC_LEVELS), OTHER_BASIC_POINTS)
           .otherwise(0))
    return pts.cast("int")


def language_items(reqs) -> Column:
    """Deduction items for a requirement array<struct<language, level, required>>."""
    items = F.transform(_c(reqs), lambda r: _item(
        F.concat(F.lit("Language: "), F.coalesce(r["language"], F.lit(""))),
        F.coalesce(r["level"], F.lit("")), language_points(r["language"], r["level"], r["required"])))
    return F.filter(items, lambda x: x["points"] < 0)


def competency_items(absent) -> Column:
    """-1 for each listed competency marked clearly absent, however often."""
    names = F.array(*[F.lit(c) for c in COMPETENCIES])
    return F.transform(F.filter(F.array_distinct(F.coalesce(_c(absent), F.array().cast("array<string>"))),
                                lambda x: F.array_contains(names, x)),
                       lambda x: _item("Competency absent", x, -1))


def combine(additions: list, deductions: list, flags: list) -> Column:
    """One response-shaped struct from rule outputs; score with R8 = A5."""
    def cat(arrs, t):
        return F.concat(*arrs) if arrs else F.array().cast(t)
    adds = cat(additions, f"array<{_ITEM}>")
    deds = cat(deductions, f"array<{_ITEM}>")
    score = F.greatest(F.lit(0), F.lit(fixed.SCORE_START)
                       + F.aggregate(adds, F.lit(0), lambda a, x: a + F.abs(x["points"]))
                       - F.aggregate(deds, F.lit(0), lambda a, x: a + F.abs(x["points"])))
    return F.struct(adds.alias("additions"), deds.alias("deductions"),
                    cat(flags, "array<string>").alias("disqualifiers"), score.alias("fit_score"))
