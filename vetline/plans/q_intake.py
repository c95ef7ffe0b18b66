"""Intake and early-filter queries: documents stand in for listing documents,
pages for crawled result pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions import text as tx
from vetline.operators import filters as flt
from vetline.operators import intake
from vetline.plans.catalog import register
from vetline.session import checkpoint_dir
from vetline.sources import seen
from vetline.sources.tables import table

# Keyword list aimed at the invented prose of ``documents`` (the default
# exclusion list targets job titles and would not hit it).
DOC_KEYWORDS = ["wh", "qua", "ción"]
DOC_MARKER = "que la"
TODAY = "20260131"
#: Buckets of the stored seen list, for tables of this size (the default is for billions of keys).
SEEN_BUCKETS = 16


def _kw_values() -> str:
    return ", ".join(f"({i + 1}, '{k}')" for i, k in enumerate(DOC_KEYWORDS))


def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def listings(spark, sf_dir):
    """documents as listings: dedup key = SHA-256 of the text (32 bytes
    shuffled instead of the whole text; equal texts only)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "text", F.sha2("text", 256).alias("text_key"))


def lines(spark, sf_dir, *columns):
    """Each line of each document as a listing name, with its number."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *columns, F.posexplode(F.split("text", "\n")).alias("line", "name"))


#: The same in SQL.
_LINES = """lines AS (SELECT doc_id, lang, source, unnest(a) AS name, generate_subscripts(a, 1) - 1 AS line
          FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS a FROM documents))"""


def seen_texts(spark, sf_dir):
    """Seen list = texts already assessed (documents that have a label row)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = table(spark, sf_dir, "labels").select("doc_id")
    return d.join(lab, "doc_id", "left_semi").select(F.sha2("text", 256).alias("text_key"))


def stored_seen(spark, sf_dir):
    """The same list as an earlier run left it: stored in buckets."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/seen-{uuid.uuid4().hex}"
    seen.create(spark, path, "text_key", SEEN_BUCKETS, seen_texts(spark, sf_dir))
    return seen.SeenList(spark, path)


# ---------------------------------------------------------------- flagship
@register("intake_funnel", sql=f"""
WITH docs AS (SELECT doc_id, text, lang FROM documents),
seen AS (SELECT DISTINCT d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
firsts AS (SELECT text, min(doc_id) AS first_id FROM docs GROUP BY text),
kw(pos, kw) AS (VALUES {_kw_values()}),
hit AS (SELECT d.doc_id, min(k.pos) AS pos FROM docs d JOIN kw k ON contains(lower(d.text), k.kw)
        GROUP BY d.doc_id),
routed AS (
  SELECT CASE
      WHEN s.text IS NOT NULL OR d.doc_id <> f.first_id THEN 'duplicate'
      WHEN k.kw IS NOT NULL THEN 'kw:' || k.kw
      WHEN d.lang NOT IN ({_sql_list(fixed.ACCEPTED_LANGS)}) THEN 'language'
      ELSE 'accepted' END AS outcome
  FROM docs d JOIN firsts f ON d.text = f.text
  LEFT JOIN seen s ON d.text = s.text
  LEFT JOIN hit h ON d.doc_id = h.doc_id
  LEFT JOIN kw k ON k.pos = h.pos)
SELECT outcome, count(*) AS n FROM routed GROUP BY outcome
""")
def intake_funnel(spark, sf_dir):
    """dedup vs seen + within batch (J1, W1) -> keyword (F2, in the whole text)
    -> language (F4) -> outcome counts (A1), in the stage order of the workflow.

    Routing of a row is computed map-side as an integer code (keyword
    position, -1 for a rejected language, 0 accepted); one keyed aggregation
    over documents and seen keys gives copies, seen flag and the first copy's
    code; a second, tiny aggregation counts outcomes."""
    docs = listings(spark, sf_dir)
    kws = F.array(*[F.lit(k) for k in DOC_KEYWORDS])
    kw = flt.first_keyword("text", DOC_KEYWORDS)
    code = (F.when(kw.isNotNull(), F.array_position(kws, kw).cast("int"))
            .when(~flt.language_accepted("lang"), F.lit(-1)).otherwise(F.lit(0)))
    per_key = intake.first_copy_counts(docs.withColumn("code", code), seen_texts(spark, sf_dir),
                                       "text_key", "doc_id", "code")
    first_label = (F.when(F.col("first_code") > 0,
                          F.concat(F.lit("kw:"), F.element_at(kws, F.col("first_code"))))
                   .when(F.col("first_code") == -1, F.lit("language"))
                   .otherwise(F.lit("accepted")))
    dup = F.when(F.col("seen") == 1, F.col("n_copies")).otherwise(F.col("n_copies") - 1)
    lab = F.array(F.struct(F.lit("duplicate").alias("outcome"), dup.alias("n")),
                  F.struct(first_label.alias("outcome"),
                           F.when(F.col("seen") == 1, 0).otherwise(1).cast("long").alias("n")))
    parts = per_key.select(F.inline(lab)).where(F.col("n") > 0)
    return parts.groupBy("outcome").agg(F.sum("n").cast("long").alias("n"))


# ---------------------------------------------------------------- P1 P2 A6
@register("url_ids", sql="""
WITH a AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host,
                  regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS arr FROM pages),
e AS (SELECT page_id, host, arr[i] AS href, i
      FROM (SELECT *, generate_subscripts(arr, 1) AS i FROM a)),
f AS (SELECT page_id, host, href, min(i) AS first_i FROM e GROUP BY page_id, host, href)
SELECT page_id,
       CAST(row_number() OVER (PARTITION BY page_id ORDER BY first_i) AS BIGINT) AS pos,
       host || href AS link
FROM f
""")
def url_ids(spark, sf_dir):
    """Links per page in first-seen order, duplicates dropped, made absolute."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    ids = intake.ordered_distinct_matches("html", r'href="(/[^"]*)"')
    return (p.select("page_id", host.alias("host"), F.posexplode(ids).alias("p0", "href"))
             .select("page_id", (F.col("p0") + 1).cast("long").alias("pos"),
                     F.concat("host", "href").alias("link")))


# ---------------------------------------------------------------- U1
@register("intake_union", sql="""
SELECT 'search' AS origin, page_id AS item_id, url FROM pages
UNION ALL
SELECT 'email' AS origin, doc_id AS item_id, source AS url FROM documents
""")
def intake_union(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.lit("search").alias("origin"),
                                             F.col("page_id").alias("item_id"), "url")
    d = table(spark, sf_dir, "documents").select(F.lit("email").alias("origin"),
                                                 F.col("doc_id").alias("item_id"),
                                                 F.col("source").alias("url"))
    return intake.union_intake(p, d)


# ---------------------------------------------------------------- W1
@register("dedup_first", sql="""
SELECT d.doc_id, CAST(d.doc_id = f.first_id AS INTEGER) AS is_first
FROM documents d JOIN (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text) f
  ON d.text = f.text
""")
def dedup_first(spark, sf_dir):
    docs = listings(spark, sf_dir)
    out = intake.flag_first_per_key(docs, "text_key", "doc_id")
    return out.select("doc_id", F.col("is_first").cast("int").alias("is_first"))


# ---------------------------------------------------------------- J1 J2
@register("dedup_seen", sql="""
WITH seen AS (SELECT DISTINCT d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
firsts AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text)
SELECT d.doc_id,
       CASE WHEN s.text IS NOT NULL OR d.doc_id <> f.first_id THEN 'deleted' ELSE 'moved' END AS outcome,
       CAST(s.text IS NULL AND d.doc_id = f.first_id AS INTEGER) AS is_new
FROM documents d JOIN firsts f ON d.text = f.text LEFT JOIN seen s ON d.text = s.text
""")
def dedup_seen(spark, sf_dir):
    """Against the stored, bucketed list of the texts already assessed."""
    routed = intake.dedup_against_seen(listings(spark, sf_dir), stored_seen(spark, sf_dir),
                                       key="text_key", order_col="doc_id")
    return routed.select("doc_id", "outcome", F.col("is_new").cast("int").alias("is_new"))


@register("dedup_seen_force", sql="""
WITH seen AS (SELECT DISTINCT d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
firsts AS (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text)
SELECT d.doc_id, 'moved' AS outcome,
       CAST(s.text IS NULL AND d.doc_id = f.first_id AS INTEGER) AS is_new
FROM documents d JOIN firsts f ON d.text = f.text LEFT JOIN seen s ON d.text = s.text
""")
def dedup_seen_force(spark, sf_dir):
    """Force mode: duplicates pass, only new keys are added to the seen list."""
    routed = intake.dedup_against_seen(listings(spark, sf_dir), stored_seen(spark, sf_dir),
                                       force=True, key="text_key", order_col="doc_id")
    return routed.select("doc_id", "outcome", F.col("is_new").cast("int").alias("is_new"))


# ---------------------------------------------------------------- F2 J5 O3
@register("keyword_route", sql=f"""
WITH kw(pos, kw) AS (VALUES {_kw_values()}),
{_LINES},
hit AS (SELECT d.doc_id, d.line, min(k.pos) AS pos FROM lines d JOIN kw k ON contains(lower(d.name), k.kw)
        GROUP BY d.doc_id, d.line)
SELECT d.doc_id, CAST(d.line AS INTEGER) AS line, k.kw AS matched_keyword
FROM lines d LEFT JOIN hit h ON d.doc_id = h.doc_id AND d.line = h.line LEFT JOIN kw k ON k.pos = h.pos
""")
def keyword_route(spark, sf_dir):
    """Keyword exclusion with every line of the documents as a name."""
    return flt.keyword_route(lines(spark, sf_dir), "name", DOC_KEYWORDS).select("doc_id", "line", "matched_keyword")


@register("keyword_route_table", sql=f"""
WITH kw(pos, kw) AS (SELECT row_number() OVER (ORDER BY min(doc_id)), s
                     FROM (SELECT doc_id, lower(source) AS s FROM documents) GROUP BY s),
{_LINES},
docs AS (SELECT doc_id, line, name || ' ' || source AS name FROM lines),
hit AS (SELECT d.doc_id, d.line, min(k.pos) AS pos FROM docs d JOIN kw k ON contains(lower(d.name), k.kw)
        GROUP BY d.doc_id, d.line)
SELECT d.doc_id, CAST(d.line AS INTEGER) AS line, k.kw AS matched_keyword
FROM docs d LEFT JOIN hit h ON d.doc_id = h.doc_id AND d.line = h.line LEFT JOIN kw k ON k.pos = h.pos
""")
def keyword_route_table(spark, sf_dir):
    """Keyword list as a table (S7 form) derived from the data: the distinct
    sources, in order of first appearance.  Matched against each line + source."""
    d = table(spark, sf_dir, "documents")
    kw = d.groupBy(F.lower("source").alias("kw")).agg(F.min("doc_id").alias("pos"))
    names = lines(spark, sf_dir, "source").select("doc_id", "line", F.concat("name", F.lit(" "), "source").alias("name"))
    return flt.keyword_route(names, "name", kw).select("doc_id", "line", "matched_keyword")


@register("keyword_text", sql=f"""
WITH kw(pos, kw) AS (VALUES {_kw_values()}),
hit AS (SELECT d.doc_id, min(k.pos) AS pos FROM documents d JOIN kw k ON contains(lower(d.text), k.kw)
        GROUP BY d.doc_id)
SELECT d.doc_id, k.kw AS matched_keyword
FROM documents d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN kw k ON k.pos = h.pos
""")
def keyword_text(spark, sf_dir):
    """Keyword exclusion over the whole document text instead of the name
    (the ``fields`` choice of Q3), first keyword in list order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return flt.keyword_route(d, "text", DOC_KEYWORDS).select("doc_id", "matched_keyword")


# ---------------------------------------------------------------- F3
@register("closed_marker", sql=f"""
SELECT doc_id, CAST(contains(lower(text), '{DOC_MARKER}') AS INTEGER) AS closed FROM documents
""")
def closed_marker(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", flt.contains_marker("text", DOC_MARKER).cast("int").alias("closed"))


# ---------------------------------------------------------------- F4 A1
@register("lang_accept", sql=f"""
SELECT lang, CASE WHEN lang IN ({_sql_list(fixed.ACCEPTED_LANGS)}) THEN 'accepted' ELSE 'language' END AS outcome,
       count(*) AS n
FROM documents GROUP BY 1, 2
""")
def lang_accept(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang")
    out = F.when(flt.language_accepted("lang"), F.lit("accepted")).otherwise(F.lit("language"))
    return d.groupBy("lang", out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- F5 J14
LANG_NAME = {"en": "English", "de": "Deutsch", "fr": "Français", "es": "Spanish"}
SECOND_LANG = {"en": "Dutch", "de": "Italian", "fr": "French", "es": "Polish"}


def _level_sql():
    return ("CASE WHEN d.n_chars >= 5000 THEN 'C1' WHEN d.n_chars >= 1000 THEN 'B2' "
            "WHEN d.n_chars >= 300 THEN 'B1' ELSE 'A2' END")


def _case_sql(col, mapping):
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _offend_sql(lang, level, required):
    b1 = fixed.LEVELS_B2_PLUS + fixed.LEVELS_B1_EXTRA
    fr_nl = fixed.LANG_FRENCH + fixed.LANG_DUTCH
    L, V = f"lower(trim({lang}))", f"lower(trim({level}))"
    return (f"({required} AND {L} NOT IN ({_sql_list(fixed.LANG_EXEMPT)}) AND "
            f"CASE WHEN {L} IN ({_sql_list(fr_nl)}) THEN {V} IN ({_sql_list(fixed.LEVELS_B2_PLUS)}) "
            f"ELSE {V} IN ({_sql_list(b1)}) END)")


@register("lang_req", sql=f"""
WITH r AS (
  SELECT d.doc_id,
         {_case_sql('d.lang', LANG_NAME)} AS l1, {_level_sql()} AS v1, TRUE AS q1,
         {_case_sql('d.lang', SECOND_LANG)} AS l2,
         CASE WHEN l.quality = 1 THEN 'fluent' WHEN l.quality = 0 THEN 'intermediate' ELSE 'A2' END AS v2,
         coalesce(l.toxic <> 1, TRUE) AS q2
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
o AS (SELECT *, {_offend_sql('l1', 'v1', 'q1')} AS o1, {_offend_sql('l2', 'v2', 'q2')} AS o2 FROM r)
SELECT doc_id, CAST(o1 OR o2 AS INTEGER) AS disqualified,
       CASE WHEN o1 THEN l1 || ' at ' || v1 || ' required'
            WHEN o2 THEN l2 || ' at ' || v2 || ' required' END AS reason
FROM o
""")
def lang_req(spark, sf_dir):
    """Requirement arrays built from the data (document language at a level
    from its length; a second language at a level from its label), checked
    with the F5 rules; first offender gives the reason."""
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
    chk = flt.requirement_check(flt.requirements_from_struct(reqs))
    return (d.join(lab, "doc_id", "left")
             .select("doc_id", chk.alias("c"))
             .select("doc_id", F.col("c.disqualified").cast("int").alias("disqualified"),
                     F.col("c.reason").alias("reason")))


# ---------------------------------------------------------------- P13-P15
_REMOTE = _sql_list(fixed.REMOTE_SYNONYMS)


@register("city_codes", sql=f"""
WITH w AS (SELECT unnest(regexp_split_to_array(text, '[ .,;:!?\\n]+')) AS word FROM documents),
c AS (SELECT regexp_replace(word, '^\\s+|\\s+$', '', 'g') AS city, count(*) AS n FROM w GROUP BY 1),
f AS (SELECT city, n, replace(strip_accents(city), ' ', '') AS c4,
             regexp_replace(strip_accents(city), '\\s+', '', 'g') AS c7 FROM c)
SELECT city, n,
  CASE WHEN upper(city) IN ({_REMOTE}) THEN 'RMTE' WHEN c4 = '' THEN 'UNKN'
       ELSE upper(replace(substr(c4, 1, 4), 'ß', 'SS')) END AS code4,
  CASE WHEN regexp_full_match(city, '[A-Za-z]{{1,7}}') THEN upper(city)
       WHEN city = '' OR upper(city) IN ({_REMOTE}) THEN 'REMOTE' WHEN c7 = '' THEN 'UNKNOWN'
       ELSE upper(replace(substr(c7, 1, 7), 'ß', 'SS')) END AS code7
FROM f
""")
def city_codes(spark, sf_dir):
    """City codes for each distinct word of the documents (accents, case, cut),
    with how often it occurs."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ .,;:!?\n]+")).alias("word"))
    # one shuffle: words are trimmed before the partial aggregation
    cities = words.groupBy(tx.trim_ws("word").alias("city")).agg(F.count(F.lit(1)).alias("n"))
    return cities.select("city", "n", tx.city_code4("city").alias("code4"), tx.validated_city_code("city").alias("code7"))


# ---------------------------------------------------------------- P5 P16 P17
def _sanitize_sql(c):
    return (f"regexp_replace(replace(regexp_replace({c}, '[<>:\"/\\\\|?*]', '', 'g'), ' ', '_'), "
            f"'^_+|_+$', '', 'g')")


@register("safe_names", sql=f"""
SELECT p_partkey,
       regexp_replace(regexp_replace(p_name, '[<>:"/\\\\|?*]', '', 'g'), '^\\s+|\\s+$', '', 'g') AS safe,
       {_sanitize_sql('p_name')} AS sanitized,
       '{TODAY}' || '_' || upper(substr(replace(p_type, ' ', ''), 1, 4)) || '_' || {_sanitize_sql('p_name')}
         || '_-_' || {_sanitize_sql('p_brand')} || '_-_' || {_sanitize_sql('p_type')} AS stem
FROM part
""")
def safe_names(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", tx.safe_name("p_name").alias("safe"), tx.sanitize("p_name").alias("sanitized"),
        tx.extraction_stem(F.lit(TODAY), tx.city_code4("p_type"), F.col("p_name"),
                           F.col("p_brand"), F.col("p_type")).alias("stem"))


# ---------------------------------------------------------------- W3 W4
def _slots_sql(template, first):
    """Free numbers of each stem, in order, by trying all."""
    return (f"(SELECT stem, nr, row_number() OVER (PARTITION BY stem ORDER BY nr) - 1 AS j FROM (SELECT DISTINCT stem FROM c), n "
            f"WHERE nr >= {first} AND printf('{template}', stem, nr) NOT IN (SELECT name FROM used))")


@register("collision_names", sql=f"""
WITH c AS (SELECT c_custkey, c_mktsegment || CASE c_nationkey WHEN 7 THEN ' (01)' WHEN 8 THEN '_02' ELSE '' END AS stem
           FROM customer),
t AS (SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment < 'G'
      UNION SELECT printf('%s (%02d)', c_mktsegment, c_nationkey * 3) FROM customer
      UNION SELECT printf('%s_%02d', c_mktsegment, c_nationkey * 3) FROM customer),
used AS (SELECT name FROM t UNION SELECT stem FROM c),
n AS (SELECT unnest(range((SELECT count(*) + 200 FROM customer))) AS nr),
r AS (SELECT c_custkey, stem, row_number() OVER (PARTITION BY stem ORDER BY c_custkey) - 2
             + CASE WHEN stem IN (SELECT name FROM t) THEN 1 ELSE 0 END AS j FROM c)
SELECT r.c_custkey, coalesce(printf('%s (%02d)', r.stem, p.nr), r.stem) AS name_paren,
       coalesce(printf('%s_%02d', r.stem, u.nr), r.stem) AS name_under
FROM r LEFT JOIN {_slots_sql("%s (%02d)", 0)} p ON p.stem = r.stem AND p.j = r.j
LEFT JOIN {_slots_sql("%s_%02d", 1)} u ON u.stem = r.stem AND u.j = r.j
""")
def collision_names(spark, sf_dir):
    """Market segments as stems, a few with an ending that looks like a suffix,
    against stored names that take some plain names and numbers.  A stem holds
    a fifth of the rows, so no task may hold a whole stem."""
    c = table(spark, sf_dir, "customer")
    seg, nation = F.col("c_mktsegment"), F.col("c_nationkey")
    rows = c.select("c_custkey", F.concat(seg, F.when(nation == 7, " (01)").when(nation == 8, "_02").otherwise(""))
                    .alias("stem"))
    stored = (c.where(seg < "G").select(seg.alias("stem"))
              .union(c.select(F.format_string("%s (%02d)", seg, nation * 3)))
              .union(c.select(F.format_string("%s_%02d", seg, nation * 3))).distinct())
    paren = intake.collision_suffix(rows, "stem", ["c_custkey"], "paren", stored, "name_paren")
    both = intake.collision_suffix(paren, "stem", ["c_custkey"], "under", stored, "name_under")
    return both.select("c_custkey", "name_paren", "name_under")


# ---------------------------------------------------------------- P8 P7 P9
_TRIMS = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@register("stem_parse", sql=f"""
WITH {_LINES},
s AS (SELECT doc_id, line, regexp_replace('{TODAY}_' || name || ' - ' || source || ' - LinkedIn', '^[0-9]{{8}}_', '') AS body FROM lines),
p AS (SELECT doc_id, line, string_split(body, ' - ') AS parts FROM s)
SELECT doc_id, CAST(line AS INTEGER) AS line,
       CASE WHEN len(parts) >= 3 THEN {_TRIMS.format("array_to_string(parts[1:len(parts) - 2], ' - ')")} ELSE '' END AS title,
       CASE WHEN len(parts) >= 3 THEN {_TRIMS.format("parts[len(parts) - 1]")} ELSE '' END AS company
FROM p
""")
def stem_parse(spark, sf_dir):
    """Listing names ``date_title - company - source`` from every line of the
    documents, parsed back into title and company (P8)."""
    p = tx.parse_stem(F.format_string(f"{TODAY}_%s - %s - LinkedIn", "name", "source"))
    return lines(spark, sf_dir, "source").select("doc_id", "line", p["title"].alias("title"), p["company"].alias("company"))


def _clean_sql(c, n):
    folded = f"regexp_replace(strip_accents({c}), '[<>:\"/\\\\|?*]', '', 'g')"
    return _TRIMS.format(f"substr({_TRIMS.format(folded)}, 1, {n})")


@register("enriched_stems", sql=f"""
WITH {_LINES},
c AS (SELECT doc_id, line, {_clean_sql("name", 60)} AS t,
             {_clean_sql("CASE WHEN lang = 'en' THEN source ELSE '' END", 40)} AS co FROM lines)
SELECT doc_id, CAST(line AS INTEGER) AS line, CASE WHEN t <> '' AND co <> '' THEN '{TODAY}_' || t || ' - ' || co || ' - LinkedIn'
                    WHEN t <> '' THEN '{TODAY}_' || t || ' - LinkedIn' ELSE '' END AS stem
FROM c
""")
def enriched_stems(spark, sf_dir):
    """Final names after enrichment: accents folded, unsafe characters
    dropped, title cut to 60 and company to 40 (P6, P7), with every line as a
    title; English documents carry their source as the company, the others have none."""
    company = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.lit(""))
    return lines(spark, sf_dir, "lang", "source").select("doc_id", "line", tx.enriched_stem("name", company, TODAY).alias("stem"))
