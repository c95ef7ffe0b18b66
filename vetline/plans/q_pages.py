"""Page and markdown queries: pages stand in for posting pages, documents
for converted listing documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetline.functions import text as tx
from vetline.operators import pages as pg
from vetline.plans.catalog import register
from vetline.sources.tables import table

# Stand-ins chosen to hit the invented prose (the fixed markers and section
# names target posting pages).
CUT_MARKER = " und "
SEPARATORS = ["\nThe ", "\nIn ", "\nEn "]
BLACK_HEADINGS = ["ietzte.", "and ornd.", "of."]


def decode_entities(c: Column) -> Column:
    """The five basic entities, ``&amp;`` last so it is decoded once."""
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def _dec_sql(c: str) -> str:
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{ent}', '{ch}')"
    return c


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


# ---------------------------------------------------------------- X3
@register("page_title", sql=f"""
SELECT page_id,
       {_TRIM.format(_dec_sql("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')"))} AS title
FROM pages
""")
def page_title(spark, sf_dir):
    """First ``<h1>`` text, inner tags dropped, basic entities decoded."""
    p = table(spark, sf_dir, "pages")
    raw = F.regexp_extract("html", r"(?s)<h1[^>]*>(.*?)</h1>", 1)
    return p.select("page_id", tx.trim_ws(decode_entities(F.regexp_replace(raw, "<[^>]*>", "")))
                    .alias("title"))


def _dec_sql_loose(c: str) -> str:
    """Basic entities with or without the closing semicolon, ``&amp`` last."""
    for ent, ch in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "''"), ("&amp;?", "&")):
        c = f"regexp_replace({c}, '{ent}', '{ch}', 'g')"
    return c


@register("page_title_parsed", sql=f"""
SELECT page_id,
       {_TRIM.format("regexp_replace(" + _dec_sql_loose("regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')") + ", '\\s+', ' ', 'g')")} AS title
FROM pages
""")
def page_title_parsed(spark, sf_dir):
    """Title from the page parse job (X3: first ``h1`` selector with text),
    checked against a regex reading of the first ``<h1>``."""
    parsed = pg.parse_pages(table(spark, sf_dir, "pages"))
    return parsed.select("page_id", F.col("title_sel").alias("title"))


# ---------------------------------------------------------------- X1-X8 O4 P10 P11 K12
@register("page_blocks")
def page_blocks(spark, sf_dir):
    """The page parse job (rows-only check): title candidates, company,
    description block, markdown, cards, completeness flags per page."""
    parsed = pg.parse_pages(table(spark, sf_dir, "pages"))
    return parsed.select("page_id", "title_sel", "title_anchor", "company",
                         F.length("desc_html").alias("desc_html_len"),
                         F.length("desc_md").alias("desc_md_len"),
                         "results_end", "no_results", "expected", F.size("cards").alias("n_cards"))


@register("page_listing")
def page_listing(spark, sf_dir):
    """Listing documents built from parsed pages, with fallbacks and the
    quarantine flag (rows-only check)."""
    parsed = pg.parse_pages(table(spark, sf_dir, "pages"))
    out = pg.listing_fields(parsed)
    return out.select("page_id", "url", "title", "company_final",
                      F.length("body_md").alias("body_len"), "quarantine")


# ---------------------------------------------------------------- X9 X10
def _cut_sql():
    x9 = (f"CASE WHEN strpos(text, '{CUT_MARKER}') > 0 THEN substr(text, 1, strpos(text, '{CUT_MARKER}') - 1) "
          f"ELSE text END")
    x9 = _TRIM.format(x9)
    parts = []
    for s in SEPARATORS:
        lit = s.replace("\n", "' || chr(10) || '")
        parts.append(f"WHEN strpos(x9, '{lit}') > 0 THEN "
                     + _TRIM.format(f"substr(x9, strpos(x9, '{lit}') + {len(s)})"))
    return x9, "CASE " + " ".join(parts) + " ELSE x9 END"


@register("md_cut", sql=f"""
SELECT doc_id, {_cut_sql()[1]} AS md FROM (SELECT doc_id, {_cut_sql()[0]} AS x9 FROM documents)
""")
def md_cut(spark, sf_dir):
    """Cut at a marker, then drop the preamble up to the first separator in
    list order."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", pg.cut_preamble(pg.cut_at_marker("text", CUT_MARKER), SEPARATORS)
                    .alias("md"))


# ---------------------------------------------------------------- X11
def _as_markdown(text: Column) -> Column:
    def one(line):
        n = F.length(line)
        return (F.when(n < 12, F.concat(F.lit("## "), line))
                .when(n < 25, F.concat(F.lit("### "), line)).otherwise(line))
    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


_BL = ", ".join(f"'{h}'" for h in BLACK_HEADINGS)


@register("md_sections", sql=f"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents),
l AS (SELECT doc_id, i AS pos, arr[i] AS line FROM (SELECT *, generate_subscripts(arr, 1) AS i FROM a)),
m AS (SELECT doc_id, pos, CASE WHEN length(line) < 12 THEN '## ' || line
                               WHEN length(line) < 25 THEN '### ' || line ELSE line END AS ml FROM l),
h AS (SELECT *, length(regexp_extract(ml, '^(#{{1,6}})\\s+', 1)) AS lvl,
             lower({_TRIM.format("regexp_extract(ml, '^#{1,6}\\s+(.*)', 1)")}) AS txt FROM m),
b AS (SELECT *, lvl > 0 AND txt IN ({_BL}) AS black FROM h),
r AS (SELECT *, max(CASE WHEN black THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos
                                                       ROWS UNBOUNDED PRECEDING) AS bpos FROM b),
r2 AS (SELECT r.*, bl.lvl AS blvl FROM r LEFT JOIN b bl ON bl.doc_id = r.doc_id AND bl.pos = r.bpos),
c AS (SELECT doc_id, bpos, min(pos) FILTER (WHERE lvl > 0 AND NOT black AND lvl <= blvl AND pos > bpos) AS close_pos
      FROM r2 WHERE bpos IS NOT NULL GROUP BY doc_id, bpos),
k AS (SELECT r2.* FROM r2 LEFT JOIN c ON r2.doc_id = c.doc_id AND r2.bpos = c.bpos
      WHERE NOT r2.black AND (r2.bpos IS NULL OR (c.close_pos IS NOT NULL AND r2.pos >= c.close_pos)))
SELECT d.doc_id, {_TRIM.format("coalesce(string_agg(k.ml, chr(10) ORDER BY k.pos), '')")} AS md
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id
""")
def md_sections(spark, sf_dir):
    """Short lines become headings (## under 12 characters, ### under 25);
    listed sections are stripped with the heading-level rule."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", pg.strip_sections(_as_markdown(F.col("text")), BLACK_HEADINGS)
                    .alias("md"))


# ---------------------------------------------------------------- A3
@register("expected_found", sql="""
SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS expected,
       CAST(len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS BIGINT) AS found,
       len(regexp_extract_all(html, '<li>')) <> len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS mismatch
FROM pages
""")
def expected_found(spark, sf_dir):
    """Expected count (list items) vs distinct links found, per page."""
    p = table(spark, sf_dir, "pages")
    exp = F.size(F.regexp_extract_all("html", F.lit("<li>"), 0)).cast("long")
    found = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1))).cast("long")
    return p.select("page_id", exp.alias("expected"), found.alias("found"),
                    (exp != found).alias("mismatch"))


# ---------------------------------------------------------------- P26 P27
CONTEXT_TOKENS = 24576
_PROMPT_HEAD = "Today's date is 2026-01-31.\n\nReturn ONLY a JSON object.\n\n---\n"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@register("prompt_size", sql=f"""
SELECT doc_id, CAST(floor(length({_sql_text(_PROMPT_HEAD)} || text) / 4) AS INTEGER) AS est_tokens,
       CAST(floor(length({_sql_text(_PROMPT_HEAD)} || text) / 4) > {CONTEXT_TOKENS} AS INTEGER) AS over_context
FROM documents
""")
def prompt_size(spark, sf_dir):
    """Prompt per listing document and its size estimate (characters // 4);
    prompts above the context size are flagged (P26, P27)."""
    from vetline.operators import scoring as sc
    from vetline.plans.profiles import prompt_text
    d = table(spark, sf_dir, "documents")
    est = sc.prompt_tokens(prompt_text(F.col("text"), "2026-01-31"))
    return d.select("doc_id", est.alias("est_tokens"),
                    (est > CONTEXT_TOKENS).cast("int").alias("over_context"))


# ---------------------------------------------------------------- A2
@register("links_per_page", sql="""
WITH l AS (SELECT page_id, len(list_distinct(regexp_extract_all(html, 'href="(/[^"]*)"', 1))) AS n FROM pages)
SELECT page_id, CAST(n AS BIGINT) AS n_links FROM l WHERE n > 0
UNION ALL
SELECT NULL AS page_id, CAST(sum(n) AS BIGINT) AS n_links FROM l
""")
def links_per_page(spark, sf_dir):
    """Extracted links per page (message) plus the total row (A2)."""
    from vetline.operators import intake
    p = table(spark, sf_dir, "pages")
    ids = intake.ordered_distinct_matches("html", r'href="(/[^"]*)"')
    links = p.select(F.col("page_id").cast("string").alias("origin_path"), F.explode(ids).alias("href"))
    out = intake.links_per_message(links)
    return out.select(F.col("origin_path").cast("long").alias("page_id"), F.col("n_links").cast("long"))
