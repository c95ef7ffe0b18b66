"""SQL (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

SOURCE_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
tok AS MATERIALIZED (
  SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n_lang FROM tok GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n_lang) AS lang_total FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS MATERIALIZED (
  SELECT x.lang, x.source, coalesce(s.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) s USING (lang, source)),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (k.n_lang + 2)) // (l.lang_total + 2 * l.v)::HUGEINT AS q
  FROM g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT x.lang, x.source, y.source AS item, coalesce(pairs.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source),
terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM every
  UNION ALL
  SELECT lang, source, 'term', item, value::BIGINT,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT FROM terms)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def vector_codes(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Plain rounds of all distances, by rows of (vector, part, position)."""
    steps = [f"""
WITH k AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS nth, len(embedding) // {parts} AS w, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT vec_id, label, nth, (i // w) AS p, (i % w) AS i, floor(256 * embedding[i + 1]::DOUBLE)::BIGINT AS x
  FROM (SELECT *, unnest(range(len(embedding))) AS i FROM k)),
b0 AS MATERIALIZED (SELECT p, nth AS e, i, x AS c FROM x WHERE nth < {entries})"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, label, p, min(d * {entries} + e) % {entries} AS e, min(d * {entries} + e) // {entries} AS d
  FROM (SELECT x.vec_id, x.label, x.p, b.e, sum((x.x - b.c) * (x.x - b.c)) AS d
        FROM x JOIN b{r} b USING (p, i) GROUP BY x.vec_id, x.label, x.p, b.e) GROUP BY vec_id, label, p)""")
        if r < rounds:
            steps.append(f"""
b{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, b.i, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN (
    SELECT x.p, a.e, x.i, floor(sum(x.x) / count(*))::BIGINT AS c
    FROM x JOIN a{r} a USING (vec_id, p) GROUP BY x.p, a.e, x.i) m USING (p, e, i))""")
    return ",".join(steps) + f""",
codes AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
          FROM a{rounds} GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256
FROM codes
"""


SUBSTRING_DEDUP = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS key FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + k AS pos FROM (SELECT *, unnest(range(20)) AS k FROM again)),
word AS (SELECT doc_id, pos, ws[pos] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS pos FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last, sha1(h) AS x FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(x, 1 + 10 * (k // 8), 10))::BIGINT >> (35 - 5 * (k % 8))) & 31)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM g
"""


ORACLE_SQL = {"op2_substring_dedup": SUBSTRING_DEDUP, "op6_warc_archive": WARC, "op12_source_divergence": SOURCE_DIVERGENCE, "op13_vector_codes": vector_codes()}
