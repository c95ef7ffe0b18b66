"""Column functions for names, stems and city codes, from built-in functions only."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetline import fixed

_INVALID_CLASS = r'[<>:"/\\|?*]'


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c) -> Column:
    """Strip leading/trailing white space (``trim`` strips spaces only)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def default_if_blank(c, default) -> Column:
    """Missing or empty -> default."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(_c(c), F.lit("")), d)


@cache
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """The accent fold (NFD, combining marks of category Mn dropped) as
    arguments of ``translate``: letters that fold to one character, then marks,
    which have no counterpart and go.  The few characters that fold to several
    come apart, Hangul syllables excepted."""
    one, marks, several = [], [], {}
    for code in range(0x80, 0x110000):
        ch = chr(code)
        if unicodedata.category(ch) == "Mn":
            marks.append(ch)
        elif not 0xD800 <= code <= 0xDFFF and not 0xAC00 <= code <= 0xD7A3:
            kept = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
            if kept != ch and len(kept) == 1:
                one.append((ch, kept))
            elif kept != ch:
                several[ch] = kept
    return "".join(x for x, _ in one) + "".join(marks), "".join(y for _, y in one), several


def _hangul_letters(c: Column) -> Column:
    """Hangul syllables as their letters, by the arithmetic of the standard."""
    lead, vowel, tail = ("".join(map(chr, range(a, a + n))) for a, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))

    def one(ch):
        k = F.ascii(ch) - 0xAC00
        letters = F.concat(F.substr(F.lit(lead), F.floor(k / 588).cast("int") + 1, F.lit(1)),
                           F.substr(F.lit(vowel), F.floor(k % 588 / 28).cast("int") + 1, F.lit(1)),
                           F.when(k % 28 > 0, F.substr(F.lit(tail), (k % 28).cast("int"), F.lit(1))).otherwise(""))
        return F.when(ch.between("\uac00", "\ud7a3"), letters).otherwise(ch)
    return F.array_join(F.transform(F.split(c, ""), one), "")


def strip_accents(c) -> Column:
    """NFD, then drop combining marks (category Mn), from built-in functions
    only, so filters and pruning pass through (same result as Python's
    ``unicodedata`` fold; checked in tests).

    Three tiers, so that a row pays for what it holds: ASCII stays, Latin letters
    go through a small table, and only texts with others meet the whole one."""
    c = _c(c)
    old, new, several = _fold_tables()
    latin_old = "".join(ch for ch in old if ord(ch) < 0x370)
    latin_new = "".join(y for x, y in zip(old, new) if ord(x) < 0x370)  # marks, without a partner, come last in old
    apart = c
    for ch, kept in several.items():
        apart = F.replace(apart, F.lit(ch), F.lit(kept))
    full = F.when(c.rlike("[" + "".join(several) + "]"), apart).otherwise(c) if several else c
    full = F.when(full.rlike("[\uac00-\ud7a3]"), _hangul_letters(full)).otherwise(full)
    return (F.when(F.octet_length(c) == F.length(c), c)
             .when(~c.rlike("[^\\x00-\u024f\u0300-\u036f]"), F.translate(c, latin_old, latin_new))
             .otherwise(F.translate(full, old, new)))


def safe_name(c) -> Column:
    """Drop characters invalid in a listing name, then trim (P5)."""
    return trim_ws(F.regexp_replace(_c(c), _INVALID_CLASS, ""))


def clean_name(c) -> Column:
    """Accent fold + invalid character drop + trim."""
    return safe_name(strip_accents(_c(c)))


def sanitize(c) -> Column:
    """Drop invalid characters, spaces -> '_', trim '_' at both ends."""
    s = F.regexp_replace(_c(c), _INVALID_CLASS, "")
    s = F.replace(s, F.lit(" "), F.lit("_"))
    return F.regexp_replace(s, r"^_+|_+$", "")


def _is_remote(c: Column) -> Column:
    return F.upper(c).isin(*fixed.REMOTE_SYNONYMS)


def city_code4(c) -> Column:
    """4-character city code; remote synonyms -> RMTE; empty -> UNKN."""
    t = trim_ws(_c(c))
    compact = F.replace(strip_accents(t), F.lit(" "), F.lit(""))
    return (F.when(_is_remote(t), F.lit(fixed.CITY_CODE4_REMOTE))
            .when(compact == "", F.lit(fixed.CITY_CODE4_EMPTY))
            .otherwise(F.upper(F.substring(compact, 1, 4))))


def city_code7(c) -> Column:
    """7-character city code; blank/remote -> REMOTE; empty -> UNKNOWN."""
    t = trim_ws(_c(c))
    compact = F.regexp_replace(strip_accents(t), r"\s+", "")
    return (F.when((t == "") | _is_remote(t), F.lit(fixed.CITY_CODE7_REMOTE))
            .when(compact == "", F.lit(fixed.CITY_CODE7_EMPTY))
            .otherwise(F.upper(F.substring(compact, 1, 7))))


def validated_city_code(c) -> Column:
    """Keep a 1-7 letter code as given (upper-cased), else derive one."""
    t = trim_ws(F.coalesce(_c(c), F.lit("")))
    return F.upper(F.when(t.rlike(r"^[A-Za-z]{1,7}$"), t).otherwise(city_code7(t)))


def format_dmy(c) -> Column:
    """``YYYYMMDD`` -> ``DD/MM/YYYY``; any other text unchanged."""
    c = _c(c)
    return F.when(c.rlike(r"^[0-9]{8}$"),
                  F.concat(F.substring(c, 7, 2), F.lit("/"), F.substring(c, 5, 2),
                           F.lit("/"), F.substring(c, 1, 4))).otherwise(c)


def email_placeholder_name(date_str, job_id) -> Column:
    """``{date}_Job_{id} - Email - LinkedIn``."""
    return F.format_string("%s_Job_%s - Email - " + fixed.DEFAULT_SOURCE,
                           _c(date_str), _c(job_id))


def card_name(date_str, title, company) -> Column:
    """``{date}_{title} - {company} - LinkedIn`` with unsafe characters dropped."""
    return F.format_string("%s_%s - %s - " + fixed.DEFAULT_SOURCE,
                           _c(date_str), safe_name(title), safe_name(company))


def canonical_url(job_id) -> Column:
    """Posting URL from its numeric id."""
    return F.concat(F.lit(fixed.CANONICAL_URL_PREFIX), _c(job_id),
                    F.lit(fixed.CANONICAL_URL_SUFFIX))


def enriched_stem(title, company, today: str) -> Column:
    """Final stem after enrichment: title cut to 60, company to 40.
    No company -> shorter form; no title -> ''."""
    t = trim_ws(F.substring(clean_name(title), 1, fixed.TITLE_CUT))
    co = trim_ws(F.substring(clean_name(company), 1, fixed.COMPANY_CUT))
    src = fixed.DEFAULT_SOURCE
    return (F.when((t != "") & (co != ""),
                   F.format_string(f"{today}_%s - %s - {src}", t, co))
            .when(t != "", F.format_string(f"{today}_%s - {src}", t))
            .otherwise(F.lit("")))


def enriched_name(name, title, company, today: str) -> Column:
    """A placeholder name gives way to the enriched stem where a title was
    found; other names stay (P9)."""
    stem = enriched_stem(title, company, today)
    return F.when(_c(name).contains(fixed.EMAIL_PLACEHOLDER_MARK) & (stem != ""), stem).otherwise(_c(name))


def parse_stem(stem) -> Column:
    """``YYYYMMDD_Title - Company - Source`` -> struct(title, company).
    Fewer than three parts -> both empty."""
    body = F.regexp_replace(_c(stem), r"^[0-9]{8}_", "")
    parts = F.split(body, " - ")
    n = F.size(parts)
    ok = n >= 3
    company = F.when(ok, trim_ws(F.element_at(parts, -2))).otherwise(F.lit(""))
    title = F.when(ok, trim_ws(F.array_join(F.slice(parts, 1, n - 2), " - "))).otherwise(F.lit(""))
    return F.struct(title.alias("title"), company.alias("company"))


def extraction_stem(date_str, code, title, company, source) -> Column:
    """Stage-05 stem ``date_CITY_title_-_company_-_source``."""
    return F.format_string("%s_%s_%s_-_%s_-_%s", _c(date_str), _c(code), sanitize(title),
                           sanitize(company), sanitize(source))


def scored_stem(ref_nr, score, date_str, code, title, company, source, client) -> Column:
    """Stage-06 stem ``ref_score_date_city_title_company_source[__client]``."""
    base = F.format_string("%04d_%03d_%s_%s_%s_%s_%s", _c(ref_nr).cast("bigint"),
                           _c(score).cast("int"), _c(date_str), _c(code), sanitize(title),
                           sanitize(company), sanitize(source))
    cl = sanitize(F.coalesce(_c(client), F.lit("")))
    named = F.when(cl != "", F.concat(base, F.lit("__"), cl)).otherwise(base)
    return F.when(_c(ref_nr).isNotNull(), named)  # a row without a ref has no stem


def restem_score(stem, new_score) -> Column:
    """Replace the score part of a stage-06 stem (P25); refs of any length."""
    parts = r"(?s)^([0-9]+)_[0-9]+_(.*)$"
    s = _c(stem)
    return F.when(s.rlike(parts), F.concat(
        F.regexp_extract(s, parts, 1), F.format_string("_%03d_", _c(new_score).cast("int")),
        F.regexp_extract(s, parts, 2)))


def url_from_markdown(md) -> Column:
    """``**URL:** http...`` in a listing document, trailing ')' stripped (P20)."""
    u = F.regexp_extract(_c(md), r"\*\*URL:\*\*\s*(https?://\S+)", 1)
    return F.regexp_replace(u, r"\)+$", "")


def shortcut_url(text, loose: bool = False) -> Column:
    """URL inside an internet-shortcut text (S4 strict, S5 loose).
    Strict: first line starting ``URL=``, rest trimmed, else null.
    Loose: first ``URL=(.+)`` anywhere, trimmed, else ''."""
    t = _c(text)
    if loose:
        return trim_ws(F.regexp_extract(t, r"URL=(.+)", 1))
    has = t.rlike(r"(?m)^URL=")
    return F.when(has, trim_ws(F.regexp_extract(t, r"(?m)^URL=(.*)$", 1)))


def relative_published_date(text, today) -> Column:
    """Publication date from ``N hour(s)/day(s)/week(s)/month(s) ago`` relative
    to ``today`` as ``yyyyMMdd``; default today (D1)."""
    t = F.lower(_c(text))
    m = F.regexp_extract(t, r"(\d+)\s+(hour|day|week|month)s?\s+ago", 0)
    n = F.regexp_extract(m, r"(\d+)", 1).try_cast("int")
    n = F.when(n <= 100_000, n)  # more than that is no age of a posting
    unit = F.regexp_extract(m, r"(hour|day|week|month)", 1)
    td = F.to_date(F.lit(today), "yyyyMMdd")
    d = (F.when(unit == "hour", F.date_sub(td, F.floor(n / 24).cast("int")))
         .when(unit == "day", F.date_sub(td, n))
         .when(unit == "week", F.date_sub(td, n * 7))
         .when(unit == "month", F.add_months(td, -n))
         .otherwise(td))
    return F.date_format(F.coalesce(d, td), "yyyyMMdd")
