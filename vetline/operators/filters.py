"""Routing predicates: keyword exclusion, closed marker, accepted language,
language requirements (F2-F5, J5, J14, C38, C41)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions import json_fields as jf
from vetline.functions.text import trim_ws

# Leading bytes of a keyword that a keyword table is joined on, and the slots
# that these are dealt to; a name's bytes are looked at in pieces of so many.
KEYWORD_GRAM, GRAM_SLOTS, PIECE = 3, 65_521, 1 << 20


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_keyword(name, keywords: list[str]) -> Column:
    """First keyword (list order) that is a substring of lower(name), else null
    (F2, O3).  The list is a bounded configuration value inlined as an array,
    so matching stays inside whole-stage codegen with no join or shuffle."""
    kws = F.array(*[F.lit(k.strip().lower()) for k in keywords if k.strip()])
    low = F.lower(_c(name))
    return F.get(F.filter(kws, lambda k: low.contains(k)), 0)


def keyword_route(df: DataFrame, name_col: str, keywords, force: bool = False,
                  out_col: str = "matched_keyword") -> DataFrame:
    """Add the reported keyword; ``force`` bypasses the filter.

    ``keywords`` is a Python list, inlined in the plan, or a DataFrame
    ``(pos, kw)`` (from ``sources.files.read_keywords``), matched in Spark
    whatever its size (J5, ``table_keywords``).  A null name has no keyword."""
    if force:
        return df.withColumn(out_col, F.lit(None).cast("string"))
    if isinstance(keywords, list):
        return df.withColumn(out_col, first_keyword(name_col, keywords))
    hits = table_keywords(df.select(F.lower(name_col).alias("_low")), "_low", keywords, out_col)
    out = df.drop(out_col)
    return (out.join(hits, F.lower(out[name_col]) == F.col("_low"), "left")
               .select(*[out[c] for c in out.columns], out_col))


def keyword_gram(kw: Column) -> Column:
    """The first ``KEYWORD_GRAM`` bytes (a shorter keyword: all) as a number,
    with their count above them."""
    head = F.substring(kw.cast("binary"), 1, KEYWORD_GRAM)
    return F.conv(F.hex(head), 16, 10).cast("long") + F.lit(1 << 8 * KEYWORD_GRAM) * F.length(head)


def name_grams(slots: list[int], lengths: list[int]):
    """Function of a binary column: the distinct grams of ``lengths`` bytes of
    each text, from any of its bytes on, whose slot (remainder by
    ``GRAM_SLOTS``) is among ``slots``."""
    wanted = np.zeros(GRAM_SLOTS, dtype=bool)
    wanted[slots] = True
    room = 8 * KEYWORD_GRAM + 2

    def of_texts(texts: pa.Array) -> pa.Array:
        _, offsets, data = texts.buffers()
        wide = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
        off = np.frombuffer(offsets, dtype=wide)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        found = [np.zeros(0, np.int64)]
        for at in range(0, len(raw), PIECE):
            part = raw[at:at + PIECE + KEYWORD_GRAM - 1].astype(np.uint32)
            for n in lengths:
                size = max(0, min(PIECE, len(part) - n + 1))
                gram = np.full(size, n, dtype=np.uint32) << np.uint32(8 * (KEYWORD_GRAM - n))
                for i in range(n):
                    gram = (gram << np.uint32(8)) | part[i:size + i]
                hit = np.flatnonzero(wanted[gram % np.uint32(GRAM_SLOTS)])
                text = np.searchsorted(off, at + hit, side="right") - 1
                inside = at + hit + n <= off[text + 1]  # not over the end of a text
                found.append(np.unique((text[inside] << room) | gram[hit[inside]].astype(np.int64)))
        pairs = np.unique(np.concatenate(found))
        ends = np.searchsorted(pairs >> room, np.arange(len(texts) + 1))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs & ((1 << room) - 1), pa.int64()))
    return of_texts


def table_keywords(names: DataFrame, low_col: str, keywords: DataFrame, out_col: str) -> DataFrame:
    """Each distinct lower-cased name that holds a keyword, with the first one
    in list order.

    An equi-join finds the candidates: a keyword is found at its first
    ``KEYWORD_GRAM`` bytes (a shorter one at all of them), a name at those of
    its grams whose slot a keyword has.  The slots, at most ``GRAM_SLOTS``
    for each length whatever the size of the list, are fetched first; neither side is
    broadcast by force or collected, and the join emits only pairs that share a
    gram."""
    kw = (keywords.select("pos", F.lower(trim_ws("kw")).alias("_kw")).where(F.col("_kw") != "")
                  .groupBy("_kw").agg(F.min("pos").alias("pos"))
                  .withColumn("_gram", keyword_gram(F.col("_kw"))))
    of = kw.select((F.col("_gram") % GRAM_SLOTS).alias("slot"), F.shiftright("_gram", 8 * KEYWORD_GRAM).alias("n")).distinct().collect()
    low = F.col(low_col)
    grams = F.arrow_udf(name_grams(sorted({r["slot"] for r in of}), sorted({r["n"] for r in of})), "array<long>")
    cand = (names.select(low, grams(low.cast("binary")).alias("_grams")).where(F.size("_grams") > 0).distinct()
                 .select(low, F.explode("_grams").alias("_gram")))
    return (cand.join(kw, "_gram").where(low.contains(F.col("_kw")))
                .groupBy(low).agg(F.min_by("_kw", "pos").alias(out_col)))


def is_closed(body) -> Column:
    """Closed-posting marker in the lower-cased text."""
    return F.lower(_c(body)).contains(fixed.CLOSED_MARKER)


def contains_marker(body, marker: str) -> Column:
    return F.lower(_c(body)).contains(marker.lower())


def language_accepted(lang) -> Column:
    """Accepted description language (F4); pushed to Parquet as ``In``."""
    return _c(lang).isin(*fixed.ACCEPTED_LANGS)


def _in(values: list[str], c: Column) -> Column:
    return c.isin(values)


def requirements_from_variant(v) -> Column:
    """``language_requirements`` of a parsed response as
    array<struct<language, level, language_raw, level_raw, required, valid>>.

    Non-object entries are marked invalid and ignored (Q5).  ``required``
    absent counts as true; null, false, 0 and '' as false (Q23)."""
    arr = jf.variant_array(v, "language_requirements")

    def one(x):
        req = F.try_variant_get(x, "$.required", "variant")
        required = F.when(req.isNull(), F.lit(True)).otherwise(jf.truthy(req))
        lang_raw = F.try_variant_get(x, "$.language", "string")
        level_raw = F.try_variant_get(x, "$.level", "string")
        return F.struct(
            F.lower(trim_ws(F.coalesce(lang_raw, F.lit("")))).alias("language"),
            F.lower(trim_ws(F.coalesce(level_raw, F.lit("")))).alias("level"),
            lang_raw.alias("language_raw"), level_raw.alias("level_raw"),
            required.alias("required"), jf.is_object(x).alias("valid"))
    return F.transform(arr, one)


def requirements_from_struct(reqs) -> Column:
    """Typed requirement arrays (language, level, required) in the same shape."""
    def one(r):
        return F.struct(
            F.lower(trim_ws(F.coalesce(r["language"], F.lit("")))).alias("language"),
            F.lower(trim_ws(F.coalesce(r["level"], F.lit("")))).alias("level"),
            r["language"].alias("language_raw"), r["level"].alias("level_raw"),
            F.coalesce(r["required"], F.lit(True)).alias("required"),
            F.lit(True).alias("valid"))
    return F.transform(_c(reqs), one)


def requirement_offenders(reqs: Column) -> Column:
    """Entries that disqualify (F5): required, not exempt; French/Dutch at B2+;
    any other language at B1+ (exact set membership, Q4)."""
    b1_plus = fixed.LEVELS_B2_PLUS + fixed.LEVELS_B1_EXTRA

    def offends(r):
        fr_nl = _in(fixed.LANG_FRENCH + fixed.LANG_DUTCH, r["language"])
        return (r["valid"] & r["required"] & ~_in(fixed.LANG_EXEMPT, r["language"])
                & F.when(fr_nl, _in(fixed.LEVELS_B2_PLUS, r["level"]))
                   .otherwise(_in(b1_plus, r["level"])))
    return F.filter(reqs, offends)


def requirement_check(reqs: Column) -> Column:
    """struct(disqualified boolean, reason string); the first offender gives
    ``'{language} at {level} required'``."""
    off = requirement_offenders(reqs)
    first = F.get(off, 0)
    reason = F.when(first.isNotNull(), F.format_string(
        "%s at %s required",
        F.coalesce(first["language_raw"], first["language"]),
        F.coalesce(first["level_raw"], first["level"])))
    return F.struct((F.size(off) > 0).alias("disqualified"), reason.alias("reason"))
