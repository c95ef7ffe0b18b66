"""Criteria text as a table of rules, and the rules applied to texts.

Users edit the criteria as plain text, so the rules are read from it:

    # CRITERION 1 — TARGET ROLES          names the criterion; other # lines are comments
    DISCOUNTED TITLES — deduct 10 points  a section, with the effect of its phrases
      - Chief of Staff / Fractional CFO   phrases, told apart by " / "; (notes) are left out
      Berlin, Germany: deduct 30 points   a phrase with an effect of its own
    OUT OF SCOPE — HARD DISQUALIFIER:     texts of this criterion that match no phrase are flagged

Effects: ``add N points``, ``deduct N points``, ``no deduction``, ``neutral``,
``HARD DISQUALIFIER``; ``ONCE`` counts a section once however many phrases
match.  A criterion with an out-of-scope section grades: the longest phrase
found decides alone (ties: the earlier line); else every phrase found counts.

A rule is matched by its words, one after another, without regard to case.
Rules meet texts by an equi-join on a rule's first word, so neither the rules
nor the texts are broadcast by force and no pair is made that shares no word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetline.functions import text as tx

_EFFECT = r"(?i)(add|deduct) +([0-9]+) +points?|no deduction|neutral|hard disqualifier"
_RULE_KEYS = ["criterion", "section"]
#: What separates words: all but letters, digits and the signs of names such as C#, M&A, S.A.
_NOT_WORD = r"[^\p{L}\p{N}#&+]+"


def words_of(text) -> Column:
    """Lower-cased words of a text, one blank between and around them."""
    c = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _NOT_WORD, " ")), F.lit(" "))


def parse_criteria(criteria: DataFrame, text_col: str = "criteria", by: list[str] | None = None) -> DataFrame:
    """``pos, criterion, section, phrase, points, once, flag`` of criteria texts
    (one row a text, told apart by the columns ``by``).

    ``flag`` rows stand for an out-of-scope section and have no phrase.  The
    criterion and the section are carried down the lines by a window over a
    text, which is as long as a text that people edit."""
    by = by or []
    lines = criteria.select(*by, F.posexplode(F.split(text_col, r"\r?\n")).alias("pos", "line"))
    line, body = F.col("line"), F.col("_body")
    name = F.regexp_extract("line", r"^#\s*CRITERION\s+\S+\s+—\s+(.+?)\s*$", 1)
    head = F.regexp_extract("line", r"^([^\s#:—-][^:—]*?)\s+—\s+(.+)$", 1)
    rows = lines.withColumn("_name", F.nullif(name, F.lit(""))).withColumn("_head", F.nullif(head, F.lit("")))
    rows = rows.withColumn("_effect", F.regexp_extract("line", r"—\s+(.+)$", 1))
    carried = Window.partitionBy(*by).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    section = F.struct(F.col("_head").alias("head"), F.col("_effect").alias("effect"))
    rows = (rows.withColumn("criterion", F.last("_name", ignorenulls=True).over(carried))
            .withColumn("_section", F.last(F.when(F.col("_head").isNotNull() | F.col("_name").isNotNull(), section), ignorenulls=True).over(carried)))
    bullet = F.regexp_extract("line", r"^\s+(?:-|[0-9]+\.)\s+(.+)$", 1)
    inline = F.regexp_extract("line", rf"^\s+([^:#-][^:]*):\s*(?:{_EFFECT}).*$", 1)
    rows = (rows.withColumn("_inline", F.when(inline != "", inline)).withColumn("_bullet", F.when(bullet != "", bullet))
            .withColumn("_body", F.when(F.col("_inline").isNotNull(), F.regexp_extract("line", r":\s*(.+)$", 1)).otherwise(F.col("_section.effect"))))
    sign = F.when(F.lower(F.regexp_extract(body, _EFFECT, 1)) == "add", 1).otherwise(-1)
    points = F.coalesce(F.nullif(F.regexp_extract(body, _EFFECT, 2), F.lit("")).cast("int") * sign, F.lit(0))
    flagging = F.coalesce(F.lower(body).contains("hard disqualifier"), F.lit(False))
    rows = rows.select(*by, "pos", "criterion", F.col("_section.head").alias("section"), "_head", "_inline", "_bullet", points.alias("points"),
                       F.coalesce(body.contains("ONCE"), F.lit(False)).alias("once"), flagging.alias("flag"),
                       F.coalesce(body.rlike(_EFFECT), F.lit(False)).alias("_known"))
    # a flagging section is one rule; a flagging place of its own is a phrase that flags
    flags = rows.where(F.col("_head").isNotNull() & F.col("flag")).withColumn("phrase", F.lit(None).cast("string"))
    listed = (rows.where(F.col("_head").isNull() & F.col("_known") & F.coalesce("_inline", "_bullet").isNotNull()
                         & (F.col("_inline").isNotNull() | ~F.col("flag")))
              .withColumn("phrase", F.explode(F.split(F.regexp_replace(F.coalesce("_inline", "_bullet"), r"\([^)]*\)", " "), r"\s/\s")))
              .withColumn("phrase", F.trim(words_of("phrase"))).where(F.col("phrase") != ""))
    keep = [*by, "pos", *_RULE_KEYS, "phrase", "points", "once", "flag"]
    return listed.select(*keep).unionByName(flags.select(*keep))


def matches(texts: DataFrame, key: str, columns: dict[str, str], rules: DataFrame) -> DataFrame:
    """``key, criterion, section, pos, phrase, points, once, flag``: the rules found
    in each row; ``columns`` names the text column of each criterion."""
    parts = [texts.select(key, F.lit(c).alias("criterion"), words_of(col).alias("_words")) for c, col in columns.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    firsts = rows.withColumn("_first", F.explode(F.array_distinct(F.split(F.trim("_words"), " "))))
    phrases = rules.where(F.col("phrase").isNotNull()).withColumn("_first", F.element_at(F.split("phrase", " "), 1))
    found = firsts.join(phrases, ["criterion", "_first"]).where(F.col("_words").contains(F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))))
    return found.select(key, *_RULE_KEYS, "pos", "phrase", "points", "once", "flag")


def _flag(criterion) -> Column:
    """How a disqualifier of a criterion begins; routing knows roles and locations."""
    low = F.lower(criterion)
    return F.concat(F.when(low.contains("role"), "Role").when(low.contains("location"), "Location").otherwise(F.initcap(low)), F.lit(" disqualifier: "))


def apply_rules(texts: DataFrame, key: str, columns: dict[str, str], rules: DataFrame) -> DataFrame:
    """``key, additions, deductions, disqualifiers`` of each row, response-shaped
    (``scoring`` scores and routes them like a model's).

    A row's items are at most as many as the rules, so they are collected."""
    graded = rules.where(F.col("flag") & F.col("phrase").isNull()).select("criterion", F.lit(True).alias("_graded")).distinct()
    found = matches(texts, key, columns, rules).join(graded, "criterion", "left")
    by_length = F.struct(F.length("phrase").alias("l"), (-F.col("pos")).alias("p"))
    value = F.struct("pos", "phrase", "section", "points", "flag")
    grading = found.where("_graded").groupBy(key, "criterion").agg(F.max_by(value, by_length).alias("v"))
    once = found.where("_graded is null and once").groupBy(key, *_RULE_KEYS).agg(F.min(value).alias("v"))
    each = found.where("_graded is null and not once").groupBy(key, *_RULE_KEYS, "phrase").agg(F.min(value).alias("v"))
    hits = grading.select(key, "criterion", "v").unionByName(once.select(key, "criterion", "v")).unionByName(each.select(key, "criterion", "v"))
    hits = hits.select(key, "criterion", "v.*")
    item = F.struct(F.col("phrase").alias("criterion"), F.col("section").alias("detail"), F.col("points").alias("points"))
    counted = hits.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("points") > 0, item))).alias("additions"),
        F.array_sort(F.collect_list(F.when((F.col("points") < 0), item))).alias("deductions"),
        F.collect_set("criterion").alias("_in_scope"),
        F.array_sort(F.collect_list(F.when(F.col("flag"), F.concat(_flag(F.col("criterion")), "phrase")))).alias("_flags"))
    out_of = [F.struct(F.lit(c).alias("criterion"), F.col(col).alias("text")) for c, col in columns.items()]
    scopes = graded.agg(F.collect_list("criterion").alias("_scopes"))  # one row: the graded criteria
    out = texts.select(key, F.array(*out_of).alias("_texts")).join(counted, key, "left").join(F.broadcast(scopes))
    empty = F.array().cast("array<struct<criterion:string,detail:string,points:int>>")
    none = F.array().cast("array<string>")
    missed = F.transform(F.filter("_texts", lambda t: F.array_contains("_scopes", t["criterion"]) & ~F.array_contains(F.coalesce("_in_scope", none), t["criterion"])),
                         lambda t: F.concat(_flag(t["criterion"]), F.coalesce(t["text"], F.lit("")), F.lit(" does not match any accepted tier")))
    return out.select(key, F.coalesce("additions", empty).alias("additions"), F.coalesce("deductions", empty).alias("deductions"),
                      F.concat(F.coalesce("_flags", none), missed).alias("disqualifiers"))
