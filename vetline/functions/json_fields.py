"""Schema-loose JSON handling for model responses, JVM-side via VARIANT.

A response is free text that should hold one JSON object.  The helpers here
find it (X12), repair control characters (X13), parse it strictly (a second
object after the first is an error, as in a strict JSON reader) and read
fields with the coercions the scoring rules need (P22, P23, Q15, Q23).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetline import fixed
from vetline.functions.text import trim_ws


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(x, use) -> Column:
    """``use(x)`` with ``x`` worked out a single time, however often ``use``
    reads it.  Common expressions are found by Spark neither within lambdas nor
    within the branches of a condition."""
    return F.get(F.transform(F.array(_c(x)), use), 0)


def json_candidate(text) -> Column:
    """First ``{`` to last ``}`` across lines; '' when there is none."""
    return F.regexp_extract(_c(text), r"(?s)\{.*\}", 0)


def repair_control_chars(raw) -> Column:
    """Literal newline/tab/CR -> escapes, other control characters dropped."""
    r = F.replace(_c(raw), F.lit("\n"), F.lit("\\n"))
    r = F.replace(r, F.lit("\t"), F.lit("\\t"))
    r = F.replace(r, F.lit("\r"), F.lit("\\r"))
    return F.regexp_replace(r, r"[\x00-\x1f]", "")


def strict_parse(raw) -> Column:
    """Parse exactly one JSON value; trailing content makes it null.
    Wrapping in ``[...]`` turns the parser's lenient tail into an error, or
    into a second element (``{..},{..}``), which makes it null too."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), _c(raw), F.lit("]")))
    return once(F.try_variant_get(wrapped, "$", "array<variant>"), lambda values: F.when(F.size(values) == 1, F.get(values, 0)))


def parse_response(text) -> Column:
    """Free text -> VARIANT object or null: candidate, parse, repaired parse."""
    raw = json_candidate(text)
    return F.when(raw != "", F.coalesce(strict_parse(raw),
                                        strict_parse(repair_control_chars(raw))))


def quoted(s) -> Column:
    """A string as a JSON string."""
    listed = F.to_json(F.array(_c(s)))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


#: Objects and lists in each other are indented to this depth; deeper ones stay in one line.
PRETTY_DEPTH = 3


def pretty(v, depth: int = PRETTY_DEPTH, indent: str = "") -> Column:
    """A VARIANT as indented JSON with all its keys, two blanks a level.

    Objects and lists are taken apart level by level as maps and arrays of
    VARIANT, each a single time; text outside ASCII is kept.  Keys come in
    VARIANT order."""
    if not depth:
        return F.coalesce(F.to_json(_c(v)), F.lit("null"))
    inner = indent + "  "

    def block(opened, lines, closed):
        return F.concat(F.lit(f"{opened}\n{inner}"), F.array_join(lines, f",\n{inner}"), F.lit(f"\n{indent}{closed}"))

    def value(x, plain):
        items = F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda y: pretty(y, depth - 1, inner))
        pairs = F.transform(F.map_entries(F.try_variant_get(x, "$", "map<string,variant>")),
                            lambda e: F.concat(quoted(e["key"]), F.lit(": "), pretty(e["value"], depth - 1, inner)))
        return (F.when(plain.startswith("{") & (plain != "{}"), block("{", pairs, "}"))
                 .when(plain.startswith("[") & (plain != "[]"), block("[", items, "]")).otherwise(plain))
    # the text in one line tells what is there; only objects and lists are taken apart
    return once(v, lambda x: once(F.coalesce(F.to_json(x), F.lit("null")), lambda plain: value(x, plain)))


def parse_status(text) -> Column:
    """empty / no_json / bad_json / ok."""
    t = _c(text)
    raw = json_candidate(t)
    return (F.when(t.isNull() | (t == ""), F.lit("empty"))
            .when(raw == "", F.lit("no_json"))
            .when(parse_response(t).isNull(), F.lit("bad_json"))
            .otherwise(F.lit("ok")))


def field_str(v, name: str) -> Column:
    """String value of a key (numbers rendered as text); null when absent."""
    return F.try_variant_get(_c(v), f"$.{name}", "string")


def has_key(v, name: str) -> Column:
    return F.try_variant_get(_c(v), f"$.{name}", "variant").isNotNull()


def truthy(x: Column) -> Column:
    """Truth value of a JSON value the way a dynamic language reads it:
    null/false/0/''/[]/{} are false, anything else true."""
    t = F.schema_of_variant(x)
    return (F.when(F.is_variant_null(x), F.lit(False))
            .when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean"))
            .when(t.startswith("STRING"), F.length(F.try_variant_get(x, "$", "string")) > 0)
            .when(t.startswith("ARRAY"),
                  F.size(F.try_variant_get(x, "$", "array<variant>")) > 0)
            .when(t.startswith("OBJECT"),
                  F.size(F.try_variant_get(x, "$", "map<string,variant>")) > 0)
            .otherwise(F.coalesce(F.try_variant_get(x, "$", "double") != 0, F.lit(True))))


def is_object(x: Column) -> Column:
    return F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))


def variant_array(v, name: str) -> Column:
    """``result.get(name) or []`` as array<variant> (non-arrays -> [])."""
    a = F.try_variant_get(_c(v), f"$.{name}", "array<variant>")
    return F.coalesce(a, F.array().cast("array<variant>"))


def _element_text(x: Column) -> Column:
    return F.coalesce(F.try_variant_get(x, "$", "string"), F.lit(""))


def int_value(x: Column) -> Column:
    """Integer conversion of a JSON value the way a dynamic language's int()
    does it, independent of the session's ANSI setting: booleans -> 0/1,
    numbers truncated toward zero, strings only when they spell a whole
    integer (spaces and a sign allowed), anything else null (Q15)."""
    def convert(x, t):
        s = F.try_variant_get(x, "$", "string")
        whole = F.coalesce(s.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.lit(False))
        num = F.try_variant_get(x, "$", "double")
        return (F.when(t == "BOOLEAN", F.try_variant_get(x, "$", "boolean").cast("int"))
                .when(t.startswith("STRING"), F.when(whole, trim_ws(s).try_cast("int")))
                .when(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"),
                      F.when(num.isNotNull(), num.try_cast("int"))))
    return once(x, lambda v: once(F.schema_of_variant(v), lambda t: convert(v, t)))


def breakdown_raw(v, name: str, sign: int) -> Column:
    """``additions`` / ``deductions`` as array<struct<criterion, detail, points>>.

    Non-object entries become ``{points 0, criterion <text>, detail ''}`` (P23).
    Points: integer conversion of the value, absolute, signed by ``sign``; an
    unconvertible or missing value is 0 (P22, Q15)."""
    arr = variant_array(v, name)

    def to_item(x, obj):
        pts = F.coalesce(F.abs(int_value(F.try_variant_get(x, "$.points", "variant"))), F.lit(0))
        pts = pts if sign > 0 else -pts
        crit = F.when(obj, F.coalesce(F.try_variant_get(x, "$.criterion", "string"), F.lit("")))
        crit = F.coalesce(crit, _element_text(x))
        detail = F.when(obj, F.coalesce(F.try_variant_get(x, "$.detail", "string"), F.lit("")))
        return F.struct(crit.alias("criterion"), F.coalesce(detail, F.lit("")).alias("detail"),
                        F.when(obj, pts).otherwise(F.lit(0)).alias("points"))

    return F.transform(arr, lambda x: once(is_object(x), lambda obj: to_item(x, obj)))


def apply_once(items: Column) -> Column:
    """Only the first addition whose criterion contains ``industr`` counts;
    later ones get 0 points and a note (A5)."""
    industry = lambda it: F.lower(it["criterion"]).contains(fixed.ONCE_ONLY_CRITERION)

    def one(it, i, first):
        dup = industry(it) & (i + 1 > first)
        return F.struct(
            it["criterion"].alias("criterion"),
            F.when(dup, F.concat(it["detail"], F.lit(fixed.ONCE_ONLY_NOTE))).otherwise(it["detail"]).alias("detail"),
            F.when(dup, F.lit(0)).otherwise(it["points"]).alias("points"))

    first_once = F.array_position(F.transform(items, industry), True)  # 1-based, 0 when none
    return once(first_once, lambda first: F.transform(items, lambda it, i: one(it, i, first)))


def breakdown_items(v, name: str, sign: int) -> Column:
    items = breakdown_raw(v, name, sign)
    return apply_once(items) if sign > 0 else items


def sum_points(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda acc, it: acc + it["points"])


def fit_score(additions: Column, deductions: Column) -> Column:
    """max(0, 100 + additions + deductions), no ceiling."""
    return F.greatest(F.lit(0), F.lit(fixed.SCORE_START) + sum_points(additions) + sum_points(deductions))


def string_array(v, name: str) -> Column:
    a = F.try_variant_get(_c(v), f"$.{name}", "array<string>")
    return F.coalesce(a, F.array().cast("array<string>"))


def any_flag(flags: Column, prefix: str) -> Column:
    """Any entry starting with ``prefix`` ignoring case."""
    return F.exists(flags, lambda d: F.lower(F.coalesce(d, F.lit(""))).startswith(prefix))


def eight_digits_or(c: Column, default) -> Column:
    t = trim_ws(c)
    d = default if isinstance(default, Column) else F.lit(default)
    return F.when(F.coalesce(t.rlike(r"^[0-9]{8}$"), F.lit(False)), t).otherwise(d)
