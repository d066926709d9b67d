"""Numbers, units and texts as they compare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite_number(text: Column) -> Column:
    """The finite double a text or number holds, else null."""
    x = F.trim(text.cast("string")).try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def same_number(x: Column, expected: Column) -> Column:
    """Equality within a millionth of the expected value, at least of 1; null if either is."""
    return F.abs(x - expected) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(expected))


def canonical_number(text: Column) -> Column:
    """An exact decimal as text without needless zeros; other texts as they are, without outer space.

    ``<4.2`` is text and differs from ``4.2``; ``4.20`` and ``4.2`` are one.
    """
    bare = F.trim(text)
    plain = F.when(bare.rlike(r"^[+-]?\d{1,20}(\.\d{1,17})?$"), bare)
    number = plain.cast("decimal(38,17)").cast("string")
    short = F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.when(short == "-0", "0").otherwise(short), bare)


def unit_key(unit: Column) -> Column:
    """Units without space, in lower case."""
    return F.lower(F.regexp_replace(unit, r"\s+", ""))


def first_number(text: Column) -> Column:
    """The first number of a text that is no range; a comma is a decimal point, a comparison sign is passed over."""
    bare = F.regexp_replace(text, r"\d+(?:[.,]\d+)?\s*[-–~]\s*\d+(?:[.,]\d+)?", " ")
    return F.replace(F.nullif(F.regexp_extract(bare, r"(?<![\w.,])(\d+(?:[.,]\d+)?)(?![\w])", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def last_number_before(text: Column, unit_pattern: str) -> Column:
    """The last number before the unit; without a unit the last number of the text."""
    head = F.when(text.rlike(unit_pattern), F.regexp_extract(text, rf"^(.*?)(?:{unit_pattern})", 1)).otherwise(text)
    return F.try_element_at(F.regexp_extract_all(head, F.lit(r"([<>]?\d+(?:\.\d+)?)"), 1), F.lit(-1))


def row_id(*parts: Column, length: int = 16) -> Column:
    """The leading hex digits of the sha-256 of the parts joined by ``|``."""
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, length)


def grams_per_litre(value: Column, unit: Column) -> Column:
    """A mass concentration in g/L: from g/dL, g/L, mg/dL or mg/L; null for other units."""
    key = unit_key(unit)
    return F.when(key == "g/dl", value * 10).when(key == "g/l", value).when(key == "mg/dl", value / 100).when(key == "mg/l", value / 1000)


def moment_of(text: Column) -> tuple[Column, Column]:
    """The date or date-time a text names and its precision: second, minute, day, ``invalid`` or ``missing``."""
    pattern = r"(20\d{2})\s*[-/／.年]\s*(\d{1,2})\s*[-/／.月]\s*(\d{1,2})(?:\s*日)?(?:[T\s]*(\d{1,2})\s*[:：]\s*(\d{2})(?:\s*[:：]\s*(\d{2}))?)?"
    g = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    has = text.rlike(pattern)
    at = F.try_make_timestamp_ntz(g(1).cast("int"), g(2).cast("int"), g(3).cast("int"), F.coalesce(g(4), F.lit("0")).cast("int"), F.coalesce(g(5), F.lit("0")).cast("int"), F.coalesce(g(6), F.lit("0")).cast("decimal(8,6)"))
    precision = F.when(~F.coalesce(has, F.lit(False)), "missing").when(at.isNull(), "invalid").when(g(6).isNotNull(), "second").when(g(4).isNotNull(), "minute").otherwise("day")
    return F.when(has, at), precision


def day_marker(text: Column) -> Column:
    """The relative day a text names: ``day 5``, ``Tag 5``, ``第5日``, ``D+5``; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?:\b[Dd]ay |\bTag |第|D\+)(\d{1,4})", 1), F.lit("")).cast("int")


def brace_object(text: Column) -> Column:
    """The outermost ``{...}`` of a noisy text, if it is JSON; a response envelope gives its message's content first."""
    content = F.coalesce(F.get_json_object(text, "$.choices[0].message.content"), text)
    inner = F.nullif(F.regexp_extract(content, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.try_parse_json(inner).isNotNull(), inner)
