"""Calendar dates in text, and their relative days.

One reader (``read_dates``) finds every date-like span of a text by an ordered list of forms; the full dates, the
anchor and the relative text are views of what it found.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from datetime import date, timedelta
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Days around the anchor within which a date belongs to the encounter.
REACH = 400
# How dates are written, in the order they are read; year, month and day are the groups y, m and d.
FORMS = (
    ("full", re.compile(r"(?<!\d)(?P<y>(?:19|20)\d{2})\s*[-/.年]\s*(?P<m>\d{1,2})\s*[-/.月]\s*(?P<d>\d{2}(?=\s*日?\s*(?:[01]\d|2[0-3])\s*[:：]\s*[0-5]\d(?!\d))|\d{1,2}(?!\d))日?")),
    ("full", re.compile(r"(?<!\d)(?P<y>(?:19|20)\d{2})(?P<m>\d{2})(?P<d>\d{2})(?!\d)")),
    ("short", re.compile(r"(?<!\d)(?P<y>\d{2})\s*[-/.]\s*(?P<m>\d{1,2})\s*[-/.]\s*(?P<d>\d{1,2})(?!\d)")),
    ("part", re.compile(r"(?<!\d)(?P<m>0[1-9]|1[0-2])[-/.](?P<d>0[1-9]|[12]\d|3[01])(?!\d)")),
)
# What dates become.
RELATIVE, OUTSIDE = "[相对日+{}]", "[非就诊日期已移除]"
#: A relative day as written, and the mask of a date that was taken out.
TOKEN_PATTERN, MASK_PATTERN = r"\[相对日\+(-?\d+)\]", r"\[(?:日期|非就诊日期已移除)\]"


class Reading(NamedTuple):
    """A date-like span: its form, and the year (None where none is written), month and day it names."""

    start: int
    end: int
    form: str
    year: int | None
    month: int
    day: int

    def in_year(self, year: int) -> date | None:
        try:
            return date(year, self.month, self.day)
        except ValueError:
            return None

    def dated(self) -> date | None:
        return None if self.year is None else self.in_year(self.year)


def read_dates(text: str) -> list[Reading]:
    """Every date-like span from the left; what an earlier form has read is blank to the later ones."""
    out: list[Reading] = []
    left = text
    for form, pattern in FORMS:
        found = [Reading(m.start(), m.end(), form, (int(g["y"]) + (2000 if form == "short" else 0)) if "y" in (g := m.groupdict()) else None, int(g["m"]), int(g["d"])) for m in pattern.finditer(left)]
        for r in found:
            left = f"{left[: r.start]}{chr(0) * (r.end - r.start)}{left[r.end :]}"
        out += found
    return sorted(out)


def explicit_dates(text: str) -> tuple[list[date], str | None]:
    """The full dates of a text in order, or why none is taken.

    ``invalid_explicit_date`` if one is no day of the calendar, ``ambiguous_year`` if what is left has a two-digit
    year or only month and day.
    """
    read = read_dates(text)
    days = [r.dated() for r in read if r.form == "full"]
    reason = "invalid_explicit_date" if None in days else "ambiguous_year" if len(days) < len(read) else None
    return ([], reason) if reason else (days, None)


def anchor_date(texts: Iterable[str]) -> date | None:
    """The first date of the latest encounter: the least within ``REACH`` days before the latest of all texts."""
    days = {d for t in texts for r in read_dates(t) if (d := r.dated())}
    return min((d for d in days if max(days) - d <= timedelta(days=REACH)), default=None)


def _relative_day(r: Reading, anchor: date) -> int | None:
    """Days from the anchor; without a written year the candidate years are ranked: soonest ahead within reach, then nearest."""
    if r.year is not None:
        return None if (d := r.dated()) is None else (d - anchor).days
    away = [(d - anchor).days for y in (-1, 0, 1) if (d := r.in_year(anchor.year + y))]
    return min(away, key=lambda n: (not 0 <= n <= REACH, abs(n)), default=None)


def relative_days(text: str, anchor: date | None) -> str:
    """``text`` with each date as its day from the anchor; far ones are masked, impossible ones stay.

    Month and day alone take the year that puts them first at or after the anchor, within reach, else the nearest,
    and are never masked.
    """
    out, last = [], 0
    for r in read_dates(text) if anchor is not None else ():
        n = _relative_day(r, anchor)
        if n is not None:
            out += [text[last : r.start], OUTSIDE if r.year is not None and abs(n) > REACH else RELATIVE.format(n)]
            last = r.end
    return "".join([*out, text[last:]])


def plain_space(text: Column) -> Column:
    """One kind of line break, single spaces, at most one empty line, nothing around."""
    t = F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("\x00"), F.lit("")), "\r\n?", "\n"), "[ \t　]+", " ")
    return F.regexp_replace(F.regexp_replace(t, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


_DATES = T.StructType([T.StructField("dates", T.ArrayType(T.DateType())), T.StructField("reason", T.StringType())])


@F.pandas_udf(_DATES)
def dates_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """``dates, reason`` of each text (see ``explicit_dates``); null texts have neither."""
    for texts in batches:
        yield pd.DataFrame([([], None) if t is None else explicit_dates(t) for t in texts], columns=["dates", "reason"])


@F.pandas_udf(T.StringType())
def relative_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for texts, anchors in batches:
        yield pd.Series([None if t is None else relative_days(t, None if pd.isna(a) else a) for t, a in zip(texts, anchors)], dtype=object)
