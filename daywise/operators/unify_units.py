"""Quantities recorded in different units, brought to the common unit of their item."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daywise.functions.unit_grammar import fold, is_unit, unit_code

#: Reference tables of items and aliases are broadcast; above this many rows that is refused.
MOST_REFERENCE_ROWS = 100_000
_NUMBER = re.compile(r"(?P<bound>[<>≤≥~≈≲≳=±]|<=|>=|ca\.?|about)?\s*(?P<num>[+-]?(?:\d{1,3}(?:[ '’  ]\d{3})+(?![\d^])(?:[.,]\d+)?|\d[\d.,]*\d|\d|[.,]\d+)(?:[eE][+-]?\d{1,3}(?!\d))?)")
_MARKED = re.compile(r"\([HLhl*!+-]{1,2}\)|[*↑↓!⇧⇩▲▼]+")
_FLAG = re.compile(r"\((?:[HLhl*!+-]{1,2})\)|[*↑↓!⇧⇩▲▼]+|(?<![^\s\d*])(?:HH?|LL?)(?=$|\s)")


class Item(NamedTuple):
    """The units of an item: code, factor, shift, lowest and highest plausible value; and the common one."""

    units: tuple[tuple[str, float, float, float, float], ...]
    common: str | None


def readings(text: str) -> tuple[list[float], str, str]:
    """The numbers a text may mean (the likelier first), its bound sign, and what stands after the number.

    The last separator of two kinds is the decimal one; of one kind, several are thousands; a single comma before
    exactly three digits is one too unless only zero stands before it. Nothing is read from a text without a digit
    at its beginning.
    """
    clean = unicodedata.normalize("NFKC", "".join(f"\x00{c}" if c in "⁰¹²³⁴⁵⁶⁷⁸⁹" else c for c in text)).strip()
    clean = clean.replace("−", "-").replace("٫", ".").replace("٬", ",")
    m = _NUMBER.match(clean.replace("\x00", "^"))
    if not m:
        return [], "", ""
    raw = m.group("num").replace(" ", "").replace("'", "").replace("’", "").replace(" ", "")
    head, mark, power = raw.partition("e") if "e" in raw else raw.partition("E")
    exponent = mark + power
    out: list[str] = []
    if "." in head and "," in head:
        decimal = max(".,", key=head.rfind)
        other = "," if decimal == "." else "."
        out.append(head.replace(other, "").replace(decimal, ".") if head.count(decimal) == 1 else head.replace(".", "").replace(",", ""))
    elif head.count(",") > 1 or head.count(".") > 1:
        out.append(head.replace(",", "").replace(".", ""))
    elif "," in head:
        whole, _, part = head.partition(",")
        if len(part) == 3 and whole.lstrip("+-").strip("0"):
            out += [whole + part, f"{whole}.{part}"]
        else:
            out.append(f"{whole}.{part}")
    elif re.fullmatch(r"[+-]?[1-9]\d{0,2}\.\d{3}", head):
        out += [head, head.replace(".", "")]
    else:
        out.append(head)
    numbers = [float(x + exponent) for x in out if x not in ("", ".", "+", "-")]
    return numbers, (m.group("bound") or ""), clean.replace("\x00", "^")[m.end() :].strip()


def _unit_texts(rest: str, flagged: bool) -> Iterator[str]:
    """The texts that may be a unit; after a number without marked result flags, then without letters that may be flags."""
    last = ""
    for flags in (_MARKED, _FLAG) if flagged else (None,):
        bare = " ".join((flags.sub(" ", rest) if flags else rest).split()).strip(",;:()[]（）【】 ")
        if bare and bare != last:
            yield bare
            last = bare


#: Marks of a unit in a text that reads as none.
_UNIT_LIKE = re.compile(r"[^\W\d_].*[/^%·]|[/^%·].*[^\W\d_]")


@functools.lru_cache(maxsize=100_000)
def _stated(text: str, codes: tuple[str, ...], flagged: bool) -> str | None:
    """The item's unit a text states, the empty text for any other unit, read or not, None for no unit."""
    shown = list(_unit_texts(text, flagged))
    for t in shown:
        code = unit_code(t, codes)
        if code:
            return code
    # After a number letters may be flags of the result: only what is left without them tells of another unit.
    left = shown[-1] if shown and (not flagged or _FLAG.sub(" ", text).strip(" ,;:()[]（）【】")) else ""
    return "" if any(c.isalpha() or c in "%°″\"" for c in left) and (is_unit(left) or _UNIT_LIKE.search(left)) else None


def name_key(text: str) -> str:
    """How names of items compare: compatibility form, single spaces, folded case."""
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


def split_item(text: str | None, names: dict[str, str]) -> tuple[str | None, str]:
    """The item's code by its longest name at the beginning of ``text``, and what follows the name."""
    if not text:
        return None, ""
    shown = " ".join(fold(text).split())
    key = shown.casefold()
    if key in names:
        return names[key], ""
    for n in range(len(key) - 1, 0, -1):
        if key[:n] in names and not (key[n].isalnum() and key[n - 1].isalnum() and key[n].isascii() and key[n - 1].isascii()):
            rest = shown[n:].strip()
            return names[key[:n]], re.sub(r"^(?:in|as|als|单位|:|：|,|，)\s*(?=\S)", "", rest).strip(" ,:，：")
    return None, ""


def resolve(item_text: str | None, value: str | None, unit: str | None, names: dict[str, str], items: dict[str, Item]):
    """``item_code, number, bound, unit_code, value_common, how`` of one observation; None for what is not known.

    ``how``: ``stated``, ``inferred`` (no unit is stated, or the stated one of the item's makes the value implausible,
    and one alone makes it plausible), ``undecided`` (none or several do, or only a unit is stated that is none of the
    item's, read or not), ``unreadable`` or ``unknown_item``.
    """
    code, tail = split_item(item_text, names)
    if code is None or code not in items:
        return None, None, None, None, None, "unknown_item"
    numbers, bound, rest = readings(value) if value else ([], "", "")
    if not numbers:
        return code, None, None, None, None, "unreadable"
    item = items[code]
    codes = tuple(u[0] for u in item.units)
    by = {u[0]: u for u in item.units}

    def common(x: float, u: str) -> float:
        return x * by[u][1] + by[u][2]

    def fits(x: float, u: str) -> bool:
        return by[u][3] <= common(x, u) <= by[u][4]

    said = [_stated(t, codes, t is rest) for t in (unit or "", rest, tail) if t]
    stated = [s for s in said if s]
    if "" in said and not stated:
        return code, numbers[0], bound, None, None, "undecided"
    for s in stated:
        if fits(numbers[0], s):
            return code, numbers[0], bound, s, common(numbers[0], s), "stated"
    for k, x in enumerate(numbers):
        fit = [u for u in codes if fits(x, u)]
        if k and stated:
            for s in stated:
                if fits(x, s):
                    return code, x, bound, s, common(x, s), "stated"
        if len(fit) == 1:
            return code, x, bound, fit[0], common(x, fit[0]), "inferred"
        if fit:
            break
    return code, numbers[0], bound, None, None, "undecided"


def reference(item_unit: DataFrame, item_alias: DataFrame) -> tuple[dict[str, str], dict[str, Item]]:
    """The fixed reference tables as dictionaries; their sizes are checked, for every task gets them."""
    units = item_unit.select("item_code", "unit_code", "factor", "shift", "is_common", "low_common", "high_common").limit(MOST_REFERENCE_ROWS + 1).collect()
    aliases = item_alias.select("alias_name", "item_code").limit(MOST_REFERENCE_ROWS + 1).collect()
    if max(len(units), len(aliases)) > MOST_REFERENCE_ROWS:
        raise ValueError(f"a reference table has more than {MOST_REFERENCE_ROWS} rows")
    grouped: dict[str, list] = {}
    for r in units:
        if r.item_code is not None and r.unit_code is not None and r.factor is not None:
            grouped.setdefault(r.item_code, []).append(r)
    items = {
        k: Item(tuple(sorted({(r.unit_code, r.factor, r.shift or 0.0, -float("inf") if r.low_common is None else r.low_common, float("inf") if r.high_common is None else r.high_common) for r in v})), next((r.unit_code for r in v if r.is_common), None))
        for k, v in grouped.items()
    }
    names = {" ".join(fold(r.alias_name).split()).casefold(): r.item_code for r in aliases if r.alias_name and r.item_code}
    return names, items


def unify_units(submissions: DataFrame, item_unit: DataFrame, item_alias: DataFrame) -> DataFrame:
    """One row per ``observation_id`` with its value in the common unit of its item.

    Columns: ``observation_id, item_code, bound, value_read, unit_code, value_common, is_common, how`` (see
    ``resolve``). Unit strings are segmented by dynamic programming over tries of prefixes, roots and exponents;
    ambiguous ones are decided by the item's own dimensions, and a stated unit that makes the value implausible
    gives way to the only plausible one. Of an observation submitted again the latest row counts (of equal times the
    greatest by item, value and unit); rows without ``observation_id`` count as one. Null, blank and unreadable
    values keep their row with null results.
    """
    names, items = reference(item_unit, item_alias)
    last = submissions.groupBy("observation_id").agg(F.max(F.struct("submitted_at", "item", "value", "unit")).alias("v")).select("observation_id", "v.item", "v.value", "v.unit")
    kind = T.StructType([T.StructField(n, t) for n, t in (("item_code", T.StringType()), ("value_read", T.DoubleType()), ("bound", T.StringType()), ("unit_code", T.StringType()), ("value_common", T.DoubleType()), ("how", T.StringType()))])

    @F.pandas_udf(kind)
    def resolved(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for item, value, unit in batches:
            yield pd.DataFrame([resolve(*row, names, items) for row in zip(item, value, unit)], columns=kind.names)

    common = [c for c in sorted((k, v.common) for k, v in items.items() if v.common)]
    is_common = F.array(*[F.concat_ws("\x00", F.lit(a), F.lit(b)) for a, b in common]) if common else F.array().cast("array<string>")
    done = last.withColumn("r", resolved("item", "value", "unit")).select("observation_id", "r.*")
    flag = F.when(F.col("unit_code").isNotNull(), F.array_contains(is_common, F.concat_ws("\x00", "item_code", "unit_code")))
    return done.select("observation_id", "item_code", "bound", "value_read", "unit_code", "value_common", flag.alias("is_common"), "how")


def recorded_elsewhere(submissions: DataFrame, item_unit: DataFrame, item_alias: DataFrame) -> DataFrame:
    """``observation_id, unit_code`` of readable observations recorded in a unit other than the common one."""
    return unify_units(submissions, item_unit, item_alias).filter("observation_id is not null and not is_common").select("observation_id", "unit_code")
