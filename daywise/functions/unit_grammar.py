"""Unit strings segmented into multipliers, prefixes, roots and exponents."""

from __future__ import annotations

import functools
import unicodedata
from typing import NamedTuple

# Powers of ten of prefixes by their spellings.
PREFIXES = {
    "m": -3, "milli": -3, "毫": -3, "u": -6, "μ": -6, "mc": -6, "micro": -6, "mikro": -6, "微": -6, "n": -9, "nano": -9, "纳": -9,
    "p": -12, "pico": -12, "皮": -12, "f": -15, "k": 3, "kilo": 3, "千": 3, "M": 6, "mega": 6, "G": 9, "giga": 9, "T": 12, "tera": 12,
    "d": -1, "deci": -1, "dezi": -1, "分": -1, "c": -2, "centi": -2, "zenti": -2, "厘": -2, "h": 2, "hecto": 2, "da": 1,
}
# Powers of ten that count particles, alone or before a root.
MULTIPLIERS = {
    "thou": 3, "thousand": 3, "tsd": 3, "tausend": 3, "k": 3, "kilo": 3, "千": 3, "wan": 4, "万": 4, "萬": 4, "mio": 6, "mill": 6, "million": 6,
    "百万": 6, "亿": 8, "g": 9, "giga": 9, "t": 12, "tera": 12,
}
# Roots by their spellings: kind, power of ten against the kind's base, and whether prefixes may stand before.
ROOTS = {
    "g": ("gram", 0, True), "gm": ("gram", 0, True), "gr": ("gram", 0, False), "gram": ("gram", 0, True), "grams": ("gram", 0, True), "gramm": ("gram", 0, True), "gramme": ("gram", 0, True), "克": ("gram", 0, True),
    "公斤": ("gram", 3, False), "lb": ("pound", 0, False), "lbs": ("pound", 0, False), "pound": ("pound", 0, False), "pounds": ("pound", 0, False), "磅": ("pound", 0, False),
    "mol": ("mole", 0, True), "mole": ("mole", 0, True), "moles": ("mole", 0, True), "摩尔": ("mole", 0, True), "摩": ("mole", 0, True), "M": ("molar", 0, True),
    "eq": ("equivalent", 0, True), "val": ("equivalent", 0, True), "当量": ("equivalent", 0, True),
    "l": ("litre", 0, True), "L": ("litre", 0, True), "litre": ("litre", 0, True), "litres": ("litre", 0, True), "liter": ("litre", 0, True), "liters": ("litre", 0, True), "升": ("litre", 0, True), "公升": ("litre", 0, False), "cc": ("litre", -3, False), "ccm": ("litre", -3, False),
    "floz": ("ounce", 0, False), "fl oz": ("ounce", 0, False), "fl. oz": ("ounce", 0, False), "fl. oz.": ("ounce", 0, False), "ounce": ("ounce", 0, False), "ounces": ("ounce", 0, False), "oz": ("ounce", 0, False), "盎司": ("ounce", 0, False),
    "m": ("metre", 0, True), "metre": ("metre", 0, True), "metres": ("metre", 0, True), "meter": ("metre", 0, True), "meters": ("metre", 0, True), "米": ("metre", 0, True), "公分": ("metre", -2, False), "公尺": ("metre", 0, False),
    "in": ("inch", 0, False), "inch": ("inch", 0, False), "inches": ("inch", 0, False), "zoll": ("inch", 0, False), '"': ("inch", 0, False), "''": ("inch", 0, False), "英寸": ("inch", 0, False), "寸": ("inch", 0, False), "吋": ("inch", 0, False),
    "mmHg": ("mercury", 0, False), "mm Hg": ("mercury", 0, False), "Torr": ("mercury", 0, False), "毫米汞柱": ("mercury", 0, False), "Pa": ("pascal", 0, True), "pascal": ("pascal", 0, True), "帕": ("pascal", 0, True), "帕斯卡": ("pascal", 0, True),
    "°C": ("celsius", 0, False), "C": ("celsius", 0, False), "degC": ("celsius", 0, False), "deg C": ("celsius", 0, False), "celsius": ("celsius", 0, False), "degrees celsius": ("celsius", 0, False), "摄氏度": ("celsius", 0, False), "度": ("celsius", 0, False), "Grad": ("celsius", 0, False), "Grad C": ("celsius", 0, False),
    "°F": ("fahrenheit", 0, False), "F": ("fahrenheit", 0, False), "degF": ("fahrenheit", 0, False), "deg F": ("fahrenheit", 0, False), "fahrenheit": ("fahrenheit", 0, False), "degrees fahrenheit": ("fahrenheit", 0, False), "华氏度": ("fahrenheit", 0, False),
    "K": ("kelvin", 0, False), "kelvin": ("kelvin", 0, False), "°K": ("kelvin", 0, False), "开尔文": ("kelvin", 0, False), "开": ("kelvin", 0, False),
    "cell": ("count", 0, False), "cells": ("count", 0, False), "zellen": ("count", 0, False), "pt": ("count", 0, False), "part": ("count", 0, False), "particles": ("count", 0, False), "partikel": ("count", 0, False), "个": ("count", 0, False), "個": ("count", 0, False), "#": ("count", 0, False),
    "%": ("percent", 0, True),
    "U": ("unit", 0, True), "unit": ("unit", 0, False), "units": ("unit", 0, False), "E": ("unit", 0, False), "IU": ("international unit", 0, True), "UI": ("international unit", 0, True), "IE": ("international unit", 0, True), "单位": ("unit", 0, False), "国际单位": ("international unit", 0, False), "kat": ("katal", 0, True), "osm": ("osmole", 0, True),
    "s": ("second", 0, True), "sec": ("second", 0, True), "sek": ("second", 0, False), "second": ("second", 0, False), "seconds": ("second", 0, False), "秒": ("second", 0, False), "min": ("minute", 0, False), "minute": ("minute", 0, False), "minutes": ("minute", 0, False), "分钟": ("minute", 0, False),
    "h": ("hour", 0, False), "hr": ("hour", 0, False), "hrs": ("hour", 0, False), "hour": ("hour", 0, False), "hours": ("hour", 0, False), "std": ("hour", 0, False), "stunde": ("hour", 0, False), "小时": ("hour", 0, False), "d": ("day", 0, False), "day": ("day", 0, False), "days": ("day", 0, False), "tag": ("day", 0, False), "天": ("day", 0, False), "日": ("day", 0, False),
    "beat": ("beat", 0, False), "beats": ("beat", 0, False), "次": ("beat", 0, False), "breath": ("breath", 0, False), "breaths": ("breath", 0, False), "Bq": ("becquerel", 0, True), "J": ("joule", 0, True), "cal": ("calorie", 0, True), "V": ("volt", 0, True),
}
# Units written as one word that stand for a quotient.
QUOTIENTS = {"bpm": "beats/min", "rpm": "breaths/min", "ppm": "mg/kg"}
SEPARATORS = ("/", " per ", " pro ", "每", "·", "*", "•", "⋅", ".", " ", "_")
OVER = frozenset(("/", " per ", " pro ", "每"))
#: Words before a length that raise it, and exponents behind a root.
RAISING = {"cubic ": 3, "立方": 3, "square ": 2, "平方": 2}
EXPONENTS = (("^-1", -1), ("-1", -1), ("^-2", -2), ("-2", -2), ("^2", 2), ("2", 2), ("^3", 3), ("3", 3))


class Unit(NamedTuple):
    """A product of roots, each with its exponent and power of ten, in order, and a power of ten no root has taken.

    Powers stay with their roots, as two units of an item may be one quantity written in two ways (10^9/L, 10^3/uL).
    """

    factors: tuple[tuple[str, int, int], ...]
    power: int

    def times(self, kind: str, exponent: int, power: int) -> Unit:
        taken = self.power if exponent > 0 else 0
        return Unit(tuple(sorted((*self.factors, (kind, exponent, power + taken)))), self.power - taken)


class _State(NamedTuple):
    """What has been read: the unit so far, whether a stroke has been passed, whether a factor must or may come next, and by what a length is raised."""

    unit: Unit
    under: bool
    opened: bool
    begun: bool
    raised: int


class Trie:
    """Spellings by their characters; matches give every spelling that begins at a place."""

    def __init__(self, words: dict[str, object]):
        self.root: dict = {}
        for w, v in words.items():
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = v

    def match(self, text: str, at: int):
        node = self.root
        while True:
            if "" in node:
                yield at, node[""]
            if at >= len(text) or text[at] not in node:
                return
            node = node[text[at]]
            at += 1


def _both(words: dict) -> dict:
    """Spellings as listed (value, True) and folded (value, False)."""
    out: dict[str, list] = {}
    for w, v in words.items():
        out.setdefault(w, []).append((v, True))
        for x in {w.lower(), w.upper(), w.capitalize()} - {w}:
            out.setdefault(x, []).append((v, False))
    return out


@functools.lru_cache(maxsize=1)
def _tries() -> tuple[Trie, Trie, Trie]:
    return Trie(_both(PREFIXES)), Trie(_both(MULTIPLIERS)), Trie(_both(ROOTS))


SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻", "0123456789+-")


def fold(text: str) -> str:
    """One spelling of signs: superscripts as ``^n``, compatibility forms, one minus, one micro, single spaces."""
    out: list[str] = []
    for c in text:
        if c in "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻":
            if not out or not out[-1].startswith("^"):
                out.append("^")
            out[-1] += c.translate(SUPER)
        else:
            out.append("°" if c in "º˚" else unicodedata.normalize("NFKC", c))
    text = "".join(out)
    for a, b in (("µ", "μ"), ("−", "-"), ("–", "-"), ("×", "x"), ("″", '"'), ("”", '"'), ("“", '"'), ("′′", '"'), ("∕", "/"), ("⁄", "/"), ("℉", "°F"), ("℃", "°C")):
        text = text.replace(a, b)
    return " ".join(text.split())


def _power(text: str, at: int):
    """A power of ten such as 10^9, x10E9, 10*9, 10e4 that begins at ``at``: its end and exponent."""
    i = at
    if i < len(text) and text[i] in "xX*":
        i += 1
        while i < len(text) and text[i] == " ":
            i += 1
    if text[i : i + 2] != "10":
        return None
    i += 2
    for sign in ("^", "E", "e", "*", "**", ""):
        if text.startswith(sign, i):
            j = i + len(sign)
            k = j
            while k < len(text) and text[k].isdigit() and k - j < 2:
                k += 1
            if k > j:
                return k, int(text[j:k])
    return None


def _number(text: str, at: int):
    """A plain number that begins at ``at``: its end and spelling."""
    k = at
    while k < len(text) and (text[k].isdigit() or text[k] in ".," and k > at and text[k + 1 : k + 2].isdigit()):
        k += 1
    return (k, text[at:k].replace(",", ".")) if k > at else None


def segmentations(text: str) -> list[tuple[float, Unit]]:
    """The ways ``text`` reads as a unit, best first, by dynamic programming over its positions.

    A state is what has been read (``_State``): any number of factors over and under the stroke, each a prefix, a root
    and an exponent, behind a power of ten. Each extension is a spelling in a trie; every state of a place is extended.
    Spellings in another case than listed cost, as do symbols beside words and unused marks.
    """
    text = fold(text)
    if not text:
        return []
    text = QUOTIENTS.get(text.lower(), text)
    prefixes, multipliers, roots = _tries()
    n, low = len(text), text.lower()
    empty = Unit((), 0)
    layers: list[dict[_State, float]] = [{} for _ in range(n + 1)]
    layers[0][_State(empty, False, True, False, 1)] = 0.0

    def put(at: int, state: _State, score: float) -> None:
        if score > layers[at].get(state, -1e9):
            layers[at][state] = score

    for i in range(n):
        if not layers[i]:
            continue
        heads = [(i, 0, 0.0)]
        for to, found in prefixes.match(text, i):
            heads += [(to, power, (0.0 if exact else -0.6) - 0.1) for power, exact in found]
        # Every root that can begin here, with its prefix and exponent.
        steps = []
        for at, power, cost in heads:
            for to, found in roots.match(text, at):
                for (kind, base, prefixed), exact in found if to > at else ():
                    if at > i and not prefixed or not exact and to - at == 1 and kind in SHORT:
                        continue
                    ends = [(to, 1, 0.0)] + [(to + len(e), v, 0.2) for e, v in EXPONENTS if text.startswith(e, to)]
                    steps += [(end, kind, power + base, e, cost + (to - at) * 0.05 - (0.0 if exact else 0.4) + gain) for end, e, gain in ends]
        for (unit, under, opened, begun, raised), s in list(layers[i].items()):
            for sep in SEPARATORS:
                if text.startswith(sep, i):
                    if sep not in OVER:
                        put(i + len(sep), _State(unit, under, True, begun, raised), s - 0.3)
                    elif raised == 1 and not (under and opened):
                        put(i + len(sep), _State(unit, True, True, begun, 1), s)
            if not begun and low.startswith("per ", i):
                put(i + 4, _State(unit, True, True, True, 1), s)
            if not begun and not under:
                if (p := _power(text, i)) is not None:
                    put(p[0], _State(Unit((), p[1]), False, True, True, 1), s + 1)
                for to, found in multipliers.match(text, i):
                    for power, exact in found:
                        put(to, _State(Unit((), power), False, True, True, 1), s - (0 if exact else 0.2) - 1.0)
            if len(unit.factors) == 1 and unit.factors[0][:2] == ("gram", 1) and not under and not opened and text[i] == "%":  # g%, mg%: grams in a decilitre
                put(i + 1, _State(unit.times("litre", -1, -1), True, False, True, 1), s)
            if not opened:
                continue
            for word, by in RAISING.items():
                if low.startswith(word, i) and raised == 1:
                    put(i + len(word), _State(unit, under, True, begun, by), s)
            if under and (number := _number(text, i)) is not None:
                put(number[0], _State(unit.times(number[1], -1, 0), under, True, True, raised), s - 0.1)
            for end, kind, total, exponent, score in steps:
                if raised != 1:
                    if kind != "metre" or exponent != 1:
                        continue
                    exponent = raised
                elif exponent < 0 and (under or not (unit.factors or unit.power)):
                    continue
                sign = -1 if under else 1
                if kind == "metre" and exponent in (3, -3):
                    fresh = unit.times("litre", sign * exponent // 3, 3 * total + 3)
                elif kind == "molar":
                    fresh = unit.times("mole", sign * exponent, total).times("litre", -sign * exponent, 0)
                else:
                    fresh = unit.times(kind, sign * exponent, total)
                put(end, _State(fresh, under or exponent < 0, False, True, 1), s + score)
    out: dict[Unit, float] = {}
    for (unit, _, opened, _, _), s in layers[n].items():
        if opened or not unit.factors:
            continue
        if all(e < 0 for _, e, _ in unit.factors):
            unit = unit.times("count", 1, 0)
        out[unit] = max(out.get(unit, -1e9), s)
    return sorted(((s, u) for u, s in out.items()), key=lambda v: (-v[0], v[1]))


#: Roots of one letter that are only read as listed.
SHORT = frozenset(("unit", "second", "hour", "day", "volt", "joule"))


@functools.lru_cache(maxsize=512)
def code_unit(code: str) -> Unit | None:
    """The unit a code such as ``g_per_dL`` names."""
    found = segmentations(code.replace("_per_", " per ").replace("per_", "per ").replace("_", " "))
    return found[0][1] if found else None


def unit_code(text: str, codes: tuple[str, ...]) -> str | None:
    """The one of an item's ``codes`` that ``text`` states.

    Field prior: of all segmentations the best that is one of the item's own units; the same letters so read as
    giga per litre for a count and as gram per litre for a mass.
    """
    by_unit = {code_unit(c): c for c in codes}
    for _, u in segmentations(text):
        if u in by_unit:
            return by_unit[u]
    return None


def is_unit(text: str) -> bool:
    """Whether ``text`` reads as a unit at all."""
    return bool(segmentations(text))
