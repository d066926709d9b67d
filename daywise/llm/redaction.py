"""Personal information in text lines: found in a normalised form, replaced in the source."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

# Letters of other scripts that stand for Latin ones in disguised identifiers.
HOMOGLYPHS = str.maketrans("АВЕКМНОРСТУХІЈЅаеосрхуіјѕԁһкԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρ", "ABEKMHOPCTYXIJSaeocpxyijsdhkqwABEZHIKMNOPTYXoavip")
# Spelled digits.
SPELLED = {w: str(d) for d, ws in enumerate(("zero null oh 零 〇", "one eins ein 一 壹 幺", "two zwei zwo 二 贰", "three drei 三 叁", "four vier 四 肆", "five fünf 五 伍", "six sechs 六 陆", "seven sieben 七 柒", "eight acht 八 捌", "nine neun 九 玖")) for w in ws.split()}
# Street words.
STREETS_EN = "Street St Road Rd Lane Ln Avenue Ave Court Ct Mews Row Drive Dr Close Crescent Terrace Place Square Way Walk Grove Gardens Hill Park Parade Boulevard Blvd Alley Yard Bend Quay Wharf Green Rise View"
STREETS_DE = "straße strasse str. weg gasse allee platz damm steig stieg bogen ofen ufer ring chaussee pfad markt hof graben wall brücke berg feld garten anger winkel kamp stiege zeile park tor wiese aue"
# Capitalised words that are no part of a person's name.
NO_NAME = frozenset(
    "The This That These Those An And Are At By For From In Is No Not Of On Or Sample Sampling Specimen Fax Call Home Name Patient Please Questions Spoke Requested Repeated Cardiological Microbiological Microscopic Electrolyte "
    "Coagulation Postoperative Insurance Between Consequently Independent Vitamin Day Page Sheet Ward Clinic Hospital Infirmary Department Laboratory Medicine Centre Center Institute Unit Case Tel "
    "Die Der Das Den Dem Des Ein Eine Einer Nach Bei Bitte Frau Herr Herrn Zwischen Am Im Auf Aus Mit Von Vor Und Oder Probe Charge Tag Station Seite Blatt Fall Einsender Angehörige Angehöriger Klinik Praxis Labor Zentrallabor Institut Neue Kopie "
    "Mikroskopisch Gerinnungsdiagnostik Elektrolytsubstitution Versichertennummer Telefonat Anschrift Rückfragen Uhr Hausbesuche Befundmappe Korrektur".split()
)
CAP = r"[A-ZÄÖÜ][a-zäöüßé]+(?:-[A-ZÄÖÜ][a-zäöüßé]+)?"
UPPER = r"[A-ZÄÖÜ]{2,}(?:-[A-ZÄÖÜ]{2,})?"

EMAIL = re.compile(r"(?<![A-Za-z0-9_.+-])(?:(?<!')[A-Za-z]')?[A-Za-z0-9_](?:[\w.+-]*[\w+-])?@[A-Za-z0-9](?:[\w-]*\w)?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9])")
_LOCAL, _OPEN, _SHUT = r"[A-Za-z0-9_](?:[\w.+-]*[\w+-])?", r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_SAID_DOT = rf"(?:{_OPEN}(?:dot|punkt|\.){_SHUT}|\s+(?:dot|punkt)\s+)"
_SAID_AT = rf"(?:{_OPEN}(?:at|@){_SHUT}|\s+at\s+(?=[\w-]+(?:\.[\w-]+)*{_SAID_DOT})|\s@\s|@)"
#: An address of which marks are said or set apart; what stands for them becomes the mark.
_SAID_EMAIL = re.compile(rf"(?<![A-Za-z0-9_.+-]){_LOCAL}(?:{_SAID_DOT}{_LOCAL})*(?P<at>{_SAID_AT})[A-Za-z0-9](?:[\w-]*\w)?(?:(?:\.|{_SAID_DOT})[A-Za-z0-9-]+)*(?:\.|{_SAID_DOT})[A-Za-z]{{2,}}(?![A-Za-z0-9])", re.IGNORECASE)
_DOT_MARK = re.compile(_SAID_DOT, re.IGNORECASE)
_SAID_HINT = re.compile(r"[\[({<]\s*(?:at|@|dot|punkt|\.)\s*[\])}>]|\s@\s|\s(?:at|dot|punkt)\s", re.IGNORECASE)
ID = re.compile(
    r"(?<![\dA-Za-z-])(?:[1-9]\d{5} ?(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01]) ?\d{3}[\dXx]|\d{3}-\d{2}-\d{4}|999[ -]\d{3}[ -]\d{4}|[A-Z]{1,3}\d{6,9}[A-Z]?)(?![\d-]*\d)"
)
#: Identifiers known by their check digits, whatever stands before them.
ID_CHECKED = re.compile(r"(?<![\dA-Za-z.,/:+-])(?<!\d )(?:(?P<ten>\d{3} \d{3} \d{4})|(?P<iban>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?))(?![\dA-Za-z]|[.,:/-]\d)")
ID_CUED = re.compile(r"(?:\bID|\bVers(?:icherten)?\.?-?(?:Nr\.?|nummer)|Insurance record|NHS(?: No\.?)?|SSN|Passport(?: No\.?)?|证件号|身份证号?|医保号)[ :：]*(?=([\dA-Z][\dA-Za-z -]{5,22}[\dA-Za-z]))")
PHONE = re.compile(
    r"(?<![\d/:.,+-])(?<!\d )(?:"
    r"(?:\+|00)\d{1,3}[ ./-]?(?:\(0\) ?)?\d[\d ./-]{5,14}\d"
    r"|\(0\d{2,4}\) ?\d{3,8}(?:[ -]\d{2,8})*"
    r"|\(\d{3}\) ?\d{3}[-. ]\d{4}"
    r"|\d{3}[-. ]\d{3}[-.]\d{4}|\d{3}[-.]\d{3}[-. ]\d{4}"
    r"|0\d{2,4}[ /-]\d{3,5}[ -]\d{3,5}"
    r"|0\d{2,3}[-/ ]\d{7,8}"
    r"|1[3-9]\d[ -]?\d{4}[ -]?\d{4}"
    r")(?!\d|[./:-]\d)(?:,? ?(?:ext\.?|x|Durchwahl|App\.) ?\d{1,5})?"
)
PHONE_CUED = re.compile(r"(?:\bTel(?:efon)?\.?|\bFax|\bCall back|\bPhone|\bMobile|\bHandy|电话|手机|传真)[ :：]*(?=([+(]?\d[\d ()./-]{5,18}\d))")
ADDRESS_EN = re.compile(
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite) \d+[A-Za-z]?, )?(?<![\w.:/-])\d{{1,4}}[A-Za-z]? (?:{CAP} ){{1,3}}(?:{'|'.join(STREETS_EN.split())})\b\.?(?:, (?:Flat|Apt\.?|Apartment|Unit) \d+[A-Za-z]?)?(?:, (?!(?:Flat|Apt)){CAP}(?: {CAP})?)?"
)
ADDRESS_DE = re.compile(
    rf"(?:(?:Am|An der|An den|Auf der|Im|In der|Zum|Zur|Unter den|Alte[rns]?|Neue[rns]?|Große[rns]?|Kleine[rns]?|Lange|Hohe[rs]?|Obere|Untere) )?(?<![\w-])[A-ZÄÖÜ][\wäöüß-]*?(?:{'|'.join(re.escape(s) for s in STREETS_DE.split())})(?:-(?:Süd|Nord|Ost|West|Mitte))? \d{{1,4}} ?[a-z]?(?![\w.:/])(?:, \d{{5}} {CAP}(?: {CAP})?)?"
    rf"|(?:[A-ZÄÖÜ][\wäöüß-]+ ){{1,3}}\d{{1,4}}[a-z]?, \d{{5}} {CAP}(?: {CAP})?"
)
_NEAR_DE = re.compile(rf"(?:{'|'.join(re.escape(s) for s in STREETS_DE.split())})(?:-\w+)? \d|\d[a-z]?, \d{{5}} ")
ADDRESS_ZH = re.compile(r"(?:[㐀-鿿]{1,8}?(?:大道|路|街|巷|弄|胡同))\d{1,4}号(?:\d{1,4}(?:号楼|栋|幢|座|单元|层|室|号))*")
_STREET_EN = re.compile(rf"[a-z] (?:{'|'.join(STREETS_EN.split())})\b")
_BEFORE_ZH = re.compile(r".*(?:住址|地址|现住|寄送至|送至|寄至|家住|住在|住于|位于|住|至|在)")

_NAME_STRONG = re.compile(rf"(?<![\w./-])(?:{UPPER}, {CAP}|{CAP} [A-Z]\. {CAP}|(?<!\d )(?<!z\. )[A-Z]\. ?{CAP}(?!-))(?![\w])")
_NAME_CUED = re.compile(rf"(?<![\w.-])(?:{CAP}, {CAP}|{CAP} {CAP})(?![\w-])")
_LEFT = regex.compile(
    r"(?r)(?:Requested by|Patient(?:in)?:|\bName:?|(?:relabelled|signed|checked|countersigned|reviewed) by|Spoke with|(?:to|with|by|from) (?:Dr|Prof)\.|\b(?:Dr|Prof|Mrs?|Ms|Frau|Herrn?)\.?|[Ii]nform|attn\.|[Rr]elative,|attached;|Einsender:?|wurde von|Telefonat mit|\bBitte|Angehöriger?:|Kontakt:|Contact:|\bpatient(?:in)?|\b(?:de|pour|chez) M(?:me|lle|\.)|\bSigned:?|gez\.)\s*"
)
_RIGHT = re.compile(
    r"\s*(?:countersigned|agreed\b|\((?:daughter|son|wife|husband|mother|father|sister|brother|Tochter|Sohn|Ehefrau|Ehemann|Mutter|Vater|Schwester|Bruder)\)|, lives at|, wohnhaft|gegengezeichnet|vor Entlassung|, address\b|(?:on|unter) [+(\d]|(?:at|um) \d\d:\d\d|was seen\b|was informed\b|a sign[ée]\b|hat unterschrieben)"
)
_AND_LEFT = regex.compile(r"(?r)\b(?:and|und) ")
_AND_RIGHT = re.compile(r"\s*(?:and|und) ")
#: Signs that scanning puts for letters of a cue.
_MISREAD = str.maketrans("01589@!|", "olsbgail")
_WORDS = re.compile(r"[^\W\d_]{2,}")
_HYPHEN = re.compile(r"(?<=\w)[-‐¬\xad]\s*$")
_PLACE_RIGHT = re.compile(r" (?:Road|Street|Lane|Row|Court|Mews|Avenue|Clinic|Hospital|Infirmary|criterion|index|score|test|sign|scale|Klinik|Kriterium|Index|Zeichen)\b|, (?:Station|Ward)\b")


def _broken(cue: str) -> str:
    """A cue that a line break may divide."""
    return "\n?".join(cue)


def _any(cues: str) -> str:
    return "|".join(_broken(c) for c in cues.split())


_HAN = "[㐀-鿿]"
_RIGHT_ZH = _any("住址 现住 电话 联系 医师 医生 护士 复核 签字")
_ZH_NAME = re.compile(
    rf"(?:{_any('姓名： 姓名: 送检医师： 送检医师: 收件人 更正由')}) ?\n?({_HAN}{{2,3}}?)(?=\n|$|[，,。；;、 ]|{_RIGHT_ZH}|于\d)"
    rf"|(?:{_any('家属')})\n?({_HAN}{{2,3}})(?=\n?(?:{_any('住址 现住 电话 联系')}))"
    rf"|(?:{_any('联系 与')})\n?({_HAN}{{2,3}})(?=\n?[，,]\n?{_broken('电话')}|\n?(?:{_any('医师 医生 护士')}))"
    rf"|(?:由\n?|(?<![^。，；、：\n])|(?<=，))({_HAN}{{2,3}})(?=\n?{_broken('复核签字')})"
    rf"|(?<![^。，；、：\n])({_HAN}{{2,3}})(?=\n?于\n?\d{{1,2}}[:：]\d{{2}}\n?来)"
    rf"|\S {{2,}}({_HAN}{{2,3}})(?=\n|$| {{2,}})"
)


def _one(c: str) -> str:
    """The characters one source character stands for: full-width forms, homoglyphs, other dashes and spaces."""
    import unicodedata

    if c in "​‌‍⁠­﻿":
        return ""
    if c in "‐‑‒–—−﹘﹣":
        return "-"
    if "一" <= c <= "鿿":
        return c
    out = unicodedata.normalize("NFKC", c)
    return " " if out.isspace() else (out.translate(HOMOGLYPHS) if len(out) == 1 else out)


_DIGIT_WORD = re.compile("|".join(rf"(?<![^\W\d_]){w}(?![^\W\d_])" if w.isascii() or "ü" in w else w for w in sorted(SPELLED, key=len, reverse=True)), re.IGNORECASE)
_DIGIT_RUN = re.compile(rf"(?:(?:{_DIGIT_WORD.pattern}|\d)[ .-]?){{6,}}", re.IGNORECASE)
_LETTER_RUN = re.compile(r"[^\W\d_]+")
_HAN_DIGITS = frozenset(w for w in SPELLED if len(w) == 1)
_ANY_HAN = re.compile("[㐀-鿿]")


class Normal(NamedTuple):
    """A text without disguises, and for each of its characters where its source begins and ends (None: in place)."""

    text: str
    starts: list[int] | None = None
    ends: list[int] | None = None

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of ``text[a:b]``: all characters that any of it stands for."""
        return (a, b) if self.starts is None or self.ends is None else (self.starts[a], self.ends[b - 1])

    def with_edits(self, edits: list[tuple[int, int, str]]) -> Normal:
        """The text with spans replaced by one character each (or by nothing), which stands for the whole span."""
        if not edits:
            return self
        starts = self.starts if self.starts is not None else list(range(len(self.text)))
        ends = self.ends if self.ends is not None else list(range(1, len(self.text) + 1))
        text: list[str] = []
        a_of: list[int] = []
        b_of: list[int] = []
        last = 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[last:a])
            a_of += starts[last:a]
            b_of += ends[last:a]
            if new:
                text.append(new)
                a_of.append(starts[a])
                b_of.append(ends[b - 1])
            last = b
        return Normal("".join(text), a_of, b_of)


class _Characters(dict):
    """What characters stand for, by code point as it is asked for; ``uneven`` holds those that are not one for one."""

    def __init__(self) -> None:
        self.uneven: set[str] = set()

    def __missing__(self, code: int) -> str:
        self[code] = out = _one(chr(code))
        if len(out) != 1:
            self.uneven.add(chr(code))
        return out


_CHARACTERS = _Characters()


def _plain_characters(text: str) -> Normal:
    """Full-width and look-alike characters as ASCII ones, invisible ones gone."""
    if text.isascii():
        return Normal(text)
    out = text.translate(_CHARACTERS)
    if _CHARACTERS.uneven.isdisjoint(text):
        return Normal(out)
    starts = [i for i, c in enumerate(text) for _ in _CHARACTERS[ord(c)]]
    return Normal(out, starts, [i + 1 for i in starts])


def _plain_digits(seen: Normal) -> Normal:
    """Digits for spelled ones, in runs of at least six digits of which two or more are spelled."""
    out = seen.text
    edits: list[tuple[int, int, str]] = []
    if not _HAN_DIGITS.isdisjoint(out) or not SPELLED.keys().isdisjoint(_LETTER_RUN.findall(out.lower())):
        for run in _DIGIT_RUN.finditer(out):
            words = list(_DIGIT_WORD.finditer(out, run.start(), run.end()))
            if len(words) >= 2:
                for w in words:
                    edits.append((w.start(), w.end(), SPELLED[w.group().lower()]))
                    if w.end() < run.end() and out[w.end()] == " ":
                        edits.append((w.end(), w.end() + 1, ""))
    return seen.with_edits(edits)


def _plain_marks(seen: Normal) -> Normal:
    """The marks of addresses in which they are said or set apart: ``a dot b (at) c dot org`` is ``a.b@c.org``."""
    edits: list[tuple[int, int, str]] = []
    if _SAID_HINT.search(seen.text):
        for m in _SAID_EMAIL.finditer(seen.text):
            at = m.span("at")
            for a, b in ((m.start(), at[0]), (at[1], m.end())):
                edits += [(d.start(), d.end(), ".") for d in _DOT_MARK.finditer(seen.text, a, b)]
            if seen.text[at[0] : at[1]] != "@":
                edits.append((*at, "@"))
    return seen.with_edits(sorted(edits))


@lru_cache(maxsize=64)  # a line is its neighbours' neighbour
def normalise(text: str) -> Normal:
    """``text`` without disguises: transducers over characters, spelled digits and marks, one after the other."""
    return _plain_marks(_plain_digits(_plain_characters(text)))


def _checked(m: re.Match) -> bool:
    """Whether an identifier's check digits hold: of ten digits modulo 11, of an account number modulo 97."""
    if m.group("ten"):
        digits = [int(c) for c in m.group() if c.isdigit()]
        return len(set(digits)) > 2 and -sum(d * (10 - i) for i, d in enumerate(digits[:9])) % 11 == digits[9]
    bare = m.group().replace(" ", "")
    return len(bare) >= 15 and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _clean(found: str) -> str:
    return found.rstrip(" -./")


def detect(text: str, before: str = "", after: str = "") -> list[tuple[int, int, str]]:
    """Items in a line as (start, end, kind), from the left, without overlaps; neighbouring lines lend context.

    ``before`` and ``after`` may hold several lines where furniture may stand between (the nearest last, or first);
    each of them is tried as the neighbour. Order of precedence: email, identifier, telephone, address, name. What a kind has taken is no part of another.
    """
    seen = normalise(text)
    line = seen.text
    n = len(line)
    free = bytearray(b"\x01") * n
    out: list[tuple[int, int, str]] = []

    def take(a: int, b: int, kind: str) -> bool:
        if a >= b or b > n or not all(free[a:b]):
            return False
        free[a:b] = bytes(b - a)
        out.append((a, b, kind))
        return True

    if "@" in line:
        for m in EMAIL.finditer(line):
            take(m.start(), m.end(), "email")
    digits = sum(map(line.count, "0123456789"))
    if digits >= 6:
        for m in ID.finditer(line):
            take(m.start(), m.end(), "id_number")
        for m in ID_CUED.finditer(line):
            if sum(c.isdigit() for c in m.group(1)) >= 6:
                take(m.start(1), m.start(1) + len(_clean(m.group(1))), "id_number")
        for m in PHONE.finditer(line):
            take(m.start(), m.start() + len(_clean(m.group())), "phone")
        for m in PHONE_CUED.finditer(line):
            take(m.start(1), m.start(1) + len(_clean(m.group(1))), "phone")
        for m in ID_CHECKED.finditer(line):
            if _checked(m):
                take(m.start(), m.end(), "id_number")
    if digits:
        if _STREET_EN.search(line):
            for m in ADDRESS_EN.finditer(line):
                take(m.start(), m.end(), "street_address")
        if _NEAR_DE.search(line):
            for m in ADDRESS_DE.finditer(line):
                take(m.start(), m.end(), "street_address")
        if "号" in line:
            for m in ADDRESS_ZH.finditer(line):
                cue = _BEFORE_ZH.match(m.group())
                take(m.start() + (cue.end() if cue else 0), m.end(), "street_address")
    befores, afters = before.split("\n")[::-1], after.split("\n")
    if _ANY_HAN.search(line):
        tails, aheads = [normalise(x).text for x in befores], [normalise(x).text for x in afters]
        for tail, ahead in [(t, aheads[0]) for t in tails] + [(tails[0], x) for x in aheads[1:]]:
            whole = f"{tail}\n{line}\n{ahead}"
            o = len(tail) + 1
            for m in _ZH_NAME.finditer(whole):
                a, b = m.start(m.lastindex) - o, m.end(m.lastindex) - o
                if a >= 0:
                    take(a, b, "person_name")
    else:
        _latin_names(line, befores, afters, take, _HYPHEN.search(text) is not None)
    return [(*seen.source(a, b), k) for a, b, k in sorted(out)]


def _latin_names(line: str, befores: list[str], afters: list[str], take, broken: bool) -> None:
    spans: list[tuple[int, int]] = []
    at = 0
    while (m := _NAME_STRONG.search(line, at)) is not None:
        words = _WORDS.findall(m.group())
        if words[0] in NO_NAME:
            at = m.start() + len(words[0])
            continue
        at = m.end()
        if not any(w in NO_NAME or w.title() in NO_NAME for w in words) and not _PLACE_RIGHT.match(line, at):
            spans.append(m.span())
    at, sides, end = 0, None, len(line)
    while (m := _NAME_CUED.search(line, at)) is not None:
        a, b = m.span()
        words = _WORDS.findall(m.group())
        if words[0] in NO_NAME:
            at = a + len(words[0])
            continue
        at = a + 1
        while at < b and line[at].isalpha():
            at += 1
        if any(w in NO_NAME for w in words) or any(a < y and b > x for x, y in spans) or _PLACE_RIGHT.match(line, b):
            continue
        if sides is None:
            tails = [normalise(_HYPHEN.sub("", x)).text + ("" if _HYPHEN.search(x) else " ") for x in befores]
            # An invisible hyphen is gone from the normal form, a visible one is taken off.
            cut = _HYPHEN.search(line) if broken else None
            end = cut.start() if cut else len(line)
            rights = [line[:end] + ("" if broken else " ") + x for x in afters]
            sides = [(t + line, len(t)) for t in tails], rights, [r.translate(_MISREAD) for r in rights]
        lefts, rights, misread = sides
        # A cue ends where the name begins, or begins where it ends, in the line joined with any of its neighbours.
        cued = any(_LEFT.match(t, 0, o + a) for t, o in lefts) or any(_RIGHT.match(r, b) for r in (*rights, *misread))
        left, o = lefts[0]
        cued = cued or (a == 0 and _COLUMN.match(rights[0], b)) or (left.endswith("  ", 0, o + a) and (line.startswith("  ", b) or not line[b:].strip()))
        cued = cued or (any(y <= a for _, y in spans) and _AND_LEFT.match(left, 0, o + a)) or (_AND_RIGHT.match(rights[0], b) and _NEXT_NAME.match(rights[0], b))
        if cued:
            spans.append((a, b))
            at = b
    for a, b in spans:
        take(a, b, "person_name")


_NEXT_NAME = re.compile(rf"\s*(?:and|und) (?:{UPPER}, {CAP}|{CAP}, {CAP}|{CAP} (?:[A-Z]\. )?{CAP}|[A-Z]\. ?{CAP})(?=\s*(?:at|um) \d|\s*$)")


_COLUMN = re.compile(r" {2,}\S")


def redact(text: str, items: list[tuple[int, int, str]]) -> str:
    """``text`` with a typed placeholder for each item, otherwise unchanged."""
    out, last = [], 0
    for a, b, kind in items:
        out += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*out, text[last:]])


def may_hold_items(text: Column) -> Column:
    """False only for lines in which ``detect`` finds nothing.

    Every line with a character that ``normalise`` may change by itself (all but printable ASCII and German letters)
    may hold items. In the others each kind of item leaves a mark that is asked for here: numbers have six digits or
    spelled digits, addresses of mail a mark or a said one, streets a word of theirs before a number, and names two
    capitals in a row.
    """
    letters = "A-Za-zÄÖÜäöüßé"
    words = "|".join(sorted((w for w in SPELLED if len(w) > 1), key=len, reverse=True))
    streets = "|".join(re.escape(s) for s in STREETS_DE.split())
    names = r"[A-ZÄÖÜ]{2,}, [A-ZÄÖÜ][a-zäöüßé]|[A-ZÄÖÜ]\. ?[A-ZÄÖÜ][a-zäöüßé]|[A-ZÄÖÜ][a-zäöüßé]+,? [A-ZÄÖÜ][a-zäöüßé]"
    street = text.rlike(" [0-9]") & text.rlike(rf"(?:{streets})(?:-[\wÄÖÜäöüßé]+)? [0-9]|[0-9][a-z]?, [0-9]{{5}} ")
    said = text.rlike(r"(?i)[\[({<]\s*at\s*[\])}>]|\sat\s.*(?:dot|punkt)")
    digits = F.regexp_count(text, F.lit(rf"[0-9]|(?iu:(?<![{letters}])(?:{words})(?![{letters}]))")) >= 6
    return text.rlike(rf"[^ -~ÄÖÜäöüßé]|{names}|@") | said | street | digits


_ITEM = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


@F.pandas_udf(_ITEM)
def items_of(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, before, after in batches:
        yield pd.Series([None if t is None else detect(t, b or "", a or "") for t, b, a in zip(text, before, after)])


def lines_in_order(lines: DataFrame) -> DataFrame:
    """Each line once, with the text before and after it in its document.

    Rows with one ``document_token`` and ``line_index`` are one line (of different texts the greatest counts). Where
    a page begins or ends within three lines, head and foot lines may stand between: there ``before`` and ``after``
    hold four lines each.
    """
    page = F.col("page_number").cast("int") if "page_number" in lines.columns else F.lit(0)
    one = lines.select("document_token", F.col("line_index").cast("int").alias("line_index"), "text", page.alias("page")).repartition("document_token").groupBy("document_token", "line_index").agg(F.max(F.struct("text", "page")).alias("v")).select("document_token", "line_index", "v.text", "v.page")
    order = Window.partitionBy("document_token").orderBy("line_index")
    text = F.coalesce("text", F.lit(""))
    seen = one.withColumn("whole", text)
    turn = lambda f: ~f("page", 3).over(order).eqNullSafe(F.col("page"))
    far = lambda f, ks: F.concat_ws("\n", *[f("whole", k).over(order) for k in ks])
    before = F.when(turn(F.lag), far(F.lag, (4, 3, 2, 1))).otherwise(F.lag("whole", 1).over(order))
    after = F.when(turn(F.lead), far(F.lead, (1, 2, 3, 4))).otherwise(F.lead("whole", 1).over(order))
    return seen.withColumns({"before": before, "after": after}).select("document_token", "line_index", "text", "before", "after")


def personal_items(lines: DataFrame) -> DataFrame:
    """``document_token, line_index, pii_kind, occurrence, start, end, text`` of every item of every line.

    Method: each line is normalised character by character (full-width forms, look-alikes, spelled digits, at and
    dot disguises) with the source place of every character kept; identifiers are detected in the normal form, with
    the neighbouring lines as context for names, and their spans mapped back. ``start`` and ``end`` are code points
    of the source. Null and empty texts have no items; repeated rows count once.
    """
    marked = lines_in_order(lines).filter(may_hold_items(F.col("text")))
    items = marked.select("document_token", "line_index", "text", items_of("text", "before", "after").alias("items")).filter(F.size("items") > 0)
    each = items.select("document_token", "line_index", "text", "items", F.posexplode("items").alias("i", "item"))
    earlier = F.filter(F.slice("items", F.lit(1), F.col("i") + 1), lambda x: x["kind"] == F.col("item.kind"))
    return each.select("document_token", "line_index", F.col("item.kind").alias("pii_kind"), F.size(earlier).alias("occurrence"), "item.start", "item.end", "text")


def redacted_lines(lines: DataFrame) -> DataFrame:
    """``document_token, line_index, redacted`` of every line: typed placeholders for items, otherwise unchanged."""
    lines = lines_in_order(lines)

    @F.pandas_udf(T.StringType())
    def written(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, before, after in batches:
            yield pd.Series([None if t is None else redact(t, detect(t, b or "", a or "")) for t, b, a in zip(text, before, after)], dtype=object)

    marked = F.when(may_hold_items(F.col("text")), F.col("text"))
    return lines.select("document_token", "line_index", F.coalesce(written(marked, "before", "after"), "text").alias("redacted"))
