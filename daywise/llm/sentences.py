"""Sentence boundaries across languages and scripts."""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daywise.session import spread

# Words that take a full stop which does not end a sentence. "num" ones only before a number, "any" ones
# always, "low" ones unless an upper-case letter, a digit or a letter without case follows.
ABBREVIATIONS = {
    "en": {
        "num": "no nos p pp vol vols fig figs tab eq sec ch art approx ca ref refs ed cf al",
        "any": "dr mr mrs ms prof st rev hon sr jr messrs mme capt col gen lt sgt vs cf e.g i.e eg ie viz approx ca resp",
        "low": "etc inc ltd co a.m p.m am pm p.o i.v i.m s.c min max hr hrs dept u.s e.u",
    },
    "de": {
        "num": "nr s abb tab bd art abs ziff kap anm taf fig bl sp ca min st",
        "any": "dr prof med hr fr frl st vgl bzw z d u i v o s.a s.o z.b d.h u.a i.d.r ca inkl exkl evtl ggf sog bspw zzgl dipl ing rer nat phil jur geb gegr abt allg mind max hrsg jan feb apr aug sept okt nov dez",
        "low": "usw etc u.s.w u.s.f std min sek mio mrd tgl",
    },
    "fr": {
        "num": "p pp fig tab vol art chap env no nos n°",
        "any": "dr m mm mme mlle me pr st ste cf env p.ex c.-à-d p vs éd",
        "low": "etc ex",
    },
    "es": {
        "num": "pág págs p pp fig figs tab vol núm núms art cap aprox nº no",
        "any": "dr dra sr sra srta srs d dña prof profa st sto sta vs cf p.ej aprox pág núm ud uds",
        "low": "etc ej",
    },
    "ru": {
        "num": "рис стр с табл гл п пп № т ок",
        "any": "см ср т т.е т.к т.н т.д напр др проф г-н г-жа им акад доц св ул д",
        "low": "ч мин сек г гг руб тыс млн млрд тп т.п пр л",
    },
    "ar": {"num": "ص رقم", "any": "د أ م", "low": ""},
    "hi": {"num": "पृ सं", "any": "डॉ श्री प्रो कु", "low": ""},
}
# Frequent words that tell the language of Latin-script text.
COMMON = {
    "en": "the of and was to is with before day not by for from that are which had no",
    "de": "der die das und wurde ist auf mit vor am nicht ohne sich den dem von im laut bei",
    "fr": "le la les de du des et est à après jour ne pas une un au pour par reste",
    "es": "el la los las de del y es no una un al en día por para tras queda que",
}
# English words that a single capital letter names a kind of; such a letter is no initial.
LETTERED = frozenset("vitamin hepatitis group type class grade plan figure fig table appendix schedule ward room block factor section part point option team unit level phase stage category annex exhibit schedule".split())
# English words that begin a sentence after an abbreviation in capitals, beside the frequent ones.
OPENERS = frozenset("he she it we they you i a an there here then after as if when while all both please her his their our my its these those".split())
#: German words before a day number with a full stop that is an ordinal.
ORDINAL_BEFORE = frozenset("am vom zum der die das den dem des im bis ab seit dieser jeder".split())
PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "「": "」", "『": "』", "‘": "’", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》", "〈": "〉", '"': '"', "＂": "＂"}
BRACKETS = frozenset("(（[【")
_MARKS = frozenset("".join(PAIRS) + "".join(PAIRS.values()))


@functools.lru_cache(maxsize=1)
def _tables() -> dict[str, dict[str, frozenset[str]]]:
    return {k: {kind: frozenset(w.split()) for kind, w in v.items()} for k, v in ABBREVIATIONS.items()}


@functools.lru_cache(maxsize=1)
def _patterns():
    import regex

    return {
        # Sentence terminals of all scripts by the standard's character property, dot leaders and runs of them.
        "term": regex.compile(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…‥]+"),
        "blank": regex.compile(r"(?:\r\n|[\n\r\v\f\x85 ])(?:[^\S\n\r\v\f\x85  ]*(?:\r\n|[\n\r\v\f\x85 ]))+| "),
        "line": regex.compile(r"\r\n|[\n\r\v\f\x85 ]"),
        "item": regex.compile(r"\s*(?:([-*•‣▪◦·])|\(?(\d{1,3}|[a-zA-Z])([.)）、]))(?=[^\S\n])\s*"),
        # Read from the right: the word that ends at a place, and the one before it.
        "word": regex.compile(r"(?r)[\p{L}\p{M}\p{N}.№°/–-]+"),
        "prior": regex.compile(r"(?r)([\p{L}\p{M}\p{N}.№°/–-]+)\s*"),
        "opening": regex.compile(r"[\p{L}\p{M}]+"),
        "spacing": regex.compile(r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]"),
        "close": regex.compile(r"[\p{Sentence_Break=Close}--[\p{Ps}\p{Pi}¿¡]]", regex.V1),
        "thai": regex.compile(r"(?<=([\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])|(.))(?:([^\S\n]*[\xa0　][^\S\n]*|[^\S\n]{2,})|\s+)(?=([\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])|(.))", regex.S),
        # Lower-case beginnings that are symbols, not words: pH, eGFR, mmol/L, p5:L77.
        "symbol": regex.compile(r"\p{Ll}+[\p{Lu}\p{N}/:]"),
        "latin": regex.compile(r"[a-zà-ÿß]+"),
        "free": regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]"),
    }


#: Letters of the scripts that tell a language, by code points.
_SCRIPTS = {"ru": re.compile("[\u0400-\u0481\u048a-\u052f]"), "ar": re.compile("[\u0620-\u064a\u066e-\u06d3\u06ee-\u077f]"), "hi": re.compile("[\u0904-\u0939\u0958-\u0961\u0971-\u097f]"), "latin": re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]")}
_COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}


def _language(text: str, lang: str | None) -> str:
    """The language whose abbreviations hold in a block: by script, in Latin script by frequent words."""
    if not text.isascii():
        counts = {k: len(p.findall(text)) for k, p in _SCRIPTS.items()}
        kind = max(counts, key=counts.get)
        if kind != "latin":
            return kind
    words = _patterns()["latin"].findall(text.lower())
    hits = {k: sum(map(own.__contains__, words)) for k, own in _COMMON.items()}
    best = max(hits, key=hits.get)
    if hits[best] == 0:
        said = (lang or "").lower()[:2]
        return said if said in COMMON else "en"
    return best


_MARK = re.compile(f"[{re.escape(''.join(sorted(_MARKS)))}]")
#: For each closing mark the marks it closes.
_OPENERS = {c: tuple(o for o, ends in PAIRS.items() if c in ends) for c in _MARKS}


def _quotes(text: str) -> list[tuple[int, int]]:
    """Outermost balanced quotations and brackets, as spans of their marks; marks without a double are passed over."""
    pairs: list[tuple[int, int]] = []
    stack: list[int] = []
    levels: dict[str, list[int]] = {}  # of each mark the places in the stack where it is open
    inward = "«" in text
    for m in _MARK.finditer(text):
        i, c = m.start(), m.group()
        # The nearest open mark that this one closes; those opened since stay without a double.
        at = max((levels[o][-1] for o in _OPENERS[c] if levels.get(o)), default=None)
        if at is not None:
            pairs.append((stack[at], i))
            while len(stack) > at:
                levels[text[stack.pop()]].pop()
        elif c in PAIRS and c != "‘" and not (c == "»" and inward):
            levels.setdefault(c, []).append(len(stack))
            stack.append(i)
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


def _suppressed(word: str, before: str, lang: str, nxt: str, lower: bool, then: str) -> bool:
    """Whether the full stop after ``word`` is that of an abbreviation, ordinal or initial.

    ``before`` is the word before it, ``nxt`` the next visible character and ``then`` the word that begins there.
    """
    own = _tables().get(lang) or _tables()["en"]
    w = word.lower().lstrip(".-–/")
    if not w:
        return False
    if w in own["any"]:
        return True
    if w in own["num"] and (nxt.isdigit() or nxt in "–-№"):
        return True
    if w in own["low"] or len(w) > 2 and _CAPITALS.fullmatch(word):
        # In capitals (U.S.) it goes on with a name, unless a word follows that begins sentences.
        return lower or bool(_CAPITALS.fullmatch(word)) and nxt.isupper() and then.lower() not in OPENERS and then.lower() not in _COMMON["en"]
    if lang == "de" and w.isdigit() and len(w) <= 2:
        return before.lower() in ORDINAL_BEFORE
    # Initials: one capital after a name, a title or another initial.
    if not (len(word) == 1 and word.isupper() and nxt.isupper() and lang in ("en", "fr", "es") and word != "I"):
        return False
    title = before.endswith(".") and (before.lower().rstrip(".") in own["any"] or len(before) == 2 and before[0].isupper())
    return title or before[:1].isupper() and before[-1:].islower() and before.lower() not in LETTERED


_CAPITALS = re.compile(r"(?:[A-Z]\.)+[A-Z]")


def _block(text: str, lang: str | None) -> list[int]:
    """Sentence starts in a text without blank lines, as offsets into it."""
    p = _patterns()
    n = len(text)
    items, skip = [0], set()
    first = p["item"].match(text)
    if first:
        at, shape = first, (first.group(1), first.group(3))
        number = first.group(2)
        skip.add(first.end() - 1)
        marks = [(0, first.end())]
        for br in p["line"].finditer(text):
            at = p["item"].match(text, br.end())
            if at and (at.group(1), at.group(3)) == shape and (number is None or _follows(number, at.group(2))):
                number = at.group(2)
                items.append(br.end())
                marks.append((br.end(), at.end()))
    else:
        marks = []
    out = []
    for k, a in enumerate(items):
        b = items[k + 1] if k + 1 < len(items) else n
        head = marks[k][1] if marks else a
        out.append(a)
        out += [head + x for x in _run(text[head:b], lang)]
    return out


def _follows(a: str, b: str | None) -> bool:
    if b is None:
        return False
    if a.isdigit() and b.isdigit():
        return int(b) == int(a) + 1
    return len(a) == len(b) == 1 and ord(b) == ord(a) + 1


@functools.lru_cache(maxsize=65_536)
def _is(kind: str, c: str) -> bool:
    """Whether a character is of one of the patterns' kinds."""
    return _patterns()[kind].match(c) is not None


def _run(text: str, lang_said: str | None) -> list[int]:
    """Where sentences begin after the first in running text."""
    p = _patterns()
    n = len(text)
    lang = None
    quotes = None
    starts: list[int] = []
    last = 0

    def visible(i: int) -> int:
        while i < n and text[i].isspace():
            i += 1
        return i

    def inside(i: int) -> tuple[int, int] | None:
        nonlocal quotes
        if quotes is None:
            quotes = _quotes(text)
        k = bisect.bisect_left(quotes, (i,)) - 1
        return quotes[k] if k >= 0 and i <= quotes[k][1] else None

    cuts = []
    for m in p["term"].finditer(text):
        end = m.end()
        quote = inside(m.start())
        while end < n and _is("close", text[end]) and not (quote is None and text[end] in "\"'" and inside(end) is None and end + 1 < n and not text[end + 1].isspace()):
            end += 1
        if quote is not None:
            a, b = quote
            # Within a quotation nothing ends but the whole: the terminal must be its last.
            if text[m.end() : b].strip():
                continue
            end = b + 1
            while end < n and _is("close", text[end]):
                end += 1
        after = visible(end)
        if after >= n:
            continue
        nxt = text[after]
        spaced = after > end
        free = _is("free", nxt)
        mark = m.group()
        lower = nxt.islower() and not p["symbol"].match(text, after)
        if _is("term", nxt) or nxt in ",，、;；:：" or (nxt in "»”’\"" and not spaced):
            continue
        if nxt in "-–—" and not spaced:
            continue
        if quote is not None and text[quote[0]] not in BRACKETS:
            opening = text[: quote[0]].rstrip()
            led = opening[-1:] in (":", "：")
            if not led and (free or lower or not (nxt.isupper() or nxt.isdigit() or nxt.islower())):
                continue  # an attribution goes on after the quotation
            if led and not free and lower:
                continue
        if mark[-1] in ".…‥․" and (mark.endswith("..") or mark[-1] in "…‥"):
            wide = m.start() > 0 and _is("free", text[m.start() - 1])
            if not wide and (lower or not spaced and not free):
                continue
        elif mark == "." or mark == "․":
            if not spaced and not free and quote is None and end == m.end():
                continue
            if lower:
                continue
            if not spaced and not free:
                continue
            w = p["word"].match(text, 0, m.start()) if quote is None else None
            if w is not None:
                if lang is None:
                    lang = _language(text, lang_said)
                before, then = p["prior"].match(text, 0, w.start()), p["opening"].match(text, after)
                if _suppressed(w.group(), before.group(1) if before else "", lang, nxt, lower, then.group() if then else ""):
                    continue
        elif mark[-1] in "!?" and (not spaced and not free or lower):
            continue
        elif mark[-1] in "؟۔" and not spaced:
            continue
        cuts.append(after)
    for m in p["thai"].finditer(text) if p["spacing"].search(text) else ():
        # Scripts that end sentences by a space: one between letters, or a wide one on either side of a letter.
        left, right = m.group(1), m.group(4)
        if left and right or m.group(3) and (left or right):
            cuts.append(m.end())
    for c in sorted(set(cuts)):
        if c > last:
            starts.append(c)
            last = c
    return starts


def sentence_starts(text: str | None, lang: str | None = None) -> list[int]:
    """Offsets (code points) of the first visible character of every sentence; empty for null and blank texts."""
    if not text:
        return []
    out: list[int] = []
    last = 0
    spans = []
    for m in _patterns()["blank"].finditer(text):
        spans.append((last, m.start()))
        last = m.end()
    spans.append((last, len(text)))
    for a, b in spans:
        part = text[a:b]
        lead = len(part) - len(part.lstrip())
        if lead == len(part):
            continue
        a += lead
        part = text[a:b]
        for s in _block(part, lang):
            while s < len(part) and part[s].isspace():
                s += 1
            if s < len(part) and (not out or a + s > out[-1]):
                out.append(a + s)
    return out


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def starts_of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, lang in batches:
        yield pd.Series([np.array(sentence_starts(t, s), dtype=np.int32) for t, s in zip(text, lang)])


def sentence_positions(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, start_pos``: one row for each sentence of each document.

    Method: the standard's character properties give the terminals and closers of every script; abbreviations of
    the block's language, ordinals, initials, quotations and brackets suppress breaks; blank lines, headings and
    list items end sentences; scripts without terminals break at their spaces. Whole texts are read. Null, empty and
    blank texts give no row; repeated documents give their rows again.
    """
    lang: Column = F.col(f"`{lang_col}`").cast("string") if lang_col in documents.columns else F.lit(None).cast("string")
    return spread(documents.select(id_col, text_col, *([lang_col] if lang_col in documents.columns else []))).select(F.col(id_col).alias("doc_id"), F.explode(starts_of(F.col(text_col), lang)).alias("start_pos"))


def sentences(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, sentence_no, start_pos, sentence`` with outer white space taken off; cases as in sentence_positions."""
    lang: Column = F.col(f"`{lang_col}`").cast("string") if lang_col in documents.columns else F.lit(None).cast("string")
    pos = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), starts_of(F.col(text_col), lang).alias("starts"))
    cut = pos.select("doc_id", "text", "starts", F.posexplode("starts").alias("i", "start_pos"))
    end = F.coalesce(F.try_element_at("starts", F.col("i") + 2), F.length("text"))
    return cut.select("doc_id", (F.col("i") + 1).alias("sentence_no"), "start_pos", F.regexp_replace(F.substring(F.col("text"), F.col("start_pos") + 1, end - F.col("start_pos")), r"(?U)\s+$", "").alias("sentence"))
