"""Text of scanned pages: furniture, words broken over lines and misread characters."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywise.session import spread, stored

#: Words of the vocabulary have at least this count, whatever the corpus.
LEAST_COUNT = 5
#: A vocabulary of at most so many words goes to every task as a whole; of a larger one each slice of lines gets the
#: words it can need, with the same results.
MOST_WORDS, SLICE_WORDS = 50_000, 500_000
#: Lines whose like is judged by all its places have at least this count, whatever the corpus.
LEAST_LINES = 3
#: A word is suspect beside one so many times as frequent with the same strokes.
RATIO, RATIO_HAN = 15, 6
DIMENSIONS, NEGATIVE = 32, 5
#: What is found out about a word or an ideograph is kept for at most so many, then forgotten and found anew.
MOST_KEPT = 500_000

# Letters as the strokes a scanner sees; words of equal strokes are plausible misreadings of each other.
STROKES = {
    "m": "rri", "n": "ri", "u": "ii", "ü": "ii", "w": "vv", "d": "ci", "h": "b", "e": "c", "é": "c", "ä": "a", "@": "a", "ö": "o", "0": "o", "l": "i", "1": "i", "!": "i", "|": "i", "f": "t",
    "9": "g", "q": "g", "5": "s", "$": "s", "8": "b", "6": "b", "ß": "b", "2": "z",
}
_STROKES = str.maketrans(STROKES)
# Ideographs taken for each other by scanners.
HAN_CLASSES = (
    "白自", "未末", "结洁", "血皿", "采釆", "检捡", "参叁", "科料", "钾钿", "体休", "日曰", "肌肮", "患惠", "术木", "人入", "大太", "天夭", "千干", "土士", "己已巳", "住往", "候侯", "复夏", "析折", "待侍", "治冶", "清淸", "拔拨", "第笫",
    "目日", "间问", "今令", "电申", "由田", "贝见", "拆折", "免兔", "鸟乌", "辨辩", "微徽", "崇祟", "茶荼", "历厉", "刺剌", "汨汩", "戍戌", "母毋", "准淮", "孑子", "酐酊", "胆担", "素索", "葡蔔", "压庄", "糖搪", "标柝", "测侧", "时吋", "量置", "氨氦", "酶酵",
)
# Digits a letter may stand for.
AS_DIGIT = {"O": "0", "o": "0", "I": "1", "l": "1", "i": "1", "!": "1", "|": "1", "Z": "2", "z": "2", "S": "5", "s": "5", "b": "6", "B": "8", "g": "9", "q": "9"}
HYPHENS = "-‐‑¬­"


@lru_cache(maxsize=1)
def _han() -> dict[str, str]:
    out: dict[str, str] = {}
    for row in HAN_CLASSES:
        for c in row:
            out.setdefault(c, row[0])
    return out


@lru_cache(maxsize=200_000)
def strokes(word: str) -> str:
    return word.lower().translate(_STROKES)


def _is_han(c: str) -> bool:
    return "㐀" <= c <= "鿿"


_HAN = re.compile("[㐀-鿿]")
#: What a word can be corrected to: letters, joined by marks inside.
_LETTERS = re.compile(r"[^\W\d_]+(?:[-/'’·.][^\W\d_]+)*\.?$")
_EDGE = ".,;:()[]\"'“”„«»。，；：（）、"
_NUMBER = re.compile(r"^[<>≤≥]?(?=\S*\d)(?=\S*[OoIlSsZzBbgqi!|])[\dOoIlSsZzBbgqi!|]+(?:[.,:/-][\dOoIlSsZzBbgqi!|]+)*$")
_UNIT_TAIL = re.compile(r"(?<=[\dOolISsZzBb])(?:[munμ]?mol|[munμk]?g|k?U|m?Eq)/[dmuμ]?[Ll]$")
_ASCII_TOKEN = re.compile(r"[!-~µμ°²³äöüÄÖÜßé]+")


class _Bare(dict):
    """Words without outer punctuation, each stripped once."""

    def __missing__(self, word: str) -> str:
        bare = self[word] = word.strip(_EDGE)
        return bare


def _has_han(text: str) -> bool:
    return not text.isascii() and _HAN.search(text) is not None


@lru_cache(maxsize=1)
def _doubled() -> re.Pattern[str]:
    """Any ideograph with doubles."""
    return re.compile(f"[{''.join(_han())}]")


def han_places(text: str) -> Iterator[tuple[int, str]]:
    """For each ideograph with doubles its place, and itself between what stands on both sides."""
    n = len(text)
    for m in _doubled().finditer(text):
        i = m.start()
        a = text[i - 1] if i else "^"
        b = text[i + 1] if i + 1 < n else "$"
        a = a if _is_han(a) or a == "^" else "|"
        b = b if _is_han(b) or b == "$" else "|"
        yield i, f"{a}{text[i]}{b}"


def _grams(place: str) -> tuple[str, str, str]:
    """The grams of an ideograph in its surroundings: both sides, left, right."""
    return f"\x01{place}", f"\x02{place[:2]}", f"\x03{place[1:]}"


def han_grams(text: str) -> Iterator[tuple[int, str, str, str]]:
    """For each ideograph with doubles its place and what stands around it: both sides, left, right."""
    return ((i, *_grams(place)) for i, place in han_places(text))


@lru_cache(maxsize=200_000)
def _han_class(gram: str) -> str:
    doubles = _han()
    return gram[0] + "".join(doubles.get(c, c) for c in gram[1:])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words: Counter = Counter()
    pairs: Counter = Counter()
    places: Counter = Counter()
    bare = _Bare()
    for batch in batches:
        # The words of all lines in a row, an empty one after each line.
        row: list[str] = []
        for text in batch["text"]:
            if not text:
                continue
            if _has_han(text):
                places.update([place for _, place in han_places(text)])
                continue
            row.extend(filter(None, map(bare.__getitem__, text.split())))
            row.append("")
        words.update(row)
        pairs.update(zip(row, row[1:]))
        if len(words) + len(pairs) + len(places) > 1_000_000:
            yield _counted(words, pairs, places)
            words, pairs, places = Counter(), Counter(), Counter()
        if len(bare) > 1_000_000:
            bare.clear()
    yield _counted(words, pairs, places)


def _counted(words: Counter, pairs: Counter, places: Counter) -> pd.DataFrame:
    words.pop("", None)
    for place, n in places.items():
        for gram in _grams(place):
            words[gram] += n
    near = [(a, b) for a, b in pairs if a and b]
    return pd.DataFrame({"a": [*words, *(a for a, _ in near)], "b": [""] * len(words) + [b for _, b in near], "n": [*words.values(), *(pairs[p] for p in near)]}).astype({"n": "int64"})


class Language(NamedTuple):
    """What is known of the corpus: counts and vectors of its vocabulary, and the suspects' frequent doubles."""

    counts: dict[str, int]
    vectors: dict[str, np.ndarray]
    doubles: dict[str, list[str]]
    suspects: dict[str, list[str]]
    least: int
    #: Found on the way: words as they stand in lines that are no misreading whatever is around them, what words are
    #: corrected to between their neighbours, and what ideographs are.
    sure: set[str]
    corrected: dict[tuple[str, str, str], str | None]
    read: dict[str, str | None]


@lru_cache(maxsize=500_000)
def _sign(context: str) -> np.ndarray:
    """The random direction of a context word, the same on every machine."""
    return np.random.default_rng(zlib.crc32(context.encode())).choice(np.array([-1.0, 1.0], dtype=np.float32), DIMENSIONS)


class Learned(NamedTuple):
    """What all lines say: ``word, n, key, v`` of the vocabulary, and the number of words read."""

    vocabulary: DataFrame
    total: int


def _key(word: str) -> str:
    """What words that may be misread for each other share: strokes, of ideographs with surroundings their classes."""
    return _han_class(word) if word[0] <= "\x03" else strokes(word)


def learn(lines: DataFrame) -> Learned:
    """Counts and skip-gram vectors from all lines, as a table.

    Words, neighbouring pairs and ideographs with doubles in their surroundings are counted before they are shuffled.
    A word's vector is its row of the shifted pointwise mutual information of words and neighbours, which is what
    skip-gram with negative sampling factorises, brought to 32 dimensions by random signs of the neighbours.
    """
    counted = stored(spread(lines.select("text").filter("text is not null")).mapInPandas(_count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    words = counted.filter(F.col("b") == "")
    known = words.filter(F.col("n") >= LEAST_COUNT).select(F.col("a").alias("word"), "n")
    latin = known.filter(F.col("word") > "\x03\uffff")
    sums = words.agg(F.sum("n").alias("all"), F.sum(F.when((F.col("n") >= LEAST_COUNT) & (F.col("a") > "\x03\uffff"), F.col("n"))).alias("latin")).first()
    whole = max(1, sums["latin"] or 0)
    of = lambda c: latin.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}"))
    near = counted.filter(F.col("b") != "").join(of("a"), "a").join(of("b"), "b")
    pmi = F.log(F.col("n") * F.lit(float(whole)) / (F.col("n_a") * F.col("n_b"))) - math.log(NEGATIVE)
    both = near.withColumn("pmi", pmi).filter("pmi > 0").select(F.explode(F.array(F.struct(F.col("a").alias("w"), F.concat(F.lit(">"), "b").alias("c")), F.struct(F.col("b").alias("w"), F.concat(F.lit("<"), "a").alias("c")))).alias("p"), "pmi").select("p.w", "p.c", "pmi")

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(DIMENSIONS, dtype=np.float32))
        for batch in batches:
            for w, c, x in zip(batch["w"], batch["c"], batch["pmi"]):
                out[w] += np.float32(x) * _sign(c)
        if out:
            yield pd.DataFrame({"w": list(out), "v": [v.tolist() for v in out.values()]})

    @F.pandas_udf("string")
    def key(word: pd.Series) -> pd.Series:
        return word.map(_key)

    learned = both.repartition("w").mapInPandas(vectors, "w string, v array<float>")
    return Learned(stored(known.join(learned, known["word"] == learned["w"], "left").select("word", "n", key("word").alias("key"), "v")), sums["all"] or 0)


def as_language(rows: Iterable[tuple[str, int, object]]) -> Language:
    """Words with their counts and vectors as they are looked up; words of one key must all be there or none."""
    counts: dict[str, int] = {}
    vectors: dict[str, np.ndarray] = {}
    for word, n, v in rows:
        counts[word] = int(n)
        if v is not None:
            vectors[word] = np.asarray(v, dtype=np.float32)
    return doubles_of(counts, vectors, LEAST_COUNT)


def learn_language(lines: DataFrame) -> Language:
    """All of what ``learn`` tells at once; for small corpora."""
    return as_language((r.word, r.n, r.v) for r in learn(lines).vocabulary.select("word", "n", "v").toLocalIterator())


def doubles_of(counts: dict[str, int], vectors: dict[str, np.ndarray], least: int) -> Language:
    """Frequent words by their strokes, and the words of the vocabulary that are suspect beside them."""
    by: dict[str, list[str]] = defaultdict(list)
    for w in counts:
        by[_key(w)].append(w)
    suspects: dict[str, list[str]] = {}
    doubles: dict[str, list[str]] = {}
    for key, words in by.items():
        words.sort(key=lambda w: (-counts[w], w))
        han = words[0][0] <= "\x03"
        right = [w for w in words if han or _LETTERS.match(w)]
        for w in words:
            if not han and not any(c.isalpha() for c in w):
                continue
            mates = [f for f in right if counts[f] >= (RATIO_HAN if han else RATIO) * counts[w] and f.lower() != w.lower()]
            if mates:
                suspects[w] = mates
        doubles[key] = [w for w in right if w not in suspects]
    return Language(counts, vectors, doubles, suspects, least, set(), {}, {})


def _affinity(word: str, left: str, right: str, known: Language) -> float | None:
    """How well a word goes with its neighbours by their vectors; None if none of them is known."""
    v = known.vectors.get(word)
    near = [c for c, w in ((f"<{left}", left), (f">{right}", right)) if w in known.counts]
    if v is None or not near:
        return None
    return float(sum(v @ _sign(c) for c in near)) / (DIMENSIONS * len(near))


def _mates(word: str, known: Language) -> list[str] | None:
    """The frequent words that ``word`` may be a misreading of."""
    if len(word) < 2 or not any(c.isalpha() for c in word):
        return None
    if known.counts.get(word, 0):
        return known.suspects.get(word)
    return [f for f in known.doubles.get(strokes(word), ()) if f.lower() != word.lower() and known.counts[f] >= known.least * 2]


def correct_word(word: str, left: str, right: str, known: Language) -> str | None:
    """The frequent word that ``word`` is a misreading of, in its context; None if it stands as it is."""
    mates = _mates(word, known)
    if not mates:
        return None
    # Short words of equal strokes may both be right: the frequent one must go with the neighbours.
    short = len(word) < 6 and not any(c in "0123456789@!|$" for c in word)
    best = mates[0]
    if short or len(mates) > 1:
        scored = []
        for f in mates:
            # Casing of the first letter is read rightly more often than not.
            same_case = f[:1].isupper() == word[:1].isupper() or not word[:1].isalpha()
            fit = _affinity(f, left, right, known)
            scored.append(((fit if fit is not None else 0.0) + 0.5 * same_case + 0.05 * math.log(known.counts[f]), fit, f))
        _, fit, best = min(scored, key=lambda x: (-x[0], x[2]))
        if short and (fit is None or fit < (0.1 if len(word) > 3 else 0.3)):
            return None
    # Strokes of both cases are alike: the case that was read stays where the letter is the same.
    if best[0] != word[0] and best[0].lower() == word[0].lower():
        best = word[0] + best[1:]
    return best


def wrong_han(text: str, known: Language) -> list[tuple[int, str]]:
    """Places of misread ideographs and the right ones, by the counts of their surroundings."""
    out = []
    read = known.read
    for i, place in han_places(text):
        if place not in read:
            if len(read) > MOST_KEPT:
                read.clear()
            read[place] = _right_han(place, known)
        if read[place] is not None:
            out.append((i, read[place]))
    return out


def _right_han(place: str, known: Language) -> str | None:
    """The ideograph that the one between its neighbours is a misreading of; None if it stands as it is."""
    counts = known.counts
    c = place[1]
    votes: Counter = Counter()
    for weight, gram, at in zip((2, 1, 1), _grams(place), (2, 2, 1)):
        own = counts.get(gram, 0)
        best = next((f for f in known.doubles.get(_han_class(gram), ()) if f[at] != c and counts[f] >= max(RATIO_HAN * own, known.least)), None)
        if best is not None:
            votes[best[at]] += weight
        elif own:
            votes[c] += weight
    if not votes:
        return None
    top, n = votes.most_common(1)[0]
    return top if top != c and n >= 2 and n > votes.get(c, 0) else None


def misread_number(token: str, alone: bool) -> bool:
    """Whether a token is a number with a letter for a digit."""
    if not _NUMBER.match(token):
        return False
    if any(s in token for s in ".,:/-"):
        parts = re.split(r"[.,:/-]", token)
        return any(any(c.isdigit() for c in p) for p in parts)
    # Without a separator only short ones; a last letter may be that of a house number or unit.
    return len(token) <= 5 and (alone or not token[-1].isalpha() or sum(c.isalpha() for c in token) > 1) and not (token[0].isupper() and token[1:].isdigit() and not alone and token[0] in "BS")


def line_faults(text: str, after: str | None, before: str | None, known: Language) -> tuple[bool, list[tuple[int, int, str]]]:
    """Whether the line's last word goes on in the next, and (start, end, right text) of what was misread in it.

    ``before`` and ``after`` are the body lines around it.
    """
    if _has_han(text):
        faults = [(i, i + 1, c) for i, c in wrong_han(text, known)]
        for m in _ASCII_TOKEN.finditer(text):
            t = _UNIT_TAIL.sub("", m.group().strip(_EDGE))
            if t and misread_number(t, False) and t not in known.counts:
                at = m.start() + m.group().index(t)
                faults.append((at, at + len(t), "".join(AS_DIGIT.get(c, c) for c in t)))
        return False, sorted(faults)
    words = text.split()
    if not words:
        return False, []
    broken = after is not None and goes_on(text, after, known)
    carried = _last_part(before) if before is not None and goes_on(before, text, known) else ""
    sure, corrected = known.sure, known.corrected
    if not broken and not carried and sure.issuperset(words):
        return False, []
    faults: list[tuple[int, int, str]] = []
    last = len(words) - 1
    for i, raw in enumerate(words):
        head, tail = carried if i == 0 else "", ""
        ends = i == last and broken
        if not head and not ends and (raw in sure or _is_sure(raw, known)):
            continue
        w = raw if raw in known.counts else raw.strip(_EDGE)
        if not w:
            continue
        start = raw.index(w)
        if ends:
            w = w.rstrip(HYPHENS)
            tail = _first_part(after)
        whole = head + w + tail
        if not w or _is_address(w):
            continue
        if misread_number(whole, len(words) == 1) and whole not in known.counts:
            right = "".join(AS_DIGIT.get(c, c) for c in w)
        else:
            case = whole, words[i - 1] if i else "", words[i + 1] if i < last else ""
            if case not in corrected:
                if len(corrected) > MOST_KEPT:
                    corrected.clear()
                corrected[case] = correct_word(whole, case[1].strip(_EDGE), case[2].strip(_EDGE), known)
            best = corrected[case]
            right = None if best is None else _own_part(whole, best, len(head), len(head) + len(w))
        if right is not None:
            start += _start(text, words, i)
            faults.append((start, start + len(w), right))
    return broken, faults


def _is_address(word: str) -> bool:
    return "@" in word.strip("@") and re.search(r"@[\w-]+\.\w", word) is not None


def _is_sure(raw: str, known: Language) -> bool:
    """Whether a whole word, as it stands in a line, is no misreading whatever is around it."""
    w = raw if raw in known.counts else raw.strip(_EDGE)
    if w and (w in known.suspects or w not in known.counts and not _is_address(w) and (misread_number(w, True) or _mates(w, known))):
        return False
    if len(known.sure) > MOST_KEPT:
        known.sure.clear()
    known.sure.add(raw)
    return True


def _start(text: str, words: list[str], i: int) -> int:
    """Where the word of this number begins in its line."""
    at = 0
    for raw in words[:i]:
        at = text.index(raw, at) + len(raw)
    return text.index(words[i], at)


@lru_cache(maxsize=200_000)
def _own_part(wrong: str, right: str, a: int, b: int) -> str | None:
    """The part of ``right`` for ``wrong[a:b]``; None if the two differ only outside that part."""
    ends = [0]
    acc = ""
    for c in right:
        acc += c.lower().translate(_STROKES)
        ends.append(len(acc))
    at = [0]
    acc = ""
    for c in wrong:
        acc += c.lower().translate(_STROKES)
        at.append(len(acc))
    x = next((i for i, e in enumerate(ends) if e >= at[a]), len(right))
    y = next((i for i, e in enumerate(ends) if e >= at[b]), len(right))
    part = right[x:y]
    return part if part.lower() != wrong[a:b].lower() else None


def _last_part(text: str) -> str:
    words = text.split()
    return words[-1].rstrip(HYPHENS).lstrip(_EDGE) if words else ""


def _first_part(text: str | None) -> str:
    words = (text or "").split()
    return words[0].rstrip(_EDGE + HYPHENS) if words else ""


def goes_on(text: str, after: str | None, known: Language) -> bool:
    """Whether a word is broken at the end of ``text`` by a mark that is no part of it."""
    line = text.rstrip()
    if len(line) < 2 or line[-1] not in HYPHENS or not after:
        return False
    first, last = _first_part(after), _last_part(line)
    if not last or not first or not (line[-2].isalpha() or line[-2] in "@!015") or not (first[0].isalpha() or first[0] in "@!015"):
        return False
    if first.lower() in ("und", "oder", "bzw", "and", "or"):
        return False
    joined, compound = last + first, f"{last}-{first}"
    a, b = (max(known.counts.get(w, 0), known.counts.get(w.lower(), 0), known.counts.get(w[:1].upper() + w[1:], 0)) for w in (joined, compound))
    if a or b:
        return a >= b
    a, b = (len(known.doubles.get(strokes(w), ())) for w in (joined, compound))
    if a or b:
        return a >= b
    # Nothing is known of either: a next word that stands by itself elsewhere begins a new one.
    return first not in known.counts and (not first[:1].isupper() or line[-1] in "¬­")


#: What stands beside a page's number.
_NUM = r"([0-9lIOoSsZBbgiz!|]{1,4}|[ivxl]{1,6})"
PAGE_LINE = (
    rf"^[\s\-–—\[(|]*(?:(?:Seite|Page|Blatt|Sheet|S\.?|Bl\.?|p\.?|pg\.?)\s*)?{_NUM}(?:\s*(?:/|von|of)\s*[0-9lIOoSsZBbgz]{{1,4}})?[\s\-–—\])|]*$",
    rf"^(?:共\s*[0-9lIOo]{{1,4}}\s*页\s*)?第\s*{_NUM}\s*页(?:\s*[，,/]?\s*共\s*[0-9lIOo]{{1,4}}\s*页)?$",
)
_ROMAN = ["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx"]


def _page_said(text: Column) -> Column:
    """The number that a line of nothing else names, as text; null or empty for other lines."""
    a, b = (F.regexp_extract(text, p, 1) for p in PAGE_LINE)
    return F.when(F.length(text) <= 30, F.concat(a, b))


def _like(text: Column) -> Column:
    """What lines of one kind share: the strokes of the part before a wide gap, without numbers and space."""
    base = F.lower(F.regexp_replace(F.substring_index(F.trim(text), "  ", 1), r"\d(?<![\p{L}\d]\d)\d*+(?!\p{L})", ""))
    singles = {k: v for k, v in STROKES.items() if len(v) == 1} | {"ü": "u"} | {c: r[0] for r in HAN_CLASSES for c in r[1:]}
    # Characters without a double in the second list, which are white space, are taken out.
    base = F.translate(base, "".join(singles) + " \t\n\r\x0b\x0c", "".join(singles.values()))
    for a, b in (("m", "rri"), ("w", "vv"), ("d", "ci"), ("u", "ii"), ("n", "ri")):
        base = F.replace(base, F.lit(a), F.lit(b))
    return base


def _placed(lines: DataFrame) -> DataFrame:
    """Each line once with its place: whether it is among the first or last two lines of its page.

    ``doc`` stands for the document's token; as it is never null, a join by it moves no line again.
    """
    doc = F.coalesce(F.concat(F.lit("="), "document_token"), F.lit(""))
    one = lines.select(doc.alias("doc"), F.col("line_index").cast("int").alias("line_index"), F.col("page_number").cast("int").alias("page"), F.coalesce("text", F.lit("")).alias("text")).repartition("doc")
    greatest = Window.partitionBy("doc").orderBy("line_index", F.desc("text"), F.desc("page"))
    one = one.withColumns({"no": F.row_number().over(greatest), "last": F.lag("line_index").over(greatest)}).filter((F.col("no") == 1) | ~F.col("last").eqNullSafe(F.col("line_index"))).drop("no", "last")
    order = Window.partitionBy("doc").orderBy("line_index")
    at = {"a2": F.lag("page", 2), "a1": F.lag("page", 1), "b1": F.lead("page", 1), "b2": F.lead("page", 2)}
    one = one.withColumns({k: f.over(order) for k, f in at.items()})
    other = {k: ~F.col(k).eqNullSafe(F.col("page")) for k in at}
    edge = F.when(other["a1"] | other["a2"], F.lit(1)).when(other["b1"] | other["b2"], F.lit(2)).otherwise(F.lit(0))
    return one.select("doc", "line_index", "text", "page", edge.alias("edge"), (other["a1"] | other["b1"]).alias("outer"), other["a1"].alias("first"))


def _place_like(edge: Column, like: Column) -> Column:
    return F.concat(edge.cast("string"), like)


def _line_kinds(placed: DataFrame) -> DataFrame:
    """``doc, running_of``: of each document the edges and likes of lines that may be running lines, and whether it repeats them there.

    A like that is frequent over all lines must stand at page edges; one that is not counts where its document repeats
    it. Only likes that can be running lines (four characters) are joined, by an ordinary join of one row per document,
    edge and like. A document's map is bounded by its pages.
    """
    edge = F.col("edge") > 0
    seen = placed.select(_like(F.col("text")).alias("like"), "edge", F.when(edge, F.col("doc")).otherwise(F.lit("-")).alias("doc"))
    # Both sides of the join read this one aggregate: their filters are on counts and ``doc`` is never null, so that its
    # exchange is shared, and no filter on likes makes them a second time for each line.
    cells = seen.groupBy("like", "edge", "doc").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("edge") > 0).alias("edges"))
    by = cells.groupBy("like").agg(F.sum("n").alias("all"), F.sum("edges").alias("at_edges"))
    frequent = F.col("all") >= LEAST_LINES
    kinds = by.filter((F.col("at_edges") > 0) & (~frequent | (F.col("at_edges") >= 0.8 * F.col("all"))) & (F.when(F.col("all") > 0, F.length("like")) >= 4)).select("like", frequent.alias("frequent"))
    own = cells.filter("edges = n").join(kinds, "like").filter("frequent or n >= 2")
    return own.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct(_place_like(F.col("edge"), F.col("like")), F.col("n") >= 2))).alias("running_of"))


_FAULTS = "broken boolean, misread boolean, fixed string"


def _repaired(text: str, after: str | None, before: str | None, known: Language) -> tuple[bool, bool, str | None]:
    broken, faults = line_faults(text, after, before, known)
    if not faults:
        return broken, False, None
    out, last = [], 0
    for a, b, right in faults:
        out += [text[last:a], right]
        last = b
    return broken, True, "".join([*out, text[last:]])


#: Python's white space: a line that ends in none of it nor in a hyphen is not broken, whatever comes next.
_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _may_go_on(text: Column) -> Column:
    return F.substring(text, -1, 1).isin(*HYPHENS, *_SPACE)


def repaired_lines(lines: DataFrame) -> DataFrame:
    """``document_token, line_index, text, furniture, broken, misread, fixed`` of every line, once each.

    Method: counts, skip-gram vectors and plausible doubles are learned from all lines (``learn``). A rare
    word, or one rare beside a word of the same strokes, is corrected to the one that goes best with its neighbours;
    ideographs by the counts of their surroundings. ``furniture`` is ``running_line`` (at a page edge, repeated on
    the document's pages, or the like of such lines elsewhere), ``page_number`` or null for body lines. ``broken``:
    the last word goes on in the next body line. ``fixed`` is the body line with misread characters replaced.
    Repeated rows count once (of different texts the greatest); null texts are empty lines; ``confidence`` is no
    sure sign and not used.
    """
    learned = learn(lines)
    placed = _placed(lines)
    doc = Window.partitionBy("doc")
    text = F.col("text")
    numbered = placed.withColumn("said", F.when(F.col("edge") > 0, _page_said(F.trim(text))))
    said = F.nullif(F.col("said"), F.lit(""))
    number = F.translate(said, "".join(AS_DIGIT), "".join(AS_DIGIT.values())).try_cast("int")
    roman = F.try_element_at(F.array(*[F.lit(r) for r in _ROMAN[1:]]), F.greatest(F.col("page"), F.lit(1)))
    named = (F.col("edge") > 0) & said.isNotNull() & ((number == F.col("page")) | (F.translate(said, "lI1!|", "iiiii") == F.translate(roman, "l", "i")))
    bare = F.trim(text) == said
    marked = numbered.withColumns({"place": F.when(F.col("edge") > 0, _place_like(F.col("edge"), _like(text))), "named": F.coalesce(named & ~bare, F.lit(False)), "bare": F.coalesce(named & bare, F.lit(False))})
    marked = marked.withColumns({"pages": F.count_if(F.col("first")).over(doc), "bares": F.count_if(F.col("bare")).over(doc)})
    page_number = F.col("named") | F.col("bare") & F.when(F.col("pages") == 1, F.col("outer")).otherwise(F.col("bares") >= 0.5 * F.col("pages"))
    marked = marked.join(_line_kinds(placed), "doc", "left")
    repeated = F.when(F.col("edge") > 0, F.try_element_at("running_of", F.col("place")))
    running = repeated | repeated.isNotNull() & (F.col("pages") > 1)
    furniture = F.when(page_number, "page_number").when(F.coalesce(running, F.lit(False)), "running_line")
    marked = marked.select("doc", "line_index", "text", furniture.alias("furniture")).withColumn("body", F.when(F.col("furniture").isNull(), text))
    # The body lines around a line, however much furniture or how many pages of nothing else stand between.
    near = marked.withColumns({n: F.expr(f"{f}(body) ignore nulls over (partition by doc order by line_index)") for n, f in (("before", "lag"), ("after", "lead"))})
    token = F.when(F.col("doc") != "", F.expr("substring(doc, 2)")).alias("document_token")
    ready = near.select(token, "line_index", "text", "furniture", "body", *[F.when(F.col("body").isNotNull() & _may_go_on(F.col(c)), F.col(n)).alias(n) for c, n in (("body", "after"), ("before", "before"))])
    if learned.vocabulary.limit(MOST_WORDS + 1).count() > MOST_WORDS:
        return _by_slices(ready, learned)
    known = as_language((r.word, r.n, r.v) for r in learned.vocabulary.select("word", "n", "v").toLocalIterator())

    @F.pandas_udf(_FAULTS)
    def repaired(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for body, after, before in batches:
            yield _all_repaired(body, after, before, known)

    return _with_text(ready.withColumn("r", repaired("body", "after", "before")).select("document_token", "line_index", "text", "furniture", "r.*"))


def _with_text(done: DataFrame) -> DataFrame:
    """Body lines in which nothing was misread stay as they are."""
    return done.withColumn("fixed", F.when(F.col("furniture").isNull(), F.coalesce("fixed", "text")))


def _all_repaired(body: pd.Series, after: pd.Series, before: pd.Series, known: Language) -> pd.DataFrame:
    n = len(body)
    broken, misread, fixed = [False] * n, [False] * n, [None] * n
    sure = known.sure
    for i, (text, a, b) in enumerate(zip(body, after, before)):
        # Most lines hold nothing but sure words.
        if text is not None and not (a is None and b is None and text.isascii() and sure.issuperset(text.split())):
            broken[i], misread[i], fixed[i] = _repaired(text, a, b, known)
    return pd.DataFrame({"broken": broken, "misread": misread, "fixed": pd.Series(fixed, dtype=object)})


def _asked(text: str, after: str | None) -> set[str]:
    """The keys of every word a line can ask for: its own, and those its last word may be part of."""
    if _has_han(text):
        return {_key(g) for _, *grams in han_grams(text) for g in grams} | {strokes(t) for m in _ASCII_TOKEN.finditer(text) for t in (m.group().strip(_EDGE), _UNIT_TAIL.sub("", m.group().strip(_EDGE)))}
    words = text.split()
    out = {strokes(w) for raw in words for w in (raw, raw.strip(_EDGE), raw.rstrip(HYPHENS).strip(_EDGE))}
    last, first = _last_part(text), _first_part(after)
    if last and first:
        out |= {strokes(w) for w in (first, last + first, f"{last}-{first}")}
        # The next line's first word stands behind its own edge marks, as it is joined.
        out.add(strokes(words[-1].rstrip(HYPHENS) + first))
    return out


def _by_slices(ready: DataFrame, learned: Learned) -> DataFrame:
    """The repaired lines where the vocabulary is too large for one task.

    Lines are dealt out to slices of some 500,000 words, a long document to several (each line carries its
    neighbours). A slice gets the vocabulary's words of every key its lines ask for; as all that is decided about a
    word depends on the words of its key, the results are those of the whole vocabulary.
    """
    slices = max(1, learned.total // SLICE_WORDS)
    dealt = ready.withColumn("slice", F.pmod(F.xxhash64("document_token", F.floor(F.col("line_index") / 1000)), F.lit(slices)).cast("int"))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[int, set[str]] = defaultdict(set)
            for k, text, after, before in zip(batch["slice"], batch["body"], batch["after"], batch["before"]):
                if text is not None:
                    found[k] |= _asked(text, after)
                    if before is not None:
                        found[k] |= _asked(before, text)
            yield pd.DataFrame([(k, x) for k, xs in found.items() for x in xs], columns=["slice", "key"])

    asked = dealt.select("slice", "body", "after", "before").mapInPandas(keys, "slice int, key string").distinct()
    entries = asked.join(learned.vocabulary, "key").select("slice", "word", "n", "v")

    def repaired(lines: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        known = as_language(zip(words["word"], words["n"], words["v"]))
        none = lambda c: lines[c].astype(object).where(lines[c].notna(), None)
        done = _all_repaired(none("body"), none("after"), none("before"), known)
        return pd.concat([lines[["document_token", "line_index", "text", "furniture"]].reset_index(drop=True), done], axis=1)

    return _with_text(dealt.groupBy("slice").cogroup(entries.groupBy("slice")).applyInPandas(repaired, f"document_token string, line_index int, text string, furniture string, {_FAULTS}"))


def scan_noise(lines: DataFrame) -> DataFrame:
    """``document_token, line_index, noise_kind``: ``running_line, page_number, hyphen_break, misread`` of each line."""
    kinds = F.array("furniture", F.when(F.col("broken"), F.lit("hyphen_break")), F.when(F.col("misread"), F.lit("misread")))
    return repaired_lines(lines).select("document_token", "line_index", F.explode(F.array_compact(kinds)).alias("noise_kind"))


def paragraphs(lines: DataFrame) -> DataFrame:
    """``document_token, paragraph_no, first_line, text``: the repaired body as continuous paragraphs.

    A paragraph ends with a line that ends a sentence well before the document's right edge, and table cells (lines
    under half its width beside each other) stay apart. Broken words are joined, other lines by a space, lines
    between ideographs by nothing. Empty lines end paragraphs. Furniture is left out.
    """
    order = Window.partitionBy("document_token").orderBy("line_index")
    body = repaired_lines(lines).filter("furniture is null").select("document_token", "line_index", F.rtrim("fixed").alias("t"), "broken")
    width = F.max(F.length("t")).over(Window.partitionBy("document_token"))
    body = body.withColumn("wide", F.length("t") / F.greatest(width, F.lit(1)))
    closed = (F.col("t").rlike("[.!?。！？:：][\"”’)）]?$") & (F.col("wide") < 0.85)) | (F.col("wide") < 0.5) & ~F.col("broken") | (F.length("t") == 0)
    body = body.withColumn("starts", F.coalesce(F.lag(F.when(closed, 1).otherwise(0)).over(order), F.lit(0)))
    number = F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    parts = body.withColumn("paragraph_no", number)
    joint = F.when(F.col("broken"), F.regexp_replace("t", rf"[{HYPHENS}]\s*$", "")).when(F.col("t").rlike("[㐀-鿿。，；：！？、）]$"), F.col("t")).otherwise(F.concat("t", F.lit(" ")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_index", joint.alias("j")))), lambda x: x["j"]), "")
    return parts.groupBy("document_token", "paragraph_no").agg(F.min("line_index").alias("first_line"), F.rtrim(text).alias("text")).filter("text <> ''").select("document_token", (F.col("paragraph_no") + 1).cast("int").alias("paragraph_no"), "first_line", "text")
