"""One plain form for text that looks the same but differs in its characters."""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters that look alike, each Latin letter or letter pair with its Greek and Cyrillic doubles.
LOOK_ALIKES = (
    "AΑА", "BΒВ", "CϹС", "EΕЕ", "HΗН", "IΙІӀ", "JͿЈ", "KΚК", "MΜМ", "NΝ", "OΟО", "PΡР", "SЅ", "TΤТ", "XΧХ", "YΥҮ",
    "ZΖ", "GԌ", "QԚ", "WԜ", "VѴ", "aαа", "cϲс", "dԁ", "eе", "gɡ", "hһ", "iіı", "jϳј", "kк", "lӏ",
    "oοо", "pρр", "qԛ", "sѕ", "uυ", "vνѵ", "wԝ", "xχх", "yу", "ßβ", "ɣγ", "ΓГ", "ΠП", "ΦФ", "ΛЛ", "πп", "τт", "κк",
)
# Punctuation and signs that compatibility normalization leaves or spoils.
SIGNS = {
    "º": "°", "˚": "°", "∘": "°", "µ": "μ", "ˆ": "^", "․": ".", "⁄": "/", "∕": "/", "⧸": "/", "‐": "-", "‑": "-", "‒": "-",
    "–": "-", "—": "-", "−": "-", "⁃": "-", "﹘": "-", "‚": ",", "‘": "'", "’": "'", "‛": "'", "′": "'", "ʹ": "'", "ʼ": "'",
    "“": '"', "”": '"', "‟": '"', "″": '"', "∶": ":", "ː": ":", "꞉": ":", "∗": "*", "٪": "%", "⁎": "*", "ǃ": "!", "∣": "|",
    "ǀ": "|", "∼": "~", "˜": "~", "‹": "<", "›": ">", "⁓": "~", "΄": "'", "´": "'", "٫": ",",
}
# Kana that look like ideographs or like the other kana, plain form for a katakana neighbourhood first.
KANA = {"ニ": "二", "ロ": "口", "カ": "力", "ー": "一", "エ": "工", "ト": "卜", "タ": "夕", "ハ": "八", "ヘ": "へ", "ベ": "べ", "ペ": "ぺ", "リ": "り"}
#: Superscript digits and signs are plain.
SUPERSCRIPT = frozenset("⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻")
#: Log score of a letter of another script inside a word, of a pair of letters never seen, and of a changed letter.
FOREIGN, CHANGED = -60.0, -0.01
#: Log score of two neighbouring characters of different East Asian scripts.
TURN = -1.0


def _script(c: str) -> str:
    """L, G or C for a Latin, Greek or Cyrillic letter, else the empty string."""
    o = ord(c)
    if c.isascii():
        return "L" if c.isalpha() else ""
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "G" if c.isalpha() else ""
    if 0x400 <= o < 0x530 or 0x1C80 <= o < 0x1C90 or 0x2DE0 <= o < 0x2E00 or 0xA640 <= o < 0xA6A0:
        return "C" if c.isalpha() else ""
    if (0xAA <= o < 0x2B0 or 0x1D00 <= o < 0x1D80 or 0x1E00 <= o < 0x1F00) and c.isalpha():
        return "L"
    return ""


@functools.lru_cache(maxsize=1)
def _doubles() -> dict[str, tuple[str, ...]]:
    """For each letter the letters it may stand for, itself first."""
    out: dict[str, dict[str, None]] = {}
    for row in LOOK_ALIKES:
        for a in row:
            out.setdefault(a, {a: None}).update(dict.fromkeys(row))
    return {a: tuple(v) for a, v in out.items()}


@functools.lru_cache(maxsize=4096)
def _class(c: str) -> str:
    """The letter itself if the model counts it alone: ASCII and listed letters; other letters share one class."""
    return c if c.isascii() or c in _doubles() else "~"


def _letters(word: str) -> list[tuple[str, str]]:
    """The letters of a word, each with the marks on it."""
    out: list[tuple[str, str]] = []
    for c in unicodedata.normalize("NFD", word):
        if unicodedata.combining(c) and out:
            out[-1] = (out[-1][0], out[-1][1] + c)
        else:
            out.append((c, ""))
    return out


@functools.lru_cache(maxsize=1)
def _ignorable():
    import regex

    return regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}\p{Cc}&&[^\t\n\r]]", regex.V1)


def compatible(text: str) -> str:
    """Compatibility normalization that keeps superscripts, without ignorable characters and outer space."""
    text = _ignorable().sub("", text)
    if not text.isascii():
        out = []
        for c in text:
            out.append(c if c in SUPERSCRIPT else SIGNS.get(c) or c if c.isascii() or c in SIGNS else _compose(c))
        text = unicodedata.normalize("NFC", "".join(out))
    return "".join(" " if c.isspace() or c in "ᅠㅤ⠀" else c for c in text).strip(" ")


@functools.lru_cache(maxsize=8192)
def _compose(c: str) -> str:
    o = ord(c)
    if 0x2E80 <= o < 0x2FE0:  # radicals that stand for ideographs
        return unicodedata.normalize("NFKC", c)
    return "".join(SIGNS.get(x, x) for x in unicodedata.normalize("NFKC", c))


def words(text: str) -> Iterator[tuple[int, int]]:
    """Spans of Latin, Greek and Cyrillic letters."""
    start = None
    for i, c in enumerate(text):
        if _script(c) or start is not None and unicodedata.combining(c):
            start = i if start is None else start
        elif start is not None:
            yield start, i
            start = None
    if start is not None:
        yield start, len(text)


def pair_counts(text: str, weight: int, into: Counter) -> None:
    """Count the letter pairs of the words of one script in a compatible text; ``^`` and ``$`` are the word's ends."""
    for a, b in words(text):
        word = [c for c, _ in _letters(text[a:b])]
        kinds = {_script(c) for c in word}
        if len(kinds) == 1:
            kind, last = kinds.pop(), "^"
            for c in [_class(c) for c in word] + ["$"]:
                into[kind, last, c] += weight
                last = c


class PairModel:
    """Log probabilities of letter pairs by script, from counts over the whole corpus."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        self.counts = counts
        self.total: Counter = Counter()
        for (_, a, _b), n in counts.items():
            self.total[a] += n

    def score(self, kind: str, a: str, b: str) -> float:
        return math.log((self.counts.get((kind, a, b), 0) + 0.05) / (self.total.get(a, 0) + 20.0))


def _best_word(word: str, model: PairModel) -> str:
    """Viterbi over the letters each character may stand for, one script per word where its letters allow."""
    bases = _letters(word)
    doubles = _doubles()
    options = [doubles.get(b, (b,)) for b, _ in bases]
    best: tuple[float, list[str]] | None = None
    for kind in "LGC":
        layer = {"^": 0.0}
        back: list[dict[str, tuple[str, str]]] = []  # of each class the one before it, and its letter
        for (own, _), choice in zip(bases, options):
            fit = [c for c in choice if _script(c) == kind]
            after: dict[str, float] = {}
            came: dict[str, tuple[str, str]] = {}
            for c in fit or [own]:
                cls = _class(c)
                k = max(layer, key=lambda k: layer[k] + model.score(kind, k, cls))
                s = layer[k] + model.score(kind, k, cls) + ((0.0 if c == own else CHANGED) if fit else FOREIGN)
                if cls not in after or s > after[cls]:
                    after[cls], came[cls] = s, (k, c)
            layer = after
            back.append(came)
        k = max(layer, key=lambda k: layer[k] + model.score(kind, k, "$"))
        total = layer[k] + model.score(kind, k, "$")
        if best is None or total > best[0]:
            path = []
            for came in reversed(back):
                k, c = came[k]
                path.append(c)
            best = (total, path[::-1])
    return unicodedata.normalize("NFC", "".join(c + m for c, (_, m) in zip(best[1], bases)))


def _is_katakana(c: str) -> bool:
    return "゠" <= c <= "ヿ" and c not in "・"


@functools.lru_cache(maxsize=1)
def _kana_doubles() -> dict[str, tuple[str, ...]]:
    """For each kana and ideograph with a double what it may stand for, itself first; hiragana are not written for katakana."""
    out = {k: (k, v) if v not in "へべぺり" else (k,) for k, v in KANA.items()}
    return out | {v: (v, k) for k, v in KANA.items()}


def _wide_script(c: str) -> str:
    """K, H or I for katakana, hiragana and ideographs, O for other letters, else the empty string."""
    if _is_katakana(c):
        return "K"
    if "ぁ" <= c <= "ゟ":
        return "H"
    return "I" if "一" <= c <= "鿿" else "O" if c.isalpha() and not c.isascii() else ""


def _kana(text: str) -> str:
    """Viterbi over the kana and ideographs that each character may stand for, scored by pairs of scripts.

    A pair of one script costs nothing and one of two scripts ``TURN``, beside ``CHANGED`` for a changed character;
    what is no such letter separates runs. Of equal paths the one that changes least, then least early, is taken.
    """
    doubles = _kana_doubles()
    if doubles.keys().isdisjoint(text):
        return text
    layer: dict[str, float] = {"": 0.0}  # of each script of the last character the best score
    back: list[dict[str, tuple[str, str]]] = []
    for c in text:
        after: dict[str, float] = {}
        came: dict[str, tuple[str, str]] = {}
        for x in doubles.get(c, (c,)):
            kind = _wide_script(x)
            for last, score in layer.items():
                s = score + (TURN if kind and last and kind != last else 0.0) + (0.0 if x == c else CHANGED)
                if kind not in after or s > after[kind] + 1e-9:
                    after[kind], came[kind] = s, (last, x)
        layer = after
        back.append(came)
    at = max(layer, key=lambda k: layer[k])
    out = []
    for came in reversed(back):
        at, x = came[at]
        out.append(x)
    return "".join(reversed(out))


def plain(text: str | None, model: PairModel) -> str | None:
    """The plain form of ``text``; null for null, the empty text for one of nothing visible."""
    if text is None:
        return None
    text = compatible(text)
    if text.isascii():
        return text
    out, last = [], 0
    spans = list(words(text))
    # Beside words of another script a word of ASCII letters that all have doubles may be one of theirs.
    others = any(_script(c) in "GC" for a, b in spans if not text[a:b].isascii() for c in text[a:b] if _script(c))
    for a, b in spans:
        word = text[a:b]
        sure = word.isascii() and not (others and len(word) > 2 and all(c in _doubles() for c in word))
        out += [text[last:a], word if sure else _best_word(word, model)]
        last = b
    return _kana("".join([*out, text[last:]]))


def certain(col: Column) -> Column:
    """True for texts that are plain on sight: printable ASCII without outer space."""
    return col.rlike(r"^[!-~]([ -~]*[!-~])?$") | (col == "")


def letter_pairs(df: DataFrame, cols: Sequence[str]) -> PairModel:
    """The pair model of all values of ``cols``.

    Values are counted before their letters are. What reaches the driver is bounded by the counted letters, not the
    corpus: at most three scripts times the square of some 180 listed letters.
    """
    values = df.select(F.explode(F.array(*[F.col(f"`{c}`") for c in cols])).alias("v")).filter("v is not null and v != ''").groupBy("v").count()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        into: Counter = Counter()
        for batch in batches:
            for v, n in zip(batch["v"], batch["count"]):
                pair_counts(compatible(v), int(n), into)
        yield pd.DataFrame([(*k, n) for k, n in into.items()], columns=["kind", "a", "b", "n"])

    rows = values.mapInPandas(counted, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return PairModel({(r.kind, r.a, r.b): r.n for r in rows})


def plain_form(df: DataFrame, cols: Sequence[str], *, suffix: str = "_plain", model: PairModel | None = None) -> DataFrame:
    """``df`` with the plain form of each of ``cols`` in a further column.

    Method: compatibility normalization and deletion of ignorable characters, then for every word the best path
    through the lattice of look-alike letters, scored by letter pairs of one script that were counted over all
    values. Superscript digits stay. Null stays null; blank or invisible texts become empty; repeated rows stay.
    Texts that are plain on sight never leave the JVM. A column that has the new one's name gives way to it.
    """
    model = model or letter_pairs(df, cols)

    @F.pandas_udf("string")
    def plainly(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, str] = {}
        for batch in batches:
            codes, distinct = pd.factorize(batch)
            if len(known) > 200_000:
                known.clear()
            for v in distinct:
                if v not in known:
                    known[v] = plain(v, model)
            forms = [known[v] for v in distinct]
            yield pd.Series([forms[c] if c >= 0 else None for c in codes], dtype=object)

    own = {c: F.col(f"`{c}`") for c in cols}
    sent = df.withColumns({f"__u_{c}": plainly(F.when(~certain(v), v)) for c, v in own.items()})
    done = sent.withColumns({f"{c}{suffix}": F.when(certain(v), v).otherwise(F.col(f"`__u_{c}`")) for c, v in own.items()})
    return done.drop(*[f"__u_{c}" for c in cols])


def disguised_fields(record_view: DataFrame, fields: Sequence[str] = ("project_name", "unit")) -> DataFrame:
    """``record_id, field_name`` of the records whose field is not in its plain form, each once."""
    slim = record_view.select("record_id", *fields)
    forms = plain_form(slim, fields)
    cases = F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"{f}_plain")), F.lit(f)) for f in fields])
    return forms.select("record_id", F.explode(F.array_compact(cases)).alias("field_name")).distinct()
