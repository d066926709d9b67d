"""Schemas that drift from file to file: every change, and one consistent table.

Fields of neighbouring files of a feed that lost or gained a name are matched by similarity flooding. Their schema
graphs hold fields, types, name parts, nested members and, as content, what the fields say about the documents both
files speak of.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daywise.session import spread, stored

#: A pair of fields is one field from this flooded score, of at most 1.
LEAST_SCORE = 0.05
#: Fields that say the same of fewer of the shared documents than this share, beyond chance, are two fields.
DIFFERENT = 0.4
#: Names are alike from this likeness, where one column is found for all files.
NAME_FROM = 0.45
#: Distinct field names that may reach the driver to be grouped; schemas have names in number of people, not of rows.
MOST_NAMES = 20_000


class _Decimal(str):
    """A JSON number as written with a point."""


def _read(payload: str | None) -> dict | None:
    """The fields of a readable payload, else None."""
    if payload is None:
        return None
    try:
        out = json.loads(payload, parse_float=lambda s: _Decimal(s) if "." in s else int(float(s)), parse_constant=lambda s: None)
    except (ValueError, RecursionError, OverflowError):
        return None
    return out if isinstance(out, dict) else None


def json_type(v: object) -> str | None:
    """integer, decimal, string, boolean, array or object; None for null."""
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, _Decimal):
        return "decimal"
    if isinstance(v, int):
        return "integer"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def _leaves(v: object) -> list[object]:
    if isinstance(v, dict):
        return [x for k in sorted(v) for x in _leaves(v[k])]
    if isinstance(v, list):
        return [x for y in v for x in _leaves(y)]
    return [] if v is None else [v]


def _runs(leaf: object) -> list[str]:
    """Words and numbers of a leaf; a minus that stands before a number, and not between two parts, belongs to it."""
    return re.findall(r"(?<![^\W_])-(?=\d)[^\W_]+|[^\W_]+", str(leaf).lower())


def _numeric(part: str) -> bool:
    return part.lstrip("-").isdigit()


def content_forms(v: object) -> list[str]:
    """The forms by which contents of different types compare: all parts joined, its numbers alone, its words alone.

    58, "58", 58.0, ["present", 58] and {"state": "present", "value": 58} share a form, as do "1-3" and [1, 3],
    and 0.9 and {"major": 0, "minor": 9}.
    """
    leaves = _leaves(v)
    parts = [r for x in leaves for r in _runs(x)]
    forms = {"|".join(parts)}
    numbers = [p for p in parts if _numeric(p)]
    if numbers:
        forms.add("|".join(numbers))
    words = [p for p in parts if not _numeric(p)]
    if words and len(words) < len(parts):
        forms.add("|".join(words))
    for x in leaves:
        if isinstance(x, _Decimal) or isinstance(x, str) and re.fullmatch(r"-?\d+\.0+", x):
            forms.add(str(x).split(".")[0] if not str(x).split(".")[1].strip("0") else str(x))
    return sorted(f for f in forms if f)


def _shape(v: object) -> str:
    """A digest of a value's whole text with its numbers taken out."""
    return hashlib.md5(re.sub(r"\d+", "9", "|".join(str(x) for x in _leaves(v))).encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest()


def name_parts(name: str) -> list[str]:
    """Words of a field name, whatever joins them."""
    return [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_A-Za-z]+", name)]


@functools.lru_cache(maxsize=100_000)  # names are few beside the files that use them
def name_likeness(a: str, b: str) -> float:
    """1 for names of the same words in any order and joining, else the Dice share of their letter triples and words."""
    pa, pb = name_parts(a), name_parts(b)
    small = {"of", "n", "total", "the", "no", "num", "nr"}
    ca, cb = ({p.rstrip("s") or p for p in x if p not in small} or set(x) for x in (pa, pb))
    if ca == cb:
        return 1.0
    words = 2 * len(ca & cb) / max(1, len(ca) + len(cb))
    ta, tb = ({f"  {''.join(x)} "[i : i + 3] for i in range(len("".join(x)) + 1)} for x in (pa, pb))
    return max(words, 2 * len(ta & tb) / max(1, len(ta) + len(tb)))


def _type_likeness(a: str | None, b: str | None) -> float:
    if a is None or b is None or a == b:
        return 1.0
    return 0.7 if {a, b} <= {"integer", "decimal"} else 0.4


class _Label(NamedTuple):
    """One kind of edge of both schema graphs: which fields have which symbols, and how alike symbols are at first."""

    left: np.ndarray
    right: np.ndarray
    alike: np.ndarray


def _label(left: Sequence[Sequence[str]], right: Sequence[Sequence[str]], likeness: Callable[[str, str], float]) -> _Label:
    xs, ys = sorted({x for s in left for x in s}), sorted({y for s in right for y in s})
    on = lambda sets, names: np.array([[float(n in s) for n in names] for s in sets]).reshape(len(sets), len(names))
    return _Label(on(left, xs), on(right, ys), np.array([[likeness(x, y) for y in ys] for x in xs]).reshape(len(xs), len(ys)))


def flood(start: np.ndarray, labels: Sequence[_Label], nodes: np.ndarray | None = None, *, rounds: int = 200, least: float = 1e-4) -> np.ndarray:
    """Similarity flooding between the fields of two schemas: scores of all pairs, from their first scores.

    The graph's nodes are pairs of fields and, for each kind of edge, pairs of symbols (types, words of names, nested
    members). A node's score flows to the nodes it is joined with, in equal parts over each kind of edge, beside its
    first score, until the scores settle. As all pairs of fields that share a pair of symbols are joined with it, a
    round is a few products of incidence matrices. The first scores are added in each round and the highest score is 1.
    Pairs of fields that are not among ``nodes`` pass nothing on and stay at 0.
    """
    nodes = np.ones(start.shape) if nodes is None else nodes.astype(float)
    start = start * nodes
    even = lambda m: np.divide(1.0, m, out=np.zeros_like(m), where=m > 0)
    fields = start.copy()
    symbols = [x.alike.copy() for x in labels]
    of_fields = [even(np.outer(x.left.sum(1), x.right.sum(1))) for x in labels]
    of_symbols = [even(np.outer(x.left.sum(0), x.right.sum(0))) for x in labels]
    for _ in range(rounds):
        base = start + fields
        held = [x.alike + z for x, z in zip(labels, symbols)]
        fresh = base + nodes * sum((x.left @ (z * share) @ x.right.T for x, z, share in zip(labels, held, of_symbols)), np.zeros_like(base))
        flown = [z + x.left.T @ (base * share) @ x.right for x, z, share in zip(labels, held, of_fields)]
        top = max([float(m.max()) for m in (fresh, *flown) if m.size], default=0.0) or 1.0
        fresh, flown = fresh / top, [z / top for z in flown]
        moved = float(((fresh - fields) ** 2).sum() + sum(((x - y) ** 2).sum() for x, y in zip(flown, symbols))) ** 0.5
        fields, symbols = fresh, flown
        if moved < least:
            break
    return fields / (float(fields.max()) if fields.size and fields.max() > 0 else 1.0)


def first_scores(before: Sequence[dict], after: Sequence[dict], content: dict[tuple[str, str], float]) -> tuple[np.ndarray, np.ndarray]:
    """How alike pairs of fields are by themselves: what they say on shared documents, where known, and their names.

    Fields of one name say the same unless it is known otherwise. Equal shapes of values speak for a pair nothing
    else is known of, and for one whose fields say one thing throughout, which changes from file to file. The second
    result tells which pairs can be one field: not those that are known to say different things.
    """
    out, nodes = np.zeros((len(before), len(after))), np.ones((len(before), len(after)), dtype=bool)
    for i, a in enumerate(before):
        for j, b in enumerate(after):
            agreed, name = content.get((a["field"], b["field"])), name_likeness(a["field"], b["field"])
            shape = a["shape"] is not None and a["shape"] == b["shape"]
            constant = min(a["chance"] or 0.0, b["chance"] or 0.0) > 0.9
            if a["field"] == b["field"]:
                out[i, j] = 1.0
            elif agreed is not None and not (constant and agreed < DIFFERENT):
                out[i, j] = 0.75 * max(0.0, agreed) + 0.25 * name
                nodes[i, j] = agreed >= DIFFERENT
            else:
                out[i, j] = 0.75 * name + (0.25 if shape else 0.0)
    return out, nodes


def correspondences(before: Sequence[dict], after: Sequence[dict], content: dict[tuple[str, str], float]) -> list[tuple[str, str, float]]:
    """One-to-one pairs of fields with their flooded scores, from the highest, down to ``LEAST_SCORE``.

    ``before`` and ``after`` are whole schemas: ``field``, ``type``, ``members`` (names of nested fields), ``chance`` and
    ``shape``. Fields of one name are in the graph like all others.
    """
    names = [[name_parts(x["field"]) for x in side] for side in (before, after)]
    types = [[[x["type"] or ""] for x in side] for side in (before, after)]
    same = lambda x, y: float(x == y)
    labels = [_label(*types, lambda x, y: _type_likeness(x or None, y or None)), _label(*names, same), _label(*[[x["members"] for x in side] for side in (before, after)], same)]
    start, nodes = first_scores(before, after, content)
    score = flood(start, labels, nodes)
    out, used_a, used_b = [], set(), set()
    for i, j in sorted(np.ndindex(score.shape), key=lambda ij: (-score[ij], before[ij[0]]["field"] != after[ij[1]]["field"], ij)):
        if score[i, j] < LEAST_SCORE:
            break
        if i not in used_a and j not in used_b:
            out.append((before[i]["field"], after[j]["field"], float(score[i, j])))
            used_a.add(i)
            used_b.add(j)
    return out


_FIELDS = "feed string, file_seq int, field string, kind string, rows long, members array<string>"


def _field_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()
    members: dict[tuple, set] = defaultdict(set)
    for batch in batches:
        for feed, seq, payload in zip(batch["feed"], batch["file_seq"], batch["payload"]):
            for k, v in (_read(payload) or {}).items():
                seen[feed, seq, k, json_type(v)] += 1
                if isinstance(v, dict):
                    members[feed, seq, k, "object"].update(v)
        if len(seen) > 100_000:
            yield _counted(seen, members)
            seen, members = Counter(), defaultdict(set)
    yield _counted(seen, members)


def _counted(seen: Counter, members: dict) -> pd.DataFrame:
    return pd.DataFrame([(*k, n, sorted(members.get(k, ()))) for k, n in seen.items()], columns=["feed", "file_seq", "field", "kind", "rows", "members"])


def file_fields(snapshots: DataFrame) -> DataFrame:
    """``feed, file_seq, field, kind, members`` of each file: kind is the most frequent type of non-null values."""
    rows = snapshots.select("feed", F.col("file_seq").cast("int").alias("file_seq"), "payload").filter("payload is not null and feed is not null and file_seq is not null")
    counted = rows.mapInPandas(_field_counts, _FIELDS).groupBy("feed", "file_seq", "field", "kind").agg(F.sum("rows").alias("rows"), F.array_distinct(F.flatten(F.collect_list("members"))).alias("members"))
    best = F.max(F.when(F.col("kind").isNotNull(), F.struct("rows", "kind", "members"))).alias("b")
    return counted.groupBy("feed", "file_seq", "field").agg(best).select("feed", "file_seq", "field", "b.kind", F.coalesce("b.members", F.array().cast("array<string>")).alias("members"))


def _said(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """What each payload says in the fields asked for."""
    for batch in batches:
        out = []
        for feed, seq, payload, wanted in zip(batch["feed"], batch["file_seq"], batch["payload"], batch["wanted"]):
            fields = _read(payload)
            if not fields or fields.get(key) is None:
                continue
            for w in wanted:
                v = fields.get(w["field"])
                if v is not None:
                    out.append((feed, w["seq"], w["later"], str(fields[key]), w["field"], content_forms(v), _shape(v)))
        yield pd.DataFrame(out, columns=["feed", "seq", "later", "doc", "field", "forms", "shape"])


def schema_changes(snapshots: DataFrame, *, key: str = "document_token") -> DataFrame:
    """``feed, file_seq, change_kind, field_name, former_name``: each change of a file against its feed's file before.

    Unreadable and null payloads say nothing; a file without readable payloads has no fields and takes part in no
    comparison; files that landed twice or late count by their number. ``key`` is the payload field that names what a
    row is about: fields of two files agree where they say the same about the same. Rows with a null feed or number
    take no part. An empty table has no changes.
    """
    # Schemas are small beside what they were read from; written once, they are not read out of the payloads again.
    fields = stored(file_fields(snapshots))
    files = fields.select("feed", "file_seq").distinct()
    pairs = files.join(files.select("feed", (F.col("file_seq") + 1).alias("file_seq")), ["feed", "file_seq"])
    now = fields.join(pairs, ["feed", "file_seq"], "left_semi").select("feed", "file_seq", "field", F.col("kind").alias("kind_b"), F.col("members").alias("members_b"), F.lit(True).alias("later"))
    old = fields.withColumn("file_seq", F.col("file_seq") + 1).join(pairs, ["feed", "file_seq"], "left_semi").select("feed", "file_seq", "field", F.col("kind").alias("kind_a"), F.col("members").alias("members_a"), F.lit(True).alias("earlier"))
    both = old.join(now, ["feed", "file_seq", "field"], "full_outer")
    kept = both.filter("earlier and later and kind_a <> kind_b").select("feed", "file_seq", F.lit("type_changed").alias("change_kind"), F.col("field").alias("field_name"), F.lit("").alias("former_name"))
    loose = stored(both.filter("earlier is null or later is null").select("feed", "file_seq", "field", F.col("later").isNotNull().alias("later"), F.coalesce("kind_a", "kind_b").alias("kind"), F.coalesce("members_a", "members_b").alias("members")))

    # Content is read only where a pair of files both lost and gained names.
    open_pairs = loose.groupBy("feed", "file_seq").agg(F.max("later").alias("x"), F.min("later").alias("y")).filter("x and not y").select("feed", "file_seq")
    asked = loose.join(open_pairs, ["feed", "file_seq"], "left_semi")
    wanted = asked.select("feed", F.when(F.col("later"), F.col("file_seq")).otherwise(F.col("file_seq") - 1).alias("file_seq"), F.struct(F.col("file_seq").alias("seq"), "later", "field").alias("w")).groupBy("feed", "file_seq").agg(F.collect_list("w").alias("wanted"))
    rows = snapshots.select("feed", F.col("file_seq").cast("int").alias("file_seq"), "payload").filter("payload is not null").join(wanted, ["feed", "file_seq"])
    # Four branches read what was said; written once, the payloads are parsed once.
    said = stored(spread(rows).mapInPandas(lambda b: _said(b, key), "feed string, seq int, later boolean, doc string, field string, forms array<string>, shape string").distinct())
    left = said.filter("not later").select("feed", "seq", "doc", F.col("field").alias("a"), F.col("forms").alias("forms_a"), F.col("shape").alias("shape_a"))
    right = said.filter("later").select("feed", "seq", "doc", F.col("field").alias("b"), F.col("forms").alias("forms_b"), F.col("shape").alias("shape_b"))
    met = left.join(right, ["feed", "seq", "doc"]).groupBy("feed", "seq", "a", "b").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.arrays_overlap("forms_a", "forms_b")).alias("same"))
    # Chance: how often equal forms meet when documents are shuffled.
    form = lambda side, f, name: side.select("feed", "seq", F.col(name).alias("f"), F.element_at(F.array_sort(f"forms_{name}"), 1).alias("v"), F.col(f"shape_{name}").alias("shape")).groupBy("feed", "seq", "f", "v", "shape").agg(F.count(F.lit(1)).alias("n"))
    forms = form(left, "forms_a", "a").withColumn("later", F.lit(False)).unionByName(form(right, "forms_b", "b").withColumn("later", F.lit(True)))
    # The most frequent values bound chance from both sides; a field's list of them stays short.
    few = forms.groupBy("feed", "seq", "later", "f").agg(F.sum("n").alias("total"), F.max(F.struct("n", "v")).alias("top"), F.max(F.struct("n", "shape")).alias("s"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    facts = few.select("feed", F.col("seq").alias("file_seq"), "later", F.col("f").alias("field"), (F.col("squares") / (F.col("total") * F.col("total"))).alias("chance"), F.col("s.shape").alias("shape"))

    known = facts.drop("later")  # a field that was lost or gained is on one side only
    whole = both.join(open_pairs, ["feed", "file_seq"], "left_semi").join(known, ["feed", "file_seq", "field"], "left")
    nodes = whole.groupBy("feed", "file_seq").agg(F.collect_list(F.struct("field", "earlier", "later", "kind_a", "kind_b", "members_a", "members_b", "chance", "shape")).alias("nodes"))
    links = met.groupBy("feed", F.col("seq").alias("file_seq")).agg(F.collect_list(F.struct("a", "b", "docs", "same")).alias("links"))

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for feed, seq, found, joined in zip(batch["feed"], batch["file_seq"], batch["nodes"], batch["links"]):
                out += [(feed, seq, *c) for c in _changes(list(found), [] if joined is None else list(joined))]
            yield pd.DataFrame(out, columns=["feed", "file_seq", "change_kind", "field_name", "former_name"])

    result = "feed string, file_seq int, change_kind string, field_name string, former_name string"
    renamed = nodes.join(links, ["feed", "file_seq"], "left").mapInPandas(matched, result)
    single = loose.join(open_pairs, ["feed", "file_seq"], "left_anti").select("feed", "file_seq", F.when(F.col("later"), "added").otherwise("removed").alias("change_kind"), F.col("field").alias("field_name"), F.lit("").alias("former_name"))
    return kept.unionByName(single).unionByName(renamed)


def _changes(found: list, links: list) -> list[tuple[str, str, str]]:
    """The changes between two files, but for types of fields that kept their names."""
    side = lambda there, kind, members: sorted(({"field": x["field"], "type": x[kind], "members": sorted(x[members]), "chance": x["chance"], "shape": x["shape"]} for x in found if x[there]), key=lambda x: x["field"])
    before, after = side("earlier", "kind_a", "members_a"), side("later", "kind_b", "members_b")
    by_a, by_b = {x["field"]: x for x in before}, {x["field"]: x for x in after}
    content: dict[tuple[str, str], float] = {}
    for x in links:
        a, b = by_a[x["a"]], by_b[x["b"]]
        chance = min(1.0, max(a["chance"] or 0.0, b["chance"] or 0.0) if x["same"] else 0.0)
        share = x["same"] / x["docs"]
        # Agreement beyond chance; two constants that agree tell half.
        content[x["a"], x["b"]] = 0.5 * share if chance > 0.98 else (share - chance) / (1 - chance)
    paired = [(a, b) for a, b, _ in correspondences(before, after, content)]
    out: list[tuple[str, str, str]] = []
    for a, b in paired:
        if a != b:
            out.append(("renamed", b, a))
            if by_a[a]["type"] and by_b[b]["type"] and by_a[a]["type"] != by_b[b]["type"]:
                out.append(("type_changed", b, a))
    out += [("removed", a, "") for a in by_a if a not in {x for x, _ in paired}]
    out += [("added", b, "") for b in by_b if b not in {y for _, y in paired}]
    return out


def field_groups(changes: DataFrame, fields: DataFrame, known: Sequence[str] = ()) -> dict[str, str]:
    """For each field name of any file the one name its column has: a known one, else the most frequent of its names.

    A rename seen once joins two names only if they are alike. What is collected are names, whose number is checked.
    """
    names = fields.groupBy("field").agg(F.count(F.lit(1)).alias("files")).limit(MOST_NAMES + 1).collect()
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} field names: their values are data, not a schema")
    files = {r.field: r.files for r in names}
    root = {f: f for f in files}

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in changes.filter("change_kind = 'renamed'").groupBy("former_name", "field_name").count().collect():
        if r["count"] > 1 or name_likeness(r.former_name, r.field_name) >= NAME_FROM:
            a, b = find(r.former_name), find(r.field_name)
            root[max(a, b)] = min(a, b)
    alike: dict[tuple[str, ...], str] = {}
    for f in sorted(files):  # spellings of the same words need no rename
        first = alike.setdefault(tuple(name_parts(f)), f)
        root[find(f)] = find(first)
    best: dict[str, str] = {}
    for f in sorted(files, key=lambda f: (f not in known, -files[f], f)):
        best.setdefault(find(f), f)
    return {f: best[find(f)] for f in files}


#: A whole number in text, with its sign; neither part of a word nor of a fraction.
_WHOLE = re.compile(r"(?<![\w.,])[-+]?\d+(?:\.0+)?(?![\w]|[.,]\d)")


def as_integer(v: object) -> int | None:
    """The one whole number a value of any type holds, with its sign; else None, as for one beyond 64 bits."""
    found: set[int] = set()
    for x in _leaves(v):
        if isinstance(x, int) and not isinstance(x, bool):
            found.add(x)
        elif isinstance(x, str):  # decimals are texts as written
            found.update(int(m.split(".")[0]) for m in _WHOLE.findall(x.replace("\u2212", "-")))
    return n if len(found) == 1 and -(2**63) <= (n := found.pop()) < 2**63 else None


def as_version(v: object) -> str | None:
    """``major.minor`` of a version written as a number, text or object."""
    parts = [p for x in _leaves(v) for p in re.findall(r"\d+", str(x))]
    return ".".join(parts) if parts else None


def consistent_snapshots(snapshots: DataFrame, *, integers: Sequence[str] = ("page_count", "line_count"), versions: Sequence[str] = ("schema_version",), key: str = "document_token") -> DataFrame:
    """One table of all snapshots: typed columns for the named fields, all others as canonical JSON text in a map.

    Each ``snapshot_id`` appears once with its latest landing; unreadable and null payloads keep their row with null
    fields and ``readable`` false. Values of any type are cast to the column's; what holds no single whole number
    is null there.
    """
    names = field_groups(schema_changes(snapshots, key=key), file_fields(snapshots), (*versions, *integers, key))
    last = snapshots.groupBy("snapshot_id").agg(F.max(F.struct("landed_at", "feed", "file_seq", "source_file", "payload")).alias("v")).select("snapshot_id", "v.*")
    typed = [*versions, *integers]

    def cast(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ["readable", key, *typed, "others"]}
            for payload in batch["payload"]:
                fields = _read(payload)
                row = {names.get(k, k): v for k, v in (fields or {}).items()}
                out["readable"].append(fields is not None)
                out[key].append(None if row.get(key) is None else str(row.pop(key)))
                for c in versions:
                    out[c].append(as_version(row.pop(c, None)))
                for c in integers:
                    out[c].append(as_integer(row.pop(c, None)))
                out["others"].append({k: json.dumps(v, sort_keys=True, ensure_ascii=False) for k, v in row.items() if v is not None})
            fresh = batch.drop(columns=["payload"]).assign(**{c: pd.Series(v, index=batch.index, dtype=object) for c, v in out.items()})
            yield fresh

    schema = ", ".join([f"`{n}` {t}" for n, t in last.dtypes if n != "payload"] + ["readable boolean", f"`{key}` string"] + [f"`{c}` string" for c in versions] + [f"`{c}` long" for c in integers] + ["others map<string,string>"])
    return last.mapInPandas(cast, schema)
