"""Consensus labels, agreement and annotator reliability from labels that disagree."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from daywise.session import cut, cut_by, stored

CLASSES = ("clear", "unclear", "needs_clinician")
#: Labels in other languages.
OTHER_WORDS = {"明确": "clear", "看不清": "unclear", "需临床判断": "needs_clinician"}
#: Overlap that holds weights back where an annotator shares next to no item with others.
RIDGE = 1.0
#: Items with more labels than this are summed by a split aggregate instead of a window; the sums are the same.
HOT = 10_000


#: White space of all kinds.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def label_class(label: Column) -> Column:
    """One spelling for each label; null for none of the classes (not started, blank, null)."""
    known = {c: c for c in CLASSES} | OTHER_WORDS
    # One look-up, so that the text is made once.
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.regexp_replace(F.lower(F.btrim(label, F.lit(WHITE))), rf"[{WHITE}_-]+", "_"))


def _sum(parts: Sequence[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _directions(k: int) -> list[list[float]]:
    """The corners of a simplex of ``k`` classes in k - 1 dimensions: unit vectors that sum to nothing."""
    out = [[0.0] * (k - 1) for _ in range(k)]
    for j in range(k - 1):
        out[j][j] = math.sqrt(max(0.0, 1.0 - sum(x * x for x in out[j][:j])))
        for i in range(j + 1, k):
            out[i][j] = (-1.0 / (k - 1) - sum(x * y for x, y in zip(out[i][:j], out[j][:j]))) / out[j][j]
    return out


def _solved(df: DataFrame, k: int, m: int, mixed: Callable[[int, int], Column]) -> DataFrame:
    """``df`` with ``x{a}_{j}``: the solution of the symmetric system ``d{j}_{l}`` for each label's right side, by elimination."""
    df = df.withColumns({f"e{i}_{j}": F.col(f"d{min(i, j)}_{max(i, j)}") + (RIDGE if i == j else 0.0) for i in range(m) for j in range(m)} | {f"y{a}_{j}": mixed(a, j) for a in range(k) for j in range(m)})
    for p in range(m):
        below = {i: F.col(f"e{i}_{p}") / F.col(f"e{p}_{p}") for i in range(p + 1, m)}
        df = df.withColumns({f"e{i}_{j}": F.col(f"e{i}_{j}") - f * F.col(f"e{p}_{j}") for i, f in below.items() for j in range(p + 1, m)} | {f"y{a}_{i}": F.col(f"y{a}_{i}") - f * F.col(f"y{a}_{p}") for i, f in below.items() for a in range(k)})
    for p in reversed(range(m)):
        df = df.withColumns({f"x{a}_{p}": (F.col(f"y{a}_{p}") - _sum([F.lit(0.0), *[F.col(f"e{p}_{j}") * F.col(f"x{a}_{j}") for j in range(p + 1, m)]])) / F.col(f"e{p}_{p}") for a in range(k)})
    return df


class _Labels(NamedTuple):
    """Counted labels partitioned by item, and apart from them those of items too large for one task."""

    usual: DataFrame
    hot: DataFrame | None


def _with_item_sums(labels: _Labels, value: Callable[[DataFrame], DataFrame], sums: dict[str, Column]) -> DataFrame:
    """Label rows, each with the sums over all labels of its item."""
    item = Window.partitionBy("item")
    out = value(labels.usual).withColumns({n: F.sum(c).over(item) for n, c in sums.items()})
    if labels.hot is not None:
        rows = value(labels.hot)
        out = out.unionByName(rows.join(rows.groupBy("item").agg(*[F.sum(c).alias(n) for n, c in sums.items()]), "item").select(*out.columns))
    return out


def _weights(labels: _Labels, shares: Sequence[float], rounds: int, least: float) -> DataFrame:
    """``annotator, u``: for each annotator the weight vectors of its labels, flat.

    Two annotators' labels a and b agree beyond chance, over the items they share, as u_a * u_b: the vectors are the
    leading eigenvectors (one less than there are classes) of the chance-centred agreement matrix of all labels of
    all annotators, fitted to the number of shared items. A round of the power iteration multiplies by the matrix
    without making it: each item sums the vectors of its labels, each label takes its item's sum less its own part,
    each annotator sums these by label and divides by the overlap. No pair of annotators is ever a row. It starts from
    what the labels are called, which tells the classes apart, and ends when no weight moves by more than ``least``.
    """
    k, m = len(shares), len(shares) - 1
    corners = _directions(k)
    mean = [sum(shares[a] * corners[a][j] for a in range(k)) for j in range(m)]
    start = [0.7 * (corners[a][j] - mean[j]) for a in range(k) for j in range(m)]
    pairs = [(j, i) for j in range(m) for i in range(j, m)]
    at = lambda a, j: F.col("u")[a * m + j]
    gram = lambda: F.array(*[_sum([at(a, j) * at(a, i) for a in range(k)]) for j, i in pairs])
    who = [labels.usual] + ([labels.hot] if labels.hot is not None else [])
    u = functools.reduce(DataFrame.union, [d.select("annotator") for d in who]).distinct().withColumn("u", F.array(*[F.lit(x) for x in start]))
    u = stored(u.withColumn("g", gram()))
    for _ in range(rounds):
        own = {f"o{j}": F.get("u", F.col("label") * m + j) for j in range(m)} | {f"g{j}_{i}": F.col("g")[p] for p, (j, i) in enumerate(pairs)}
        joined = lambda df, u=u, own=own: df.join(u, "annotator").withColumns(own).drop("u", "g")
        rows = _with_item_sums(labels, joined, {f"t{c}": F.col("n") * F.col(c) for c in own})
        rest = {c: F.col("n") * (F.col(f"t{c}") - F.col("n") * F.col(c)) for c in own}
        # First by annotator and label with few sums, whose code stays small enough to be compiled; then by annotator.
        by_label = rows.groupBy("annotator", "label").agg(F.sum("n").alias("n"), *[F.sum(c).alias(f"r{name}") for name, c in rest.items()])
        said = lambda a, c: F.sum(F.when(F.col("label") == a, F.col(c)).otherwise(0.0))
        per = by_label.groupBy("annotator").agg(*[said(a, "n").alias(f"n{a}") for a in range(k)], *[said(a, f"ro{j}").alias(f"s{a}_{j}") for a in range(k) for j in range(m)], *[F.sum(f"rg{j}_{i}").alias(f"d{j}_{i}") for j, i in pairs])
        every = _sum([F.col(f"n{a}") for a in range(k)])
        per = _solved(per, k, m, lambda a, j: F.col(f"s{a}_{j}") - F.col(f"n{a}") / every * _sum([F.col(f"s{b}_{j}") for b in range(k)]))
        # Half the step: simultaneous updates of all annotators would swing.
        fresh = per.join(u.select("annotator", F.col("u").alias("was")), "annotator").select("annotator", "was", F.array(*[(F.col(f"x{a}_{j}") + F.col("was")[a * m + j]) / 2 for a in range(k) for j in range(m)]).alias("u"))
        moved = Observation()
        fresh = fresh.observe(moved, F.max(F.array_max(F.zip_with("u", "was", lambda x, y: F.abs(x - y)))).alias("most"))
        u = stored(fresh.select("annotator", "u").withColumn("g", gram()))
        if (moved.get["most"] or 0.0) < least:
            break
    return u.select("annotator", "u")


def consensus(labels: DataFrame, classes: Sequence[str] = CLASSES, *, rounds: int = 100, least: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Consensus per item and reliability per annotator of ``item, annotator, label`` rows.

    Method: spectral weights (see ``_weights``) of each annotator's labels decide the votes, and nothing else does. One
    weight vector per label, not one number per annotator, also reads annotators who mix up two classes or always
    give one: a label's vector points to the classes in which it is really given, and is short if it is given in all.

    First result ``item, judgment, confidence, agreement, n_labels``: confidence is the winner's lead over the second
    class against the most its labels could give (0 to 1), agreement the share of the item's label pairs that are
    equal (null under two labels). Second ``annotator, n_labels, rho, accuracy``: rho is how far the annotator's
    labels point to their own classes against the most reliable annotator's, accuracy the share of its labels that
    equal the consensus. Null items, annotators and labels take no part; a label given twice to an item by one
    annotator counts twice; an item's ties go to the class with the larger share, then to the earlier one in
    ``classes``. Empty input gives empty results.
    """
    k, m = len(classes), len(classes) - 1
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    rows = labels.select("item", "annotator", number.cast("int").alias("label")).filter("item is not null and annotator is not null and label >= 0")
    counted = rows.groupBy("item", "annotator", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    held = _Labels(cut_by(counted, "item"), None)
    hot = stored(held.usual.groupBy("item").count().filter(F.col("count") > HOT).select("item"))
    if not hot.isEmpty():
        held = _Labels(cut_by(held.usual.join(hot, "item", "left_anti"), "item"), cut(held.usual.join(hot, "item", "left_semi").repartition("item", "annotator")))
    whole = held.usual if held.hot is None else held.usual.unionByName(held.hot)
    by_class = {r.label: r.n for r in whole.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    total = sum(by_class.values()) or 1.0
    shares = [by_class.get(c, 0.0) / total for c in range(k)]
    u = _weights(held, shares, rounds, least)

    # The classes' directions: where all annotators' labels of a name point together.
    points = u.agg(*[F.sum(F.col("u")[a * m + j]).alias(f"c{a}_{j}") for a in range(k) for j in range(m)]).first()
    centre = [[points[f"c{a}_{j}"] or 0.0 for j in range(m)] for a in range(k)]
    centre = [[x / size for x in c] if (size := math.hypot(*c)) > 0 else d for c, d in zip(centre, _directions(k))]
    own = {f"o{j}": F.get("u", F.col("label") * m + j) for j in range(m)}
    voted = whole.join(u, "annotator").withColumns(own)
    length = F.sqrt(_sum([F.col(f"o{j}") * F.col(f"o{j}") for j in range(m)]))
    per = voted.groupBy("item").agg(*[F.sum(F.col("n") * F.col(f"o{j}")).alias(f"t{j}") for j in range(m)], F.sum(F.col("n") * length).alias("most"), F.sum("n").alias("n_labels"), *[F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0.0)).alias(f"n{c}") for c in range(k)])
    order = sorted(range(k), key=lambda c: (-shares[c], c))
    votes = F.reverse(F.array_sort(F.array(*[F.struct(_sum([F.col(f"t{j}") * centre[c][j] for j in range(m)]).alias("score"), F.lit(-i).alias("first"), F.lit(classes[c]).alias("judgment")) for i, c in enumerate(order)])))
    lead = (F.col("v")[0]["score"] - F.col("v")[1]["score"]) / (F.col("most") * k / m)
    pairs = F.col("n_labels") * (F.col("n_labels") - 1)
    same = _sum([F.col(f"n{c}") * (F.col(f"n{c}") - 1) for c in range(k)])
    items = per.withColumn("v", votes).select("item", F.col("v")[0]["judgment"].alias("judgment"), F.when(F.col("most") > 0, F.least(F.lit(1.0), lead)).otherwise(0.0).alias("confidence"), F.when(pairs > 0, same / pairs).alias("agreement"), F.col("n_labels").cast("long").alias("n_labels"))

    name = F.element_at(F.array(*[F.lit(c) for c in classes]), F.col("label") + 1)
    right = F.sum(F.when(name == F.col("judgment"), F.col("n")).otherwise(0.0))
    each = whole.join(items.select("item", "judgment"), "item").groupBy("annotator").agg(F.sum("n").cast("long").alias("n_labels"), (right / F.sum("n")).alias("accuracy"))
    towards = u.select("annotator", _sum([F.col("u")[a * m + j] * centre[a][j] for a in range(k) for j in range(m)]).alias("s"))
    most = towards.agg(F.max("s")).scalar()
    return items, each.join(towards, "annotator").select("annotator", "n_labels", F.when(most > 0, F.greatest(F.lit(-1.0), F.col("s") / most)).otherwise(0.0).alias("rho"), "accuracy")


def review_labels(review_template: DataFrame) -> DataFrame:
    """``item, annotator, label`` of the sheets; a sheet's copies count once, spellings of labels and codes are one.

    A label whose annotator is null tells nobody's reliability and takes no part.
    """
    code = lambda c: F.upper(F.translate(F.col(c), WHITE, ""))
    pairs = (("reviewer_a", "reviewer_a_judgment"), ("reviewer_b", "reviewer_b_judgment"), ("adjudicator", "adjudication"))
    given = F.explode(F.array(*[F.struct(F.lit(a).alias("place"), code(a).alias("annotator"), label_class(F.col(b)).alias("label")) for a, b in pairs])).alias("g")
    rows = review_template.select("sheet_id", F.col("observation_id").alias("item"), given).select("sheet_id", "item", "g.*").filter("label is not null")
    return rows.filter("annotator is not null").distinct().select("item", "annotator", "label")


def judged_observations(review_template: DataFrame, **options: float) -> tuple[DataFrame, DataFrame]:
    """``observation_id, judgment, confidence, agreement, n_labels`` of every observation, and the reviewers.

    Observations without any label get the class with the largest share among all items, with null confidence.
    """
    items, who = consensus(review_labels(review_template), **options)
    items = stored(items)
    common = items.groupBy("judgment").count().orderBy(F.col("count").desc(), "judgment").first()
    every = review_template.select(F.col("observation_id").alias("item")).filter("item is not null").distinct()
    done = every.join(items, "item", "left").withColumn("judgment", F.coalesce("judgment", F.lit(common.judgment if common else CLASSES[0])))
    return done.withColumnRenamed("item", "observation_id"), who
