"""Scoring of predicted records, fields and groupings against references."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywise.functions.values import canonical_number, finite_number, same_number, unit_key


def set_scores(reference: Column, predicted: Column) -> dict[str, Column]:
    """Exactness, precision and recall of two id arrays.

    Precision of an empty prediction is 1 beside an empty reference, else null; recall on an empty reference is 1
    for an empty prediction, else 0. Repeated ids count once.
    """
    ref, got = F.array_distinct(reference), F.array_distinct(predicted)
    both = F.size(F.array_intersect(ref, got))
    return {
        "set_exact_match": (F.size(ref) == both) & (F.size(got) == both),
        "precision": F.when(F.size(got) > 0, both / F.size(got)).when(F.size(ref) == 0, 1.0),
        "recall": F.when(F.size(ref) > 0, both / F.size(ref)).when(F.size(got) == 0, 1.0).otherwise(0.0),
    }


def score_selections(reference: DataFrame, answers: DataFrame) -> DataFrame:
    """Each task's answer against its reference outcome.

    ``reference`` has ``task_id, status, selected, candidates``; ``answers`` has ``task_id, status, selected,
    fields_match`` (null: not judged). A task without an answer is a format failure. Against an undetermined
    reference only abstention succeeds, and the sets compare with the candidates; against an unsupported role only
    its status; else the set, the status and, where anything was selected, the fields must be right.
    """
    a = answers.select("task_id", F.lower("status").alias("said"), F.coalesce("selected", F.array().cast("array<string>")).alias("got"), "fields_match")
    both = reference.join(a, "task_id", "left")
    undetermined, unsupported = F.col("status") == "undetermined", F.col("status") == "unsupported_time_role"
    got = F.coalesce("got", F.array().cast("array<string>"))
    plain, held = set_scores(F.col("selected"), got), set_scores(F.col("candidates"), got)
    nothing = F.size(got) == 0
    answered = F.col("said").isNotNull()
    expected = F.when(undetermined | unsupported, F.col("status")).when(F.size("selected") > 0, "ok").otherwise("empty")
    status_ok = F.when(answered, F.col("said") == expected)
    exact = F.when(~answered | unsupported, F.lit(None)).when(undetermined & nothing, F.col("said") == "undetermined").when(undetermined, held["set_exact_match"]).otherwise(plain["set_exact_match"])
    abstained = undetermined | unsupported
    success = answered & F.coalesce(status_ok, F.lit(False)) & F.when(abstained, nothing).otherwise(plain["set_exact_match"] & (nothing | F.coalesce("fields_match", F.lit(False))))
    return both.select(
        "task_id", F.col("status").alias("reference_status"), F.coalesce("said", F.lit("format_failure")).alias("answer_status"), exact.alias("set_exact_match"),
        F.when(~answered | unsupported, F.lit(None).cast("double")).when(undetermined & ~nothing, held["precision"]).when(~undetermined, plain["precision"]).alias("precision"),
        F.when(~answered | unsupported, F.lit(None).cast("double")).when(undetermined, F.when(F.size("candidates") > 0, held["recall"])).otherwise(plain["recall"]).alias("recall"),
        status_ok.alias("status_ok"), success.alias("task_success"),
    )


def field_mismatches(value: Column, unit: Column, day: Column, clock: Column, expected_value: Column, expected_unit: Column, expected_day: Column, expected_clock: Column, expected_precision: Column, display: Column | None = None) -> Column:
    """The codes of what an answer's fields get wrong against the record's.

    Values agree within a millionth; units in any case and spacing; days as whole numbers. Under second display the
    clock must be there and equal; under day display a clock the record does not carry is one too precise. Without
    a declared display the record's own precision governs.
    """
    shown = display if display is not None else F.when(F.lower(expected_precision) == "second", "second").otherwise("day")
    number, whole = finite_number(value), finite_number(day)
    day_ok = (whole == F.floor(whole)) & (whole == expected_day)
    day_ok = F.coalesce(day_ok, F.lit(False))
    clock_ok = F.trim(clock).rlike(r"^([01]\d|2[0-3]):[0-5]\d(:[0-5]\d)?$") & (expected_clock.isNull() | (F.trim(clock) == F.trim(expected_clock)))
    time_code = (
        F.when(day.isNull() & clock.isNull(), "missing_time").when(~day_ok, "time")
        .when((shown == "second") & clock.isNull(), "time_precision").when((shown == "second") & ~clock_ok, "time")
        .when((shown != "second") & clock.isNotNull() & ~F.lower(F.coalesce(expected_precision, F.lit(""))).eqNullSafe("second"), "time_precision")
    )
    return F.array_compact(F.array(
        F.when(value.isNull(), "missing_value").when(~F.coalesce(same_number(number, finite_number(expected_value)), F.lit(False)), "value"),
        F.when(unit.isNull(), "missing_unit").when(~unit_key(unit).eqNullSafe(unit_key(expected_unit)), "unit"),
        time_code,
    ))


def overlap_anchors(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """``pred_id, ref_id`` of observations of one case that share a source line; both have ``id, case_token, source_refs``.

    An equi-join on case and line, distinct pairs: an observation without lines has no anchor.
    """
    p = predicted.select(F.col("id").alias("pred_id"), "case_token", F.explode(F.array_distinct("source_refs")).alias("ref"))
    r = reference.select(F.col("id").alias("ref_id"), "case_token", F.explode(F.array_distinct("source_refs")).alias("ref"))
    return p.join(r, ["case_token", "ref"]).select("pred_id", "ref_id").distinct()


def largest_matching(edges: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """A largest one-to-one matching of (predicted, reference) edges, the same for any order of the edges.

    Layered shortest augmenting paths (Hopcroft and Karp), without recursion.
    """
    near: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        near.setdefault(a, []).append(b)
    mate_a: dict[str, str] = {}
    mate_b: dict[str, str] = {}
    while True:
        depth = {a: 0 for a in near if a not in mate_a}
        queue, found = list(depth), False
        for a in queue:
            for b in near[a]:
                nxt = mate_b.get(b)
                if nxt is None:
                    found = True
                elif nxt not in depth:
                    depth[nxt] = depth[a] + 1
                    queue.append(nxt)
        if not found:
            return sorted(mate_a.items())
        for root in [a for a in near if a not in mate_a]:
            path: list[tuple[str, Iterator[str]]] = [(root, iter(near[root]))]
            trail: list[str] = []
            while path:
                a, rest = path[-1]
                for b in rest:
                    nxt = mate_b.get(b)
                    if nxt is None:
                        trail.append(b)
                        for (x, _), y in zip(path, trail):
                            mate_a[x], mate_b[y] = y, x
                        path = []
                        break
                    if depth.get(nxt) == depth[a] + 1:
                        trail.append(b)
                        path.append((nxt, iter(near[nxt])))
                        break
                else:
                    depth.pop(a, None)
                    path.pop()
                    if trail:
                        trail.pop()


def match_anchors(anchors: DataFrame, component: str = "case_token") -> DataFrame:
    """``case_token, pred_id, ref_id``: a largest matching within each case.

    Pairs of which each side has no other partner are matched by a window; only what is left goes to Python, case by
    case. Anchors are links of one source line, so their number per case is that of its shared lines.
    """
    a = anchors.withColumns({"np": F.count(F.lit(1)).over(Window.partitionBy(component, "pred_id")), "nr": F.count(F.lit(1)).over(Window.partitionBy(component, "ref_id"))})
    sure = a.filter("np = 1 and nr = 1").select(component, "pred_id", "ref_id")

    def matched(group: pd.DataFrame) -> pd.DataFrame:
        pairs = largest_matching(list(zip(group["pred_id"], group["ref_id"])))
        return pd.DataFrame({component: group[component].iloc[0], "pred_id": [p for p, _ in pairs], "ref_id": [r for _, r in pairs]})

    open_ = a.filter("not (np = 1 and nr = 1)").select(component, "pred_id", "ref_id")
    return sure.unionByName(open_.groupBy(component).applyInPandas(matched, f"{component} string, pred_id string, ref_id string"))


def match_through_lines(seen: Iterable[tuple[str, Sequence[str]]]) -> list[tuple[str, str]]:
    """A largest one-to-one matching of observations (id, lines) with others that share a line, in any order of them.

    Each may be once a predicted and once a reference one. What lines hold is searched, never the pairs they make: all
    unmatched ones of a line go round in a ring, then augmenting paths from all that are left grow side by side, and
    a line hands each of its observations out once. Time of a round and memory are in proportion to the lines held.
    """
    rows = sorted((i, sorted(set(lines))) for i, lines in seen)
    members: dict[str, list[int]] = {}
    for u, (_, lines) in enumerate(rows):
        for line in lines:
            members.setdefault(line, []).append(u)
    to: dict[int, int] = {}
    of: dict[int, int] = {}
    for line in sorted(members):
        alone = [u for u in members[line] if u not in to]
        if len(alone) > 1:
            for u, v in zip(alone, alone[1:] + alone[:1]):
                to[u], of[v] = v, u
    while True:
        root = {u: u for u in range(len(rows)) if u not in to}
        queue, came, done = list(root), {}, set()
        left = {line: iter(held) for line, held in members.items()}
        own: dict[str, list[int]] = {}  # who passed itself over on a line; the next one there takes it
        for u in queue:
            for line in rows[u][1]:
                if root[u] in done:
                    break
                for v in itertools.chain(own.pop(line, ()), left[line]):
                    if v == u:
                        own[line] = [v]
                    elif v not in came:
                        came[v] = u
                        if v not in of:
                            done.add(root[u])
                            at: int | None = v
                            while at is not None:
                                by = came[at]
                                of[at], to[by], at = by, at, to.get(by)
                            break
                        root[of[v]] = root[u]
                        queue.append(of[v])
        if not done:
            return [(rows[u][0], rows[v][0]) for u, v in sorted(to.items())]


def match_observations(observations: DataFrame) -> DataFrame:
    """``case_token, pred_id, ref_id``: a largest matching of observations with others of their case that share a source line.

    ``observations`` has ``id, case_token, source_refs``, ids once each. The result is as large as that of
    ``match_anchors`` on all pairs of different ids, but no pair is made, so rows stay in proportion to the source lines
    however many observations hold one. Observations of the same shared lines are a class. A class that shares its lines
    with no other goes round in a ring. Of any other, as many as it has lines (at least two) serve all neighbours that may
    need one, since those on one line need one at most; the rest, at least two, goes round in a ring. Python gets
    what is left, case by case: a few of each class. Rows without id, case or lines have no match.
    """
    held = observations.filter("id is not null and case_token is not null").select("case_token", "id", F.explode(F.array_distinct("source_refs")).alias("ref")).filter("ref is not null")
    shared = held.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("case_token", "ref"))).filter("n > 1")
    seen = shared.groupBy("case_token", "id").agg(F.sort_array(F.collect_list("ref")).alias("lines"), F.max("n").alias("most"))
    among = Window.partitionBy("case_token", "lines")
    turn = among.orderBy("id")
    enough = F.greatest(F.lit(2), F.size("lines"))
    kept = F.when(F.col("n") == F.col("most"), 0).when(F.col("n") > enough + 1, enough).otherwise(F.col("n"))
    dealt = seen.withColumns({"n": F.count(F.lit(1)).over(among), "k": F.row_number().over(turn)}).withColumn("ring", F.col("k") > kept)
    ring = dealt.filter("ring").select("case_token", F.col("id").alias("pred_id"), F.coalesce(F.lead("id").over(turn), F.first("id").over(turn)).alias("ref_id"))

    def matched(group: pd.DataFrame) -> pd.DataFrame:
        pairs = match_through_lines(zip(group["id"], group["lines"]))
        return pd.DataFrame({"case_token": group["case_token"].iloc[0], "pred_id": [p for p, _ in pairs], "ref_id": [r for _, r in pairs]})

    open_ = dealt.filter("not ring").select("case_token", "id", "lines")
    return ring.unionByName(open_.groupBy("case_token").applyInPandas(matched, "case_token string, pred_id string, ref_id string"))


def field_correct(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """Fields right over predictions with exactly one anchor: ``aligned, value_ok, unit_ok, sampling_ok, times_ok, joint_ok``.

    Both sides have ``id, case_token, item, value, unit, source_refs, time_assertions``. Values are equal as exact
    numbers, else as text; assertions as bags. Ambiguous anchors get no credit.
    """
    anchors = overlap_anchors(predicted, reference)
    only = anchors.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("pred_id"))).filter("n = 1").drop("n")
    side = lambda df, x: df.select(F.col("id").alias(f"{x}_id"), *[F.col(c).alias(f"{c}_{x}") for c in ("item", "value", "unit", "source_refs", "time_assertions")])
    both = only.join(side(predicted, "pred"), "pred_id").join(side(reference, "ref"), "ref_id")
    same = lambda c: F.trim(f"{c}_pred").eqNullSafe(F.trim(f"{c}_ref"))
    bag = lambda c, keep=None: F.array_sort(F.transform(F.filter(c, keep) if keep else F.col(c), lambda t: F.struct(*[t[f] for f in ("role", "relative_day", "coordinate_id", "binding_status")])))
    sampling = lambda t: t["role"] == "sampling"
    value_ok = same("item") & canonical_number(F.col("value_pred")).eqNullSafe(canonical_number(F.col("value_ref")))
    sampling_ok = bag("time_assertions_pred", sampling).eqNullSafe(bag("time_assertions_ref", sampling))
    checks = both.select(value_ok.alias("value"), same("unit").alias("unit"), sampling_ok.alias("sampling"), bag("time_assertions_pred").eqNullSafe(bag("time_assertions_ref")).alias("times"), F.array_sort("source_refs_pred").eqNullSafe(F.array_sort("source_refs_ref")).alias("sources"))
    return checks.agg(F.count(F.lit(1)).alias("aligned"), F.count_if("value").alias("value_ok"), F.count_if("unit").alias("unit_ok"), F.count_if("sampling").alias("sampling_ok"), F.count_if("times").alias("times_ok"), F.count_if(F.col("value") & F.col("unit") & F.col("sampling") & F.col("sources")).alias("joint_ok"))


def _bag(c: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Time assertions as they compare: a bag of role, day, coordinate and binding, in order; null is an empty one."""
    rows = F.col(c) if keep is None else F.filter(c, keep)
    return F.coalesce(F.to_json(F.array_sort(F.transform(rows, lambda t: F.struct(*[t[f].alias(f) for f in ("role", "relative_day", "coordinate_id", "binding_status")])))), F.lit("[]"))


def observation_scores(predicted: DataFrame, reference: DataFrame, *, full_record: bool = False) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` of predicted observations that are right as a whole, matched one to one.

    Right is an observation of the same case, item, exact value, unit, source lines and sampling assertions (with
    ``full_record`` all time assertions). Being right is an equivalence, so a largest one-to-one matching takes from
    each class of equal observations the smaller of both numbers: classes are counted, and no pair is ever made, however
    many repeats a case has. Without source lines nothing is aligned, so such rows are wrong. A measure over nothing
    is null.
    """
    refs = F.coalesce("source_refs", F.array().cast("array<string>"))
    sampling = _bag("time_assertions", lambda t: t["role"] == "sampling")
    key = F.struct("case_token", F.trim("item").alias("item"), canonical_number(F.col("value")).alias("value"), F.trim("unit").alias("unit"), F.array_sort(F.array_distinct(refs)).alias("refs"), (_bag("time_assertions") if full_record else sampling).alias("times"))
    side = lambda df, a, b: df.select(key.alias("key"), (F.size(refs) > 0).alias("aligned"), F.lit(a).alias("p"), F.lit(b).alias("r"))
    classes = side(predicted, 1, 0).unionByName(side(reference, 0, 1)).groupBy("key", "aligned").agg(F.sum("p").alias("p"), F.sum("r").alias("r"))
    sums = classes.agg(F.coalesce(F.sum(F.when(F.col("aligned"), F.least("p", "r"))), F.lit(0)).alias("tp"), F.coalesce(F.sum("p"), F.lit(0)).alias("p"), F.coalesce(F.sum("r"), F.lit(0)).alias("r"))
    out = sums.select("tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("r") - F.col("tp")).alias("fn"), F.try_divide("tp", "p").alias("precision"), F.try_divide("tp", "r").alias("recall"))
    return out.withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def identity_scores(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Counts over reference pairs (``left_row, right_row, relation``) by predicted groups (``row, group_id``).

    ``relation``: same, different or unresolved. A pair of which a row is in no group lacks a decision; a decision on
    an unresolved pair is unsupported.
    """
    g = groups.select("row", "group_id")
    both = pairs.join(g.select(F.col("row").alias("left_row"), F.col("group_id").alias("a")), "left_row", "left").join(g.select(F.col("row").alias("right_row"), F.col("group_id").alias("b")), "right_row", "left")
    decided = F.col("a").isNotNull() & F.col("b").isNotNull()
    is_ = lambda r: F.col("relation") == r
    one = F.col("a") == F.col("b")
    return both.agg(
        F.count_if(is_("same")).alias("same_pairs"), F.count_if(is_("different")).alias("different_pairs"), F.count_if(is_("unresolved")).alias("unresolved_pairs"),
        F.count_if(decided & ((is_("same") & one) | (is_("different") & ~one))).alias("correct"), F.count_if(decided & is_("different") & one).alias("false_merge"), F.count_if(decided & is_("same") & ~one).alias("false_split"),
        F.count_if(~decided).alias("missing_decision"), F.count_if(decided & is_("unresolved")).alias("unsupported_resolution"),
    )


def whole_sum(col: Column) -> Column:
    """The sum that is unknown as soon as one of its parts is; 0 over no rows."""
    return F.when(F.count_if(col.isNull()) == 0, F.coalesce(F.sum(col), F.lit(0)))


def cost_summary(attempts: DataFrame, keys: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """Per group: attempts, failed attempts, the null-propagating sum of each part, and ``recorded`` or ``partial``."""
    out = attempts.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.count_if(~F.coalesce(F.col("status") == "success", F.lit(False))).alias("failed_calls"), *[whole_sum(F.col(p)).alias(p) for p in parts])
    unknown = F.lit(False)
    for p in parts:
        unknown = unknown | F.col(p).isNull()
    return out.withColumn("cost_status", F.when(unknown, "partial").otherwise("recorded"))


def resolve_items(items: DataFrame, records: DataFrame) -> DataFrame:
    """``item_id, status, record_id``: which record of its case an answer item refers to.

    ``items`` has ``item_id, case_token, value, unit, day, source_refs``; ``records`` has ``record_id, case_token,
    value, unit, day, refs``. Candidates agree in unit and, within a millionth, in value; several are narrowed by
    the item's own day, then by its source lines, each only if something is left; none is ``unmatched``, several
    ``ambiguous``: the first is never picked. Candidates meet by case, unit and a rounded value, not by all pairs.
    """
    number = finite_number(F.col("value"))
    # Values within the tolerance share one of two neighbouring steps of the logarithm.
    step = F.when(number == 0, 0).otherwise(F.floor(F.log(F.abs(number)) / 2e-6))
    i = items.select("item_id", "case_token", number.alias("x"), unit_key(F.col("unit")).alias("u"), F.col("day").alias("item_day"), F.coalesce("source_refs", F.array().cast("array<string>")).alias("claimed"), F.explode(F.array(step - 1, step, step + 1)).alias("step"))
    r = records.select("record_id", "case_token", number.alias("y"), unit_key(F.col("unit")).alias("u"), F.col("day").alias("record_day"), F.coalesce("refs", F.array().cast("array<string>")).alias("own"), step.alias("step"))
    met = i.join(r, ["case_token", "u", "step"]).filter(same_number(F.col("x"), F.col("y"))).dropDuplicates(["item_id", "record_id"])
    met = met.withColumns({"on_day": F.coalesce(F.col("item_day") == F.col("record_day"), F.lit(False)), "on_source": F.arrays_overlap("claimed", "own")})
    w = Window.partitionBy("item_id")
    met = met.withColumn("any_day", F.max("on_day").over(w) & (F.count(F.lit(1)).over(w) > 1)).filter("on_day or not any_day")
    met = met.withColumn("any_source", F.max("on_source").over(w) & (F.count(F.lit(1)).over(w) > 1)).filter("on_source or not any_source")
    found = met.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("record_id"))
    out = items.select("item_id").join(found, "item_id", "left")
    return out.select("item_id", F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unmatched").alias("status"), F.when(F.col("n") == 1, F.col("record_id")).alias("record_id"))
