"""Bounded temporal selection: records of a case inside a day window, with an explicit outcome.

``records`` has ``record_id, case_token, times`` (a map from time role to day, clock and precision), ``value``,
``unit`` and ``identity_status``. ``tasks`` has ``task_id, case_token, time_role, low, high, include_low,
include_high, selection, tie_policy, missing_policy``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywise.functions.clock import clock_seconds
from daywise.plans.selection import EMPTY, OK, UNDETERMINED, UNSUPPORTED_ROLE, SelectionPlan
from daywise.plans.window import in_window

TASK_COLUMNS = ("task_id", "case_token", "time_role", "low", "high", "include_low", "include_high", "selection", "tie_policy", "missing_policy")


def frozen_view(record_view: DataFrame) -> DataFrame:
    """Each ``record_id`` once, as last ingested (of equal times the greatest row), with the map of its time roles.

    The role named by ``time_role`` has the plain day, clock and precision; the report role its prefixed ones, if
    any of them is there. Rows without ``record_id`` count as one record. Columns beyond the known ones are dropped.
    """
    kept = ("ingested_at", "case_token", "time_role", "collection_day", "day_offset", "clock", "precision", "value", "unit", "project_name", "project_ref", "result_ref", "unit_ref", "collection_ref", "report_ref", "identity_status", "report_day_offset", "report_clock", "report_precision", "batch_no")
    last = record_view.groupBy("record_id").agg(F.max(F.struct(*kept)).alias("v")).select("record_id", "v.*")
    moment = lambda d, c, p: F.struct(F.col(d).cast("int").alias("day"), F.col(c).alias("clock"), F.col(p).alias("precision"))
    report = F.col("report_day_offset").isNotNull() | F.col("report_clock").isNotNull() | F.col("report_precision").isNotNull()
    entries = F.array(
        F.when(F.col("time_role").isNotNull(), F.struct(F.col("time_role").alias("key"), moment("day_offset", "clock", "precision").alias("value"))),
        F.when(report & ~F.col("time_role").eqNullSafe("report"), F.struct(F.lit("report").alias("key"), moment("report_day_offset", "report_clock", "report_precision").alias("value"))),
    )
    return last.withColumn("times", F.map_from_entries(F.array_compact(entries)))


def plan_tasks(cases: DataFrame, plan: SelectionPlan, task_id: Column | None = None) -> DataFrame:
    """One task per case for a plan."""
    w = plan.window
    return cases.select(
        (task_id if task_id is not None else F.concat(F.lit(f"{plan.selection}:"), F.col("case_token"))).alias("task_id"), "case_token", F.lit(plan.time_role).alias("time_role"), F.lit(w.low).cast("int").alias("low"), F.lit(w.high).cast("int").alias("high"), F.lit(w.include_low).alias("include_low"), F.lit(w.include_high).alias("include_high"), F.lit(plan.selection).alias("selection"), F.lit(plan.tie_policy).alias("tie_policy"), F.lit(plan.missing_policy).alias("missing_policy"),
    )


def considered(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """Records of each task's case with the task's own time, and whether they are usable, incomplete or out.

    ``standing``: ``no_role`` (the record does not carry the role), ``out`` (no day, or outside the window),
    ``incomplete`` (identity not explicit, value or unit missing) or ``usable``; in this order of precedence.
    """
    slim = records.select("record_id", "case_token", "times", (F.col("value").isNotNull() & F.col("unit").isNotNull() & (F.col("identity_status") == "explicit")).alias("whole"))
    both = tasks.select(*TASK_COLUMNS).join(slim, "case_token", "left")
    moment = F.try_element_at("times", F.col("time_role"))
    timed = both.withColumns({"carries": F.coalesce(F.map_contains_key("times", F.col("time_role")), F.lit(False)), "day": moment["day"], "second": clock_seconds(moment["clock"], moment["precision"])})
    inside = in_window(F.col("day"), F.col("low"), F.col("high"), F.col("include_low"), F.col("include_high"))
    standing = F.when(~F.col("carries"), "no_role").when(~inside, "out").when(F.coalesce("whole", F.lit(False)), "usable").otherwise("incomplete")
    return timed.withColumn("standing", standing).drop("times", "whole")


def select_records(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """``task_id, status, selected, candidates, reason, n_selected, n_incomplete`` for every task.

    Latest and first take the extreme day's only record, or the one with the extreme clock if every record of that
    day has a usable clock and no other shares it; else the outcome is undetermined, with the day's records (of
    equal clocks those that share the extreme one) as candidates, or as the selection under ``all_ties``. All takes
    every usable record in order of day, clock (unknown last) and id. Cases without a record of the role are
    unsupported; without a usable record they are undetermined if incomplete ones lie in the window and the policy
    says so, else empty. A null clock never orders.
    """
    seen = considered(records, tasks)
    single = F.col("selection").isin("first", "latest")
    usable = F.col("standing") == "usable"
    clock = F.when(F.col("selection") == "latest", F.col("second")).otherwise(-F.col("second"))
    # First by day, which splits a case of very many records; of single selections only the extreme day's list goes on.
    days = seen.groupBy(*TASK_COLUMNS, "day").agg(
        F.count_if("carries").alias("n_carrying"), F.count_if(F.col("standing") == "incomplete").alias("n_incomplete"), F.count_if(usable).alias("n_listed"),
        F.count_if(usable & F.col("second").isNull()).alias("n_unknown"), F.max(F.when(usable, clock)).alias("extreme"),
        F.collect_list(F.when(usable, F.struct("day", F.coalesce("second", F.lit(86400)).alias("second"), "record_id", clock.alias("clock")))).alias("listed"),
    )
    direction = F.when(F.col("selection") == "latest", F.col("day")).otherwise(-F.col("day"))
    whole = F.struct("n_listed", "n_unknown", "extreme", "listed")
    top = F.max_by(F.when(single, whole), F.when(F.col("n_listed") > 0, direction))
    per = days.groupBy(*TASK_COLUMNS).agg(F.sum("n_carrying").alias("n_carrying"), F.sum("n_incomplete").alias("n_incomplete"), top.alias("top"), F.sum("n_listed").alias("n_usable"), F.flatten(F.collect_list(F.when(~single, F.col("listed")))).alias("every"))
    per = per.select(*TASK_COLUMNS, "n_carrying", "n_incomplete", F.when(single, F.coalesce("top.n_listed", F.lit(0))).otherwise(F.col("n_usable")).alias("n_listed"), F.col("top.n_unknown").alias("n_unknown"), F.col("top.extreme").alias("extreme"), F.array_sort(F.when(single, F.coalesce("top.listed", "every")).otherwise(F.col("every"))).alias("listed"))
    ids = lambda rows: F.transform(rows, lambda x: x["record_id"])
    at_extreme = F.filter("listed", lambda x: x["clock"] == F.col("extreme"))
    all_known = F.col("n_unknown") == 0
    one = (F.col("n_listed") == 1) | (all_known & (F.size(at_extreme) == 1))
    winners = F.when(F.col("n_listed") == 1, F.col("listed")).when(all_known, at_extreme).otherwise(F.col("listed"))
    reason = F.when(all_known, "SAME_DAY_IDENTICAL_TIMESTAMP").when(F.col("n_unknown") < F.col("n_listed"), "SAME_DAY_CLOCK_UNKNOWN_FOR_SOME_RECORDS").otherwise("SAME_DAY_CLOCK_UNKNOWN_FOR_ALL_RECORDS")
    none = F.array().cast("array<string>")
    unsupported, nothing = F.col("n_carrying") == 0, F.col("n_listed") == 0
    lenient = F.col("tie_policy") == "all_ties"
    incomplete = (F.col("n_incomplete") > 0) & (F.col("missing_policy") == "undetermined")
    chosen = F.when(unsupported | nothing, none).when(~single, ids(F.col("listed"))).when(one | lenient, ids(winners)).otherwise(none)
    return per.select(
        "task_id", "case_token",
        F.when(unsupported, UNSUPPORTED_ROLE).when(nothing & incomplete, UNDETERMINED).when(nothing, EMPTY).when(~single | one | lenient, OK).otherwise(UNDETERMINED).alias("status"),
        chosen.alias("selected"), F.when(unsupported | nothing | ~single | one | lenient, none).otherwise(ids(winners)).alias("candidates"),
        F.when(unsupported, F.concat(F.lit("NO_RECORD_CARRIES_TIME_ROLE:"), "time_role")).when(nothing, "NO_ELIGIBLE_RECORD").when(~single | one, F.lit(None)).when(lenient, "TIE_RETURNED_ALL").otherwise(reason).alias("reason"),
        F.size(chosen).alias("n_selected"), F.col("n_incomplete").cast("int").alias("n_incomplete"),
    )


def naive_pick(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """``task_id, record_id``: one record per task by day and clock text, ties by id; no completeness is asked for.

    A missing clock sorts as the empty text. The contrast to ``select_records``; tasks without a record have no row.
    """
    seen = considered(records, tasks).filter("standing in ('usable', 'incomplete')")
    text = F.coalesce(F.col("second"), F.lit(-1))
    order = [F.when(F.col("selection") == "latest", -F.col("day")).otherwise(F.col("day")), F.when(F.col("selection") == "latest", -text).otherwise(text), F.col("record_id")]
    ranked = seen.withColumn("n", F.row_number().over(Window.partitionBy("task_id").orderBy(*order)))
    return ranked.filter("n = 1").select("task_id", "record_id")


def latest_with_ties(records: DataFrame, keys: Sequence[str], role: str = "collection") -> DataFrame:
    """Every record at the latest day and clock of its group; records without a usable clock give way to ones with."""
    moment = F.try_element_at("times", F.lit(role))
    timed = records.withColumns({"day": moment["day"], "second": clock_seconds(moment["clock"], moment["precision"])}).filter("day is not null")
    order = Window.partitionBy(*keys).orderBy(F.col("day").desc(), F.col("second").desc_nulls_last())
    return timed.withColumn("n", F.dense_rank().over(order)).filter("n = 1").select(*keys, "record_id", "day", "second")


def expand_selected(outcomes: DataFrame, records: DataFrame, fields: Sequence[str] = ("value", "unit", "project_name")) -> DataFrame:
    """``task_id, record_id, resolved`` and the record's fields for every selected id; unknown ids stay unresolved."""
    ids = outcomes.select("task_id", F.explode("selected").alias("record_id"))
    known = records.select("record_id", *fields, F.lit(True).alias("found"))
    return ids.join(known, "record_id", "left").select("task_id", "record_id", F.coalesce("found", F.lit(False)).alias("resolved"), *fields)


def day_coordinate(records: DataFrame, day: str = "collection_day") -> DataFrame:
    """``record_id, case_token, day, offset``: days from the case's own first day; null days stay null.

    The first day is a partial aggregate joined back, as one case may hold a large part of all records.
    """
    origin = records.groupBy(F.col("case_token").alias("of")).agg(F.min(day).alias("origin"))
    both = records.join(origin, F.col("case_token").eqNullSafe(F.col("of")), "left")
    return both.select("record_id", "case_token", F.col(day).cast("int").alias("day"), (F.col(day) - F.col("origin")).cast("int").alias("offset"))


def compare_outcomes(left: DataFrame, right: DataFrame) -> DataFrame:
    """``task_id, same_status, same_selected, same_candidates`` of every task of either side; ids compare as sets."""
    a = left.select("task_id", F.col("status").alias("sa"), F.array_sort("selected").alias("la"), F.array_sort("candidates").alias("ca"))
    b = right.select("task_id", F.col("status").alias("sb"), F.array_sort("selected").alias("lb"), F.array_sort("candidates").alias("cb"))
    both = a.join(b, "task_id", "full_outer")
    return both.select("task_id", F.col("sa").eqNullSafe(F.col("sb")).alias("same_status"), F.col("la").eqNullSafe(F.col("lb")).alias("same_selected"), F.col("ca").eqNullSafe(F.col("cb")).alias("same_candidates"))


def reference_outcomes(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """The same outcomes defined apart, by ranking windows; for comparison with ``select_records``."""
    seen = considered(records, tasks)
    usable = seen.filter("standing = 'usable'")
    single = usable.filter("selection <> 'all'")
    sign = F.when(F.col("selection") == "latest", F.lit(-1)).otherwise(F.lit(1))
    by_day = single.withColumn("r", F.rank().over(Window.partitionBy("task_id").orderBy(sign * F.col("day")))).filter("r = 1")
    w = Window.partitionBy("task_id")
    by_day = by_day.withColumns({"n": F.count(F.lit(1)).over(w), "known": F.count("second").over(w), "place": F.rank().over(w.orderBy((sign * F.col("second")).asc_nulls_last()))})
    by_day = by_day.withColumn("ties", F.count_if(F.col("place") == 1).over(w))
    win = by_day.withColumn("decided", (F.col("n") == 1) | ((F.col("known") == F.col("n")) & (F.col("ties") == 1)))
    keep = win.filter("(n = known and place = 1) or n > known or n = 1")
    listed = keep.groupBy("task_id").agg(F.max("decided").alias("decided"), F.collect_list("record_id").alias("ids"))
    every = usable.filter("selection = 'all'").groupBy("task_id").agg(F.lit(True).alias("decided"), F.collect_list("record_id").alias("ids"))
    facts = seen.groupBy("task_id", "missing_policy", "tie_policy").agg(F.max("carries").alias("carries"), F.max(F.col("standing") == "incomplete").alias("some"))
    done = facts.join(listed.unionByName(every), "task_id", "left")
    none = F.array().cast("array<string>")
    status = F.when(~F.col("carries"), UNSUPPORTED_ROLE).when(F.col("ids").isNotNull() & (F.col("decided") | (F.col("tie_policy") == "all_ties")), OK)
    status = status.when(F.col("ids").isNotNull() | (F.col("some") & (F.col("missing_policy") == "undetermined")), UNDETERMINED).otherwise(EMPTY)
    return done.withColumn("status", status).select("task_id", "status", F.when(F.col("status") == OK, F.col("ids")).otherwise(none).alias("selected"), F.when((F.col("status") == UNDETERMINED) & F.col("ids").isNotNull(), F.col("ids")).otherwise(none).alias("candidates"))
