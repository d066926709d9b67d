"""Bounded temporal selection over record_view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywise.operators import selection as S
from daywise.plans.selection import SelectionPlan
from daywise.plans.window import DayWindow
from daywise.sources.rendering import record_lines
from daywise.sources.tables import table

ANCHOR = 30
LATEST = SelectionPlan("collection", DayWindow(None, ANCHOR, False, True), "latest")
FIRST = SelectionPlan("collection", DayWindow(ANCHOR, None, False, False), "first")
WITHIN = SelectionPlan("collection", DayWindow(ANCHOR - 14, ANCHOR, True, True), "all")
TIES = SelectionPlan("collection", DayWindow(None, ANCHOR, False, True), "latest", "all_ties", "ignore")
REPORT = SelectionPlan("report", DayWindow(None, ANCHOR, False, True), "latest")


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.frozen_view(table(spark, sf_dir, "record_view"))


def _tasks(view: DataFrame, plan: SelectionPlan) -> DataFrame:
    return S.plan_tasks(view.select("case_token").distinct(), plan)


def _outcome(plan: SelectionPlan):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        view = _view(spark, sf_dir)
        done = S.select_records(view, _tasks(view, plan))
        return done.select("task_id", "case_token", "status", F.array_join("selected", ",").alias("selected"), F.array_join("candidates", ",").alias("candidates"), "reason", "n_selected", "n_incomplete")

    return query


def pred_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, sf_dir)
    return S.considered(view, _tasks(view, LATEST)).groupBy("case_token", "standing").agg(F.count(F.lit(1)).alias("records"))


def w3_naive_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, sf_dir)
    return S.naive_pick(view, _tasks(view, LATEST))


def w2_latest_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.latest_with_ties(_view(spark, sf_dir), ["case_token"])


def j1_expand_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, sf_dir)
    return S.expand_selected(S.select_records(view, _tasks(view, WITHIN)), view)


def j19_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, sf_dir)
    tasks = _tasks(view, LATEST).unionByName(_tasks(view, FIRST)).unionByName(_tasks(view, WITHIN))
    same = S.compare_outcomes(S.select_records(view, tasks), S.reference_outcomes(view, tasks))
    return same.groupBy("same_status", "same_selected", "same_candidates").agg(F.count(F.lit(1)).alias("tasks"))


def c16_day_coordinate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.day_coordinate(_view(spark, sf_dir))


def g8_day_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir).groupBy("case_token").agg(F.min("day_offset").cast("int").alias("first_day"), F.max("day_offset").cast("int").alias("last_day"), F.count("day_offset").alias("dated"))


def s11_record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_lines(_view(spark, sf_dir))


QUERIES = {
    "c1_latest_at_or_before": _outcome(LATEST), "c1_first_after": _outcome(FIRST), "c1_all_within": _outcome(WITHIN), "c1_all_ties": _outcome(TIES), "c1_report_role": _outcome(REPORT),
} | {f.__name__: f for f in (pred_eligibility, w3_naive_latest, w2_latest_with_ties, j1_expand_selected, j19_compare, c16_day_coordinate, g8_day_bounds, s11_record_lines)}

VIEW = """
view AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC NULLS LAST, case_token DESC NULLS LAST,
      time_role DESC NULLS LAST, collection_day DESC NULLS LAST, day_offset DESC NULLS LAST, clock DESC NULLS LAST,
      precision DESC NULLS LAST, value DESC NULLS LAST, unit DESC NULLS LAST, project_name DESC NULLS LAST,
      project_ref DESC NULLS LAST, result_ref DESC NULLS LAST, unit_ref DESC NULLS LAST, collection_ref DESC NULLS LAST,
      report_ref DESC NULLS LAST, identity_status DESC NULLS LAST, report_day_offset DESC NULLS LAST,
      report_clock DESC NULLS LAST, report_precision DESC NULLS LAST, batch_no DESC NULLS LAST) AS version
    FROM record_view) WHERE version = 1)"""


def _seconds(clock: str, precision: str) -> str:
    return f"""CASE WHEN {precision} IS NOT NULL AND lower(trim({precision})) NOT IN ('', 'day', 'date')
      AND regexp_full_match(trim({clock}), '([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?')
      THEN CAST(substr(trim({clock}), 1, 2) AS INTEGER) * 3600 + CAST(substr(trim({clock}), 4, 2) AS INTEGER) * 60
      + CASE WHEN length(trim({clock})) > 5 THEN CAST(substr(trim({clock}), 7, 2) AS INTEGER) ELSE 0 END END"""


def considered_sql(plan: SelectionPlan) -> str:
    w = plan.window
    if plan.time_role == "report":
        carries = "(report_day_offset IS NOT NULL OR report_clock IS NOT NULL OR report_precision IS NOT NULL) AND time_role IS DISTINCT FROM 'report' OR time_role = 'report'"
        day = "CASE WHEN time_role = 'report' THEN day_offset ELSE report_day_offset END"
        second = f"CASE WHEN time_role = 'report' THEN {_seconds('clock', 'precision')} ELSE {_seconds('report_clock', 'report_precision')} END"
    else:
        carries, day, second = f"time_role = '{plan.time_role}'", "day_offset", _seconds("clock", "precision")
    low = "TRUE" if w.low is None else f"day {'>=' if w.include_low else '>'} {w.low}"
    high = "TRUE" if w.high is None else f"day {'<=' if w.include_high else '<'} {w.high}"
    return f"""timed AS (
  SELECT record_id, case_token, coalesce({carries}, FALSE) AS carries, CAST({day} AS INTEGER) AS day, {second} AS second,
    value IS NOT NULL AND unit IS NOT NULL AND coalesce(identity_status = 'explicit', FALSE) AS whole FROM view),
seen AS (
  SELECT *, CASE WHEN NOT carries THEN 'no_role' WHEN day IS NULL OR NOT ({low} AND {high}) THEN 'out'
    WHEN whole THEN 'usable' ELSE 'incomplete' END AS standing FROM timed)"""


def outcome_sql(plan: SelectionPlan) -> str:
    top, lenient, policy = ("max" if plan.selection == "latest" else "min"), plan.tie_policy == "all_ties", plan.missing_policy == "undetermined"
    listed = "usable" if plan.selection == "all" else f"SELECT u.* FROM usable u JOIN (SELECT case_token, {top}(day) AS d FROM usable GROUP BY 1) t ON u.case_token = t.case_token AND u.day = t.d"
    return f"""WITH {VIEW},
{considered_sql(plan)},
usable AS (SELECT * FROM seen WHERE standing = 'usable'),
listed AS ({'SELECT * FROM usable' if plan.selection == 'all' else listed}),
facts AS (SELECT case_token, bool_or(carries) AS carries, count(*) FILTER (WHERE standing = 'incomplete') AS n_incomplete FROM seen GROUP BY 1),
extreme AS (SELECT case_token, count(*) AS n, count(second) AS known, {top}(second) AS edge FROM listed GROUP BY 1),
placed AS (SELECT l.*, e.n, e.known, coalesce(l.second = e.edge, FALSE) AS at_edge FROM listed l JOIN extreme e ON l.case_token = e.case_token),
grouped AS (
  SELECT case_token, max(n) AS n, max(known) AS known, count(*) FILTER (WHERE at_edge) AS ties,
    string_agg(record_id, ',' ORDER BY day, coalesce(second, 86400), record_id) AS all_ids,
    string_agg(record_id, ',' ORDER BY day, coalesce(second, 86400), record_id) FILTER (WHERE at_edge) AS edge_ids FROM placed GROUP BY 1),
decided AS (
  SELECT f.*, g.n, g.known, CASE WHEN g.n = 1 OR g.known < g.n THEN g.all_ids ELSE g.edge_ids END AS winners, g.all_ids,
    CASE WHEN g.n = 1 OR g.known < g.n THEN g.n ELSE g.ties END AS n_winners,
    coalesce(g.n = 1 OR (g.known = g.n AND g.ties = 1), FALSE) AS one FROM facts f LEFT JOIN grouped g ON f.case_token = g.case_token)
SELECT '{plan.selection}:' || case_token AS task_id, case_token,
  CASE WHEN NOT carries THEN 'unsupported_time_role' WHEN n IS NULL AND n_incomplete > 0 AND {policy} THEN 'undetermined' WHEN n IS NULL THEN 'empty'
    WHEN {plan.selection == 'all'} OR one OR {lenient} THEN 'ok' ELSE 'undetermined' END AS status,
  CASE WHEN n IS NULL OR NOT carries THEN '' WHEN {plan.selection == 'all'} THEN all_ids WHEN one OR {lenient} THEN winners ELSE '' END AS selected,
  CASE WHEN n IS NULL OR NOT carries OR {plan.selection == 'all'} OR one OR {lenient} THEN '' ELSE winners END AS candidates,
  CASE WHEN NOT carries THEN 'NO_RECORD_CARRIES_TIME_ROLE:{plan.time_role}' WHEN n IS NULL THEN 'NO_ELIGIBLE_RECORD' WHEN {plan.selection == 'all'} OR one THEN NULL
    WHEN {lenient} THEN 'TIE_RETURNED_ALL' WHEN known = n THEN 'SAME_DAY_IDENTICAL_TIMESTAMP'
    WHEN known > 0 THEN 'SAME_DAY_CLOCK_UNKNOWN_FOR_SOME_RECORDS' ELSE 'SAME_DAY_CLOCK_UNKNOWN_FOR_ALL_RECORDS' END AS reason,
  CAST(CASE WHEN n IS NULL OR NOT carries THEN 0 WHEN {plan.selection == 'all'} THEN n WHEN one OR {lenient} THEN n_winners ELSE 0 END AS INTEGER) AS n_selected,
  CAST(n_incomplete AS INTEGER) AS n_incomplete
FROM decided"""


ORACLE = {
    "c1_latest_at_or_before": outcome_sql(LATEST), "c1_first_after": outcome_sql(FIRST), "c1_all_within": outcome_sql(WITHIN), "c1_all_ties": outcome_sql(TIES), "c1_report_role": outcome_sql(REPORT),
    "pred_eligibility": f"WITH {VIEW}, {considered_sql(LATEST)} SELECT case_token, standing, count(*) AS records FROM seen GROUP BY 1, 2",
    "w3_naive_latest": f"""WITH {VIEW}, {considered_sql(LATEST)}
SELECT 'latest:' || case_token AS task_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY case_token ORDER BY day DESC, coalesce(second, -1) DESC, record_id) AS n
  FROM seen WHERE standing IN ('usable', 'incomplete')) WHERE n = 1""",
    "w2_latest_with_ties": f"""WITH {VIEW}, {considered_sql(LATEST)}
SELECT case_token, record_id, day, second FROM (SELECT *, dense_rank() OVER (PARTITION BY case_token ORDER BY day DESC, second DESC NULLS LAST) AS n
  FROM seen WHERE carries AND day IS NOT NULL) WHERE n = 1""",
    "j1_expand_selected": f"""WITH {VIEW}, {considered_sql(WITHIN)}
SELECT 'all:' || s.case_token AS task_id, s.record_id, TRUE AS resolved, v.value, v.unit, v.project_name FROM seen s JOIN view v ON s.record_id = v.record_id WHERE standing = 'usable'""",
    "j19_compare": "SELECT TRUE AS same_status, TRUE AS same_selected, TRUE AS same_candidates, 3 * count(DISTINCT case_token) AS tasks FROM record_view",
    "c16_day_coordinate": f"""WITH {VIEW} SELECT record_id, case_token, CAST(collection_day AS INTEGER) AS day,
  CAST(collection_day - min(collection_day) OVER (PARTITION BY case_token) AS INTEGER) AS "offset" FROM view""",
    "g8_day_bounds": f"WITH {VIEW} SELECT case_token, CAST(min(day_offset) AS INTEGER) AS first_day, CAST(max(day_offset) AS INTEGER) AS last_day, count(day_offset) AS dated FROM view GROUP BY 1",
    "s11_record_lines": f"""WITH {VIEW} SELECT record_id, record_id || chr(9) || coalesce(case_token, 'None') || chr(9) || coalesce(CAST(CAST(day_offset AS INTEGER) AS VARCHAR), 'None') || chr(9)
  || coalesce(clock, 'None') || chr(9) || coalesce(value, 'None') || chr(9) || coalesce(unit, 'None') AS line FROM view""",
}
