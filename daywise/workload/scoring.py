"""Scores of selections, fields, groupings and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywise.functions.values import finite_number
from daywise.operators import scoring as G
from daywise.operators import selection as S
from daywise.sources.tables import table
from daywise.workload.selection import LATEST, ORACLE as SELECTION_SQL, VIEW, outcome_sql


def _observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ("submitted_at", "case_token", "item", "value", "unit", "source_refs", "time_assertions")
    last = table(spark, sf_dir, "unified_fixture_submission").groupBy("observation_id").agg(F.max(F.struct(*kept)).alias("v"))
    return last.select(F.col("observation_id").alias("id"), "v.*")


def c6_selection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = S.frozen_view(table(spark, sf_dir, "record_view"))
    tasks = S.plan_tasks(view.select("case_token").distinct(), LATEST)
    picks = tasks.select("task_id").join(S.naive_pick(view, tasks), "task_id", "left")
    answers = picks.select("task_id", F.when(F.col("record_id").isNull(), "empty").otherwise("ok").alias("status"), F.array_compact(F.array("record_id")).alias("selected"), F.lit(True).alias("fields_match"))
    return G.score_selections(S.select_records(view, tasks), answers)


def c7_field_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "record_view")
    kept = F.struct("ingested_at", "value", "unit", "day_offset", "clock", "precision")
    both = raw.groupBy("record_id").agg(F.min(kept).alias("a"), F.max(kept).alias("b"))
    codes = G.field_mismatches(*[F.col(f"a.{c}") for c in ("value", "unit", "day_offset", "clock")], *[F.col(f"b.{c}") for c in ("value", "unit", "day_offset", "clock", "precision")])
    return both.select("record_id", F.array_join(codes, ",").alias("mismatches")).filter("mismatches <> ''")


def j10_overlap_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _observations(spark, sf_dir)
    return G.overlap_anchors(seen, seen)


def j11_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.match_observations(_observations(spark, sf_dir)).groupBy("case_token").agg(F.count(F.lit(1)).alias("matched"))


def c8_field_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _observations(spark, sf_dir)
    sheets = table(spark, sf_dir, "review_template").groupBy(F.col("observation_id").alias("id")).agg(F.max(F.struct("locked_at", "sheet_id", "item", "value", "unit")).alias("s"))
    said = seen.select("id", "case_token", "source_refs", "time_assertions").join(sheets, "id").select("id", "case_token", "s.item", "s.value", "s.unit", "source_refs", "time_assertions")
    return G.field_correct(said, seen)


def _sheets_and_observations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What the latest sheet of each observation says, and the observations."""
    seen = _observations(spark, sf_dir)
    sheets = table(spark, sf_dir, "review_template").groupBy(F.col("observation_id").alias("id")).agg(F.max(F.struct("locked_at", "sheet_id", "item", "value", "unit")).alias("s"))
    return seen.select("id", "case_token", "source_refs", "time_assertions").join(sheets, "id").select("id", "case_token", "s.item", "s.value", "s.unit", "source_refs", "time_assertions"), seen


def c8_joint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.observation_scores(*_sheets_and_observations(spark, sf_dir))


def c8_full_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.observation_scores(*_sheets_and_observations(spark, sf_dir), full_record=True)


def c9_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _observations(spark, sf_dir)
    facts = seen.select("id", F.lower(F.trim("item")).alias("item"), "value", "case_token")
    pairs = G.overlap_anchors(seen, seen).filter("pred_id < ref_id")
    a = facts.select(F.col("id").alias("left_row"), F.col("item").alias("ia"), F.col("value").alias("va"))
    b = facts.select(F.col("id").alias("right_row"), F.col("item").alias("ib"), F.col("value").alias("vb"))
    both = pairs.select(F.col("pred_id").alias("left_row"), F.col("ref_id").alias("right_row")).join(a, "left_row").join(b, "right_row")
    relation = F.when(F.col("va").isNull() | F.col("vb").isNull(), "unresolved").when(F.col("ia") == F.col("ib"), "same").otherwise("different")
    groups = facts.filter("value is not null").select(F.col("id").alias("row"), F.concat_ws("|", "case_token", F.substring("item", 1, 1)).alias("group_id"))
    return G.identity_scores(both.select("left_row", "right_row", relation.alias("relation")), groups)


def g10_unknown_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _observations(spark, sf_dir)
    dated = F.exists("time_assertions", lambda t: (t["role"] == "sampling") & t["relative_day"].isNotNull())
    return seen.groupBy("case_token").agg(F.count(F.lit(1)).alias("observations"), F.count_if(~F.coalesce(dated, F.lit(False))).alias("unknown_sampling"))


def g12_cost_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = S.frozen_view(table(spark, sf_dir, "record_view"))
    attempts = view.select("case_token", F.when(F.col("identity_status") == "explicit", "success").otherwise("failed").alias("status"), finite_number(F.col("value")).alias("amount"), F.length("project_name").alias("tokens"))
    out = G.cost_summary(attempts, ["case_token"], ["amount", "tokens"])
    return out.select("case_token", "calls", "failed_calls", F.round("amount", 3).alias("amount"), F.col("tokens").cast("long").alias("tokens"), "cost_status")


def j15_resolve_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = S.frozen_view(table(spark, sf_dir, "record_view"))
    records = view.select("record_id", "case_token", "value", "unit", F.col("day_offset").cast("int").alias("day"), F.array_compact(F.array("project_ref", "result_ref")).alias("refs"))
    items = records.select(F.col("record_id").alias("item_id"), "case_token", "value", "unit", "day", F.slice("refs", 1, 1).alias("source_refs"))
    return G.resolve_items(items, records)


QUERIES = {f.__name__: f for f in (c6_selection_score, c7_field_mismatches, j10_overlap_anchors, j11_matching, c8_field_correct, c8_joint_scores, c8_full_scores, c9_identity, g10_unknown_sampling, g12_cost_summary, j15_resolve_items)}

OBSERVATIONS = """obs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY observation_id ORDER BY submitted_at DESC) AS version FROM unified_fixture_submission) WHERE version = 1)"""
REFS = "refs AS (SELECT DISTINCT observation_id AS id, case_token, unnest(source_refs) AS ref FROM obs)"
ANCHORS = "anchors AS (SELECT DISTINCT a.id AS pred_id, b.id AS ref_id FROM refs a JOIN refs b ON a.case_token = b.case_token AND a.ref = b.ref)"
PLAIN = r"regexp_full_match(trim({0}), '[+-]?[0-9]{{1,20}}(\.[0-9]{{1,17}})?')"
NUMBER = "TRY_CAST(trim({0}) AS DOUBLE)"
FINITE = "CASE WHEN isfinite(TRY_CAST(trim({0}) AS DOUBLE)) THEN TRY_CAST(trim({0}) AS DOUBLE) END"
UNIT = r"lower(regexp_replace({0}, '\s+', '', 'g'))"
CLOCK = "regexp_full_match(trim({0}), '([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?')"

def _scores_sql(keep: str) -> str:
    told = "coalesce(t.role, '~') || '|' || coalesce(CAST(t.relative_day AS VARCHAR), '~') || '|' || coalesce(t.coordinate_id, '~') || '|' || coalesce(t.binding_status, '~')"
    key = f"""case_token, trim(item) AS item, CASE WHEN {PLAIN.format('value')} THEN CAST(CAST(trim(value) AS DECIMAL(38,17)) AS VARCHAR) ELSE trim(value) END AS value, trim(unit) AS unit, list_sort(list_distinct(coalesce(source_refs, []))) AS refs,
  CAST(list_sort(list_transform(list_filter(coalesce(time_assertions, []), lambda t: {keep}), lambda t: {told})) AS VARCHAR) AS times"""
    return f"""WITH {OBSERVATIONS}, sheets AS (SELECT * FROM (SELECT observation_id, item, value, unit,
  row_number() OVER (PARTITION BY observation_id ORDER BY locked_at DESC NULLS LAST, sheet_id DESC, item DESC NULLS LAST, value DESC NULLS LAST, unit DESC NULLS LAST) AS n FROM review_template) WHERE n = 1),
said AS (SELECT o.case_token, o.source_refs, o.time_assertions, s.item, s.value, s.unit FROM obs o JOIN sheets s ON o.observation_id = s.observation_id),
k AS (SELECT 1 AS p, 0 AS r, {key} FROM said UNION ALL SELECT 0, 1, {key} FROM obs),
c AS (SELECT refs, sum(p) AS p, sum(r) AS r FROM k GROUP BY case_token, item, value, unit, refs, times),
t AS (SELECT CAST(sum(CASE WHEN len(refs) > 0 THEN least(p, r) ELSE 0 END) AS BIGINT) AS tp, CAST(sum(p) AS BIGINT) AS p, CAST(sum(r) AS BIGINT) AS r FROM c)
SELECT tp, p - tp AS fp, r - tp AS fn, CAST(tp AS DOUBLE) / nullif(p, 0) AS precision, CAST(tp AS DOUBLE) / nullif(r, 0) AS recall, 2.0 * tp / nullif(p + r, 0) AS f1 FROM t"""


ORACLE = {
    "c6_selection_score": f"""WITH ref AS ({outcome_sql(LATEST)}), naive AS ({SELECTION_SQL['w3_naive_latest']}),
both_ AS (SELECT r.*, n.record_id AS pick, CASE WHEN n.record_id IS NULL THEN 'empty' ELSE 'ok' END AS said,
  CASE WHEN status IN ('undetermined', 'unsupported_time_role') THEN status WHEN n_selected > 0 THEN 'ok' ELSE 'empty' END AS expected,
  CASE WHEN candidates = '' THEN 0 ELSE len(string_split(candidates, ',')) END AS n_cand,
  coalesce(list_contains(string_split(candidates, ','), n.record_id), FALSE) AS in_cand, coalesce(selected = n.record_id, FALSE) AS hit
  FROM ref r LEFT JOIN naive n ON r.task_id = n.task_id)
SELECT task_id, status AS reference_status, said AS answer_status,
  CASE WHEN status = 'unsupported_time_role' THEN NULL WHEN status = 'undetermined' AND pick IS NULL THEN FALSE WHEN status = 'undetermined' THEN in_cand AND n_cand = 1
    ELSE hit OR (n_selected = 0 AND pick IS NULL) END AS set_exact_match,
  CASE WHEN status = 'unsupported_time_role' THEN NULL WHEN status = 'undetermined' AND pick IS NULL THEN NULL WHEN status = 'undetermined' THEN CAST(in_cand AS DOUBLE)
    WHEN pick IS NOT NULL THEN CAST(hit AS DOUBLE) WHEN n_selected = 0 THEN 1.0 END AS precision,
  CASE WHEN status = 'unsupported_time_role' THEN NULL WHEN status = 'undetermined' AND n_cand = 0 THEN NULL WHEN status = 'undetermined' THEN CAST(in_cand AS DOUBLE) / n_cand
    WHEN n_selected > 0 THEN CAST(hit AS DOUBLE) / n_selected WHEN pick IS NULL THEN 1.0 ELSE 0.0 END AS recall,
  said = expected AS status_ok,
  said = expected AND CASE WHEN status IN ('undetermined', 'unsupported_time_role') THEN pick IS NULL ELSE hit OR (n_selected = 0 AND pick IS NULL) END AS task_success
FROM both_""",
    "c7_field_mismatches": f"""WITH ordered AS (SELECT record_id, value, unit, CAST(day_offset AS DOUBLE) AS day, clock, precision,
  row_number() OVER (PARTITION BY record_id ORDER BY ingested_at NULLS FIRST, value NULLS FIRST, unit NULLS FIRST, day_offset NULLS FIRST, clock NULLS FIRST, precision NULLS FIRST) AS up,
  row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC NULLS LAST, value DESC NULLS LAST, unit DESC NULLS LAST, day_offset DESC NULLS LAST, clock DESC NULLS LAST, precision DESC NULLS LAST) AS down FROM record_view),
p AS (SELECT a.record_id, a.value AS va, b.value AS vb, a.unit AS ua, b.unit AS ub, a.day AS da, b.day AS db, a.clock AS ca, b.clock AS cb,
  CASE WHEN lower(b.precision) = 'second' THEN 'second' ELSE 'day' END AS shown, lower(coalesce(b.precision, '')) AS pb
  FROM ordered a JOIN ordered b ON a.record_id = b.record_id WHERE a.up = 1 AND b.down = 1),
c AS (SELECT record_id,
  CASE WHEN va IS NULL THEN 'missing_value' WHEN coalesce(abs({FINITE.format('va')} - {FINITE.format('vb')}) <= 1e-6 * greatest(1.0, abs({FINITE.format('vb')})), FALSE) THEN NULL ELSE 'value' END AS c1,
  CASE WHEN ua IS NULL THEN 'missing_unit' WHEN {UNIT.format('ua')} IS DISTINCT FROM {UNIT.format('ub')} THEN 'unit' END AS c2,
  CASE WHEN da IS NULL AND ca IS NULL THEN 'missing_time' WHEN NOT coalesce(da = db, FALSE) THEN 'time' WHEN shown = 'second' AND ca IS NULL THEN 'time_precision'
    WHEN shown = 'second' AND NOT coalesce({CLOCK.format('ca')} AND (cb IS NULL OR trim(ca) = trim(cb)), FALSE) THEN 'time'
    WHEN shown <> 'second' AND ca IS NOT NULL AND pb <> 'second' THEN 'time_precision' END AS c3 FROM p)
SELECT record_id, concat_ws(',', c1, c2, c3) AS mismatches FROM c WHERE concat_ws(',', c1, c2, c3) <> ''""",
    "j10_overlap_anchors": f"WITH {OBSERVATIONS}, {REFS}, {ANCHORS} SELECT pred_id, ref_id FROM anchors",
    "c8_field_correct": f"""WITH {OBSERVATIONS}, sheets AS (SELECT * FROM (SELECT observation_id, item, value, unit,
  row_number() OVER (PARTITION BY observation_id ORDER BY locked_at DESC NULLS LAST, sheet_id DESC, item DESC NULLS LAST, value DESC NULLS LAST, unit DESC NULLS LAST) AS n FROM review_template) WHERE n = 1),
said AS (SELECT o.observation_id AS id, o.case_token, o.source_refs, s.item, s.value, s.unit FROM obs o JOIN sheets s ON o.observation_id = s.observation_id),
pr AS (SELECT DISTINCT id, case_token, unnest(source_refs) AS ref FROM said), {REFS},
anchors AS (SELECT DISTINCT a.id AS pred_id, b.id AS ref_id FROM pr a JOIN refs b ON a.case_token = b.case_token AND a.ref = b.ref),
only_ AS (SELECT pred_id, min(ref_id) AS ref_id FROM anchors GROUP BY 1 HAVING count(*) = 1),
checks AS (SELECT trim(s.item) IS NOT DISTINCT FROM trim(o.item) AND CASE WHEN {PLAIN.format('s.value')} AND {PLAIN.format('o.value')} THEN CAST(trim(s.value) AS DECIMAL(38,17)) = CAST(trim(o.value) AS DECIMAL(38,17))
    ELSE trim(s.value) IS NOT DISTINCT FROM trim(o.value) END AS v, trim(s.unit) IS NOT DISTINCT FROM trim(o.unit) AS u
  FROM only_ x JOIN said s ON x.pred_id = s.id JOIN obs o ON x.ref_id = o.observation_id)
SELECT count(*) AS aligned, count(*) FILTER (WHERE v) AS value_ok, count(*) FILTER (WHERE u) AS unit_ok, count(*) AS sampling_ok, count(*) AS times_ok, count(*) FILTER (WHERE v AND u) AS joint_ok FROM checks""",
    "c8_joint_scores": _scores_sql("t.role = 'sampling'"),
    "c8_full_scores": _scores_sql("TRUE"),
    "c9_identity": f"""WITH {OBSERVATIONS}, {REFS}, {ANCHORS},
facts AS (SELECT observation_id AS id, lower(trim(item)) AS item, value, case_token FROM obs),
p AS (SELECT CASE WHEN a.value IS NULL OR b.value IS NULL THEN 'unresolved' WHEN a.item = b.item THEN 'same' ELSE 'different' END AS relation,
  a.value IS NOT NULL AND b.value IS NOT NULL AS decided, a.case_token || '|' || substr(a.item, 1, 1) = b.case_token || '|' || substr(b.item, 1, 1) AS one
  FROM anchors x JOIN facts a ON x.pred_id = a.id JOIN facts b ON x.ref_id = b.id WHERE x.pred_id < x.ref_id)
SELECT count(*) FILTER (WHERE relation = 'same') AS same_pairs, count(*) FILTER (WHERE relation = 'different') AS different_pairs, count(*) FILTER (WHERE relation = 'unresolved') AS unresolved_pairs,
  count(*) FILTER (WHERE decided AND ((relation = 'same' AND one) OR (relation = 'different' AND NOT one))) AS correct, count(*) FILTER (WHERE decided AND relation = 'different' AND one) AS false_merge,
  count(*) FILTER (WHERE decided AND relation = 'same' AND NOT one) AS false_split, count(*) FILTER (WHERE NOT decided) AS missing_decision, count(*) FILTER (WHERE decided AND relation = 'unresolved') AS unsupported_resolution FROM p""",
    "g10_unknown_sampling": f"""WITH {OBSERVATIONS}, dated AS (SELECT DISTINCT observation_id FROM (SELECT observation_id, unnest(time_assertions) AS t FROM obs) WHERE t.role = 'sampling' AND t.relative_day IS NOT NULL)
SELECT case_token, count(*) AS observations, count(*) FILTER (WHERE d.observation_id IS NULL) AS unknown_sampling FROM obs o LEFT JOIN dated d ON o.observation_id = d.observation_id GROUP BY 1""",
    "g12_cost_summary": f"""WITH {VIEW}, a AS (SELECT case_token, coalesce(identity_status = 'explicit', FALSE) AS good, {FINITE.format('value')} AS amount, length(project_name) AS tokens FROM view)
SELECT case_token, count(*) AS calls, count(*) FILTER (WHERE NOT good) AS failed_calls, CASE WHEN count(*) = count(amount) THEN round(sum(amount), 3) END AS amount,
  CAST(CASE WHEN count(*) = count(tokens) THEN sum(tokens) END AS BIGINT) AS tokens, CASE WHEN count(*) = count(amount) AND count(*) = count(tokens) THEN 'recorded' ELSE 'partial' END AS cost_status FROM a GROUP BY 1""",
    "j15_resolve_items": f"""WITH {VIEW}, r AS (SELECT record_id, case_token, {FINITE.format('value')} AS x, {UNIT.format('unit')} AS u, CAST(day_offset AS INTEGER) AS day, project_ref, result_ref FROM view),
met AS (SELECT i.record_id AS item_id, r.record_id, coalesce(i.day = r.day, FALSE) AS on_day, coalesce(i.project_ref IN (r.project_ref, r.result_ref), FALSE) AS on_source
  FROM r i JOIN r ON i.case_token = r.case_token AND i.u = r.u AND abs(i.x - r.x) <= 1e-6 * greatest(1.0, abs(r.x))),
d AS (SELECT * FROM (SELECT *, bool_or(on_day) OVER (PARTITION BY item_id) AND count(*) OVER (PARTITION BY item_id) > 1 AS any_day FROM met) WHERE on_day OR NOT any_day),
s AS (SELECT * FROM (SELECT *, bool_or(on_source) OVER (PARTITION BY item_id) AND count(*) OVER (PARTITION BY item_id) > 1 AS any_source FROM d) WHERE on_source OR NOT any_source),
f AS (SELECT item_id, count(*) AS n, min(record_id) AS record_id FROM s GROUP BY 1)
SELECT r.record_id AS item_id, CASE WHEN n = 1 THEN 'resolved' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status, CASE WHEN n = 1 THEN f.record_id END AS record_id FROM r LEFT JOIN f ON r.record_id = f.item_id""",
}
