"""Violations, field states, event tables and grounding over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywise.operators import binding as N
from daywise.operators import layout as L
from daywise.operators import selection as S
from daywise.operators import validation as V
from daywise.sources.tables import table
from daywise.workload.layout import BOX, NUMBER, ONE, ORACLE as LAYOUT_SQL
from daywise.workload.scoring import OBSERVATIONS
from daywise.workload.selection import VIEW


def v_observation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.observation_violations(table(spark, sf_dir, "unified_fixture_submission"))


def v_evidence_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ("submitted_at", "case_token", "source_refs")
    seen = table(spark, sf_dir, "unified_fixture_submission").groupBy("observation_id").agg(F.max(F.struct(*kept)).alias("v")).select("observation_id", "v.*")
    refs = seen.select("case_token", F.explode("source_refs").alias("evidence_id")).groupBy("evidence_id").agg(F.min("case_token").alias("case_token"))
    evidence = refs.select("evidence_id", "case_token", F.when(F.col("evidence_id").endswith("7"), "date").otherwise("row").alias("kind"))
    return V.evidence_violations(seen, evidence.filter(~F.col("evidence_id").endswith("9")))


def v_field_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "source_snapshot")
    return rows.groupBy("feed", V.field_state(F.col("payload"), "review_scope").alias("state")).agg(F.count(F.lit(1)).alias("payloads"))


def v_missing_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = S.frozen_view(table(spark, sf_dir, "record_view"))
    return view.select("record_id", F.array_join(V.missing_parts(), ",").alias("missing")).filter("missing <> ''")


def c12_event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = L.reading_order(table(spark, sf_dir, "layout_line")).withColumns(L.extents(F.col("bbox")))
    ident = F.col("line_index").cast("string")
    rows = seen.filter(F.trim("text").rlike(L.NUMBER_LINE)).select("document_token", "page_number", "top", ident.alias("row_id"), F.trim("text").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(None).cast("string").alias("role"))
    headers = seen.filter(F.col("text").rlike("[:：]")).select("document_token", "page_number", "top", ident.alias("header_id"), F.col("line_index").alias("date"), F.when(F.contains("text", F.lit(":")), "report").otherwise("unknown").alias("role"))
    return N.event_table(rows, headers).select("document_token", "row_id", "value", "event_date", "temporal_role", "binding_status")


def d19_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "layout_line")
    claims = L.table_rows(lines).select("document_token", "line_index", F.when(F.col("value") == F.floor("value"), F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string")).alias("value"), "unit")
    return N.grounding(claims, L.reading_order(lines))


QUERIES = {f.__name__: f for f in (v_observation_violations, v_evidence_violations, v_field_states, v_missing_parts, c12_event_table, d19_grounding)}

BLANK = "({0} IS NULL OR trim({0}) = '')"
ORACLE = {
    "v_observation_violations": f"""WITH n AS (SELECT *, row_number() OVER () AS rid, count(*) OVER (PARTITION BY case_token, observation_id) AS copies FROM unified_fixture_submission),
a AS (SELECT rid, unnest(time_assertions) AS t FROM n),
g AS (SELECT rid, bool_or(NOT coalesce(t.role IN ('sampling', 'report', 'collection', 'receipt', 'unknown') AND t.binding_status IN ('explicit', 'conflicting', 'unresolved', 'unknown'), FALSE)) AS bad_status,
  bool_or(t.relative_day IS NOT NULL AND ({BLANK.format('t.coordinate_id')} OR {BLANK.format('t.date_ref')})) AS no_source,
  bool_or(coalesce(t.binding_status IN ('explicit', 'conflicting'), FALSE) AND (t.relative_day IS NULL OR t.role = 'unknown' OR {BLANK.format('t.role_ref')} OR {BLANK.format('t.scope_ref')})) AS no_support,
  count(*) <> count(DISTINCT t) AS twice, bool_or(t.role = 'sampling') AS sampled FROM a GROUP BY 1),
j AS (SELECT n.*, g.bad_status, g.no_source, g.no_support, g.twice, g.sampled FROM n LEFT JOIN g ON n.rid = g.rid),
c AS (SELECT observation_id, case_token, unnest([
  CASE WHEN {BLANK.format('observation_id')} OR {BLANK.format('case_token')} OR {BLANK.format('item')} OR {BLANK.format('value')} OR {BLANK.format('unit')} THEN 'OBSERVATION_FIELDS_INVALID' END,
  CASE WHEN copies > 1 THEN 'DUPLICATE_OBSERVATION_ID' END,
  CASE WHEN source_refs IS NULL OR len(source_refs) < 1 OR len(list_distinct(source_refs)) <> len(source_refs) THEN 'SOURCE_REFS_INVALID' END,
  CASE WHEN time_assertions IS NULL OR len(time_assertions) < 1 THEN 'TIME_ASSERTIONS_INVALID' END,
  CASE WHEN bad_status THEN 'TIME_STATUS_INVALID' END, CASE WHEN no_source THEN 'DATED_ASSERTION_MISSING_PROVENANCE' END, CASE WHEN no_support THEN 'BOUND_ASSERTION_MISSING_SUPPORT' END,
  CASE WHEN twice THEN 'DUPLICATE_TIME_ASSERTION' END, CASE WHEN time_assertions IS NOT NULL AND NOT coalesce(sampled, FALSE) THEN 'SAMPLING_STATUS_MISSING' END]) AS code FROM j)
SELECT observation_id, case_token, code FROM c WHERE code IS NOT NULL""",
    "v_evidence_violations": f"""WITH {OBSERVATIONS}, r AS (SELECT DISTINCT observation_id, case_token, unnest(source_refs) AS ref FROM obs),
p AS (SELECT ref, count(DISTINCT observation_id) AS owners, min(case_token) AS a, max(case_token) AS b FROM r GROUP BY 1),
c AS (SELECT ref, unnest([CASE WHEN ref LIKE '%9' OR ref LIKE '%7' THEN 'GOLD_ROW_REFERENCE_INVALID' END, CASE WHEN owners > 1 THEN 'GOLD_ROW_OWNERSHIP_AMBIGUOUS' END, CASE WHEN ref NOT LIKE '%9' AND a <> b THEN 'GOLD_CROSS_CASE_REFERENCE' END]) AS code FROM p)
SELECT ref, code FROM c WHERE code IS NOT NULL""",
    "v_field_states": """WITH t AS (SELECT feed, CASE WHEN payload IS NOT NULL AND json_valid(payload) THEN json_extract(payload, '$.review_scope') END AS v FROM source_snapshot)
SELECT feed, CASE WHEN v IS NULL OR json_type(v) = 'NULL' THEN 'missing' WHEN CAST(v AS VARCHAR) IN ('""', '[]', '{}') THEN 'empty' ELSE 'value' END AS state, count(*) AS payloads FROM t GROUP BY 1, 2""",
    "v_missing_parts": f"""WITH {VIEW}, c AS (SELECT record_id, concat_ws(',', CASE WHEN value IS NULL THEN 'VALUE_MISSING' END, CASE WHEN unit IS NULL THEN 'UNIT_MISSING' END, CASE WHEN clock IS NULL AND day_offset IS NULL THEN 'COLLECTION_TIME_MISSING' END,
  CASE WHEN collection_ref IS NULL THEN 'COLLECTION_ANCHOR_MISSING' END, CASE WHEN report_ref IS NULL THEN 'REPORT_ANCHOR_MISSING' END) AS missing FROM view) SELECT * FROM c WHERE missing <> ''""",
    "c12_event_table": f"""WITH {ONE}, {BOX}, h AS (SELECT document_token, page_number, top, min(CAST(line_index AS VARCHAR)) AS header_id, count(*) AS n FROM box WHERE contains(text, ':') OR contains(text, '：') GROUP BY 1, 2, 3),
r AS (SELECT document_token, page_number, top, CAST(line_index AS VARCHAR) AS row_id, trim(text) AS value FROM box WHERE {NUMBER.format('text')}),
near AS (SELECT r.document_token, r.page_number, r.row_id, r.value, max(h.top) AS top FROM r LEFT JOIN h ON r.document_token = h.document_token AND r.page_number = h.page_number AND h.top <= r.top GROUP BY 1, 2, 3, 4),
s AS (SELECT n.*, CASE WHEN h.n = 1 THEN h.header_id END AS header_id FROM near n LEFT JOIN h ON n.document_token = h.document_token AND n.page_number = h.page_number AND n.top = h.top),
e AS (SELECT s.*, CASE WHEN contains(o.text, ':') THEN 'report' WHEN o.text IS NOT NULL THEN 'unknown' END AS role, o.line_index AS at_line FROM s LEFT JOIN one o ON s.document_token = o.document_token AND s.header_id = CAST(o.line_index AS VARCHAR))
SELECT document_token, row_id, value, CASE WHEN role = 'report' THEN at_line END AS event_date, coalesce(role, 'unknown') AS temporal_role, CASE WHEN role = 'report' THEN 'explicit' ELSE 'unresolved' END AS binding_status FROM e""",
    "d19_grounding": f"""WITH claims AS (SELECT document_token, line_index, CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END AS value, unit FROM ({LAYOUT_SQL['c10_table_rows']})),
{ONE}, near AS (SELECT document_token, line_index, concat_ws(chr(10), text, {', '.join(f'lead(text, {k}) OVER w' for k in range(1, 7))}) AS near FROM one WINDOW w AS (PARTITION BY document_token ORDER BY line_index))
SELECT c.document_token, count(*) AS claims, count(n.near) AS resolvable, count(*) FILTER (WHERE contains(n.near, c.value)) AS value_verbatim, count(*) FILTER (WHERE contains(n.near, c.unit)) AS unit_verbatim
FROM claims c LEFT JOIN near n ON c.document_token = n.document_token AND c.line_index = n.line_index GROUP BY 1""",
}
