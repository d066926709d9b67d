"""Positioned lines: order, checks, bands, assembly joins and retrieval over layout_line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywise.functions.values import day_marker, row_id
from daywise.operators import layout as L
from daywise.operators import retrieval as R
from daywise.operators import validation as V
from daywise.sources.tables import table

QUESTION = "haemoglobin creatinine"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "layout_line")


def g16_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_ranges(_lines(spark, sf_dir))


def struct_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.structure_violations(_lines(spark, sf_dir))


def j2_alignment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    return L.alignment_audit(lines, lines.filter("confidence >= 0.9"))


def w5_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.bands(_lines(spark, sf_dir)).select("document_token", "page_number", "band_no", "line_index")


def c11_band_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.band_texts(_lines(spark, sf_dir))


def c10_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.table_rows(_lines(spark, sf_dir))


def _day_told(text: F.Column) -> tuple[F.Column, F.Column]:
    """The documents tell relative days instead of dates."""
    return day_marker(text), F.when(day_marker(text).isNotNull(), "day").otherwise("missing")


def c10_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.measurements(_lines(spark, sf_dir), alias=r"(?i)(?<![A-Za-z])(?:HGB|CA 19-9)(?![A-Za-z])", moment=_day_told)
    return found.withColumns({"source_refs": F.array_join(F.transform("source_refs", lambda r: r.cast("string")), ",")})


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.measurements(_lines(spark, sf_dir), alias=r"(?i)(?<![A-Za-z])(?:HGB|CA 19-9)(?![A-Za-z])", moment=_day_told)


def c13_rule_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The adapter's rule mode: measurements as records of their case, with what is unresolved."""
    cases = _lines(spark, sf_dir).groupBy("document_token").agg(F.min("case_token").alias("case_token"))
    found = _measured(spark, sf_dir).drop("record_id").join(cases, "document_token")
    return found.select(row_id(F.col("case_token"), F.col("document_token"), F.coalesce("result_ref", F.lit(0))).alias("record_id"), "case_token", F.col("result_ref").alias("anchor"), "project_name", "value", "unit", "identity_status", "page_number", "collection_time", "report_time", F.array_join(V.unresolved_parts(), ",").alias("unresolved"))


def pred_candidate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, missing = V.candidate_state(require_unit=True)
    return _measured(spark, sf_dir).groupBy(status.alias("status"), F.array_join(missing, ",").alias("missing")).agg(F.count(F.lit(1)).alias("candidates"))


def _headers(seen: DataFrame) -> DataFrame:
    return seen.filter(F.col("text").rlike(r"[:：]")).select("document_token", "page_number", "top", F.col("line_index").cast("string").alias("header_id"))


def j5_header_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = L.reading_order(_lines(spark, sf_dir)).withColumns(L.extents(F.col("bbox")))
    rows = seen.filter(F.trim("text").rlike(L.NUMBER_LINE)).select("document_token", "page_number", "top", F.col("line_index").cast("string").alias("row_id"))
    return L.header_in_scope(rows, _headers(seen))


def j6_preferred_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = L.reading_order(_lines(spark, sf_dir))
    rows = seen.filter(F.trim("text").rlike(L.NUMBER_LINE)).select("document_token", F.col("line_index").alias("row_index"))
    marks = seen.filter(F.trim("text").rlike(L.UNIT_LINE)).select("document_token", F.col("line_index").alias("mark_index"))
    return L.preferred_role(rows, marks)


def j7_nearest_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.nearest_marked(_lines(spark, sf_dir)).select("document_token", "line_index", F.array_join("days", ",").alias("days"))


def w4_previous_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    seen = L.reading_order(_lines(spark, sf_dir))
    before = F.lag("text").over(Window.partitionBy("document_token").orderBy("line_index"))
    return seen.withColumn("previous", before).filter(F.trim("text").rlike(L.UNIT_LINE)).select("document_token", "line_index", "text", "previous")


def c13_line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.line_cells(_lines(spark, sf_dir))


def j20_page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_rules(_lines(spark, sf_dir))


def g6_rule_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rule_histogram(_lines(spark, sf_dir))


def c14_day_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.day_candidates(_lines(spark, sf_dir))


def c15_case_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.case_coordinates(_lines(spark, sf_dir))


def c19_retrieve_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieve_pages(_lines(spark, sf_dir), QUESTION)


def c19_retrieve_best_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieve_pages(_lines(spark, sf_dir), QUESTION, max_pages=1)


def c20_retrieve_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.retrieve_lines(_lines(spark, sf_dir), QUESTION, top_k=5)


QUERIES = {
    f.__name__: f
    for f in (g16_page_ranges, struct_violations, j2_alignment_audit, w5_bands, c11_band_texts, c10_table_rows, c10_measurements, c13_rule_records, pred_candidate_states, j5_header_scope, j6_preferred_role, j7_nearest_days, w4_previous_line, c13_line_cells, j20_page_rules, g6_rule_histogram, c14_day_candidates, c15_case_coordinates, c19_retrieve_pages, c19_retrieve_best_pages, c20_retrieve_lines)
}

ONE = "one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_token, line_index ORDER BY text DESC NULLS LAST, page_number DESC) AS n FROM layout_line) WHERE n = 1)"
BOX = "box AS (SELECT *, list_min([p[1] for p in bbox]) AS \"left\", list_min([p[2] for p in bbox]) AS top, list_max([p[2] for p in bbox]) AS bottom FROM one)"
NUMBER = r"regexp_full_match(trim({0}), '[<>≤≥]?[0-9]+([.,][0-9]+)?')"
RANGE = r"regexp_full_match(trim({0}), '[0-9]+([.,][0-9]+)?-[0-9]+([.,][0-9]+)?')"
UNIT = r"regexp_full_match(trim({0}), '([mµμun]?mol/L|[mµμun]?g/d?L|k?U/L|10\^[0-9]+/L|10⁹/L|%|mmHg|kPa|°C|cm|kg)')"
DAYS = "days AS (SELECT document_token, line_index, unnest(regexp_extract_all(text, '(\\b[Dd]ay |\\bTag |第)([0-9]{1,4})', 2)) AS d, generate_subscripts(regexp_extract_all(text, '(\\b[Dd]ay |\\bTag |第)([0-9]{1,4})', 2), 1) - 1 AS ordinal FROM one)"
TERMS = "contains(lower(text), 'creatinine') OR contains(lower(text), 'haemoglobin')"
PAGES = f"""pages AS (SELECT document_token, page_number, count(*) FILTER (WHERE {TERMS}) AS hits FROM one GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY document_token ORDER BY hits DESC, page_number) AS r, row_number() OVER (PARTITION BY document_token ORDER BY page_number) AS place FROM pages)"""


def _pages(most: str, chosen: str) -> str:
    return f"""WITH {ONE}, {PAGES}, h AS (SELECT *, hits >= 1 AND {chosen} AS hit FROM ranked),
b AS (SELECT *, coalesce(lag(hit) OVER w, FALSE) OR coalesce(lead(hit) OVER w, FALSE) AS beside, bool_or(hit) OVER (PARTITION BY document_token) AS any_hit FROM h WINDOW w AS (PARTITION BY document_token ORDER BY page_number)),
c AS (SELECT *, CASE WHEN hit THEN 'hit' WHEN beside THEN 'adjacent' WHEN NOT any_hit AND place = 1 THEN 'first' END AS chosen_as FROM b),
p AS (SELECT *, count(*) OVER (PARTITION BY document_token) AS pages FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY document_token ORDER BY page_number) AS n, count(*) OVER (PARTITION BY document_token) AS chosen FROM p WHERE chosen_as IS NOT NULL)
SELECT document_token, page_number, hits, chosen_as, {'FALSE' if chosen == 'TRUE' else 'chosen < pages'} AS truncated, least(chosen, {most}) < pages AS can_read_more FROM k WHERE n <= {most}"""


# The operator's patterns in the other engine's dialect, which has no look-behind.
HB = r"'(?i)^[\s*#·※]*(血红蛋白(量|浓度)?|ha?emoglobin)([\s*#·]*[（(]\s*(HGB|Hb)\s*[)）])?[\s*#·]*$'"
SHORT = r"'(?i)(^|[^A-Za-z])(HGB|CA 19-9)([^A-Za-z]|$)'"
CUE_C, CUE_R = r"'(?i)采集时间|采样时间|采血时间|collection\s*time|collected'", r"'(?i)报告时间|报告日期|report\s*time|reported'"
SPAN = r"'[-+]?[0-9]+([.,][0-9]+)?\s*(--|[-~～至])\s*[-+]?[0-9]+([.,][0-9]+)?'"
UNIT_IN = r"'(?i)(g\s*/\s*dL|g\s*/\s*L|mg\s*/\s*dL|mg\s*/\s*L|mmol\s*/\s*L|10\s*\^?\s*9\s*/\s*L|%)'"
BARE = r"regexp_replace(text, '[0-9]+([.,][0-9]+)?\s*[-–~]\s*[0-9]+([.,][0-9]+)?', ' ', 'g')"
FIRST = rf"TRY_CAST(replace(nullif(regexp_extract({BARE}, '(^|[^0-9A-Za-z_.,])([0-9]+([.,][0-9]+)?)([^0-9A-Za-z_]|$)', 2), ''), ',', '.') AS DOUBLE)"
TOLD = r"TRY_CAST(nullif(regexp_extract(text, '(\b[Dd]ay |\bTag |第|D\+)([0-9]{1,4})', 2), '') AS INTEGER)"
MEASUREMENTS = f"""WITH {ONE}, s AS (SELECT document_token, page_number, line_index, trim(coalesce(text, '')) AS text FROM one),
c AS (SELECT *, regexp_matches(text, {CUE_C}) AS is_c, regexp_matches(text, {CUE_R}) AS is_r, regexp_matches(text, {HB}) AS named, regexp_matches(text, {SHORT}) AS short, {TOLD} AS day FROM s),
k AS (SELECT *, CASE WHEN text <> '' AND NOT is_c AND NOT is_r THEN {{'ref': line_index, 'value': {FIRST}, 'unit': nullif(regexp_extract(text, {UNIT_IN}, 1), ''), 'span': CASE WHEN regexp_matches(text, {SPAN}) THEN text END}} END AS cell FROM c),
g AS (SELECT *, list_filter([{', '.join(f'lead(cell, {i}) OVER w' for i in range(1, 7))}], lambda x: x IS NOT NULL) AS ahead, coalesce(lag(named) OVER w, FALSE) AS follows,
  (SELECT min(o.line_index) FROM c o WHERE o.document_token IS NOT DISTINCT FROM k.document_token AND o.page_number IS NOT DISTINCT FROM k.page_number AND o.is_c AND o.day IS NOT NULL AND o.line_index >= k.line_index) AS c_next,
  (SELECT max(o.line_index) FROM c o WHERE o.document_token IS NOT DISTINCT FROM k.document_token AND o.page_number IS NOT DISTINCT FROM k.page_number AND o.is_c AND o.day IS NOT NULL AND o.line_index < k.line_index) AS c_last,
  (SELECT min(o.line_index) FROM c o WHERE o.document_token IS NOT DISTINCT FROM k.document_token AND o.page_number IS NOT DISTINCT FROM k.page_number AND o.is_r AND o.day IS NOT NULL AND o.line_index >= k.line_index) AS r_next,
  (SELECT max(o.line_index) FROM c o WHERE o.document_token IS NOT DISTINCT FROM k.document_token AND o.page_number IS NOT DISTINCT FROM k.page_number AND o.is_r AND o.day IS NOT NULL AND o.line_index < k.line_index) AS r_last
  FROM k WINDOW w AS (PARTITION BY document_token, page_number ORDER BY line_index)),
b AS (SELECT *, list_filter(ahead, lambda x: x.value IS NOT NULL)[1] AS result, coalesce(c_next, c_last) AS collection_ref, coalesce(r_next, r_last) AS report_ref FROM g WHERE named OR short AND NOT follows),
d AS (SELECT *, list_filter(ahead, lambda x: x.ref > result.ref) AS rest FROM b),
e AS (SELECT *, list_filter(rest, lambda x: x.unit IS NOT NULL)[1] AS u, list_filter(rest, lambda x: x.span IS NOT NULL AND x.unit IS NULL)[1] AS bs, list_filter(rest, lambda x: x.span IS NOT NULL)[1] AS sp FROM d),
f AS (SELECT *, CASE WHEN result.unit IS NULL AND NOT (bs IS NOT NULL AND (u IS NULL OR bs.ref < u.ref)) THEN u END AS unit_row FROM e),
h AS (SELECT *, CASE WHEN result.unit IS NOT NULL THEN sp WHEN unit_row IS NULL THEN bs ELSE list_filter(rest, lambda x: x.span IS NOT NULL AND x.ref > unit_row.ref)[1] END AS range_row, coalesce(result.unit, unit_row.unit) AS shown FROM f),
i AS (SELECT *, CASE lower(regexp_replace(shown, '\\s+', '', 'g')) WHEN 'g/dl' THEN 'g/dL' WHEN 'g/l' THEN 'g/L' WHEN 'mg/dl' THEN 'mg/dL' WHEN 'mg/l' THEN 'mg/L' ELSE shown END AS unit, CASE WHEN named THEN line_index END AS project_ref, CASE WHEN result.unit IS NOT NULL THEN result.ref ELSE unit_row.ref END AS unit_ref FROM h)
SELECT i.document_token, i.page_number, i.line_index, CASE WHEN i.named THEN i.text END AS project_name, project_ref, result.ref AS result_ref, result.value AS value, unit, unit_ref, range_row.span AS reference_interval, range_row.ref AS reference_ref,
  collection_ref, cc.day AS collection_time, CASE WHEN cc.day IS NOT NULL THEN 'day' END AS collection_precision, report_ref, rr.day AS report_time, CASE WHEN rr.day IS NOT NULL THEN 'day' END AS report_precision,
  CASE WHEN i.named THEN substr(sha256(concat_ws('|', i.document_token, i.page_number, project_ref, coalesce(CAST(result.ref AS VARCHAR), 'None'))), 1, 16) END AS record_id, CASE WHEN i.named THEN 'explicit' ELSE 'invalid_task' END AS identity_status,
  CASE WHEN i.named AND result.ref IS NOT NULL AND collection_ref IS NOT NULL THEN 'explicit' ELSE 'unresolved' END AS binding_status, CASE unit WHEN 'g/dL' THEN result.value * 10 WHEN 'g/L' THEN result.value WHEN 'mg/dL' THEN result.value / 100 WHEN 'mg/L' THEN result.value / 1000 END AS value_g_l,
  concat_ws(',', project_ref, result.ref, unit_ref, range_row.ref, collection_ref, report_ref) AS source_refs
FROM i LEFT JOIN c cc ON cc.document_token = i.document_token AND cc.line_index = collection_ref LEFT JOIN c rr ON rr.document_token = i.document_token AND rr.line_index = report_ref"""

ORACLE = {
    "g16_page_ranges": f"WITH {ONE} SELECT document_token, min(page_number) AS first_page, max(page_number) AS last_page, count(*) AS line_count FROM one GROUP BY 1",
    "struct_violations": f"""WITH {ONE}, seen AS (SELECT *, line_index - lag(line_index) OVER w AS step, page_number - lag(page_number) OVER w AS turn FROM one WINDOW w AS (PARTITION BY document_token ORDER BY line_index))
SELECT document_token, line_index, 'DUPLICATE_LINE' AS code FROM layout_line GROUP BY 1, 2 HAVING count(*) > 1
UNION ALL SELECT document_token, line_index, 'PAGE_DECREASES' FROM seen WHERE turn < 0 UNION ALL SELECT document_token, line_index, 'PAGE_SKIPPED' FROM seen WHERE turn > 1
UNION ALL SELECT document_token, line_index, 'INDEX_GAP' FROM seen WHERE coalesce(step, line_index + 1) <> 1
UNION ALL SELECT document_token, line_index, 'BBOX_INVALID' FROM seen WHERE bbox IS NULL OR len(bbox) = 0
UNION ALL SELECT document_token, line_index, CASE WHEN confidence IS NULL OR isnan(confidence) THEN 'CONFIDENCE_MISSING' ELSE 'CONFIDENCE_OUT_OF_RANGE' END FROM seen WHERE confidence IS NULL OR isnan(confidence) OR NOT confidence BETWEEN 0 AND 1""",
    "j2_alignment_audit": f"""WITH {ONE}, kept AS (SELECT DISTINCT document_token, line_index FROM layout_line WHERE confidence >= 0.9)
SELECT o.document_token, count(k.line_index) AS aligned, CAST(0 AS BIGINT) AS moved, count(*) - count(k.line_index) AS left_only, CAST(0 AS BIGINT) AS right_only
FROM one o LEFT JOIN kept k ON o.document_token = k.document_token AND o.line_index = k.line_index GROUP BY 1""",
    "w5_bands": f"""WITH {ONE}, {BOX}, reached AS (SELECT *, max(bottom) OVER (PARTITION BY document_token, page_number ORDER BY top, bottom, line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM box WHERE top IS NOT NULL)
SELECT document_token, page_number, CAST(sum(CASE WHEN far IS NULL OR top > far + 4.0 THEN 1 ELSE 0 END) OVER (PARTITION BY document_token, page_number ORDER BY top, bottom, line_index ROWS UNBOUNDED PRECEDING) AS INTEGER) AS band_no, line_index FROM reached""",
    "c11_band_texts": f"""WITH {ONE}, {BOX}, reached AS (SELECT *, max(bottom) OVER (PARTITION BY document_token, page_number ORDER BY top, bottom, line_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM box WHERE top IS NOT NULL),
b AS (SELECT *, CAST(sum(CASE WHEN far IS NULL OR top > far + 4.0 THEN 1 ELSE 0 END) OVER (PARTITION BY document_token, page_number ORDER BY top, bottom, line_index ROWS UNBOUNDED PRECEDING) AS INTEGER) AS band_no FROM reached)
SELECT document_token, page_number, band_no, count(*) AS lines, string_agg(text, ' ' ORDER BY "left", line_index) AS text FROM b GROUP BY 1, 2, 3""",
    "c10_table_rows": f"""WITH {ONE}, t AS (SELECT document_token, line_index, trim(text) AS text, [{', '.join(f'trim(lead(text, {k}) OVER w)' for k in range(1, 7))}] AS ahead FROM one WINDOW w AS (PARTITION BY document_token ORDER BY line_index)),
a AS (SELECT *, list_position(list_transform(ahead, lambda x: coalesce({NUMBER.format('x')}, FALSE)), TRUE) AS pos FROM t
  WHERE regexp_full_match(text, '[\\p{{L}}\\p{{N}} .,()/-]{{2,40}}') AND regexp_matches(text, '\\p{{L}}') AND NOT {NUMBER.format('text')} AND NOT {RANGE.format('text')} AND NOT {UNIT.format('text')}),
r AS (SELECT *, ahead[pos] AS said, list_filter(ahead[pos + 1:], lambda x: {UNIT.format('x')})[1] AS unit, list_filter(ahead[pos + 1:], lambda x: {RANGE.format('x')})[1] AS span FROM a WHERE pos > 0),
v AS (SELECT document_token, line_index, text AS name, CAST(regexp_replace(replace(said, ',', '.'), '[<>≤≥]', '', 'g') AS DOUBLE) AS value, unit, TRY_CAST(replace(split_part(span, '-', 1), ',', '.') AS DOUBLE) AS low, TRY_CAST(replace(split_part(span, '-', 2), ',', '.') AS DOUBLE) AS high FROM r)
SELECT *, concat_ws(',', CASE WHEN unit IS NULL THEN 'unit' END, CASE WHEN low IS NULL THEN 'range' END) AS missing FROM v""",
    "c10_measurements": MEASUREMENTS,
    "c13_rule_records": f"""WITH m AS ({MEASUREMENTS}), cases AS (SELECT document_token, min(case_token) AS case_token FROM layout_line GROUP BY 1)
SELECT substr(sha256(concat_ws('|', case_token, m.document_token, coalesce(result_ref, 0))), 1, 16) AS record_id, case_token, result_ref AS anchor, project_name, value, unit, identity_status, page_number, collection_time, report_time,
  concat_ws(',', CASE WHEN value IS NULL THEN 'VALUE_MISSING' END, CASE WHEN unit IS NULL THEN 'UNIT_MISSING' END, CASE WHEN collection_time IS NULL THEN 'COLLECTION_TIME_MISSING' END, CASE WHEN collection_ref IS NULL THEN 'COLLECTION_ANCHOR_MISSING' END, CASE WHEN report_ref IS NULL THEN 'REPORT_ANCHOR_MISSING' END) AS unresolved FROM m JOIN cases ON m.document_token = cases.document_token""",
    "pred_candidate_states": f"""WITH m AS ({MEASUREMENTS}), c AS (SELECT identity_status = 'explicit' AS valid, concat_ws(',', CASE WHEN value IS NULL THEN 'value' END, CASE WHEN collection_time IS NULL THEN 'collection_time_role' END, CASE WHEN source_refs = '' THEN 'source_anchor' END, CASE WHEN unit IS NULL THEN 'unit' END) AS missing FROM m)
SELECT CASE WHEN NOT valid THEN 'invalid_task' WHEN missing = '' THEN 'complete' ELSE 'incomplete' END AS status, CASE WHEN valid THEN missing ELSE 'identity' END AS missing, count(*) AS candidates FROM c GROUP BY 1, 2""",
    "j5_header_scope": f"""WITH {ONE}, {BOX}, h AS (SELECT document_token, page_number, top, min(CAST(line_index AS VARCHAR)) AS header_id, count(*) AS n FROM box WHERE contains(text, ':') OR contains(text, '：') GROUP BY 1, 2, 3),
r AS (SELECT document_token, page_number, top, CAST(line_index AS VARCHAR) AS row_id FROM box WHERE {NUMBER.format('text')}),
near AS (SELECT r.document_token, r.page_number, r.row_id, max(h.top) AS top FROM r LEFT JOIN h ON r.document_token = h.document_token AND r.page_number = h.page_number AND h.top <= r.top GROUP BY 1, 2, 3)
SELECT n.document_token, n.page_number, n.row_id, CASE WHEN h.n = 1 THEN h.header_id END AS header_id, CASE WHEN n.top IS NULL THEN 'none' WHEN h.n > 1 THEN 'tie' ELSE 'explicit' END AS binding
FROM near n LEFT JOIN h ON n.document_token = h.document_token AND n.page_number = h.page_number AND n.top = h.top""",
    "j6_preferred_role": f"""WITH {ONE}, r AS (SELECT document_token, line_index AS row_index FROM one WHERE {NUMBER.format('text')}), m AS (SELECT document_token, line_index AS mark_index FROM one WHERE {UNIT.format('text')})
SELECT r.document_token, r.row_index, coalesce(min(m.mark_index) FILTER (WHERE m.mark_index >= r.row_index), max(m.mark_index)) AS mark_index FROM r LEFT JOIN m ON r.document_token = m.document_token GROUP BY 1, 2""",
    "j7_nearest_days": f"""WITH {ONE}, {BOX}, m AS (SELECT document_token, page_number, top, CAST(NULLIF(regexp_extract(text, '(\\b[Dd]ay |\\bTag |第|D\\+)([0-9]{{1,4}})', 2), '') AS INTEGER) AS day FROM box),
r AS (SELECT document_token, page_number, line_index, top FROM box WHERE {NUMBER.format('text')} AND top IS NOT NULL),
k AS (SELECT r.document_token, r.line_index, m.top, m.day, row_number() OVER (PARTITION BY r.document_token, r.line_index ORDER BY abs(m.top - r.top), m.top, m.day) AS n FROM r JOIN m ON r.document_token = m.document_token AND r.page_number = m.page_number WHERE m.day IS NOT NULL AND m.top IS NOT NULL),
g AS (SELECT document_token, line_index, string_agg(CAST(day AS VARCHAR), ',' ORDER BY top, day) AS days FROM k WHERE n <= 2 GROUP BY 1, 2)
SELECT r.document_token, r.line_index, coalesce(g.days, '') AS days FROM r LEFT JOIN g ON r.document_token = g.document_token AND r.line_index = g.line_index""",
    "w4_previous_line": f"WITH {ONE}, t AS (SELECT *, lag(text) OVER (PARTITION BY document_token ORDER BY line_index) AS previous FROM one) SELECT document_token, line_index, text, previous FROM t WHERE {UNIT.format('text')}",
    "c13_line_cells": f"""WITH {ONE}, u AS (SELECT document_token, line_index, text, NULLIF(regexp_extract(text, '(?:[mµμun]?mol/L|[mµμun]?g/d?L|k?U/L|10\\^[0-9]+/L|10⁹/L)'), '') AS unit,
  regexp_extract(text, '^(.*?)(?:[mµμun]?mol/L|[mµμun]?g/d?L|k?U/L|10\\^[0-9]+/L|10⁹/L)', 1) AS head FROM one),
v AS (SELECT document_token, line_index, list_last(regexp_extract_all(CASE WHEN unit IS NULL THEN text ELSE head END, '[<>]?[0-9]+(?:\\.[0-9]+)?')) AS value_text, unit FROM u)
SELECT document_token, line_index, value_text, CASE WHEN NOT regexp_matches(value_text, '^[<>]') THEN CAST(value_text AS DOUBLE) END AS value_numeric, unit,
  concat_ws(',', CASE WHEN regexp_matches(value_text, '^[<>]') THEN 'bounded' END, CASE WHEN unit IS NULL THEN 'no_unit' END) AS issues FROM v WHERE value_text IS NOT NULL""",
    "j20_page_rules": f"""WITH {ONE}, e AS (SELECT DISTINCT document_token, page_number, unnest(list_concat(coalesce(redaction_rules, []), coalesce(residual_rules, []))) AS rule FROM one),
p AS (SELECT document_token, page_number, string_agg(rule, ',' ORDER BY rule) AS rules FROM e GROUP BY 1, 2)
SELECT o.document_token, o.line_index, coalesce(p.rules, '') AS rules FROM one o LEFT JOIN p ON o.document_token = p.document_token AND o.page_number = p.page_number""",
    "g6_rule_histogram": f"""WITH {ONE}, e AS (SELECT DISTINCT document_token, page_number, 'redaction_rules' AS list, unnest(redaction_rules) AS rule FROM one UNION ALL SELECT DISTINCT document_token, page_number, 'residual_rules', unnest(residual_rules) FROM one)
SELECT list, rule, count(*) AS pages FROM e GROUP BY 1, 2""",
    "c14_day_candidates": f"WITH {ONE}, {DAYS} SELECT document_token, line_index, CAST(ordinal AS INTEGER) AS ordinal, CAST(d AS INTEGER) AS day FROM days",
    "c15_case_coordinates": f"""WITH {ONE}, {DAYS}, c AS (SELECT document_token, min(case_token) AS case_token FROM layout_line WHERE case_token IS NOT NULL GROUP BY 1),
x AS (SELECT c.case_token, d.document_token, d.line_index, d.ordinal, CAST(d.d AS INTEGER) AS day, row_number() OVER (PARTITION BY c.case_token ORDER BY CAST(d.d AS INTEGER), d.document_token, d.line_index, d.ordinal) AS n FROM days d JOIN c ON d.document_token = c.document_token)
SELECT case_token, max(day) FILTER (WHERE n = 1) AS origin_day, max(document_token) FILTER (WHERE n = 1) AS reference_document, count(DISTINCT document_token) AS documents, count(*) AS candidates,
  'day0-' || substr(sha256(case_token || '|' || max(document_token) FILTER (WHERE n = 1) || '|' || CAST(max(day) FILTER (WHERE n = 1) AS VARCHAR)), 1, 12) AS coordinate_id FROM x GROUP BY 1""",
    "c19_retrieve_pages": _pages("64", "TRUE"),
    "c19_retrieve_best_pages": _pages("3", "r <= 1"),
    "c20_retrieve_lines": f"""WITH {ONE}, s AS (SELECT document_token, line_index, len(list_intersect(list_distinct(string_split(text, '')), string_split('abceghilmnort', ''))) AS hits FROM one WHERE trim(text) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY document_token ORDER BY line_index) AS place, CASE WHEN row_number() OVER (PARTITION BY document_token ORDER BY hits DESC, line_index) <= 5 AND hits > 0 THEN 1 ELSE 0 END AS top FROM s),
n AS (SELECT *, max(top) OVER (PARTITION BY document_token ORDER BY place ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, max(hits) OVER (PARTITION BY document_token) AS most FROM r)
SELECT document_token, line_index, CAST(hits AS INTEGER) AS hits FROM n WHERE near = 1 OR most = 0""",
}
