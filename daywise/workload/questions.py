"""Questions on evaluations and timelines over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daywise.functions.clock import clock_seconds
from daywise.functions.values import finite_number
from daywise.operators import questions as Q
from daywise.plans.selection import with_problem_codes
from daywise.sources.tables import table
from daywise.workload.ledger import ROWS, _rows

FEW = ("project_ref", "result_ref", "unit_ref", "collection_ref", "report_ref")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "record_view")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).withColumn("day", F.col("collection_day").cast("int"))


def d23_repeated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.repeated_keys(table(spark, sf_dir, "source_snapshot"), ["feed", "source_file", "snapshot_id"])


def d24_paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.paired_outcomes(_rows(spark, sf_dir).filter("label is not null and label not in ('', 'not_started')"), ["task_id"], "arm", F.col("label") == F.col("closed"), "reviewer_a", "reviewer_b")


def d25_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = {"value": F.col("value").isNotNull(), "unit": F.col("unit").isNotNull(), "day": F.col("day_offset").isNotNull(), "clock": F.col("clock").isNotNull(), "identity": F.col("identity_status") == "explicit"}
    return Q.ladder(_records(spark, sf_dir), layers)


def d26_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.coverage(table(spark, sf_dir, "review_template"), ["candidate_status", "source_support_status"])


def d27_task_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.task_families(_records(spark, sf_dir).select("case_token", F.col("day_offset").cast("int").alias("day"), clock_seconds(F.col("clock"), F.col("precision")).alias("second")))


def _report() -> Column:
    return F.col("time_role") == "report"


def d28_day_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.day_timeline(_dated(spark, sf_dir), item="project_name", number=finite_number(F.col("value")), low=5.0, high=100.0, other=_report())


def d28_case_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.case_timeline(_dated(spark, sf_dir), _report())


def d29_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.cohort_of(d28_case_timeline(spark, sf_dir))


def d30_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each feed the share of payloads that tell of at least nine tenths of their document's lines."""
    said = lambda name: F.get_json_object("payload", f"$.{name}")
    lines = said("line_count")
    answers = table(spark, sf_dir, "source_snapshot").select("feed", F.try_parse_json("payload").isNotNull().alias("parseable"), said("document_token").alias("document_token"), F.when(lines.rlike(r"^\d{1,9}$"), lines).cast("int").alias("rows"))
    truth = table(spark, sf_dir, "layout_line").groupBy("document_token").agg(F.count_distinct("line_index").alias("truth"))
    done = Q.completed(F.col("parseable"), F.col("rows"), F.col("truth"), F.col("truth").isNotNull())
    return answers.join(truth, "document_token", "left").groupBy("feed").agg(F.count(F.lit(1)).alias("answers"), F.count_if(done).alias("complete"), (F.count_if(done) / F.count(F.lit(1))).alias("completion_rate"))


def _per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "review_template").groupBy("case_token").agg(F.count_if(F.lower("reviewer_a_judgment") == F.lower("manual_judgment")).cast("double").alias("hits"), F.count(F.lit(1)).cast("double").alias("sheets"))


def d31_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.resampled(_per_case(spark, sf_dir), "case_token", "hits", "sheets", replicates=200, seed="d31").select("replicate", F.round("mean", 9).alias("mean"))


def d31_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Q.interval(Q.resampled(_per_case(spark, sf_dir), "case_token", "hits", "sheets", replicates=200, seed="d31"), "mean")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


def d32_identity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    keys = {"by_row": [c("document_token"), c("line_index")], "by_page": [c("document_token"), c("page_number")], "by_page_text": [c("document_token"), c("page_number"), c("text")], "by_text": [c("text")], "by_anchor": [c("anchor")]}
    return Q.identity_counts(table(spark, sf_dir, "layout_line"), keys)


def d33_reviewer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each two reviewers of a sheet how often both labelled it, and alike."""
    s = table(spark, sf_dir, "review_template").dropDuplicates(["sheet_id"])
    code, label = (lambda x: F.upper(F.trim(x))), (lambda x: F.lower(F.trim(x)))
    given = lambda x: label(x).isNotNull() & ~label(x).isin("", "not_started")
    rows = s.filter(given("reviewer_a_judgment") & given("reviewer_b_judgment"))
    return rows.groupBy(F.least(code("reviewer_a"), code("reviewer_b")).alias("one"), F.greatest(code("reviewer_a"), code("reviewer_b")).alias("other")).agg(F.count(F.lit(1)).alias("sheets"), F.count_if(label("reviewer_a_judgment") == label("reviewer_b_judgment")).alias("alike"))


def d34_confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("confidence")
    return table(spark, sf_dir, "layout_line").groupBy("source_kind").agg(F.count(F.lit(1)).alias("lines"), F.count_if(low < 0.8).alias("under_80"), F.count_if(low < 0.6).alias("under_60"), F.count_if(low.isNull()).alias("unknown"), F.count_if(F.col("redaction_rules").isNotNull()).alias("with_rules"), F.count_if(F.col("residual_rules").isNotNull()).alias("with_residual"))


def d35_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.stability(_records(spark, sf_dir), ["record_id"], finite_number(F.col("value")))


def d36_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages within half a percent of the part's price, and counts that are exact."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("each"), F.count(F.lit(1)).alias("lines"))
    j = per.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice", "p_size"), "l_partkey")
    return j.groupBy("p_brand").agg(F.count_if(F.abs(F.col("each") - F.col("p_retailprice")) <= 0.005 * F.abs("p_retailprice")).alias("near"), F.count_if(F.col("lines") == F.col("p_size")).alias("exact"), F.count(F.lit(1)).alias("parts"))


def g14_cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("tokens", F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4))
    return d.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") * 3 / 1_000_000, 7).alias("cost"))


def g17_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("size", F.length(F.coalesce("text", F.lit(""))))
    return d.groupBy("lang").agg(F.sum(F.when(F.col("source") == "discharge_letter", F.col("size")).otherwise(0)).alias("letters"), F.sum("size").alias("whole"), F.try_divide(F.sum(F.when(F.col("source") == "discharge_letter", F.col("size")).otherwise(0)), F.sum("size")).alias("share"))


def x3_evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.nullif(F.trim(c), F.lit("")) for c in FEW]))))
    return _records(spark, sf_dir).groupBy("record_id").agg(F.max(F.array_join(refs, ",")).alias("refs"))


def x2_missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ("value", "unit", "clock", "project_name")
    supplied = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), c) for c in wanted]))
    missing = F.array_join(F.array_except(F.array(*[F.lit(c) for c in wanted]), supplied), ",")
    return _records(spark, sf_dir).groupBy(missing.alias("missing")).agg(F.count(F.lit(1)).alias("records"))


def x5_key_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.key_difference(_records(spark, sf_dir), table(spark, sf_dir, "documents"), "case_token")


def pred_supplied_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    any_of = lambda c: F.max(F.col(c).isNotNull())
    return _records(spark, sf_dir).groupBy("case_token").agg(any_of("value").alias("value"), any_of("unit").alias("unit"), F.max(F.col("day_offset").isNotNull() | F.col("clock").isNotNull()).alias("time"), any_of("result_ref").alias("source"), any_of("record_id").alias("id"))


def pred_alias_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by the beginning of their name."""
    source = F.col("source")
    channel = F.when(source.startswith("disch"), "letter").when(source.startswith("lab") | source.startswith("ward"), "site").when(source.isNull(), "none").otherwise("other")
    return table(spark, sf_dir, "documents").groupBy(channel.alias("channel")).agg(F.count(F.lit(1)).alias("documents"))


def pred_plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The codes of a plan made of each record, as a table of JSON plans; null fields are absent from a plan.

    An inner explode would have its size filtered below the parsing, and all of it written out once more for that.
    """
    window = F.struct(F.col("collection_day").cast("int").alias("from"), F.col("day_offset").cast("int").alias("to"), F.lit(True).alias("include_from"), F.lit(False).alias("include_to"))
    plan = F.to_json(F.struct(F.col("project_ref").alias("project"), "time_role", window.alias("window"), F.when(F.col("batch_no") % 2 == 0, "all").otherwise("latest").alias("selection"), F.col("case_token").alias("scope"), F.lit("undetermined").alias("tie_policy"), F.lower(F.col("precision")).alias("missing_policy")))
    return with_problem_codes(_records(spark, sf_dir).select(plan.alias("plan")), "plan").select(F.explode_outer("codes").alias("code")).filter("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("plans"))


def f20_canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select(F.to_json(F.struct("batch_no", "case_token", "record_id"), {"ignoreNullFields": "false"}).alias("body")).distinct()


def f28_day_of_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain day, else that of the report."""
    return _records(spark, sf_dir).groupBy("case_token").agg(F.count(F.coalesce("day_offset", "report_day_offset")).alias("dated"), F.min(F.coalesce("day_offset", "report_day_offset")).cast("int").alias("first_day"), F.count(F.coalesce("clock", "report_clock")).alias("clocked"))


def f30_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    return _records(spark, sf_dir).select("record_id", F.format_string("Case %s: %s of %s on day %s.", said("case_token"), said("value"), said("project_name"), said("day_offset")).alias("text")).distinct()


QUERIES = {
    f.__name__: f
    for f in (d23_repeated_sources, d24_paired_outcomes, d25_ladder, d26_coverage, d27_task_families, d28_day_timeline, d28_case_timeline, d29_cohort, d30_completion, d31_resampled, d31_interval, d32_identity_counts, d33_reviewer_agreement, d34_confidence_counts, d35_stability, d36_accepted, g14_cost_estimate, g17_ratios, x2_missing_fields, x3_evidence_refs, x5_key_difference, pred_supplied_fields, pred_alias_channel, pred_plan_problems, f20_canonical_json, f28_day_of_role, f30_prompts)
}

SECOND = "CASE WHEN precision IS NOT NULL AND lower(trim(precision)) NOT IN ('', 'day', 'date') AND regexp_full_match(trim(clock), '([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?') THEN CAST(substr(trim(clock), 1, 2) AS INTEGER) * 3600 + CAST(substr(trim(clock), 4, 2) AS INTEGER) * 60 + CASE WHEN length(trim(clock)) > 5 THEN CAST(substr(trim(clock), 7, 2) AS INTEGER) ELSE 0 END END"
NUMBER = "CASE WHEN isfinite(TRY_CAST(trim(value) AS DOUBLE)) THEN TRY_CAST(trim(value) AS DOUBLE) END"
LADDER = ("value IS NOT NULL", "unit IS NOT NULL", "day_offset IS NOT NULL", "clock IS NOT NULL", "coalesce(identity_status = 'explicit', FALSE)")
LAYERS = ("value", "unit", "day", "clock", "identity")
TIMES = " + ".join(f"CASE WHEN part >= {p} THEN 1 ELSE 0 END" for p in Q.POISSON)
SAMPLES = f"""per AS (SELECT case_token, CAST(count(*) FILTER (WHERE lower(reviewer_a_judgment) = lower(manual_judgment)) AS DOUBLE) AS hits, CAST(count(*) AS DOUBLE) AS sheets FROM review_template GROUP BY 1),
drawn AS (SELECT per.*, r.replicate, CAST(CAST('0x' || substr(md5('d31|' || r.replicate || '|' || case_token), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS part FROM per, (SELECT unnest(range(1, 201)) AS replicate) r WHERE case_token IS NOT NULL),
samples AS (SELECT CAST(replicate AS INTEGER) AS replicate, sum(({TIMES}) * hits) / sum(({TIMES}) * sheets) AS mean FROM drawn GROUP BY 1)"""
TIMELINE = """days AS (SELECT case_token, CAST(collection_day AS INTEGER) AS day, count(*) AS n, bool_or(coalesce(time_role = 'report', FALSE)) AS a, bool_or(NOT coalesce(time_role = 'report', FALSE)) AS b FROM record_view GROUP BY 1, 2),
timeline AS (SELECT case_token, min(day) AS first_day, max(day) AS last_day, max(day) - min(day) AS span, count(day) AS active_days, count(*) FILTER (WHERE day IS NOT NULL AND a AND b) AS shared_days, CAST(coalesce(sum(n) FILTER (WHERE day IS NULL), 0) AS BIGINT) AS undated FROM days GROUP BY 1)"""

ORACLE = {
    "d23_repeated_sources": "SELECT feed, source_file, snapshot_id, count(*) AS copies FROM source_snapshot GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "d24_paired_outcomes": f"""WITH {ROWS}, p AS (SELECT task_id, bool_or(coalesce(label = closed, FALSE)) FILTER (WHERE arm = 'reviewer_a') AS l, bool_or(coalesce(label = closed, FALSE)) FILTER (WHERE arm = 'reviewer_b') AS r FROM led WHERE label IS NOT NULL AND label NOT IN ('', 'not_started') GROUP BY 1)
SELECT count(*) FILTER (WHERE l AND NOT r) AS wins, count(*) FILTER (WHERE r AND NOT l) AS losses, count(*) FILTER (WHERE l AND r) AS "both", count(*) FILTER (WHERE NOT l AND NOT r) AS neither FROM p WHERE l IS NOT NULL AND r IS NOT NULL""",
    "d25_ladder": " UNION ALL ".join([f"SELECT '{n}' AS layer, count(*) AS kept FROM record_view WHERE {' AND '.join(LADDER[: i + 1])}" for i, n in enumerate(LAYERS)] + [f"SELECT 'minus_{n}' AS layer, count(*) AS kept FROM record_view WHERE {' AND '.join(x for j, x in enumerate(LADDER) if j != i)}" for i, n in enumerate(LAYERS)]),
    "d26_coverage": "SELECT candidate_status, source_support_status, CAST(grouping(candidate_status, source_support_status) AS INTEGER) AS level, count(*) AS rows FROM review_template GROUP BY CUBE (candidate_status, source_support_status)",
    "d27_task_families": f"""WITH r AS (SELECT case_token, CAST(day_offset AS INTEGER) AS day, {SECOND} AS second FROM record_view WHERE case_token IS NOT NULL AND day_offset IS NOT NULL),
s AS (SELECT case_token, day, second, count(*) AS n FROM r GROUP BY 1, 2, 3), d AS (SELECT case_token, day, sum(n) AS n, bool_or(n > 1 AND second IS NOT NULL) AS tied FROM s GROUP BY 1, 2),
g AS (SELECT *, lead(day) OVER (PARTITION BY case_token ORDER BY day) AS nxt FROM d),
gap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_token ORDER BY nxt - day DESC, day) AS k FROM g WHERE nxt - day > 1) WHERE k = 1),
busy AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_token ORDER BY n DESC, day) AS k FROM d) WHERE k = 1),
span AS (SELECT case_token, min(day) AS a, max(day) AS b, min(day) FILTER (WHERE tied) AS t FROM d GROUP BY 1)
SELECT case_token, 'gap' AS family, day AS low, nxt AS high, FALSE AS include_low, FALSE AS include_high, 'all' AS selection FROM gap
UNION ALL SELECT case_token, 'after_last', b, NULL, FALSE, FALSE, 'first' FROM span UNION ALL SELECT case_token, 'full_span', a, b, TRUE, TRUE, 'all' FROM span UNION ALL SELECT case_token, 'inside_span', a, b, FALSE, FALSE, 'all' FROM span
UNION ALL SELECT case_token, 'busiest_day', day, day, TRUE, TRUE, 'all' FROM busy UNION ALL SELECT case_token, 'tie_day', t, t, TRUE, TRUE, 'latest' FROM span WHERE t IS NOT NULL""",
    "d28_day_timeline": f"""WITH d AS (SELECT case_token, CAST(collection_day AS INTEGER) AS day, count(*) AS rows, count(DISTINCT project_name) AS items, count(*) FILTER (WHERE {NUMBER} < 5) AS below, count(*) FILTER (WHERE {NUMBER} > 100) AS above, count(*) FILTER (WHERE time_role = 'report') AS others FROM record_view WHERE collection_day IS NOT NULL GROUP BY 1, 2)
SELECT case_token, day, day - min(day) OVER (PARTITION BY case_token) AS day_index, rows, items, below, above, others FROM d""",
    "d28_case_timeline": f"WITH {TIMELINE} SELECT * FROM timeline",
    "d29_cohort": f"WITH {TIMELINE} SELECT count(*) AS cases, count(*) FILTER (WHERE span > 30) AS long_cases, CAST(coalesce(sum(active_days), 0) AS BIGINT) AS active_days, count(*) FILTER (WHERE shared_days > 0) AS shared_cases FROM timeline",
    "d30_completion": r"""WITH v AS (SELECT feed, CASE WHEN payload IS NOT NULL AND json_valid(payload) THEN payload END AS p FROM source_snapshot),
a AS (SELECT feed, p, json_extract_string(p, '$.document_token') AS document_token, CASE WHEN regexp_full_match(json_extract_string(p, '$.line_count'), '[0-9]{1,9}') THEN CAST(json_extract_string(p, '$.line_count') AS INTEGER) END AS n FROM v),
t AS (SELECT document_token, count(DISTINCT line_index) AS truth FROM layout_line GROUP BY 1), c AS (SELECT feed, coalesce(p IS NOT NULL AND n > 0 AND n >= 0.9 * truth, FALSE) AS done FROM a LEFT JOIN t ON a.document_token = t.document_token)
SELECT feed, count(*) AS answers, count(*) FILTER (WHERE done) AS complete, count(*) FILTER (WHERE done) / CAST(count(*) AS DOUBLE) AS completion_rate FROM c GROUP BY 1""",
    "d31_resampled": f"WITH {SAMPLES} SELECT replicate, round(mean, 9) AS mean FROM samples",
    "d31_interval": f"WITH {SAMPLES} SELECT round(quantile_cont(mean, 0.025), 9) AS low, round(quantile_cont(mean, 0.5), 9) AS middle, round(quantile_cont(mean, 0.975), 9) AS high FROM samples",
    "d32_identity_counts": "SELECT (SELECT count(*) FROM (SELECT DISTINCT document_token, line_index FROM layout_line)) AS by_row, (SELECT count(*) FROM (SELECT DISTINCT document_token, page_number FROM layout_line)) AS by_page, (SELECT count(*) FROM (SELECT DISTINCT document_token, page_number, text FROM layout_line)) AS by_page_text, (SELECT count(*) FROM (SELECT DISTINCT text FROM layout_line)) AS by_text, (SELECT count(*) FROM (SELECT DISTINCT anchor FROM layout_line)) AS by_anchor",
    "d33_reviewer_agreement": """WITH sheets AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY locked_at) AS n FROM review_template) WHERE n = 1),
s AS (SELECT upper(trim(reviewer_a)) AS a, upper(trim(reviewer_b)) AS b, lower(trim(reviewer_a_judgment)) AS x, lower(trim(reviewer_b_judgment)) AS y FROM sheets)
SELECT least(a, b) AS one, greatest(a, b) AS other, count(*) AS sheets, count(*) FILTER (WHERE x = y) AS alike FROM s WHERE x NOT IN ('', 'not_started') AND y NOT IN ('', 'not_started') GROUP BY 1, 2""",
    "d34_confidence_counts": "SELECT source_kind, count(*) AS lines, count(*) FILTER (WHERE confidence < 0.8) AS under_80, count(*) FILTER (WHERE confidence < 0.6) AS under_60, count(*) FILTER (WHERE confidence IS NULL) AS unknown, count(redaction_rules) AS with_rules, count(residual_rules) AS with_residual FROM layout_line GROUP BY 1",
    "d35_stability": f"SELECT record_id, count(x) AS repeats, min(x) AS lowest, max(x) AS highest, max(x) - min(x) AS spread FROM (SELECT record_id, {NUMBER} AS x FROM record_view) GROUP BY 1 HAVING count(x) >= 2",
    "d36_accepted": """WITH p AS (SELECT l_partkey, avg(l_extendedprice / l_quantity) AS each_, count(*) AS lines FROM lineitem GROUP BY 1)
SELECT p_brand, count(*) FILTER (WHERE abs(each_ - p_retailprice) <= 0.005 * abs(p_retailprice)) AS near, count(*) FILTER (WHERE lines = p_size) AS exact, count(*) AS parts FROM p JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "g14_cost_estimate": "SELECT source, CAST(sum(t) AS BIGINT) AS tokens, round(CAST(sum(t) AS DOUBLE) * 3 / 1000000, 7) AS cost FROM (SELECT source, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS t FROM documents) GROUP BY 1",
    "g17_ratios": "WITH d AS (SELECT lang, source, length(coalesce(text, '')) AS n FROM documents) SELECT lang, CAST(sum(CASE WHEN source = 'discharge_letter' THEN n ELSE 0 END) AS BIGINT) AS letters, CAST(sum(n) AS BIGINT) AS whole, CAST(sum(CASE WHEN source = 'discharge_letter' THEN n ELSE 0 END) AS DOUBLE) / nullif(sum(n), 0) AS share FROM d GROUP BY 1",
    "x2_missing_fields": "SELECT concat_ws(',', CASE WHEN value IS NULL THEN 'value' END, CASE WHEN unit IS NULL THEN 'unit' END, CASE WHEN clock IS NULL THEN 'clock' END, CASE WHEN project_name IS NULL THEN 'project_name' END) AS missing, count(*) AS records FROM record_view GROUP BY 1",
    "x3_evidence_refs": "WITH r AS (SELECT record_id, array_to_string(list_sort(list_distinct(list_filter([nullif(trim(project_ref), ''), nullif(trim(result_ref), ''), nullif(trim(unit_ref), ''), nullif(trim(collection_ref), ''), nullif(trim(report_ref), '')], lambda x: x IS NOT NULL))), ',') AS refs FROM record_view) SELECT record_id, max(coalesce(refs, '')) AS refs FROM r GROUP BY 1",
    "x5_key_difference": """SELECT DISTINCT case_token, 'left' AS side FROM record_view WHERE case_token IS NOT NULL AND case_token NOT IN (SELECT case_token FROM documents WHERE case_token IS NOT NULL)
UNION ALL SELECT DISTINCT case_token, 'right' FROM documents WHERE case_token IS NOT NULL AND case_token NOT IN (SELECT case_token FROM record_view WHERE case_token IS NOT NULL)""",
    "pred_supplied_fields": "SELECT case_token, bool_or(value IS NOT NULL) AS value, bool_or(unit IS NOT NULL) AS unit, bool_or(day_offset IS NOT NULL OR clock IS NOT NULL) AS time, bool_or(result_ref IS NOT NULL) AS source, bool_or(record_id IS NOT NULL) AS id FROM record_view GROUP BY 1",
    "pred_alias_channel": "SELECT CASE WHEN source LIKE 'disch%' THEN 'letter' WHEN source LIKE 'lab%' OR source LIKE 'ward%' THEN 'site' WHEN source IS NULL THEN 'none' ELSE 'other' END AS channel, count(*) AS documents FROM documents GROUP BY 1",
    "pred_plan_problems": """WITH p AS (SELECT project_ref, time_role, collection_day AS low, day_offset AS high, CASE WHEN batch_no % 2 = 0 THEN 'all' ELSE 'latest' END AS selection, case_token, lower(precision) AS missing FROM record_view),
c AS (SELECT unnest([CASE WHEN project_ref IS NULL THEN 'MISSING_PROJECT' END, CASE WHEN time_role IS NULL THEN 'MISSING_TIME_ROLE' END, CASE WHEN case_token IS NULL THEN 'MISSING_SCOPE' END, CASE WHEN missing IS NULL THEN 'MISSING_MISSING_POLICY' END,
  CASE WHEN low IS NULL THEN 'MISSING_WINDOW_FROM' END, CASE WHEN high IS NULL THEN 'MISSING_WINDOW_TO' END, CASE WHEN low > high THEN 'WINDOW_INVERTED' END,
  CASE WHEN time_role NOT IN ('collection', 'report', 'sampling') THEN 'INVALID_TIME_ROLE:' || time_role END, CASE WHEN missing NOT IN ('undetermined', 'ignore') THEN 'INVALID_MISSING_POLICY:' || missing END,
  CASE WHEN selection = 'all' AND (low IS NULL OR high IS NULL) THEN 'SELECTION_ALL_NEEDS_BOTH_BOUNDS' END, CASE WHEN selection = 'latest' AND low IS NULL AND high IS NULL THEN 'UNBOUNDED_SINGLE_SELECTION' END]) AS code FROM p)
SELECT code, count(*) AS plans FROM c WHERE code IS NOT NULL GROUP BY 1""",
    "f20_canonical_json": "SELECT DISTINCT CAST(json_object('batch_no', batch_no, 'case_token', case_token, 'record_id', record_id) AS VARCHAR) AS body FROM record_view",
    "f28_day_of_role": "SELECT case_token, count(coalesce(day_offset, report_day_offset)) AS dated, CAST(min(coalesce(day_offset, report_day_offset)) AS INTEGER) AS first_day, count(coalesce(clock, report_clock)) AS clocked FROM record_view GROUP BY 1",
    "f30_prompts": "SELECT DISTINCT record_id, 'Case ' || coalesce(case_token, 'none') || ': ' || coalesce(value, 'none') || ' of ' || coalesce(project_name, 'none') || ' on day ' || coalesce(CAST(day_offset AS VARCHAR), 'none') || '.' AS text FROM record_view",
}
