"""Questions over events, documents, orders and observations of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywise.operators import cohort as C
from daywise.sources.tables import table


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def d1_day_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.day_profile(_events(spark, sf_dir), ["user_id"], "ts").withColumn("busiest_day", F.col("busiest_day").cast("string"))


def d5_crowded_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.crowded_days(_events(spark, sf_dir), ["user_id"], "ts", 2)


def d6_night_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    return _events(spark, sf_dir).filter(second <= 6 * 3600).groupBy("event_type").agg(F.count(F.lit(1)).alias("night_events"))


def d7_longest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.longest_gaps(_events(spark, sf_dir), ["user_id"], "ts")


def d2_keyword_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.filter(F.contains("text", F.lit("day")) & F.col("created_at").isNotNull()).groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


def d8_value_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "record_view")
    number = F.trim("value").try_cast("double")
    return v.groupBy("case_token").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("project_name").alias("names"), F.count_if(F.col("value").rlike(r"\d\.\d")).alias("with_point"), F.count_if(number > 100).alias("above_100"), F.max(F.when(~F.isnan(number), number)).alias("largest"))


def d10_documents_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("case_token").agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("source").alias("sources"))


def d11_extreme_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_time = F.struct("ts", "event_id")
    e = _events(spark, sf_dir).groupBy("user_id").agg(F.min(by_time).alias("a"), F.max(by_time).alias("b"), F.max("value").alias("largest"))
    return e.select("user_id", F.col("a.event_id").alias("first_event"), F.col("b.event_id").alias("last_event"), "largest")


def d12_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "record_view").select("case_token").distinct()
    return cases.join(table(spark, sf_dir, "documents").select("case_token"), "case_token", "left_anti")


def d13_same_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.same_day(_events(spark, sf_dir), ["user_id"], "ts", F.col("event_type") == "click", F.col("event_type") == "purchase")


def d14_least_value_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = F.min(F.struct("value", F.to_date("ts").alias("day"))).alias("m")
    return _events(spark, sf_dir).filter("value is not null").groupBy("user_id").agg(least).select("user_id", F.col("m.value").alias("least"), F.col("m.day").cast("string").alias("least_day"))


def d15_outside_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.round(F.col("l_extendedprice") / F.col("l_quantity"), 4).alias("each"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    j = line.join(part, "l_partkey")
    return j.groupBy("p_brand").agg(F.count_if(F.col("each") > F.col("p_retailprice")).alias("above"), F.count_if(F.col("each") < F.col("p_retailprice")).alias("below"), F.count(F.lit(1)).alias("rows"))


def d16_cohort_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    letter = F.col("source") == "discharge_letter"
    return d.agg(F.count_distinct(F.when(F.contains("text", F.lit("window")), F.col("case_token"))).alias("cases_with_keyword"), F.count_if(letter).alias("letters"), F.count_distinct(F.when(letter, F.col("case_token"))).alias("cases_with_letter"))


def d17_spanning_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "layout_line").select("document_token", "line_index", "page_number", "text").distinct()
    return lines.groupBy("document_token", "text").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("page_number").alias("pages")).filter("pages > 1")


def d18_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sessions(_events(spark, sf_dir), ["user_id"], "ts", 6 * 3600)


def d20_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets at odds with themselves or with their submission."""
    s = table(spark, sf_dir, "review_template").dropDuplicates(["sheet_id"])
    o = table(spark, sf_dir, "unified_fixture_submission").groupBy("observation_id").agg(F.max("case_token").alias("own_case"))
    j = s.join(o, "observation_id", "left")
    return j.agg(F.count(F.lit(1)).alias("sheets"), F.count_if(F.col("own_case").isNull()).alias("unknown_observation"), F.count_if(F.col("own_case") != F.col("case_token")).alias("other_case"), F.count_if(F.upper("reviewer_a") == F.upper("reviewer_b")).alias("same_reviewer"), F.count_if((F.col("reviewer_a_judgment") == F.col("reviewer_b_judgment")) & (F.col("manual_judgment") != F.col("reviewer_a_judgment"))).alias("closed_against_both"))


def d21_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "review_template").dropDuplicates(["sheet_id"])
    label = lambda c: F.when(F.lower(F.trim(c)).isin("clear", "unclear", "needs_clinician"), F.lower(F.trim(c)))
    return C.label_agreement(s.select(label("reviewer_a_judgment").alias("a"), label("reviewer_b_judgment").alias("b")), "a", "b")


def d21_value_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("each"))
    j = line.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    out = C.value_errors(j, "each", "p_retailprice", 0.1)
    return out.select("rows", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "correlation", "within")])


def d21_rank_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") == "R").alias("returned"))
    return C.rank_auc(rows, "l_quantity", "returned")


def d22_ranked_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _events(spark, sf_dir).groupBy("event_type", "user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count(F.lit(1)).alias("rows"))
    return C.ranked_sample(per, ["event_type"], [F.col("days").desc(), F.col("rows").desc(), F.col("user_id")], 8)


QUERIES = {
    f.__name__: f
    for f in (d1_day_profile, d2_keyword_rows, d5_crowded_days, d6_night_events, d7_longest_gaps, d8_value_profile, d10_documents_per_case, d11_extreme_events, d12_absent, d13_same_day, d14_least_value_day, d15_outside_bounds, d16_cohort_counts, d17_spanning_keys, d18_sessions, d20_contradictions, d21_label_agreement, d21_value_errors, d21_rank_auc, d22_ranked_sample)
}

SHEETS = "sheets AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY locked_at) AS n FROM review_template) WHERE n = 1)"

ORACLE = {
    "d1_day_profile": """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, day) AS k FROM d)
SELECT user_id, count(*) AS days, CAST(max(day) - min(day) AS INTEGER) AS span_days, CAST(max(day) FILTER (WHERE k = 1) AS VARCHAR) AS busiest_day, max(n) FILTER (WHERE k = 1) AS busiest_rows FROM r GROUP BY 1""",
    "d2_keyword_rows": "SELECT source, count(*) AS documents FROM documents WHERE contains(text, 'day') AND created_at IS NOT NULL GROUP BY 1",
    "d5_crowded_days": "SELECT user_id, count(*) AS crowded_days FROM (SELECT user_id, CAST(ts AS DATE) AS day FROM events GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1",
    "d6_night_events": "SELECT event_type, count(*) AS night_events FROM events WHERE hour(ts) * 3600 + minute(ts) * 60 + second(ts) <= 21600 GROUP BY 1",
    "d7_longest_gaps": "SELECT user_id, count(*) AS \"rows\", max(gap) / 1e6 AS longest_gap_seconds FROM (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events) GROUP BY 1",
    "d8_value_profile": r"SELECT case_token, count(*) AS rows, count(DISTINCT project_name) AS names, count(*) FILTER (WHERE regexp_matches(value, '[0-9]\.[0-9]')) AS with_point, count(*) FILTER (WHERE TRY_CAST(trim(value) AS DOUBLE) > 100) AS above_100, max(TRY_CAST(trim(value) AS DOUBLE)) FILTER (WHERE NOT isnan(TRY_CAST(trim(value) AS DOUBLE))) AS largest FROM record_view GROUP BY 1",
    "d10_documents_per_case": "SELECT case_token, count(*) AS documents, count(DISTINCT source) AS sources FROM documents GROUP BY 1",
    "d11_extreme_events": "SELECT user_id, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event, max(value) AS largest FROM events GROUP BY 1",
    "d12_absent": "SELECT DISTINCT case_token FROM record_view WHERE case_token NOT IN (SELECT case_token FROM documents WHERE case_token IS NOT NULL)",
    "d13_same_day": "SELECT user_id, count(*) AS shared_days FROM (SELECT user_id, CAST(ts AS DATE) AS day FROM events GROUP BY 1, 2 HAVING bool_or(event_type = 'click') AND bool_or(event_type = 'purchase')) GROUP BY 1",
    "d14_least_value_day": "SELECT user_id, value AS least, CAST(day AS VARCHAR) AS least_day FROM (SELECT user_id, value, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id ORDER BY value, CAST(ts AS DATE)) AS n FROM events WHERE value IS NOT NULL) WHERE n = 1",
    "d15_outside_bounds": "SELECT p_brand, count(*) FILTER (WHERE each_ > p_retailprice) AS above, count(*) FILTER (WHERE each_ < p_retailprice) AS below, count(*) AS rows FROM (SELECT l_partkey, round(l_extendedprice / l_quantity, 4) AS each_ FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "d16_cohort_counts": "SELECT count(DISTINCT case_token) FILTER (WHERE contains(text, 'window')) AS cases_with_keyword, count(*) FILTER (WHERE source = 'discharge_letter') AS letters, count(DISTINCT case_token) FILTER (WHERE source = 'discharge_letter') AS cases_with_letter FROM documents",
    "d17_spanning_keys": "SELECT document_token, text, count(*) AS lines, count(DISTINCT page_number) AS pages FROM (SELECT DISTINCT document_token, line_index, page_number, text FROM layout_line) GROUP BY 1, 2 HAVING count(DISTINCT page_number) > 1",
    "d18_sessions": """WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before_ FROM events), n AS (SELECT *, sum(CASE WHEN before_ IS NULL OR epoch_us(ts) - epoch_us(before_) > 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, CAST(s AS INTEGER) AS session_no, min(ts) AS started, max(ts) AS ended, count(*) AS rows FROM n GROUP BY 1, 2""",
    "d20_contradictions": f"""WITH {SHEETS}, o AS (SELECT observation_id, max(case_token) AS own_case FROM unified_fixture_submission GROUP BY 1)
SELECT count(*) AS sheets, count(*) FILTER (WHERE own_case IS NULL) AS unknown_observation, count(*) FILTER (WHERE own_case <> case_token) AS other_case, count(*) FILTER (WHERE upper(reviewer_a) = upper(reviewer_b)) AS same_reviewer,
  count(*) FILTER (WHERE reviewer_a_judgment = reviewer_b_judgment AND manual_judgment <> reviewer_a_judgment) AS closed_against_both FROM sheets LEFT JOIN o ON sheets.observation_id = o.observation_id""",
    "d21_label_agreement": f"""WITH {SHEETS}, p AS (SELECT lower(trim(reviewer_a_judgment)) AS l, lower(trim(reviewer_b_judgment)) AS r FROM sheets WHERE lower(trim(reviewer_a_judgment)) IN ('clear', 'unclear', 'needs_clinician') AND lower(trim(reviewer_b_judgment)) IN ('clear', 'unclear', 'needs_clinician')),
k AS (SELECT l AS label FROM p UNION SELECT r FROM p), c AS (SELECT label, (SELECT count(*) FROM p WHERE l = label) AS nl, (SELECT count(*) FROM p WHERE r = label) AS nr, (SELECT count(*) FROM p WHERE l = label AND r = label) AS tp FROM k),
w AS (SELECT CAST(sum(nl) AS DOUBLE) AS n, CAST(sum(tp) AS DOUBLE) AS hits, avg(2.0 * tp / (nl + nr)) AS macro_f1, sum(CAST(nl AS DOUBLE) * nr) AS chance FROM c)
SELECT CAST(n AS BIGINT) AS rows, hits / n AS accuracy, macro_f1, (hits / n - chance / (n * n)) / (1 - chance / (n * n)) AS kappa FROM w""",
    "d21_value_errors": "SELECT count(*) AS rows, round(avg(abs(x - y)), 6) AS mae, round(sqrt(avg((x - y) * (x - y))), 6) AS rmse, round(corr(x, y), 6) AS correlation, round(avg(CASE WHEN abs(x - y) <= 0.1 * abs(y) THEN 1.0 ELSE 0.0 END), 6) AS within FROM (SELECT l_extendedprice / l_quantity AS x, p_retailprice AS y FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "d21_rank_auc": """WITH s AS (SELECT l_quantity AS s, count(*) FILTER (WHERE l_returnflag = 'R') AS p, count(*) FILTER (WHERE l_returnflag <> 'R') AS q FROM lineitem GROUP BY 1),
c AS (SELECT *, coalesce(sum(q) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives, CAST(sum(p * (below + q / 2.0)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * CAST(sum(q) AS DOUBLE)) AS auc FROM c""",
    "d22_ranked_sample": "SELECT event_type, user_id, days, rows, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY days DESC, rows DESC, user_id) AS place FROM (SELECT event_type, user_id, count(DISTINCT CAST(ts AS DATE)) AS days, count(*) AS rows FROM events GROUP BY 1, 2)) WHERE place <= 8",
}
