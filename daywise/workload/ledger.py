"""Job grids, ledgers and budgets over review_template and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywise.operators import ledger as B
from daywise.sources.tables import table

ARMS = ("reviewer_a", "reviewer_b", "adjudicator")
NONE = ("", "not_started")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "review_template").select(F.col("observation_id").alias("task_id")).distinct()
    return B.job_grid(tasks, ARMS)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ledger row per sheet and arm; copies of a sheet count once."""
    sheets = table(spark, sf_dir, "review_template").dropDuplicates(["sheet_id"])
    given = (("reviewer_a", "reviewer_a", "reviewer_a_judgment"), ("reviewer_b", "reviewer_b", "reviewer_b_judgment"), ("adjudicator", "adjudicator", "adjudication"))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.upper(F.trim(w)).alias("who"), F.lower(F.trim(j)).alias("label")) for a, w, j in given])).alias("g")
    return sheets.select("sheet_id", F.col("observation_id").alias("task_id"), F.lower(F.trim("manual_judgment")).alias("closed"), each).select("sheet_id", "task_id", "closed", "g.*")


def _given() -> F.Column:
    return F.col("label").isNotNull() & ~F.col("label").isin(*NONE)


def j17_job_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir)


def j16_open_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.open_jobs(_grid(spark, sf_dir), _rows(spark, sf_dir).filter(_given()))


def j18_recovered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    saved = rows.filter(F.col("closed").isNotNull()).groupBy("task_id", "arm").agg(F.count(F.lit(1)).alias("attempt"))
    return B.recovered_rows(_grid(spark, sf_dir), rows.filter(_given()), saved)


def c17_next_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run as a whole: the grid, less what the ledger has, as far as each arm's budget goes."""
    jobs = B.open_jobs(_grid(spark, sf_dir), _rows(spark, sf_dir).filter(_given())).withColumn("cost", F.when(F.col("arm") == "adjudicator", 5).otherwise(3))
    return B.within_budget(jobs, ["arm"], [F.col("task_id")], "cost", 500).select("task_id", "arm", "cost", F.col("spent").cast("long").alias("spent"))


def g4_arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.arm_summary(_rows(spark, sf_dir), ["arm"], _given(), F.col("label") == F.col("closed"))


def g5_label_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.label_histograms(_rows(spark, sf_dir).filter("who is not null"), ["who"], F.col("label"))


def pred_failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir)
    kind = B.failure_class(F.col("who").isNotNull(), _given(), F.col("label") == F.col("closed"))
    return rows.groupBy("arm", kind.alias("failure_class")).agg(F.count(F.lit(1)).alias("jobs"))


def pred_reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = table(spark, sf_dir, "review_template").dropDuplicates(["sheet_id"])
    codes = B.reason_codes([("NO_REVIEWER", F.col("reviewer_a").isNull() | F.col("reviewer_b").isNull()), ("SAME_REVIEWER", F.upper(F.trim("reviewer_a")) == F.upper(F.trim("reviewer_b"))), ("NO_VALUE", F.col("value").isNull() | (F.trim("value") == "")), ("NO_UNIT", F.col("unit").isNull() | (F.trim("unit") == "")), ("RULING_WITHOUT_ADJUDICATOR", F.col("adjudication").isNotNull() & F.col("adjudicator").isNull()), ("SOURCE_UNSUPPORTED", F.col("source_support_status") != "supported")])
    return sheets.select("sheet_id", F.array_join(codes, ",").alias("reasons"), (F.size(codes) == 0).alias("allowed"))


def w6_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    kept = B.within_budget(jobs, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "cents", 50_000_000)
    return kept.select("o_custkey", "o_orderkey", "cents", F.col("spent").cast("long").alias("spent"))


def g13_context_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.context_estimate(table(spark, sf_dir, "documents"), "text")


QUERIES = {f.__name__: f for f in (j17_job_grid, j16_open_jobs, j18_recovered_rows, c17_next_jobs, g4_arm_summary, g5_label_histograms, pred_failure_class, pred_reason_codes, w6_within_budget, g13_context_estimate)}

GRID = "grid AS (SELECT DISTINCT observation_id AS task_id, arm FROM review_template, (VALUES ('reviewer_a'), ('reviewer_b'), ('adjudicator')) v(arm))"
ROWS = """sheets AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet_id ORDER BY locked_at) AS n FROM review_template) WHERE n = 1),
led AS (SELECT sheet_id, observation_id AS task_id, lower(trim(manual_judgment)) AS closed, 'reviewer_a' AS arm, upper(trim(reviewer_a)) AS who, lower(trim(reviewer_a_judgment)) AS label FROM sheets
  UNION ALL SELECT sheet_id, observation_id, lower(trim(manual_judgment)), 'reviewer_b', upper(trim(reviewer_b)), lower(trim(reviewer_b_judgment)) FROM sheets
  UNION ALL SELECT sheet_id, observation_id, lower(trim(manual_judgment)), 'adjudicator', upper(trim(adjudicator)), lower(trim(adjudication)) FROM sheets)"""
GIVEN = "label IS NOT NULL AND label NOT IN ('', 'not_started')"

ORACLE = {
    "j17_job_grid": f"WITH {GRID} SELECT task_id, arm FROM grid",
    "j16_open_jobs": f"WITH {GRID}, {ROWS} SELECT task_id, arm FROM grid EXCEPT SELECT task_id, arm FROM led WHERE {GIVEN}",
    "j18_recovered_rows": f"""WITH {GRID}, {ROWS}, o AS (SELECT task_id, arm FROM grid EXCEPT SELECT task_id, arm FROM led WHERE {GIVEN})
SELECT o.task_id, o.arm, count(*) AS attempts FROM o JOIN led ON o.task_id = led.task_id AND o.arm = led.arm WHERE closed IS NOT NULL GROUP BY 1, 2""",
    "c17_next_jobs": f"""WITH {GRID}, {ROWS}, o AS (SELECT task_id, arm, CASE WHEN arm = 'adjudicator' THEN 5 ELSE 3 END AS cost FROM (SELECT task_id, arm FROM grid EXCEPT SELECT task_id, arm FROM led WHERE {GIVEN})),
s AS (SELECT *, sum(cost) OVER (PARTITION BY arm ORDER BY task_id ROWS UNBOUNDED PRECEDING) AS used FROM o)
SELECT task_id, arm, cost, CAST(used - cost AS BIGINT) AS spent FROM s WHERE used <= 500""",
    "g4_arm_summary": f"WITH {ROWS} SELECT arm, count(*) AS jobs, count(*) FILTER (WHERE {GIVEN}) AS done, count(*) FILTER (WHERE {GIVEN} AND label = closed) AS \"right\", CAST(count(*) FILTER (WHERE {GIVEN} AND label = closed) AS DOUBLE) / NULLIF(count(*) FILTER (WHERE {GIVEN}), 0) AS success_share FROM led GROUP BY 1",
    "g5_label_histograms": f"WITH {ROWS}, c AS (SELECT who, coalesce(label, 'none') AS label, count(*) AS n FROM led WHERE who IS NOT NULL GROUP BY 1, 2) SELECT who, CAST(sum(n) AS BIGINT) AS \"rows\", string_agg(label || '=' || n, ';' ORDER BY label) AS histogram FROM c GROUP BY 1",
    "pred_failure_class": f"WITH {ROWS} SELECT arm, CASE WHEN who IS NULL THEN 'service' WHEN NOT ({GIVEN}) THEN 'format' WHEN NOT coalesce(label = closed, FALSE) THEN 'content' ELSE 'none' END AS failure_class, count(*) AS jobs FROM led GROUP BY 1, 2",
    "pred_reason_codes": f"""WITH {ROWS}, c AS (SELECT sheet_id, concat_ws(',', CASE WHEN reviewer_a IS NULL OR reviewer_b IS NULL THEN 'NO_REVIEWER' END, CASE WHEN upper(trim(reviewer_a)) = upper(trim(reviewer_b)) THEN 'SAME_REVIEWER' END,
  CASE WHEN value IS NULL OR trim(value) = '' THEN 'NO_VALUE' END, CASE WHEN unit IS NULL OR trim(unit) = '' THEN 'NO_UNIT' END, CASE WHEN adjudication IS NOT NULL AND adjudicator IS NULL THEN 'RULING_WITHOUT_ADJUDICATOR' END,
  CASE WHEN source_support_status <> 'supported' THEN 'SOURCE_UNSUPPORTED' END) AS reasons FROM sheets) SELECT sheet_id, reasons, reasons = '' AS allowed FROM c""",
    "w6_within_budget": """WITH j AS (SELECT o_custkey, o_orderkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
s AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM j)
SELECT o_custkey, o_orderkey, cents, used - cents AS spent FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.o_custkey = a.o_custkey AND (b.o_orderdate, b.o_orderkey) <= (a.o_orderdate, a.o_orderkey) AND b.used > 50000000)""",
    "g13_context_estimate": "SELECT CAST(floor(avg(length(coalesce(text, '')))) AS BIGINT) AS mean_chars, CAST(floor(sum(length(coalesce(text, ''))) / 4.0) AS BIGINT) AS tokens FROM documents",
}
