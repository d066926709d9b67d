from pyspark.sql import functions as F

from daywise.operators import layout as L
from daywise.operators import questions as Q

LINES = "document_token string, page_number int, line_index int, text string"


def found(spark, *texts, pages=None):
    rows = [("d", (pages or {}).get(i, 1), i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:1], LINES).withColumn("bbox", F.lit(None).cast("array<array<double>>")).withColumn("at", F.lit("clash")).withColumn("result", F.lit("clash"))
    return sorted(L.measurements(df).collect(), key=lambda r: r.line_index)


def test_value_unit_range_and_times(spark):
    (r,) = found(spark, "采集时间 2025-01-05 08:30", "血红蛋白", "(HGB)", "120-160", "12.5", "", "g / dL", "11,5 - 16,0", "报告时间：2025年1月6日")
    assert (r.project_ref, r.result_ref, r.value, r.unit, r.unit_ref, r.reference_interval, r.value_g_l) == (1, 4, 12.5, "g/dL", 6, "11,5 - 16,0", 125.0)
    assert (r.collection_ref, r.collection_precision, r.report_ref, r.report_precision) == (0, "minute", 8, "day") and str(r.collection_time) == "2025-01-05 08:30:00"
    assert r.binding_status == r.identity_status == "explicit" and len(r.record_id) == 16 and r.source_refs == [1, 4, 6, 7, 0, 8]


def test_a_range_before_any_unit_ends_the_search(spark):
    (r,) = found(spark, "Hemoglobin", "125", "120-160", "g/L")
    assert (r.value, r.unit, r.reference_interval, r.binding_status) == (125.0, None, "120-160", "unresolved")
    (r,) = found(spark, "Hemoglobin (Hb)", "125 g/L", "120-160", "g/dL")
    assert (r.unit, r.unit_ref, r.reference_ref) == ("g/L", 1, 2)


def test_starts_reach_and_pages(spark):
    rows = found(spark, "HGB 3", "Glycated Hemoglobin", "糖化血红蛋白", "hemoglobin", *["-"] * 5, "7.1", "hemoglobin", "1", pages={11: 2})
    assert [(r.line_index, r.identity_status, r.value) for r in rows] == [(0, "invalid_task", None), (3, "explicit", 7.1), (10, "explicit", None)]
    assert [(r.line_index, r.value) for r in found(spark, "hemoglobin", *["-"] * 6, "7.1")] == [(0, None)]
    (r,) = found(spark, "collected 2025-01-01", "hemoglobin", "collected 5", "8", "collected 2025-02-30", "collected 2025-03-01")
    assert (r.value, r.collection_ref) == (8.0, 5)
    assert found(spark, None, "") == [] and L.measurements(spark.createDataFrame([], LINES).withColumn("bbox", F.lit(None).cast("array<array<double>>"))).count() == 0


def test_pairs_ladders_and_timelines(spark):
    rows = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", None), (2, "b", True), (3, "a", True), (3, "b", True), (4, "a", False), (4, "b", False), (5, "a", True), (1, "a", True)], "task int, arm string, ok boolean")
    assert tuple(Q.paired_outcomes(rows, ["task"], "arm", F.col("ok"), "a", "b").first()) == (1, 1, 1, 1) and tuple(Q.paired_outcomes(rows.limit(0), ["task"], "arm", F.col("ok"), "a", "b").first()) == (0, 0, 0, 0)
    df = spark.createDataFrame([(1, 1, 1), (1, 1, None), (1, None, 1), (None, 1, 1)], "x int, y int, z int")
    kept = {r.layer: r.kept for r in Q.ladder(df, {c: F.col(c).isNotNull() for c in "xyz"}).collect()}
    assert kept == {"x": 3, "y": 2, "z": 1, "minus_x": 2, "minus_y": 2, "minus_z": 2}
    r = spark.createDataFrame([("A", 1, 5), ("A", 1, 5), ("A", 1, None), ("A", 4, None), ("A", 9, None), ("A", None, 3), (None, 2, 1), ("B", 2, None)], "case_token string, day int, second int")
    tasks = {(t.case_token, t.family): (t.low, t.high) for t in Q.task_families(r).collect()}
    assert tasks["A", "gap"] == (4, 9) and tasks["A", "tie_day"] == (1, 1) and tasks["A", "busiest_day"] == (1, 1) and tasks["A", "after_last"] == (9, None) and ("B", "gap") not in tasks and ("B", "tie_day") not in tasks and len(tasks) == 10
    line = {t.case_token: t for t in Q.case_timeline(r, F.col("second") == 5).collect()}
    assert (line["A"].span, line["A"].active_days, line["A"].shared_days, line["A"].undated) == (8, 3, 1, 1) and tuple(Q.cohort_of(Q.case_timeline(r, F.lit(True)), 5).first()) == (3, 1, 5, 0)


def test_bootstrap_and_keys(spark):
    groups = spark.createDataFrame([(f"c{i}", float(i % 5), 5.0) for i in range(300)] + [(None, 9.0, 1.0)], "c string, t double, n double")
    means = Q.resampled(groups, "c", "t", "n", replicates=100, seed="x")
    r = Q.interval(means, "mean").first()
    assert r.low < 0.4 < r.high and abs(r.middle - 0.4) < 0.02 and means.count() == 100 and sorted(means.collect()) == sorted(Q.resampled(groups.repartition(7), "c", "t", "n", replicates=100, seed="x").collect())
    a, b = (spark.createDataFrame([(x,) for x in xs], "k string") for xs in (["x", "y", "y", None], ["y", "z", None]))
    assert sorted(tuple(r) for r in Q.key_difference(a, b, "k").collect()) == [("x", "left"), ("z", "right")]
    assert Q.repeated_keys(a, ["k"]).first().copies == 2 and Q.stability(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("a", None)], "k string, v double"), ["k"], F.col("v")).collect() == [("a", 2, 1.0, 3.0, 2.0)]
    d = spark.createDataFrame([(True, 9, 10, True), (True, 8, 10, True), (True, None, 10, True), (False, 10, 10, True), (True, 10, 10, None)], "p boolean, r int, t int, c boolean")
    assert [r[0] for r in d.select(Q.completed(F.col("p"), F.col("r"), F.col("t"), F.col("c"))).collect()] == [True, False, False, False, False]


def test_rank_auc_in_any_scale(spark):
    from daywise.operators.cohort import rank_auc

    rows = [((i * 37 % 1000) / (1000.0 if unit else 1.0), i % 3 == 0) for unit in (0,) for i in range(2000)]
    small = [(s / 1000, p) for s, p in rows]
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    for data in (rows, small, [(1.0, True), (1.0, False), (None, True)]):
        got = rank_auc(spark.createDataFrame(data, "s double, p boolean"), "s", "p").first()
        assert abs(got.auc - (want if len(data) > 3 else 0.5)) < 1e-9
    assert rank_auc(spark.createDataFrame([], "s double, p boolean"), "s", "p").first().auc is None
