import datetime as dt

import pytest
from pyspark.sql import functions as F

from daywise.operators import cohort as C
from daywise.operators import layout as L
from daywise.operators import ledger as B
from daywise.operators import retrieval as R

LINE = "document_token string, line_index int, page_number int, text string, bbox array<array<double>>, confidence double, case_token string"


def box(y, x=10.0, h=10.0):
    y = float(y)
    x = float(x)
    return [[x, y], [x + 50, y], [x + 50, y + h], [x, y + h]]


def lines(spark, texts, pages=None, boxes=None):
    rows = [("d", i, (pages or [1] * len(texts))[i], t, (boxes or [box(20.0 * j) for j in range(len(texts))])[i], 0.9, "A") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:1], LINE).withColumn("n", F.lit("clash")).withColumn("top", F.lit(1))


def test_table_rows_and_cells(spark):
    df = lines(spark, ["Albumin", "119", "g/L", "40-220", "Kalium", "4,5", "note", None, "", "CRP", "x"])
    got = {r.name: (r.value, r.unit, r.low, r.high, r.missing) for r in L.table_rows(df).collect()}
    assert got == {"Albumin": (119.0, "g/L", 40.0, 220.0, ""), "Kalium": (4.5, None, None, None, "unit,range")}
    cells = {r.line_index: (r.value_text, r.value_numeric, r.unit) for r in L.line_cells(lines(spark, ["a 3 then <4.2 mmol/L 9", "7 8", "none"])).collect()}
    assert cells == {0: ("<4.2", None, "mmol/L"), 1: ("8", 8.0, None)}


def test_table_rows_reach_six_lines(spark):
    texts = ["Albumin", "(serum)", "119", "*", "H", "g/L", "40-220", "Kalium", "4,5", "*", "H", "mmol/L", "*", "3,5-5,1", "CRP", "mg/L", "*", "*", "*", "*", "*", "7", "Urea", "8"]
    got = {r.name: (r.value, r.unit, r.low, r.high, r.missing) for r in L.table_rows(lines(spark, texts, pages=[1] * 23 + [2])).collect()}
    assert got["Albumin"] == (119.0, "g/L", 40.0, 220.0, "")
    assert got["Kalium"] == (4.5, "mmol/L", 3.5, 5.1, "")
    assert "CRP" not in got and got["Urea"] == (8.0, None, None, None, "unit,range")


def test_bands_merge_chains(spark):
    df = lines(spark, ["a", "b", "c", "d"], boxes=[box(0), box(12, x=5), box(25), [[float("nan"), 1.0]]])
    assert sorted((r.band_no, r.line_index) for r in L.bands(df).collect()) == [(1, 0), (1, 1), (1, 2)]
    assert sorted((r.band_no, r.line_index) for r in L.bands(df, tolerance=1.0).collect()) == [(1, 0), (2, 1), (3, 2)]
    assert L.band_texts(df).first().text == "b a c"


def test_structure(spark):
    df = lines(spark, ["a", "b", "c"], pages=[2, 1, 4], boxes=[box(0), [], box(1)])
    assert sorted((r.line_index, r.code) for r in L.structure_violations(df).collect()) == [(0, "DUPLICATE_LINE"), (1, "BBOX_INVALID"), (1, "PAGE_DECREASES"), (2, "PAGE_SKIPPED")]
    r = L.alignment_audit(df, df.filter("line_index > 0")).first()
    assert (r.aligned, r.moved, r.left_only, r.right_only) == (2, 0, 1, 0)


def test_scopes(spark):
    rows = spark.createDataFrame([("d", 1, "r1", 5.0), ("d", 1, "r2", 30.0), ("d", 1, "r3", 50.0), ("d", 2, "r4", 99.0)], "document_token string, page_number int, row_id string, top double")
    headers = spark.createDataFrame([("d", 1, "h1", 10.0), ("d", 1, "h2", 40.0), ("d", 1, "h3", 40.0)], "document_token string, page_number int, header_id string, top double")
    assert {r.row_id: (r.header_id, r.binding) for r in L.header_in_scope(rows, headers).collect()} == {"r1": (None, "none"), "r2": ("h1", "explicit"), "r3": (None, "tie"), "r4": (None, "none")}
    r = spark.createDataFrame([("d", 3), ("d", 9), ("e", 1)], "document_token string, row_index int")
    m = spark.createDataFrame([("d", 1), ("d", 5)], "document_token string, mark_index int")
    assert {(x.document_token, x.row_index): x.mark_index for x in L.preferred_role(r, m).collect()} == {("d", 3): 5, ("d", 9): 5, ("e", 1): None}


def test_days(spark):
    df = lines(spark, ["on day 5 and day 9", "3.2", "Tag 7", "第2日"])
    assert {(r.line_index, r.ordinal): r.day for r in L.day_candidates(df).collect()} == {(0, 0): 5, (0, 1): 9, (2, 0): 7, (3, 0): 2}
    assert [r.days for r in L.nearest_marked(df).collect()] == [[5, 7]]
    c = L.case_coordinates(df).first()
    assert (c.origin_day, c.documents, c.candidates) == (2, 1, 4) and c.coordinate_id.startswith("day0-")


def test_retrieval(spark):
    df = lines(spark, ["Albumin high", "x", "y", "albumin", "z"], pages=[1, 2, 3, 4, 5])
    assert [(r.page_number, r.chosen_as) for r in R.retrieve_pages(df, "albumin").orderBy("page_number").collect()] == [(1, "hit"), (2, "adjacent"), (3, "adjacent"), (4, "hit"), (5, "adjacent")]
    assert [r.page_number for r in R.retrieve_pages(df, "nothing").collect()] == [1]
    assert [r.page_number for r in R.retrieve_pages(df, "albumin", max_pages=1, adjacent=False).collect()] == [1]
    assert [r.line_index for r in R.retrieve_lines(df, "zz", top_k=2).orderBy("line_index").collect()] == [3, 4]
    every = df.filter("trim(text) <> ''").select("document_token", "line_index").distinct().count()
    assert R.retrieve_lines(df, "§", top_k=2).count() == R.retrieve_lines(df, "Ж", top_k=2).count() == every


def test_budget_and_ledger(spark):
    jobs = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), ("a", 3, 0), ("b", 1, None), ("b", 2, 99), ("b", 3, 1)], "k string, i int, cost int")
    got = sorted((r.k, r.i, r.spent) for r in B.within_budget(jobs, ["k"], [F.col("i")], "cost", 10).collect())
    assert got == [("a", 1, 0), ("b", 1, 0)]  # a job that would exceed the budget is not run
    got = sorted((r.k, r.i, r.spent) for r in B.within_budget(jobs, ["k"], [F.col("i")], "cost", 11).collect())
    assert got == [("a", 1, 0), ("a", 2, 5), ("a", 3, 11), ("b", 1, 0)]
    grid = B.job_grid(spark.createDataFrame([("t",), ("u",)], "task_id string"), ["x", "y"])
    done = spark.createDataFrame([("t", "x")], "task_id string, arm string")
    assert B.open_jobs(grid, done).count() == 3
    saved = spark.createDataFrame([("t", "x", 1), ("u", "y", 1), ("u", "y", 2)], "task_id string, arm string, attempt int")
    assert [(r.task_id, r.attempts) for r in B.recovered_rows(grid, done, saved).collect()] == [("u", 2)]


def test_cohort(spark):
    t = lambda d, h=0, m=0: dt.datetime(2025, 1, d, h, m)
    df = spark.createDataFrame([("a", t(1)), ("a", t(1, 5)), ("a", t(1, 5)), ("a", t(4)), ("b", t(2)), ("b", None)], "k string, at timestamp_ntz")
    p = {r.k: (r.days, r.span_days, r.busiest_rows) for r in C.day_profile(df, ["k"], "at").collect()}
    assert p == {"a": (2, 3, 3), "b": (1, 0, 1)}
    assert {r.k: r.longest_gap_seconds for r in C.longest_gaps(df, ["k"], "at").collect()} == {"a": 67 * 3600.0, "b": None}
    assert sorted((r.k, r.session_no, r["rows"]) for r in C.sessions(df, ["k"], "at", 6 * 3600).collect()) == [("a", 1, 3), ("a", 2, 1), ("b", 1, 1)]
    labels = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), (None, "y")], "a string, b string")
    r = C.label_agreement(labels, "a", "b").first()
    assert (r["rows"], round(r.accuracy, 4), round(r.kappa, 4)) == (3, 0.6667, 0.4)
    scores = spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False), (3.5, True), (None, True)], "s double, p boolean")
    assert C.rank_auc(scores, "s", "p").first().auc == pytest.approx(0.875)
    assert C.label_agreement(labels.limit(0), "a", "b").count() == 0
