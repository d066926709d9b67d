import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daywise.operators import selection as S
from daywise.plans.selection import PlanError, SelectionPlan, anchored_plans, checked_contract, composed, plan_problems, short_plan_problems
from daywise.plans.window import DayWindow

TIMES = "map<string,struct<day:int,clock:string,precision:string>>"
RECORDS = f"record_id string, case_token string, times {TIMES}, value string, unit string, identity_status string"


def record(rid, day, clock=None, precision="day", role="collection", case="A", value="1", unit="g/L", identity="explicit"):
    return (rid, case, {role: (day, clock, precision)} if role else {}, value, unit, identity)


def run(spark, rows, plan):
    records = spark.createDataFrame(rows, RECORDS)
    tasks = S.plan_tasks(spark.createDataFrame([("A",)], "case_token string"), plan)
    a, b = S.select_records(records, tasks), S.reference_outcomes(records, tasks)
    assert S.compare_outcomes(a, b).filter("not (same_status and same_selected and same_candidates)").count() == 0
    r = a.first()
    return r.status, r.selected, r.candidates, r.reason


LATEST5 = SelectionPlan("collection", DayWindow(None, 5, False, True), "latest")
CASES = [
    ([record("a", 5, "08:30", "second"), record("b", 5, "08:30", "second")], LATEST5, ("undetermined", [], ["a", "b"], "SAME_DAY_IDENTICAL_TIMESTAMP")),
    ([record("a", 5, "08:30", "minute"), record("b", 5)], LATEST5, ("undetermined", [], ["b", "a"], "SAME_DAY_CLOCK_UNKNOWN_FOR_SOME_RECORDS")),
    ([record("a", 5, "00:00:00", "day"), record("b", 5, "00:00:00", "date")], LATEST5, ("undetermined", [], ["a", "b"], "SAME_DAY_CLOCK_UNKNOWN_FOR_ALL_RECORDS")),
    ([record("a", 1, role="report")], LATEST5, ("unsupported_time_role", [], [], "NO_RECORD_CARRIES_TIME_ROLE:collection")),
    ([record("a", 1)], SelectionPlan("collection", DayWindow(6, 8, True, True), "all"), ("empty", [], [], "NO_ELIGIBLE_RECORD")),
    ([record("a", 39, value=None)], SelectionPlan("collection", DayWindow(38, 40, True, True), "all"), ("undetermined", [], [], "NO_ELIGIBLE_RECORD")),
    ([record("a", 1, value=None)], SelectionPlan("collection", DayWindow(38, 40, True, True), "all"), ("empty", [], [], "NO_ELIGIBLE_RECORD")),
    ([record("a", 0), record("b", 4)], SelectionPlan("collection", DayWindow(0, None, False, False), "first"), ("ok", ["b"], [], None)),
    ([record("a", 5, "08:00", "minute"), record("b", 5, "09:00", "minute"), record("c", 5, "09:00", "minute")], LATEST5, ("undetermined", [], ["b", "c"], "SAME_DAY_IDENTICAL_TIMESTAMP")),
    ([record("a", 5, "08:00", "minute"), record("b", 5, "09:00", "minute")], LATEST5, ("ok", ["b"], [], None)),
    ([record("a", None), record("b", 2, identity="conflicting"), record("c", 1)], LATEST5, ("ok", ["c"], [], None)),
    ([record("a", 3, "09:00", "minute"), record("b", 3), record("c", 2)], SelectionPlan("collection", DayWindow(0, 9, True, True), "all"), ("ok", ["c", "a", "b"], [], None)),
    ([record("a", 5), record("b", 5)], SelectionPlan("collection", DayWindow(None, 5, False, True), "latest", "all_ties"), ("ok", ["a", "b"], [], "TIE_RETURNED_ALL")),
]


@pytest.mark.parametrize("rows, plan, want", CASES)
def test_outcomes(spark, rows, plan, want):
    status, selected, candidates, reason = run(spark, rows, plan)
    assert (status, selected, sorted(candidates), reason) == (want[0], want[1], sorted(want[2]), want[3])


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from([None, "08:00", "09:00", "bad"]), st.sampled_from(["minute", "day", None]), st.sampled_from(["1", None]), st.sampled_from(["collection", "report", None])), max_size=8), st.sampled_from(["first", "latest", "all"]), st.booleans())
def test_two_definitions_agree(spark, rows, selection, include):
    records = [record(f"r{i}", d, c, p, role=role, value=v) for i, (d, c, p, v, role) in enumerate(rows)]
    run(spark, records, SelectionPlan("collection", DayWindow(1, 3, include, not include), selection))


def test_window_variants(spark):
    df = spark.createDataFrame([(d,) for d in (None, 1, 2, 3)], "d int")
    inside = lambda w: [r.d for r in df.filter(w.contains(F.col("d"))).collect()]
    assert inside(DayWindow(1, 3)) == [2] and inside(DayWindow(1, 3, True, True)) == [1, 2, 3] and inside(DayWindow()) == [1, 2, 3]
    assert inside(DayWindow.up_to(2, high=9)) == [1, 2] and inside(DayWindow.up_to(None, low=1, high=3)) == [2, 3]


def test_plan_codes():
    window = {"from": 1, "to": 2, "include_from": True, "include_to": True}
    plan = {"project": "x", "time_role": "collection", "window": window, "selection": "all", "scope": "A", "tie_policy": "undetermined", "missing_policy": "undetermined"}
    assert plan_problems(plan) == [] and SelectionPlan.of(plan).window == DayWindow(1, 2, True, True)
    assert plan_problems(3) == ["PLAN_NOT_AN_OBJECT"]
    assert "MISSING_SCOPE" in plan_problems({**plan, "scope": None})
    assert plan_problems({**plan, "window": {**window, "from": 9}}) == ["WINDOW_INVERTED"]
    assert plan_problems({**plan, "window": {**window, "from": True}}) == ["WINDOW_FROM_NOT_INTEGER"]
    assert plan_problems({**plan, "time_role": "x"}) == ["INVALID_TIME_ROLE:x"]
    assert plan_problems({**plan, "window": {**window, "to": None}}) == ["SELECTION_ALL_NEEDS_BOTH_BOUNDS"]
    assert short_plan_problems(None) == ["plan_missing"] and short_plan_problems({"project": " ", "time_role": "x", "selection": "y", "cutoff_day": True, "z": 1}) == ["plan_unexpected_keys:z", "plan_bad_project", "plan_bad_time_role", "plan_bad_selection", "plan_bad_cutoff"]
    assert composed({"project": "a"}, {"project": "b", "selection": "all", "other": 1}) == {"project": "a", "selection": "all"}
    assert composed({"project": None, "selection": "first"}, {"project": "b", "selection": "all"}) == {"project": "b", "selection": "all"}
    assert composed({"scope": "A", "selection": "first"}, None) == {"scope": "A", "selection": "first"}
    assert set(anchored_plans(5)) == {"latest_at_or_before", "first_after", "all_within"}
    with pytest.raises(PlanError):
        SelectionPlan.of({})
    assert checked_contract({}) is None
    with pytest.raises(PlanError, match="CONTRACT_MISSING_SOURCE_MODE"):
        checked_contract({"contract": {"required_fields": [], "display_precision": "day"}})


PLANS = [
    None, "x", "[1]", {}, {"project": "x", "time_role": "y", "window": 3, "selection": "all", "scope": "A", "tie_policy": "z", "missing_policy": None},
    {"project": "x", "time_role": "report", "window": {"from": 9, "to": 2, "include_from": True}, "selection": "all", "scope": "A", "tie_policy": "undetermined", "missing_policy": "ignore"},
    {"project": "x", "time_role": "report", "window": {"from": True, "to": 2.5}, "selection": "first", "scope": "A", "tie_policy": "undetermined", "missing_policy": "ignore"},
    {"project": "x", "time_role": "report", "window": {"from": None, "to": None, "include_from": True, "include_to": False}, "selection": "latest", "scope": "A", "tie_policy": "undetermined", "missing_policy": "ignore"},
    {"project": " ", "time_role": "x", "selection": "y", "cutoff_day": True, "z": 1}, {"project": "p", "time_role": "report", "selection": "earliest", "cutoff_day": None},
]


def test_a_table_of_plans_gets_the_codes_of_each_plan(spark):
    import json

    from daywise.plans.selection import SHORT_RULES, with_problem_codes

    texts = [p if p is None or isinstance(p, str) else json.dumps(p) for p in PLANS]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, plan string")
    got = {r.i: (r.a, r.b) for r in with_problem_codes(with_problem_codes(df, "plan", out="a"), "plan", SHORT_RULES, "b").collect()}
    for i, p in enumerate(PLANS):
        whole = p if isinstance(p, dict) else None
        assert got[i] == (plan_problems(whole), short_plan_problems(whole)), p
    assert with_problem_codes(df.limit(0), "plan").count() == 0
