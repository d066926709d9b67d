from datetime import date

from pyspark.sql import functions as F

from daywise.functions import dates as D
from daywise.operators import binding as N
from daywise.operators import rebase as R
from daywise.operators import rescore as Q
from daywise.operators import validation as V


def test_dates():
    assert D.explicit_dates("on 2025-01-05 and 2025年2月3日, 20250301") == ([date(2025, 1, 5), date(2025, 2, 3), date(2025, 3, 1)], None)
    assert D.explicit_dates("2025-01-0508:30") == ([date(2025, 1, 5)], None)
    assert D.explicit_dates("2025-02-30") == ([], "invalid_explicit_date")
    assert D.explicit_dates("25-01-05")[1] == D.explicit_dates("at 01-05")[1] == "ambiguous_year"
    assert D.explicit_dates("") == ([], None)
    assert D.anchor_date(["2020-01-01", "2025-01-05 and 2025-03-01", ""]) == date(2025, 1, 5) and D.anchor_date([]) is None
    shown = D.relative_days("2025-01-15, 1999-01-01, 25.01.20 and 02-03, 2025-13-01", date(2025, 1, 5))
    assert shown == "[相对日+10], [非就诊日期已移除], [相对日+15] and [相对日+29], 2025-13-01"
    assert D.relative_days("2025-01-15", None) == "2025-01-15"


def test_audit_and_sidecar(spark):
    schema = "case_token string, document_token string, line_index int, page_number int, bbox array<array<double>>, text string, confidence double"
    raw = ["seen 2025-01-05", "then 2025-01-15", "gone 2025-01-20", "old 2025-02-30", "low 2025-01-25", "none", "mask 2025-01-30"]
    red = ["seen [相对日+0]", "then [相对日+11]", "gone", "old [相对日+5]", "low [相对日+20]", "none", "mask [日期]"]
    rows = lambda texts: spark.createDataFrame([("A", "d", i, 1, [[0.0, float(i)]], t, 0.5 if t.startswith("low") else 0.9) for i, t in enumerate(texts)], schema)
    got = R.date_audit(rows(raw), rows(red))
    seen = {r.line_index: (r.issue, r.legacy_day, r.binding) for r in got.collect()}
    assert seen == {0: (None, 0, "sequence_replay_verified"), 1: ("legacy_replay_mismatch", None, None), 2: ("source_date_not_retained_as_relative_token", None, None), 3: ("legacy_replay_mismatch", None, None), 4: ("low_confidence_source", None, None), 6: (None, None, "bbox_only_candidate")}
    side = R.case_sidecar(got, rows(raw)).collect()
    assert sorted((r.line_index, r.coordinate_day) for r in side) == [(0, 0), (6, 25)] and len({r.coordinate_id for r in side}) == 1
    assert R.issue_counts(got).count() == 3


def test_binding(spark):
    c = spark.createDataFrame([(0, "A", "d", 1), (1, "A", "d", 1), (2, "A", "d", 2), (3, "A", "d", 1)], "candidate_ordinal int, case_token string, document_token string, page_number int")
    r = spark.createDataFrame([("r1", "A", "d", 1, [0, 2, 9], "report"), ("r2", "A", "d", 1, [3], None), ("r3", "A", "d", 1, [3], "report")], "row_id string, case_token string, document_token string, page_number int, candidate_ordinals array<int>, temporal_role string")
    got = {x.candidate_ordinal: (x.row_id, x.binding_status, x.code) for x in N.bind_candidates(c, r).collect()}
    assert got == {0: ("r1", "explicit", None), 1: (None, "unresolved", None), 2: (None, "unresolved", "SOURCE_SCOPE_MISMATCH"), 3: (None, "unresolved", "AMBIGUOUS_ROW_BINDING"), 9: (None, "unresolved", "INVALID_CANDIDATE_ORDINAL")}


def test_states_and_gate(spark):
    df = spark.createDataFrame([('{"a": 1}',), ('{"a": ""}',), ('{"a": []}',), ('{"a": null}',), ("{}",), ("{",), (None,), ('{"a": 0}',)], "p string")
    assert [r.s for r in df.select(V.field_state(F.col("p"), "a").alias("s")).collect()] == ["value", "empty", "empty", "missing", "missing", "missing", "missing", "value"]
    q = spark.createDataFrame([("1", "lab", "synthetic", None, True, "v", "h", "s", "audit", ["x"], "ok"), ("2", "out", "raw_test", None, None, None, "h", "", "other", None, "身份证 1")], "id string, destination string, payload_mode string, raw_test_authorized boolean, api_ready boolean, source_version string, source_sha256 string, review_scope string, purpose string, task_fields array<string>, messages string")
    got = {r.id: (r.decision, r.reasons) for r in V.gate(q, V.request_checks(["lab"], "audit", ["x"]), "id").collect()}
    assert got["1"] == ("allow", "") and got["2"] == ("block", "destination_not_approved,raw_test_authorization_missing,source_version_or_hash_missing,review_scope_missing,purpose_mismatch,task_fields_missing")


def test_rescore(spark):
    ledger = spark.createDataFrame([("t", "x"), ("t", "y"), ("u", "x")], "task_id string, arm string")
    responses = spark.createDataFrame([("t", "x", 'Answer: {"status": "ok", "selected": ["a"]}'), ("u", "x", '{"choices": [{"message": {"content": "{\\"decision\\": \\"empty\\"}"}}]}')], "task_id string, arm string, response string")
    reference = spark.createDataFrame([("t", "ok", ["a"], []), ("u", "empty", [], [])], "task_id string, status string, selected array<string>, candidates array<string>")
    got = {(r.task_id, r.arm): r.task_success for r in Q.rescored(ledger, responses, reference).collect()}
    assert got == {("t", "x"): True, ("t", "y"): False, ("u", "x"): True}
    assert {r.arm: (r.successes, r.format_failures) for r in Q.arm_scores(Q.rescored(ledger, responses, reference)).collect()} == {"x": (2, 0), "y": (0, 1)}
