import json

from pyspark.sql import functions as F

from daywise.operators import schema_drift as D


def files(spark, *payloads):
    rows = [(f"s{k}-{i}-{j}", "f", k + 1, f"f/{k}", None, json.dumps(p) if isinstance(p, dict) else p) for k, ps in enumerate(payloads) for i, p in enumerate(ps) for j in range(1 + (i == 0))]
    return spark.createDataFrame(rows, "snapshot_id string, feed string, file_seq int, source_file string, landed_at timestamp_ntz, payload string").withColumn("kind", F.lit("clash")).withColumn("wanted", F.lit(1))


def doc(i, **k):
    return {"document_token": f"D{i}", **k}


def test_changes(spark):
    a = [doc(i, schema_version="1.0" if i % 2 else "0.9", page_count=i % 4 + 1, line_count=10 + i, l1_sha="a%030d" % i, l2_sha="b%030d" % i, old_flag=bool(i % 2), files={"l1": f"x{i}", "l2": f"y{i}"}) for i in range(8)]
    b = [doc(i, layout_schema={"major": int(i % 2), "minor": 0 if i % 2 else 9}, page_count=float(i % 4 + 1), n=["present", 10 + i], l2_digest="b%030d" % i, l1_sha="a%030d" % i, new_flag=bool(i % 3), files=[f"x{i}", f"y{i}"]) for i in range(8)]
    got = {(r.file_seq, r.change_kind, r.field_name, r.former_name) for r in D.schema_changes(files(spark, a, b + [None, "{broken", "[1]"], b)).collect()}
    assert got == {
        (2, "renamed", "layout_schema", "schema_version"), (2, "type_changed", "layout_schema", "schema_version"), (2, "type_changed", "page_count", ""), (2, "renamed", "n", "line_count"), (2, "type_changed", "n", "line_count"),
        (2, "renamed", "l2_digest", "l2_sha"), (2, "removed", "old_flag", ""), (2, "added", "new_flag", ""), (2, "type_changed", "files", ""),
    }


def test_one_table(spark):
    a, b = [doc(i, page_count=i + 1, line_count=10 + i, schema_version="0.9") for i in range(4)], [doc(i, pageCount=str(i + 1), line_count={"state": "present", "value": 10 + i}, schema_version=0.9, x=None) for i in range(4)]
    rows = D.consistent_snapshots(files(spark, a, b + [None])).collect()
    assert len(rows) == 11 and {(r.document_token, r.page_count, r.line_count, r.schema_version) for r in rows if r.readable} == {(f"D{i}", i + 1, 10 + i, "0.9") for i in range(4)}
    assert [r.readable for r in rows].count(False) == 1


def test_edges(spark):
    one = files(spark, [doc(0, a=1)])
    assert D.schema_changes(one).count() == 0 and D.schema_changes(one.limit(0)).count() == 0 and D.consistent_snapshots(one.limit(0)).count() == 0
    empty_between = files(spark, [doc(0, a=1)], ["{", None], [doc(0, b="z")])
    assert D.schema_changes(empty_between).count() == 0
    nulls = files(spark, [doc(i, a=None, c=1) for i in range(3)], [doc(i, a=5, c=None) for i in range(3)])
    assert D.schema_changes(nulls).count() == 0


def test_forms_and_names():
    share = lambda a, b: bool(set(D.content_forms(a)) & set(D.content_forms(b)))
    assert share(58, "58") and share(D._Decimal("58.0"), 58) and share(["present", 58], {"state": "present", "value": 58}) and share("1-3", [1, 3]) and share({"from": 1, "to": 3}, [1, 3]) and share(D._Decimal("0.9"), {"major": 0, "minor": 9})
    assert D.name_likeness("review_scope", "scope_of_review") == 1.0 and D.name_likeness("pageCount", "page_count") == 1.0 and D.name_likeness("locked", "retention_days") < D.NAME_FROM


def test_whole_numbers_keep_their_sign():
    read = [D.as_integer(v) for v in (-3, "-3", {"value": -7}, ["present", -7], D._Decimal("-4.0"), "58 pages", "p. -2", D._Decimal("5.5"), "1-3", "x1", True, None, "", 2**63, "1.000", "3,5")]
    assert read == [-3, -3, -7, -7, -4, 58, -2, None, None, None, None, None, None, None, 1, None]
    assert not set(D.content_forms(-3)) & set(D.content_forms(3)) and set(D.content_forms(-3)) & set(D.content_forms(["n", -3]))


def test_long_values_differ_in_shape_by_their_whole_text():
    assert D._shape("a" * 500 + "b") != D._shape("a" * 500 + "c") and D._shape("n" * 500 + "12") == D._shape("n" * 500 + "7")


def field(name, kind="string", members=(), chance=0.1, shape=None):
    return {"field": name, "type": kind, "members": sorted(members), "chance": chance, "shape": shape}


def test_flooded_scores_decide_over_whole_schemas():
    before = [field("document_token"), field("page_count", "integer"), field("files", "object", ["l1", "l2"]), field("flag", "boolean")]
    after = [field("document_token"), field("pages", "string"), field("sources", "object", ["l1", "l2"]), field("shift", "string")]
    content = {("page_count", "pages"): 1.0, ("files", "sources"): 0.9, ("flag", "shift"): 0.0, ("page_count", "sources"): 0.0, ("flag", "pages"): 0.0}
    assert {(a, b) for a, b, _ in D.correspondences(before, after, content)} == {("document_token", "document_token"), ("page_count", "pages"), ("files", "sources")}
    # Nesting alone carries a pair that nothing else is known of; what contradicts it keeps it out.
    bare = {k: v for k, v in content.items() if k != ("files", "sources")}
    assert ("files", "sources") in {(a, b) for a, b, _ in D.correspondences(before, after, bare)}
    assert ("files", "sources") not in {(a, b) for a, b, _ in D.correspondences(before, after, content | {("files", "sources"): 0.0})}
    assert D.correspondences([], after, {}) == [] and D.correspondences(before, [], {}) == []


def test_flood_settles_and_is_scaled():
    start = D.np.array([[1.0, 0.2], [0.1, 0.9]])
    label = D._label([["x"], ["y"]], [["x"], ["y"]], lambda a, b: float(a == b))
    score = D.flood(start, [label])
    assert score.max() == 1.0 and score[0, 0] > 5 * score[0, 1] and score[1, 1] > 5 * score[1, 0]
    assert (D.flood(start, [label], D.np.array([[True, True], [True, False]]))[1, 1]) == 0.0
