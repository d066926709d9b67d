import collections
import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daywise.functions import values as V
from daywise.operators import scoring as G
from daywise.workload import scoring as W


@settings(max_examples=200, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 4), st.integers(0, 4)), max_size=12))
def test_largest_matching(edges):
    pairs = [(f"p{a}", f"r{b}") for a, b in edges]
    got = G.largest_matching(pairs)
    assert set(got) <= set(pairs) and len({a for a, _ in got}) == len({b for _, b in got}) == len(got)
    best = max((k for k in range(6) for some in itertools.combinations(pairs, k) if len({a for a, _ in some}) == k == len({b for _, b in some})), default=0)
    assert len(got) == best and got == G.largest_matching(pairs[::-1])


def test_long_chain_of_augmenting_paths():
    edges = [e for i in range(3000) for e in ((f"p{i:05d}", f"r{i:05d}"), (f"p{i:05d}", f"r{i + 1:05d}"))]
    assert len(G.largest_matching(edges)) == 3000


def test_match_anchors(spark):
    rows = [("A", "p1", "r1"), ("A", "p2", "r1"), ("A", "p2", "r2"), ("B", "p3", "r3")]
    got = {(r.pred_id, r.ref_id) for r in G.match_anchors(spark.createDataFrame(rows, "case_token string, pred_id string, ref_id string")).collect()}
    assert got == {("p1", "r1"), ("p2", "r2"), ("p3", "r3")}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sets(st.integers(0, 6), max_size=3), max_size=10))
def test_match_through_lines(held):
    seen = [(f"o{i}", [f"r{x}" for x in lines]) for i, lines in enumerate(held)]
    edges = {(a, b) for a, x in seen for b, y in seen if a != b and set(x) & set(y)}
    got = G.match_through_lines(seen)
    assert set(got) <= edges and len({a for a, _ in got}) == len({b for _, b in got}) == len(got) == len(G.largest_matching(list(edges)))
    assert got == G.match_through_lines(seen[::-1])


def test_long_chains_of_lines():
    chain = [(f"o{i:05d}", [f"r{i:05d}", f"r{i + 1:05d}"]) for i in range(3001)]
    assert len(G.match_through_lines(chain)) == 3000 and len(G.match_through_lines([*chain[:-1], ("o03000", ["r03000", "r00000"])])) == 3001
    # A hub whose lines lead to one observation each serves one of them only.
    assert len(G.match_through_lines([("hub", [f"r{i}" for i in range(50)]), *((f"o{i}", [f"r{i}"]) for i in range(50))])) == 2


def test_match_observations_as_over_all_pairs(spark):
    rng = random.Random(7)
    rows = [(f"o{i:04d}", f"C{rng.randrange(60)}", [f"r{rng.randrange(9)}" for _ in range(rng.choice((0, 1, 1, 1, 2, 3)))]) for i in range(500)]
    rows += [(f"w{c}-{i:02d}", f"W{c}", [f"r{x}" for x in rng.choice(((1,), (2,), (1, 2), (2, 3), (3, 4, 5), (6, 7), (8,)))]) for c in range(20) for i in range(rng.randrange(2, 30))]
    rows += [(None, "C1", ["r1"]), ("lost", None, ["r1"]), ("bare", "C1", None), ("blank1", "N", [None]), ("blank2", "N", [None]), ("twice1", "T", ["r1", "r1"]), ("twice2", "T", ["r2"])]
    df = spark.createDataFrame(rows, "id string, case_token string, source_refs array<string>")
    pairs = G.overlap_anchors(df, df).filter("pred_id <> ref_id").join(df.select(F.col("id").alias("pred_id"), "case_token"), "pred_id")
    edges = {(r.case_token, r.pred_id, r.ref_id) for r in pairs.collect()}
    got = [(r.case_token, r.pred_id, r.ref_id) for r in G.match_observations(df).collect()]
    assert set(got) <= edges and len({p for _, p, _ in got}) == len({r for _, _, r in got}) == len(got)
    sizes = lambda some: dict(collections.Counter(c for c, _, _ in some))
    assert sizes(got) == sizes((r.case_token, r.pred_id, r.ref_id) for r in G.match_anchors(pairs).collect())


def test_matching_of_many_observations_on_one_line(spark, tmp_path):
    """20,000 observations on one line have 400 million pairs; the query makes none of them."""
    refs = F.when(F.col("id") % 4 == 0, F.array(F.lit("r1"), F.lit("r2"))).when(F.col("id") == 1, F.array(F.lit("r2"))).otherwise(F.array(F.lit("r1")))
    text = [F.col("id").cast("string").alias(c) for c in ("observation_id", "item", "value", "unit")]
    spark.range(20_000).select(*text, F.lit("A").alias("case_token"), refs.alias("source_refs"), F.lit("2025-01-01").cast("timestamp").alias("submitted_at"), F.array().cast(ASSERTIONS).alias("time_assertions")).write.parquet(f"{tmp_path}/unified_fixture_submission.parquet")
    df = W.j11_matching(spark, str(tmp_path))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [("A", 20_000)]


def test_whole_sum(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), ("b", 3)], "k string, x int")
    assert {r.k: r.s for r in df.groupBy("k").agg(G.whole_sum(F.col("x")).alias("s")).collect()} == {"a": None, "b": 5}


def test_identity(spark):
    pairs = spark.createDataFrame([("a", "b", "same"), ("a", "c", "different"), ("a", "d", "same"), ("a", "b", "unresolved"), ("a", "z", "same"), ("b", "c", "different")], "left_row string, right_row string, relation string")
    groups = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2)], "row string, group_id int")
    r = G.identity_scores(pairs, groups).first()
    assert (r.correct, r.false_merge, r.false_split, r.missing_decision, r.unsupported_resolution) == (1, 2, 1, 1, 1)


def test_resolve_items(spark):
    records = spark.createDataFrame([("r1", "A", "5.0", "g/L", 1, ["x"]), ("r2", "A", "5", "G/l", 2, ["y"]), ("r3", "A", "5.1", "g/L", 3, ["z"]), ("r4", "A", "0", "g/L", 3, ["z"])], "record_id string, case_token string, value string, unit string, day int, refs array<string>")
    items = spark.createDataFrame([("i1", "A", "5.000001", "g / L", 2, None), ("i2", "A", "5", "g/L", None, ["x"]), ("i3", "A", "5", "g/L", None, None), ("i4", "A", "9", "g/L", 1, None), ("i5", "A", "0.0", "g/L", 1, None), ("i6", "A", None, None, None, None)], "item_id string, case_token string, value string, unit string, day int, source_refs array<string>")
    got = {r.item_id: (r.status, r.record_id) for r in G.resolve_items(items, records).collect()}
    assert got == {"i1": ("resolved", "r2"), "i2": ("resolved", "r1"), "i3": ("ambiguous", None), "i4": ("unmatched", None), "i5": ("resolved", "r4"), "i6": ("unmatched", None)}


def test_field_codes(spark):
    row = lambda **k: {"v": "5", "u": "g/L", "d": "3", "c": None, "ev": "5", "eu": "g/L", "ed": 3, "ec": None, "ep": "day"} | k
    rows = [row(), row(v=None, u=None, d=None), row(v="5.1", u="mg/L", d="3.5"), row(c="08:00"), row(ep="second", ec="08:00:01"), row(ep="second", ec="08:00:01", c="08:00:01"), row(ep="second", ec="08:00:01", c="09:00:00"), row(v="x")]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "v string, u string, d string, c string, ev string, eu string, ed int, ec string, ep string")
    got = [r.m for r in df.select(G.field_mismatches(*[F.col(c) for c in ("v", "u", "d", "c", "ev", "eu", "ed", "ec", "ep")]).alias("m")).collect()]
    assert got == [[], ["missing_value", "missing_unit", "missing_time"], ["value", "unit", "time"], ["time_precision"], ["time_precision"], [], ["time"], ["value"]]


def test_values(spark):
    one = lambda e: spark.range(1).select(e.alias("x")).first().x
    canon = lambda t: one(V.canonical_number(F.lit(t)))
    assert [canon(t) for t in ("4.20", "+4.2", "<4.2", "100", "0.0", "1e3", " x ")] == ["4.2", "4.2", "<4.2", "100", "0", "1e3", "x"]
    assert one(V.first_number(F.lit("range 3-5, value 4,2 g"))) == 4.2
    assert one(V.last_number_before(F.lit("a 3 b 4.5 mmol/L 9"), "mmol/L")) == "4.5" and one(V.last_number_before(F.lit("1 2"), "mmol/L")) == "2"
    assert one(V.day_marker(F.lit("on Tag 15 again"))) == 15 and one(V.day_marker(F.lit("x"))) is None
    assert one(V.grams_per_litre(F.lit(11.9), F.lit("g / dL"))) == 119.0 and one(V.grams_per_litre(F.lit(1.0), F.lit("x"))) is None
    at, precision = V.moment_of(F.lit("2025-02-30"))
    assert one(precision) == "invalid" and one(V.moment_of(F.lit("2025-02-03 08:30:01"))[1]) == "second" and one(V.moment_of(F.lit(""))[1]) == "missing"
    assert one(V.brace_object(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}' and one(V.brace_object(F.lit("no"))) is None
    assert len(one(V.row_id(F.lit("a"), F.lit(1)))) == 16


ASSERTIONS = "array<struct<role:string,relative_day:int,coordinate_id:string,binding_status:string>>"


def observed(n=12):
    """Twelve observations of two cases; one measurement was repeated."""
    time = lambda d: [("sampling", d, "c", "explicit"), ("report", d + 1, "c", "explicit")]
    return [(f"o{i}", "AB"[i % 2], "Hb", str(100 + i // 2 * 1.5), "g/L", [f"p1:L{i}"], time(i)) for i in range(n)]


def test_mutations_of_a_submission(spark):
    make = lambda rows: spark.createDataFrame(rows, f"id string, case_token string, item string, value string, unit string, source_refs array<string>, time_assertions {ASSERTIONS}")
    gold = observed()
    swapped = [*gold[:1], (*gold[1][:6], [("report", 1, "c", "explicit"), ("sampling", 2, "c", "explicit")]), *gold[2:]]
    late = [*gold[:1], (*gold[1][:6], [("sampling", 1, "c", "explicit"), ("report", 9, "c", "explicit")]), *gold[2:]]
    cases = [(gold, 12, 0, 0), (swapped, 11, 1, 1), (gold[:-1], 11, 0, 1), ([*gold, ("again", *gold[0][1:])], 12, 1, 0), ([*gold[:-1], (*gold[-1][:5], None, gold[-1][6])], 11, 1, 1), ([], 0, 0, 12), ([("x", *(None,) * 6)], 0, 1, 12), (late, 12, 0, 0), ([(*gold[0][:3], "100.00", *gold[0][4:]), *gold[1:]], 12, 0, 0)]
    for rows, tp, fp, fn in cases:
        r = G.observation_scores(make(rows), make(gold)).first()
        assert (r.tp, r.fp, r.fn) == (tp, fp, fn) and r.recall == tp / 12 and (r.precision == tp / len(rows) if rows else r.precision is None)
    assert tuple(G.observation_scores(make(late), make(gold), full_record=True).first())[:3] == (11, 1, 1)
    assert tuple(G.observation_scores(make([]), make([])).first()) == (0, 0, 0, None, None, None)
