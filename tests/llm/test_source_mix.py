import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daywise.llm import source_mix as M


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 15), st.integers(1, 4), max_size=5), st.integers(0, 90))
def test_fit_is_nearest(lengths, budget):
    taken = M.fit_budget(list(lengths.items()), budget)
    assert all(0 < k <= lengths[n] for n, k in taken.items())
    reach = {0}
    for n, c in lengths.items():
        for _ in range(c):
            reach |= {x + n for x in reach}
    assert abs(sum(n * k for n, k in taken.items()) - budget) == min(abs(x - budget) for x in reach)


def mixed(spark, **extra):
    rnd = random.Random(2)
    docs = [(i, rnd.choice(["big"] * 6 + ["small", "free", None]), " ".join(["word"] * rnd.randint(1, 60))) for i in range(900)]
    docs += [(9001, "big", None), (9002, "small", ""), docs[0]]
    target = [("big", 0.6, 1), ("small", 0.3, 2), ("gone", 0.1, 3), ("zero", 0.0, 1)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("h", F.lit("clash"))
    return M.mix_sources(d, spark.createDataFrame(target, "source string, target_weight double, max_repeats int"), **extra)


def test_shares_and_repeats(spark):
    used, report = mixed(spark)
    rows = used.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.repeats <= {"big": 1, "small": 2}[r.source] for r in rows)
    share = {r.source: r for r in report.collect()}
    assert abs(share["big"].share - 2 / 3) < 0.002 and abs(share["small"].share - 1 / 3) < 0.002
    assert share["gone"].used_tokens == 0 and share["free"].share == 0 and share[None].documents > 0
    assert sorted((r.doc_id, r.repeats) for r in mixed(spark)[0].collect()) == sorted((r.doc_id, r.repeats) for r in rows)


def test_stated_total_and_empty(spark):
    used, _ = mixed(spark, total_tokens=3000)
    assert abs(used.agg(F.sum(F.col("n_tokens") * F.col("repeats"))).first()[0] - 3000) <= 2
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    used, report = M.mix_sources(none, spark.createDataFrame([("a", 1.0, 1)], "source string, target_weight double, max_repeats int"))
    assert used.count() == 0 and [r.used_tokens for r in report.collect()] == [0]


def test_long_documents_are_fitted_as_exactly_as_short_ones():
    rnd = random.Random(5)
    lengths = {rnd.randrange(1_000_000, 3_000_000): rnd.randint(1, 3) for _ in range(12)} | {7: 9, 5_000: 40}
    budget = sum(n * c for n, c in lengths.items()) // 2
    taken = M.fit_budget(list(lengths.items()), budget)
    assert all(0 < k <= lengths[n] for n, k in taken.items()) and abs(sum(n * k for n, k in taken.items()) - budget) < 5_000


def test_targets_that_count_for_nothing_displace_none(spark, monkeypatch):
    monkeypatch.setattr(M, "MOST_TARGETS", 2)
    docs = spark.createDataFrame([(i, s, "a few words") for i, s in enumerate(["a", "b"] * 20)], "doc_id long, source string, text string")
    target = [(f"none{i}", 0.0, 1) for i in range(50)] + [("a", 0.5, 1), ("b", 0.5, 1)]
    used, report = M.mix_sources(docs, spark.createDataFrame(target, "source string, target_weight double, max_repeats int"))
    assert used.count() == 40 and {r.source: r.share for r in report.collect() if r.used_tokens} == {"a": 0.5, "b": 0.5}
    more = spark.createDataFrame([(s, 1.0, 1) for s in "abc"], "source string, target_weight double, max_repeats int")
    with pytest.raises(ValueError, match="more than 2"):
        M.mix_sources(docs, more)
