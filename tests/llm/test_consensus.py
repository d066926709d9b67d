import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from daywise.llm import consensus as C

SHEET = "sheet_id string, observation_id string, reviewer_a string, reviewer_a_judgment string, reviewer_b string, reviewer_b_judgment string, adjudicator string, adjudication string, locked_at timestamp_ntz"


def simulated(n=1500, seed=3):
    """Items with a hidden class; good annotators, constant ones, guessers and ones who swap two classes."""
    rnd = random.Random(seed)
    truth, rows = {}, []
    kinds = ["good"] * 6 + ["constant"] * 4 + ["guess"] * 3 + ["swap"] * 4
    for i in range(n):
        t = rnd.choices(range(3), [5, 3, 2])[0]
        truth[f"i{i}"] = C.CLASSES[t]
        for a in rnd.sample(range(len(kinds)), 4):
            k = kinds[a]
            said = {"good": t if rnd.random() < 0.9 else rnd.randrange(3), "constant": 0 if rnd.random() < 0.95 else rnd.randrange(3), "guess": rnd.randrange(3), "swap": ({1: 2, 2: 1}.get(t, t) if rnd.random() < 0.9 else rnd.randrange(3))}[k]
            rows.append((f"i{i}", f"{k}{a}", C.CLASSES[said]))
    return truth, rows


def test_better_than_majority_and_reliability(spark):
    truth, rows = simulated()
    items, who = C.consensus(spark.createDataFrame(rows, "item string, annotator string, label string"))
    got = {r["item"]: r.judgment for r in items.collect()}
    by = {}
    for i, _, label in rows:
        by.setdefault(i, []).append(label)
    right = np.mean([got[i] == t for i, t in truth.items()])
    majority = np.mean([max(sorted(set(v)), key=v.count) == truth[i] for i, v in by.items()])
    assert right > majority + 0.08 and right > 0.85
    rho = {r.annotator: r.rho for r in who.collect()}
    assert min(v for k, v in rho.items() if k.startswith("good")) > max(v for k, v in rho.items() if k.startswith(("constant", "guess")))


def test_sheets(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [("s1", "o1", "R1", " Clear", "R2", "明确", None, None, t), ("s1", "o1", "R1", " Clear", "R2", "明确", None, None, t), ("s2", "o2", "r1 ", "needs clinician", "R2", "Needs-Clinician", "AJ", "unclear", t), ("s3", "o3", "R1", "not_started", "R2", "", None, None, t), (None, "o4", None, "unclear", "R3", None, None, None, None), ("s5", None, "R1", "clear", "R2", "clear", None, None, t)]
    df = spark.createDataFrame(rows, SHEET).withColumn("label", F.lit("clash")).withColumn("item", F.lit(1))
    assert C.review_labels(df).count() == 7  # not the label without a reviewer
    done, _ = C.judged_observations(df, rounds=12)
    got = {r.observation_id: (r.judgment, r.n_labels) for r in done.collect()}
    assert set(got) == {"o1", "o2", "o3", "o4"} and got["o1"] == ("clear", 2) and got["o3"][1] is None and got["o2"][1] == 3 and got["o4"][1] is None


def test_empty(spark):
    done, who = C.judged_observations(spark.createDataFrame([], SHEET))
    assert done.count() == 0 and who.count() == 0


def test_items_with_very_many_labels_give_the_same(spark, monkeypatch):
    _, rows = simulated(n=200)
    rows += [("hot", a, C.CLASSES[0 if i % 5 else 1]) for i, a in enumerate(sorted({a for _, a, _ in rows}))]
    df = spark.createDataFrame(rows, "item string, annotator string, label string")
    plain = sorted((r["item"], r.judgment, round(r.confidence, 6)) for r in C.consensus(df, rounds=12)[0].collect())
    monkeypatch.setattr(C, "HOT", 10)
    assert sorted((r["item"], r.judgment, round(r.confidence, 6)) for r in C.consensus(df, rounds=12)[0].collect()) == plain


def test_rounds_end_by_convergence(spark):
    _, rows = simulated(n=400)
    df = spark.createDataFrame(rows, "item string, annotator string, label string")
    a, b = ({r["item"]: r.judgment for r in C.consensus(df, rounds=n)[0].collect()} for n in (60, 100))
    assert a == b


def test_two_classes_and_ties(spark):
    rows = [("i", "a", "y"), ("i", "b", "x"), (None, "a", "x"), ("k", None, "x"), ("k", "a", None), ("l", "a", "z")]
    items, who = C.consensus(spark.createDataFrame(rows, "item string, annotator string, label string"), classes=("x", "y"))
    assert {r["item"]: (r.judgment, r.n_labels, r.agreement) for r in items.collect()} == {"i": ("x", 2, 0.0)}
    assert {r.annotator: r.n_labels for r in who.collect()} == {"a": 1, "b": 1}
