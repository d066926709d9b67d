import datetime as dt
import random

from pyspark.sql import functions as F

from daywise.llm import top_n as module
from daywise.llm.top_n import latest_records, top_n_per_group

RECORD = "record_id string, case_token string, day_offset int, clock string, precision string, ingested_at timestamp_ntz"


def test_against_sorting(spark, monkeypatch):
    monkeypatch.setattr(module, "HOT_ROWS", 300)
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice([None, *range(-5, 12)]), f"id{i:04d}", i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, s int, id string, rank_no int")
    for n, width in ((1, 1), (3, 4), (50, 100)):
        got = {(r.g, r["rank_no"], r.id) for r in top_n_per_group(df, ["g"], F.col("s"), ["id"], n, bin_width=width, salts=4).collect()}
        want = set()
        for g in {r[0] for r in rows}:
            best = sorted((r for r in rows if r[0] == g and r[1] is not None), key=lambda r: (-r[1], r[2]))[:n]
            want |= {(g, k + 1, r[2]) for k, r in enumerate(best)}
        assert got == want


def test_one_bin_holds_all(spark):
    df = spark.range(5000).select(F.lit("g").alias("g"), F.lit(7).alias("s"), F.col("id").cast("string").alias("id"))
    got = [r.id for r in top_n_per_group(df, ["g"], F.col("s"), ["id"], 3, bin_width=1).orderBy("rank_no").collect()]
    assert got == sorted(map(str, range(5000)))[:3]


def test_latest_records_cases(spark):
    t = lambda k: dt.datetime(2025, 1, k)
    rows = [
        ("r1", "A", 5, "08:30", "minute", t(1)), ("r1", "A", 9, "08:30", "minute", t(2)),  # the later delivery counts
        ("r2", "A", 9, " 08:30:01 ", "SECOND", t(1)), ("r3", "A", 9, "23:59:59", "Day", t(1)), ("r4", "A", 9, "24:00", "minute", t(1)),
        ("r5", "B", None, "08:00", "minute", t(1)), ("r6", "B", -1, None, None, t(1)), ("r6", "B", -1, None, None, t(1)), ("r7", None, 1, "00:00", "minute", t(1)),
        (None, "C", 1, "8:00", "minute", t(1)), ("r8", "D", 3, "10:00", "", t(1)), ("r9", "D", 3, "09:00", "minute", None),
    ]
    df = spark.createDataFrame(rows, RECORD).withColumn("rank_no", F.lit("clash")).withColumn("score", F.lit(0))
    got = {(r.case_token, r.rank_no): r.record_id for r in latest_records(df).collect()}
    assert got == {("A", 1): "r2", ("A", 2): "r1", ("A", 3): "r3", ("B", 1): "r6", (None, 1): "r7", ("C", 1): None, ("D", 1): "r9", ("D", 2): "r8"}


def test_empty(spark):
    assert latest_records(spark.createDataFrame([], RECORD)).count() == 0
