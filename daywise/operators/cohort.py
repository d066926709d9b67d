"""Questions over dated rows of entities: distinct days, gaps, sessions, co-occurrence, and agreement measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_profile(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Per entity: distinct days, span in days, busiest day (the earliest of equal ones) and its rows."""
    days = rows.filter(F.col(at).isNotNull()).groupBy(*keys, F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    busiest = F.max(F.struct("n", (-F.datediff("day", F.lit("1970-01-01"))).alias("early"), "day")).alias("b")
    return days.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.datediff(F.max("day"), F.min("day")).alias("span_days"), busiest).select(*keys, "days", "span_days", F.col("b.day").alias("busiest_day"), F.col("b.n").alias("busiest_rows"))


def crowded_days(rows: DataFrame, keys: Sequence[str], at: str, least: int) -> DataFrame:
    """How many days of each entity have at least ``least`` rows; entities without one are left out."""
    days = rows.filter(F.col(at).isNotNull()).groupBy(*keys, F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return days.groupBy(*keys).agg(F.count(F.lit(1)).alias("crowded_days"))


def longest_gaps(rows: DataFrame, keys: Sequence[str], at: str) -> DataFrame:
    """Per entity the longest time between neighbouring rows, in seconds; null for one row."""
    lag = F.lag(at).over(Window.partitionBy(*keys).orderBy(at))
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(lag.cast("timestamp"))
    return rows.filter(F.col(at).isNotNull()).withColumn("gap", gap).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), (F.max("gap") / 1e6).alias("longest_gap_seconds"))


def sessions(rows: DataFrame, keys: Sequence[str], at: str, gap_seconds: int) -> DataFrame:
    """Rows of an entity no further apart than the gap, merged: ``session_no, started, ended, rows``."""
    w = Window.partitionBy(*keys).orderBy(at)
    far = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp")) > gap_seconds * 1_000_000
    numbered = rows.filter(F.col(at).isNotNull()).withColumn("begins", F.when(far | F.lag(at).over(w).isNull(), 1).otherwise(0)).withColumn("session_no", F.sum("begins").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, F.col("session_no").cast("int").alias("session_no")).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("rows"))


def same_day(rows: DataFrame, keys: Sequence[str], at: str, first: Column, second: Column) -> DataFrame:
    """Per entity the days that have a row of both kinds; one aggregate instead of a join of two."""
    days = rows.filter(F.col(at).isNotNull()).groupBy(*keys, F.to_date(at).alias("day")).agg(F.max(F.coalesce(first, F.lit(False))).alias("a"), F.max(F.coalesce(second, F.lit(False))).alias("b"))
    return days.filter("a and b").groupBy(*keys).agg(F.count(F.lit(1)).alias("shared_days"))


def label_agreement(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Accuracy, macro F1 and Cohen's kappa of two labels per row; rows with a null label take no part."""
    cells = pairs.filter(F.col(left).isNotNull() & F.col(right).isNotNull()).groupBy(F.col(left).alias("l"), F.col(right).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(F.explode(F.array(F.struct(F.col("l").alias("label"), F.lit("l").alias("side")), F.struct(F.col("r").alias("label"), F.lit("r").alias("side")))).alias("s"), "n", (F.col("l") == F.col("r")).alias("same"))
    per = sides.groupBy("s.label").agg(F.sum(F.when(F.col("s.side") == "l", F.col("n")).otherwise(0)).alias("nl"), F.sum(F.when(F.col("s.side") == "r", F.col("n")).otherwise(0)).alias("nr"), F.sum(F.when(F.col("same") & (F.col("s.side") == "l"), F.col("n")).otherwise(0)).alias("tp"))
    whole = per.agg(F.sum("nl").alias("n"), F.sum("tp").alias("hits"), F.avg(F.when(F.col("nl") + F.col("nr") > 0, 2 * F.col("tp") / (F.col("nl") + F.col("nr")))).alias("macro_f1"), F.sum(F.col("nl").cast("double") * F.col("nr")).alias("chance"))
    share, chance = F.col("hits") / F.col("n"), F.col("chance") / (F.col("n").cast("double") * F.col("n"))
    return whole.filter("n > 0").select(F.col("n").alias("rows"), share.alias("accuracy"), "macro_f1", F.when(chance < 1, (share - chance) / (1 - chance)).alias("kappa"))


def value_errors(pairs: DataFrame, left: str, right: str, tolerance: float) -> DataFrame:
    """Mean absolute and root mean square error, correlation and share within a relative tolerance."""
    x, y = F.col(left), F.col(right)
    near = F.abs(x - y) <= tolerance * F.abs(y)
    return pairs.filter(x.isNotNull() & y.isNotNull()).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs(x - y)).alias("mae"), F.sqrt(F.avg((x - y) * (x - y))).alias("rmse"), F.corr(left, right).alias("correlation"), (F.count_if(near) / F.count(F.lit(1))).alias("within"))


def rank_auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the curve by the rank sum, ties at their middle.

    Equal scores are counted first and cut into some 256 ranges of like size by their quantiles; running totals go over
    the ranges, then within each, so no window holds all rows, whatever the scores' scale.
    """
    per = rows.filter(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(positive)).cast("double").alias("p"), F.count_if(~F.col(positive)).cast("double").alias("q"))
    cuts = per.agg(F.percentile_approx("s", [k / 256 for k in range(1, 256)], 10_000)).scalar()
    per = per.withColumn("cuts", cuts).withColumn("b", F.size(F.filter("cuts", lambda c: c <= F.col("s")))).drop("cuts")
    below = per.groupBy("b").agg(F.sum("q").alias("bq")).withColumn("before", F.coalesce(F.sum("bq").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    within = per.withColumn("inner", F.coalesce(F.sum("q").over(Window.partitionBy("b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    joined = within.join(below.select("b", "before"), "b")
    wins = joined.agg(F.sum(F.col("p") * (F.col("before") + F.col("inner") + F.col("q") / 2)).alias("wins"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    return wins.select(F.col("p").cast("long").alias("positives"), F.col("q").cast("long").alias("negatives"), F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("wins") / (F.col("p") * F.col("q"))).alias("auc"))


def ranked_sample(rows: DataFrame, strata: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each stratum in a total order: a report of that size, not a cut of the data."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy(*order))).filter(F.col("place") <= n)
