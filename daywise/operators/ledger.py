"""Job grids, ledgers, budgets and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def job_grid(tasks: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Every task under every arm; arms are a short parameter, so each task row is repeated, not joined."""
    return tasks.withColumn("arm", F.explode(F.array(*[F.lit(a) for a in arms])))


def open_jobs(grid: DataFrame, ledger: DataFrame, keys: Sequence[str] = ("task_id", "arm")) -> DataFrame:
    """Jobs without a ledger row."""
    return grid.join(ledger.select(*keys).distinct(), list(keys), "left_anti")


def recovered_rows(grid: DataFrame, ledger: DataFrame, saved: DataFrame, keys: Sequence[str] = ("task_id", "arm")) -> DataFrame:
    """For open jobs with saved attempts a row with the last attempt's number; ``saved`` has the keys and ``attempt``."""
    return open_jobs(grid, ledger, keys).join(saved.groupBy(*keys).agg(F.max("attempt").alias("attempts")), list(keys))


def within_budget(jobs: DataFrame, keys: Sequence[str], order: Sequence[Column], cost: str, budget: float) -> DataFrame:
    """The prefix of each group's jobs that the budget covers, with the cost spent before each.

    The first job whose own cost would exceed what is left ends its group, whatever the later ones cost; it is not
    run. Null costs count as 0.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.coalesce(cost, F.lit(0))
    running = jobs.withColumn("spent", F.sum(own).over(w) - own)
    over = F.max(F.when(F.col("spent") + own > budget, 1).otherwise(0)).over(w)
    return running.withColumn("over", over).filter("over = 0").drop("over")


def arm_summary(ledger: DataFrame, keys: Sequence[str], done: Column, right: Column) -> DataFrame:
    """Per arm: rows, done and right ones, and their share of done ones (null without any)."""
    out = ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("jobs"), F.count_if(done).alias("done"), F.count_if(done & right).alias("right"))
    return out.withColumn("success_share", F.try_divide("right", "done"))


def label_histograms(rows: DataFrame, keys: Sequence[str], label: Column) -> DataFrame:
    """Per group a map from label to count, and its text with labels in order; null labels count as ``none``."""
    n = rows.groupBy(*keys, F.coalesce(label, F.lit("none")).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("label", "n")))
    return n.groupBy(*keys).agg(F.sum("n").alias("rows"), F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["label"], p["n"].cast("string"))), ";").alias("histogram"))


def failure_class(service_ok: Column, format_ok: Column, content_ok: Column) -> Column:
    """The first that failed of service, format and content; ``none`` if all held. Null counts as failed."""
    held = lambda c: F.coalesce(c, F.lit(False))
    return F.when(~held(service_ok), "service").when(~held(format_ok), "format").when(~held(content_ok), "content").otherwise("none")


def reason_codes(checks: Sequence[tuple[str, Column]]) -> Column:
    """The codes whose condition holds, in order; a null condition counts as not held."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), code) for code, c in checks]))


def context_estimate(texts: DataFrame, text: str, per_token: int = 4) -> DataFrame:
    """Mean length in characters and the estimated tokens, cut to whole numbers."""
    return texts.agg(F.floor(F.avg(F.length(F.coalesce(text, F.lit(""))))).alias("mean_chars"), F.floor(F.sum(F.length(F.coalesce(text, F.lit("")))) / per_token).alias("tokens"))
