"""Questions on evaluations and timelines: paired arms, ladders, task families, timelines, completion, bootstrap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The distribution function of a Poisson variable of mean 1, up to the resolution of 32 bits.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def held(c: Column) -> Column:
    """A condition whose null counts as not met."""
    return F.coalesce(c, F.lit(False))


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that more than one row has, with their number of rows; null is a key like others."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def paired_outcomes(rows: DataFrame, task: Sequence[str], arm: str, success: Column, left: str, right: str) -> DataFrame:
    """One row ``wins, losses, both, neither`` of the left arm over the right one on the tasks that both have done.

    A task's several rows in an arm count as a success if any is one; null counts as no success. One aggregate per
    task takes the place of a join of the arms.
    """
    of = lambda a: F.max(F.when(F.col(arm) == a, held(success)))
    per = rows.groupBy(*task).agg(of(left).alias("l"), of(right).alias("r")).filter("l is not null and r is not null")
    return per.agg(*[F.count_if(F.expr(c)).alias(n) for n, c in (("wins", "l and not r"), ("losses", "r and not l"), ("both", "l and r"), ("neither", "not l and not r"))])


def ladder(rows: DataFrame, layers: Mapping[str, Column]) -> DataFrame:
    """``layer, kept``: rows that hold each layer and all below it, and all layers but one (``minus_`` and its name).

    All counts come from one pass; a null layer is not held.
    """
    names = list(layers)
    both = lambda names: held(_all([held(layers[n]) for n in names]))
    wanted = {n: both(names[: i + 1]) for i, n in enumerate(names)} | {f"minus_{n}": both([x for x in names if x != n]) for n in names}
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in wanted.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), F.col(f"`{n}`").alias("kept")) for n in wanted])).alias("x")).select("x.*")


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def coverage(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts of every combination of the keys, of each key alone and of all (``level`` tells which)."""
    return rows.cube(*keys).agg(F.count(F.lit(1)).alias("rows"), F.grouping_id().cast("int").alias("level")).select(*keys, "level", "rows")


def task_families(records: DataFrame) -> DataFrame:
    """``case_token, family, low, high, include_low, include_high, selection`` made of each case's own days.

    ``records`` has ``case_token, day, second`` (null if unknown). Families: ``gap`` (the widest space between
    neighbouring days, the earliest of equal ones, ends excluded), ``after_last``, ``full_span`` with both ends and
    ``inside_span`` without, ``busiest_day`` (the earliest of equal ones) and ``tie_day`` (the first day on which two
    records share a known clock). Rows without case or day take no part; a family that a case does not have gives no row.
    """
    seen = records.filter("case_token is not null and day is not null").groupBy("case_token", "day", "second").agg(F.count(F.lit(1)).alias("n"))
    days = seen.groupBy("case_token", "day").agg(F.sum("n").alias("n"), F.max((F.col("n") > 1) & F.col("second").isNotNull()).alias("tied"))
    following = F.lead("day").over(Window.partitionBy("case_token").orderBy("day"))
    per = days.withColumn("next", following).groupBy("case_token").agg(
        F.min("day").alias("first"), F.max("day").alias("last"), F.max(F.when(F.col("next") - F.col("day") > 1, F.struct((F.col("next") - F.col("day")).alias("size"), (-F.col("day")).alias("early"), "day", "next"))).alias("gap"),
        F.max(F.struct("n", (-F.col("day")).alias("early"), "day")).alias("busy"), F.min(F.when(F.col("tied"), F.col("day"))).alias("tie"),
    )
    none = F.lit(None).cast("int")
    family = lambda name, low, high, a, b, how: F.struct(F.lit(name).alias("family"), low.cast("int").alias("low"), high.cast("int").alias("high"), F.lit(a).alias("include_low"), F.lit(b).alias("include_high"), F.lit(how).alias("selection"))
    c = F.col
    made = F.array_compact(F.array(
        F.when(c("gap").isNotNull(), family("gap", c("gap.day"), c("gap.next"), False, False, "all")), family("after_last", c("last"), none, False, False, "first"),
        family("full_span", c("first"), c("last"), True, True, "all"), family("inside_span", c("first"), c("last"), False, False, "all"), family("busiest_day", c("busy.day"), c("busy.day"), True, True, "all"),
        F.when(c("tie").isNotNull(), family("tie_day", c("tie"), c("tie"), True, True, "latest")),
    ))
    return per.select("case_token", F.explode(made).alias("t")).select("case_token", "t.*")


def day_timeline(rows: DataFrame, *, item: str, number: Column, low: float, high: float, other: Column) -> DataFrame:
    """``case_token, day, day_index, rows, items, below, above, others`` of each day of each case.

    ``day_index`` counts days from the case's first one; ``others`` are rows of the other kind. Rows without day are left out.
    """
    days = rows.filter("day is not null").groupBy("case_token", "day").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(item).alias("items"), F.count_if(number < low).alias("below"), F.count_if(number > high).alias("above"), F.count_if(other).alias("others"))
    first = F.min("day").over(Window.partitionBy("case_token"))
    return days.select("case_token", "day", (F.col("day") - first).alias("day_index"), "rows", "items", "below", "above", "others")


def case_timeline(rows: DataFrame, other: Column) -> DataFrame:
    """``case_token, first_day, last_day, span, active_days, shared_days, undated``: shared days have rows of both kinds."""
    days = rows.groupBy("case_token", "day").agg(F.count(F.lit(1)).alias("n"), F.max(held(other)).alias("a"), F.max(~held(other)).alias("b"))
    dated = F.col("day").isNotNull()
    return days.groupBy("case_token").agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), (F.max("day") - F.min("day")).alias("span"), F.count("day").alias("active_days"), F.count_if(dated & F.col("a") & F.col("b")).alias("shared_days"), F.coalesce(F.sum(F.when(~dated, F.col("n"))), F.lit(0)).alias("undated"))


def cohort_of(timelines: DataFrame, span: int = 30) -> DataFrame:
    """``cases, long_cases, active_days, shared_cases`` over case timelines."""
    return timelines.agg(F.count(F.lit(1)).alias("cases"), F.count_if(F.col("span") > span).alias("long_cases"), F.coalesce(F.sum("active_days"), F.lit(0)).alias("active_days"), F.count_if(F.col("shared_days") > 0).alias("shared_cases"))


def completed(parseable: Column, rows: Column, truth: Column, resolved: Column, share: float = 0.9) -> Column:
    """Whether an answer is complete: readable, not empty, with enough of the true rows, and every citation resolves."""
    return held(parseable) & held(rows > 0) & held(rows >= share * truth) & held(resolved)


def resampled(groups: DataFrame, cluster: str, total: str, number: str, *, replicates: int, seed: str) -> DataFrame:
    """``replicate, mean``: the mean of each bootstrap sample of whole clusters.

    ``groups`` has one row per cluster with its total and number. A cluster is drawn a Poisson number of times, told
    by a digest of seed, replicate and cluster, so samples do not hang on how rows are spread; each row is repeated
    once per replicate and summed where it is. Null clusters take no part.
    """
    drawn = groups.filter(F.col(cluster).isNotNull()).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    part = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("replicate").cast("string"), F.col(cluster).cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    times = sum((F.when(F.col("part") >= p, 1).otherwise(0) for p in POISSON), F.lit(0))
    weighted = drawn.withColumn("part", part).withColumn("times", times)
    return weighted.groupBy("replicate").agg((F.sum(F.col("times") * F.col(total)) / F.sum(F.col("times") * F.col(number))).alias("mean"))


def interval(samples: DataFrame, value: str, level: float = 0.95) -> DataFrame:
    """``low, middle, high``: percentiles of the replicates' values."""
    tail = (1 - level) / 2
    return samples.agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(0.5)).alias("middle"), F.percentile(value, F.lit(1 - tail)).alias("high"))


def identity_counts(rows: DataFrame, identities: Mapping[str, Sequence[Column]]) -> DataFrame:
    """One row with the number of distinct values under each identity, which are counted in one pass; null parts are values."""
    whole = {n: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)]) for n, cols in identities.items()}
    return rows.agg(*[F.count_distinct(c).alias(n) for n, c in whole.items()])


def stability(rows: DataFrame, keys: Sequence[str], value: Column, least: int = 2) -> DataFrame:
    """``repeats, lowest, highest, spread`` of a measure per key, of keys measured at least so many times."""
    per = rows.groupBy(*keys).agg(F.count(value).alias("repeats"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    return per.filter(F.col("repeats") >= least).withColumn("spread", F.col("highest") - F.col("lowest"))


def key_difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``key, side``: keys that only one side has, in order of use; null is no key."""
    a = left.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("a", F.lit(True))
    b = right.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("b", F.lit(True))
    both = a.join(b, key, "full_outer").filter("a is null or b is null")
    return both.select(key, F.when(F.col("a"), "left").otherwise("right").alias("side"))
