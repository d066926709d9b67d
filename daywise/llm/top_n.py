"""The N highest-scoring rows of every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywise.functions.clock import clock_seconds

#: Groups that may be salted, and the rows from which one of them is.
HOT_GROUPS, HOT_ROWS = 1000, 10_000


def top_n_per_group(df: DataFrame, keys: Sequence[str], score: Column, ties: Sequence[str], n: int, *, bin_width: int, rank_col: str = "rank_no", salts: int = 32) -> DataFrame:
    """Keep the ``n`` rows of each group with the highest integer ``score``; equal scores rank by ``ties`` ascending.

    Method: one histogram of scores per group (bins of ``bin_width``), summed map-side and added up from the top,
    gives the lowest bin that is needed for ``n`` survivors. Rows below it are filtered; the survivors are ranked
    exactly, first within ``salts`` slices of each group (so that a group whose highest bin alone holds millions of
    rows is not one task's work), then over the at most ``n * salts`` rows left of each group.

    Rows with a null score take no part. Null keys form a group of their own; null ties come last. Repeated rows are
    ranked apart; which of two rows with equal ties comes first is open, so ``ties`` must name what tells rows apart.
    An empty table gives an empty result; groups under ``n`` rows stay whole. All columns are kept, whatever their
    names; one called ``rank_col`` gives way to the rank.
    """
    if n < 1 or bin_width < 1:
        raise ValueError("n and bin_width are at least 1")
    quoted = [F.col(f"`{c}`") for c in df.columns if c != rank_col]
    own, tied = [f"k{i}" for i in range(len(keys))], [f"t{i}" for i in range(len(ties))]
    named = {a: F.col(f"`{c}`") for a, c in zip([*own, *tied], [*keys, *ties])}
    scored = df.select(F.struct(*quoted).alias("row"), *[c.alias(a) for a, c in named.items()], score.cast("long").alias("score"), F.xxhash64(score, *quoted).alias("hash")).filter("score is not null")
    scored = scored.withColumn("bin", F.floor(F.col("score") / F.lit(bin_width)))
    bins = scored.groupBy(*own, "bin").agg(F.count(F.lit(1)).alias("rows"))
    from_top = Window.partitionBy(*own).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The last bin that begins before n rows are reached is the threshold.
    need = bins.withColumn("above", F.sum("rows").over(from_top) - F.col("rows")).filter(F.col("above") < n).groupBy(*own).agg(F.min("bin").alias("least"))
    # The largest groups meet their threshold in `salts` places, not one. They are at most HOT_GROUPS, whatever the
    # data, so they can be broadcast; any other group has less than 1 / HOT_GROUPS of all rows.
    sizes = bins.groupBy(*own).agg(F.sum("rows").alias("size"))
    hot = sizes.orderBy(F.col("size").desc()).limit(HOT_GROUPS).filter(F.col("size") >= HOT_ROWS).select(*[F.col(k).alias(f"{k}_") for k in own], F.lit(True).alias("hot"))

    def same_group(right: str) -> Column:
        on = F.lit(True)
        for k in own:
            on = on & F.col(k).eqNullSafe(F.col(f"{k}{right}"))
        return on

    marked = lambda df: df.join(F.broadcast(hot), same_group("_"), "left").drop(*[f"{k}_" for k in own])
    many = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    need = marked(need).select(*[F.col(k).alias(f"{k}__") for k in own], F.explode(many).alias("salt__"), "least")
    sliced = marked(scored).withColumn("salt", F.when(F.col("hot"), F.pmod("hash", F.lit(salts))).otherwise(0).cast("int"))
    kept = sliced.join(need, same_group("__") & (F.col("salt") == F.col("salt__"))).filter(F.col("bin") >= F.col("least"))
    order = [F.col("score").desc(), *[F.col(t).asc_nulls_last() for t in tied]]
    for part in ([*own, "salt"], own):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("rank") <= n)
    return kept.select("row.*", F.col("rank").cast("int").alias(rank_col))


def latest_records(record_view: DataFrame, n: int = 3) -> DataFrame:
    """``case_token, rank_no, record_id`` of the latest ``n`` records of each case.

    Of rows with one ``record_id`` only that with the latest ``ingested_at`` counts (of several such, the one that
    is greatest by day, clock and case, so every run agrees); records without ``day_offset`` take no part. Order:
    day descending, time of day descending with unusable clocks last, ``record_id``. Rows without a
    ``record_id`` count as one record.
    """
    slim = record_view.select("record_id", "case_token", F.col("day_offset").cast("long").alias("day"), clock_seconds(F.col("clock"), F.col("precision")).alias("second"), "ingested_at")
    last = slim.groupBy("record_id").agg(F.max(F.struct("ingested_at", "day", "second", "case_token")).alias("v"))
    rows = last.select("record_id", "v.case_token", "v.day", "v.second")
    # 86,401 slots a day: slot 0 holds the records without a usable clock.
    score = F.col("day") * 86401 + F.coalesce(F.col("second") + 1, F.lit(0))
    top = top_n_per_group(rows, ["case_token"], score, ["record_id"], n, bin_width=86401)
    return top.select("case_token", "rank_no", "record_id")
