"""Sources mixed to target weights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daywise.llm.tokenize_corpus import token_counts
from daywise.session import spread, stored

#: Targets are few; their table is collected and its size checked.
MOST_TARGETS = 100_000
BUCKETS = 1024


def fit_budget(lengths: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many documents of each length to take, for a total as near ``budget`` as can be, not above it if possible.

    ``lengths`` are (tokens, documents). Documents are first taken in proportion to their number, so lengths keep
    their mix; as many are given back, from the longest on, as leave room of eight times the longest document, and
    what remains is a bounded knapsack (``_nearest_sum``) over all lengths, whatever these are.
    """
    lengths = sorted((n, c) for n, c in lengths if n > 0 and c > 0)
    total = sum(n * c for n, c in lengths)
    if budget <= 0 or not lengths:
        return {}
    if budget >= total:
        return dict(lengths)
    taken = {n: c * budget // total for n, c in lengths}
    rest = budget - sum(n * k for n, k in taken.items())
    room = 8 * lengths[-1][0]
    for n, c in reversed(lengths):  # what rounding left beyond the room
        more = min(c - taken[n], max(0, rest - room) // n)
        taken[n] += more
        rest -= more * n
    for n, _ in reversed(lengths):
        back = min(taken[n], max(0, room - rest) // n)
        taken[n] -= back
        rest += back * n
    for n, k in _nearest_sum([(n, c - taken[n]) for n, c in lengths], rest).items():
        taken[n] += k
    return {n: k for n, k in taken.items() if k}


def _nearest_sum(lengths: list[tuple[int, int]], rest: int) -> dict[int, int]:
    """Counts of each length, at most the given ones, whose sum is nearest to ``rest`` (of two, the lower).

    Each length's count is split into powers of two. For every sum up to the longest document beyond ``rest`` the part
    that reached it first is kept (four bytes a token of that span), from which the best sum is walked back: a sum's
    first part is later than those of the sum it was reached from, so no part is used twice. It ends as soon as
    ``rest`` itself is reached.
    """
    limit = rest + max(n for n, _ in lengths)
    first = np.full(limit + 1, -1, dtype=np.int32)
    first[0] = 0
    parts: list[tuple[int, int]] = [(0, 0)]
    for n, c in lengths:
        free, size = min(c, limit // n), 1
        while free > 0 and first[rest] < 0:
            size = min(size, free)
            step = n * size
            fresh = (first[: limit + 1 - step] >= 0) & (first[step:] < 0)
            if fresh.any():
                first[step:][fresh] = len(parts)
            parts.append((n, size))
            free -= size
            size *= 2
    reached = np.nonzero(first >= 0)[0]
    best = int(reached[np.argmin(np.abs(reached - rest))])
    out: dict[int, int] = {}
    while best:
        n, size = parts[first[best]]
        out[n] = out.get(n, 0) + size
        best -= n * size
    return out


def mix_plan(sizes: DataFrame, mix_target: DataFrame, total_tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What to take: ``source, n_tokens, whole, extra`` per length, and the sources with their budgets.

    ``sizes`` has ``source, n_tokens``. Weights of sources that have no tokens are shared out among the others in
    proportion. Without ``total_tokens`` the total is the largest at which every source reaches its share within its
    repeats.
    """
    targets = mix_target.groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") > 0).alias("documents"))
    rows = targets.filter("source is not null and target_weight > 0 and max_repeats > 0").join(held, "source", "left").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} sources with a target")
    live = [r for r in rows if (r.tokens or 0) > 0]
    weight = sum(r.target_weight for r in live)
    most = min((int(r.tokens * r.max_repeats / (r.target_weight / weight)) for r in live), default=0)
    total = most if total_tokens is None else total_tokens
    plans = []
    for r in live:
        budget = min(round(total * r.target_weight / weight), r.tokens * r.max_repeats)
        whole = min(budget // r.tokens, r.max_repeats)
        plans.append((r.source, r.target_weight, r.target_weight / weight, r.max_repeats, r.documents, r.tokens, budget, int(whole), int(budget - whole * r.tokens) if whole < r.max_repeats else 0))
    spark = sizes.sparkSession
    plan = spark.createDataFrame(plans, "source string, target_weight double, live_weight double, max_repeats int, documents long, tokens long, budget long, whole int, rest long")
    lengths = sizes.filter("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("docs")).join(F.broadcast(plan.select("source", "whole", "rest")), "source")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        take = fit_budget(list(zip(group["n_tokens"].tolist(), group["docs"].tolist())), int(group["rest"].iloc[0]))
        return pd.DataFrame({"source": group["source"], "n_tokens": group["n_tokens"], "whole": group["whole"], "extra": [take.get(n, 0) for n in group["n_tokens"]]})

    # One row per exact length of a source: the group is a histogram, not the source's documents.
    return lengths.groupBy("source").applyInPandas(fitted, "source string, n_tokens long, whole int, extra long"), plan


def mix_sources(documents: DataFrame, mix_target: DataFrame, *, total_tokens: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """``doc_id, source, n_tokens, repeats`` of the documents used, and the report of each source's share.

    Method: documents are counted by exact token length; each source's budget is whole copies of all its documents
    and a rest that a bounded-knapsack dynamic program meets by counts per length; documents are then chosen by
    seeded hash to these counts (by counted hash buckets, ranked only in the last bucket). No document is used more
    than ``max_repeats`` times. Documents without tokens, of no source or of one without target are not used.
    Repeated rows of an id and source count once, with the most tokens. The report ``source, target_weight, live_weight, max_repeats, documents,
    tokens, used_tokens, share`` has every source with a target or documents; a null source is reported as such.
    """
    # Texts are counted where they are read; only the counts are shuffled.
    sized = spread(documents.select("doc_id", "source", "text")).select("doc_id", "source", token_counts("text").alias("n_tokens"))
    docs = stored(sized.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens")))
    takes, plan = mix_plan(docs, mix_target, total_tokens)
    takes = stored(takes)
    marked = docs.filter("n_tokens > 0").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("b", F.pmod("h", F.lit(BUCKETS)))
    counted = marked.groupBy("source", "n_tokens", "b").agg(F.count(F.lit(1)).alias("n")).join(takes, ["source", "n_tokens"])
    before = F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    need = counted.withColumn("need", F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - before))).filter("whole > 0 or need > 0")
    chosen = marked.join(need, ["source", "n_tokens", "b"])
    sure = chosen.filter("need = 0 or need = n").withColumn("more", (F.col("need") > 0).cast("int"))
    ranked = chosen.filter("need > 0 and need < n").withColumn("rank", F.row_number().over(Window.partitionBy("source", "n_tokens", "b").orderBy("h", "doc_id")))
    ranked = ranked.withColumn("more", (F.col("rank") <= F.col("need")).cast("int")).drop("rank")
    used = sure.unionByName(ranked).select("doc_id", "source", "n_tokens", (F.col("whole") + F.col("more")).cast("int").alias("repeats")).filter("repeats > 0")

    sums = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"))
    all_sources = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
    targets = mix_target.filter("source is not null").groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    report = all_sources.join(targets, "source", "full_outer").join(plan.select("source", "live_weight"), "source", "left").join(sums, "source", "left")
    report = report.fillna(0, ["documents", "tokens", "used_tokens"])
    whole = sums.agg(F.sum("used_tokens")).scalar()
    return used, report.select("source", "target_weight", "live_weight", "max_repeats", "documents", "tokens", "used_tokens", F.when(whole > 0, F.col("used_tokens") / whole).alias("share"))
