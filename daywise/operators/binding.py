"""Candidates bound to rows, event tables, and grounding of claims in their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daywise.operators.layout import header_in_scope

ROLES = ("collection", "report", "sampling", "receipt", "unknown")


def bind_candidates(candidates: DataFrame, rows: DataFrame) -> DataFrame:
    """``candidate_ordinal, row_id, temporal_role, binding_status, code`` of every candidate.

    ``candidates``: ``candidate_ordinal`` and the scope columns ``case_token, document_token, page_number``; ``rows``:
    ``row_id``, the scope, ``candidate_ordinals``, ``temporal_role``. A candidate claimed by several rows is
    AMBIGUOUS_ROW_BINDING, one claimed from another scope SOURCE_SCOPE_MISMATCH; both stay unbound, as do unclaimed
    ones. Claims of unknown candidates are INVALID_CANDIDATE_ORDINAL.
    """
    scope = ("case_token", "document_token", "page_number")
    claims = rows.select("row_id", F.coalesce("temporal_role", F.lit("unknown")).alias("temporal_role"), F.struct(*scope).alias("row_scope"), F.explode(F.array_distinct("candidate_ordinals")).alias("candidate_ordinal"))
    claims = claims.groupBy("candidate_ordinal").agg(F.count(F.lit(1)).alias("claims"), F.min(F.struct("row_id", "temporal_role", "row_scope")).alias("c"))
    both = candidates.select("candidate_ordinal", F.struct(*scope).alias("own_scope")).join(claims, "candidate_ordinal", "full_outer")
    code = F.when(F.col("own_scope").isNull(), "INVALID_CANDIDATE_ORDINAL").when(F.col("claims") > 1, "AMBIGUOUS_ROW_BINDING").when(F.col("claims").isNotNull() & ~F.col("c.row_scope").eqNullSafe(F.col("own_scope")), "SOURCE_SCOPE_MISMATCH").when(~F.col("c.temporal_role").isin(*ROLES), "INVALID_TEMPORAL_ROLE")
    seen = both.withColumn("code", code)
    sound = F.col("code").isNull() & F.col("claims").isNotNull()
    role = F.when(sound, F.col("c.temporal_role")).otherwise("unknown")
    return seen.select("candidate_ordinal", F.when(sound, F.col("c.row_id")).alias("row_id"), role.alias("temporal_role"), F.when(role != "unknown", "explicit").otherwise("unresolved").alias("binding_status"), "code")


def event_table(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """One event per row with the date and role of the one header in scope (see ``header_in_scope``).

    A role of the row's own label wins over the header's; without a role, or with tied headers, the event stays
    unresolved and undated.
    """
    scoped = header_in_scope(rows, headers)
    own = rows.select("document_token", "page_number", F.col("row_id").cast("string").alias("row_id"), "value", "unit", "role")
    theirs = headers.select("document_token", "page_number", F.col("header_id").cast("string").alias("header_id"), F.col("date").alias("header_date"), F.col("role").alias("header_role")).dropDuplicates(["document_token", "page_number", "header_id"])
    both = own.join(scoped, ["document_token", "page_number", "row_id"]).join(theirs, ["document_token", "page_number", "header_id"], "left")
    role = F.coalesce("role", "header_role", F.lit("unknown"))
    bound = F.col("header_id").isNotNull() & (role != "unknown")
    return both.select("document_token", "page_number", "row_id", "value", "unit", F.when(bound, F.col("header_date")).alias("event_date"), role.alias("temporal_role"), F.when(bound, "explicit").otherwise("unresolved").alias("binding_status"))


def grounding(claims: DataFrame, lines: DataFrame, context: int = 6) -> DataFrame:
    """Per document: claims, cited lines that exist, and shares of values and units found verbatim near them.

    ``claims``: ``document_token, line_index, value, unit``; the cited line and ``context`` lines after it count as
    near, read by one window over the document.
    """
    order = Window.partitionBy("document_token").orderBy("line_index")
    near = F.array_join(F.collect_list("text").over(order.rowsBetween(0, context)), "\n")
    seen = lines.select("document_token", "line_index", near.alias("near"))
    both = claims.join(seen, ["document_token", "line_index"], "left")
    held = lambda c: F.coalesce(F.contains("near", F.col(c)), F.lit(False))
    return both.groupBy("document_token").agg(F.count(F.lit(1)).alias("claims"), F.count("near").alias("resolvable"), F.count_if(held("value")).alias("value_verbatim"), F.count_if(held("unit")).alias("unit_verbatim"))
