"""Checks that report every violation as a row with a stable code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daywise.operators.ledger import reason_codes

ROLES = ("sampling", "report", "collection", "receipt", "unknown")
BINDINGS = ("explicit", "conflicting", "unresolved", "unknown")
EVIDENCE_KINDS = ("row", "date", "role", "scope")
#: Identifiers that must not leave in clear text.
RAW_MARKERS = r"(?i)(?:\braw_ocr\b|身份证|住院号|patient[_ ]?name|\b\d{17}[\dx]\b)"


def blank(col: Column) -> Column:
    return col.isNull() | (F.trim(col) == "")


def observation_violations(observations: DataFrame) -> DataFrame:
    """``observation_id, case_token, code`` of observations that cannot be scored.

    Required texts, unique ids per case, distinct non-blank source lines, known roles and bindings, provenance of
    dated assertions, support of bound ones, no assertion twice, and a stated sampling status.
    """
    t = F.col("time_assertions")
    bound = lambda a: a["binding_status"].isin("explicit", "conflicting")
    missing_text = blank(F.col("observation_id")) | blank(F.col("case_token")) | blank(F.col("item")) | blank(F.col("value")) | blank(F.col("unit"))
    refs = F.col("source_refs")
    codes = reason_codes([
        ("OBSERVATION_FIELDS_INVALID", missing_text), ("DUPLICATE_OBSERVATION_ID", F.col("copies") > 1),
        ("SOURCE_REFS_INVALID", refs.isNull() | (F.size(refs) < 1) | F.exists(refs, blank) | (F.size(F.array_distinct(refs)) != F.size(refs))),
        ("TIME_ASSERTIONS_INVALID", t.isNull() | (F.size(t) < 1)),
        ("TIME_STATUS_INVALID", F.exists(t, lambda a: ~F.coalesce(a["role"].isin(*ROLES) & a["binding_status"].isin(*BINDINGS), F.lit(False)))),
        ("DATED_ASSERTION_MISSING_PROVENANCE", F.exists(t, lambda a: a["relative_day"].isNotNull() & (blank(a["coordinate_id"]) | blank(a["date_ref"])))),
        ("BOUND_ASSERTION_MISSING_SUPPORT", F.exists(t, lambda a: bound(a) & (a["relative_day"].isNull() | (a["role"] == "unknown") | blank(a["role_ref"]) | blank(a["scope_ref"])))),
        ("DUPLICATE_TIME_ASSERTION", F.size(F.array_distinct(t)) != F.size(t)),
        ("SAMPLING_STATUS_MISSING", t.isNotNull() & ~F.exists(t, lambda a: a["role"] == "sampling")),
    ])
    copies = F.count(F.lit(1)).over(Window.partitionBy("case_token", "observation_id"))
    return observations.withColumn("copies", copies).select("observation_id", "case_token", F.explode(codes).alias("code"))


def evidence_violations(observations: DataFrame, evidence: DataFrame) -> DataFrame:
    """``ref, code``: source lines that are no row evidence, are owned by several observations, or lie in another case."""
    used = observations.select("observation_id", "case_token", F.explode("source_refs").alias("ref")).distinct()
    known = evidence.groupBy(F.col("evidence_id").alias("ref")).agg(F.max("kind").alias("kind"), F.max("case_token").alias("own_case"), F.count(F.lit(1)).alias("entries"))
    per = used.groupBy("ref").agg(F.count_distinct("observation_id").alias("owners"), F.min("case_token").alias("a"), F.max("case_token").alias("b")).join(known, "ref", "left")
    codes = reason_codes([("GOLD_ROW_REFERENCE_INVALID", F.col("kind").isNull() | (F.col("kind") != "row")), ("GOLD_DUPLICATE_EVIDENCE", F.col("entries") > 1), ("GOLD_ROW_OWNERSHIP_AMBIGUOUS", F.col("owners") > 1), ("GOLD_CROSS_CASE_REFERENCE", (F.col("a") != F.col("own_case")) | (F.col("b") != F.col("own_case")))])
    return per.select("ref", F.explode(codes).alias("code"))


def field_state(payload: Column, name: str) -> Column:
    """``missing``, ``empty`` or ``value`` of a field of a JSON object; null counts as missing, as does no object."""
    whole = F.try_parse_json(payload)
    kind = F.schema_of_variant(F.try_variant_get(whole, f"$['{name}']", "variant"))
    text = F.to_json(F.try_variant_get(whole, f"$['{name}']", "variant"))
    return F.when(kind.isNull() | (kind == "VOID") | (text == "null"), "missing").when(text.isin('""', "[]", "{}"), "empty").otherwise("value")


def gate(requests: DataFrame, checks: Sequence[tuple[str, Column]], key: str) -> DataFrame:
    """``key, decision, reasons``: block with every reason that holds, else allow."""
    codes = reason_codes(checks)
    return requests.select(key, F.when(F.size(codes) == 0, "allow").otherwise("block").alias("decision"), F.array_join(codes, ",").alias("reasons"))


def request_checks(destinations: Sequence[str], purpose: str, required: Sequence[str]) -> list[tuple[str, Column]]:
    """The policy on outgoing requests, over columns of a request table."""
    raw = F.col("payload_mode") == "raw_test"
    return [
        ("destination_not_approved", ~F.coalesce(F.col("destination").isin(*destinations), F.lit(False))), ("payload_mode_missing_or_invalid", ~F.coalesce(F.col("payload_mode").isin("raw_test", "deidentified_test", "synthetic"), F.lit(False))),
        ("raw_test_authorization_missing", raw & ~F.coalesce("raw_test_authorized", F.lit(False))), ("api_ready_not_true", ~F.coalesce(raw, F.lit(False)) & ~F.coalesce("api_ready", F.lit(False))), ("source_version_or_hash_missing", blank(F.col("source_version")) | blank(F.col("source_sha256"))),
        ("review_scope_missing", blank(F.col("review_scope"))), ("purpose_mismatch", ~F.col("purpose").eqNullSafe(purpose)), ("task_fields_missing", F.size(F.array_except(F.array(*[F.lit(f) for f in required]), F.coalesce("task_fields", F.array().cast("array<string>")))) > 0),
        ("raw_identifier_marker_in_messages", ~F.coalesce(raw, F.lit(False)) & F.col("messages").rlike(RAW_MARKERS)),
    ]


def missing_parts(require_unit: bool = True) -> Column:
    """What a candidate record lacks, for ``complete`` or ``incomplete``: value, unit, collection time, anchors."""
    return reason_codes([("VALUE_MISSING", F.col("value").isNull()), ("UNIT_MISSING", F.lit(require_unit) & F.col("unit").isNull()), ("COLLECTION_TIME_MISSING", F.col("clock").isNull() & F.col("day_offset").isNull()), ("COLLECTION_ANCHOR_MISSING", F.col("collection_ref").isNull()), ("REPORT_ANCHOR_MISSING", F.col("report_ref").isNull())])


def candidate_state(require_unit: bool = False) -> tuple[Column, Column]:
    """``status, missing`` of a candidate measurement: ``invalid_task`` without an anchored identity, else whether anything is missing."""
    missing = reason_codes([("value", F.col("value").isNull()), ("collection_time_role", F.col("collection_time").isNull()), ("source_anchor", F.coalesce(F.size("source_refs"), F.lit(0)) < 1), ("unit", F.lit(require_unit) & F.col("unit").isNull())])
    valid = F.coalesce(F.col("identity_status") == "explicit", F.lit(False))
    return F.when(~valid, "invalid_task").when(F.size(missing) == 0, "complete").otherwise("incomplete"), F.when(valid, missing).otherwise(F.array(F.lit("identity")))


def unresolved_parts() -> Column:
    """The codes of what a candidate measurement does not tell: value, unit, collection time and both anchors."""
    return reason_codes([("VALUE_MISSING", F.col("value").isNull()), ("UNIT_MISSING", F.col("unit").isNull()), ("COLLECTION_TIME_MISSING", F.col("collection_time").isNull()), ("COLLECTION_ANCHOR_MISSING", F.col("collection_ref").isNull()), ("REPORT_ANCHOR_MISSING", F.col("report_ref").isNull())])
