"""Several documents of a case on one day axis, audited against their redacted twins.

``raw`` and ``redacted`` have ``case_token, document_token, line_index, page_number, bbox, text, confidence``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from daywise.functions.dates import MASK_PATTERN, REACH, TOKEN_PATTERN, dates_of, plain_space, relative_text


def document_anchors(raw: DataFrame) -> DataFrame:
    """``document_token, anchor``: the least date within reach before the document's latest.

    Dates are taken line by line and brought together as dates, so no document's text is gathered in one place.
    Lines whose dates are ambiguous give none.
    """
    days = raw.select("document_token", F.explode(dates_of(plain_space(F.coalesce("text", F.lit(""))))["dates"]).alias("day"))
    latest = F.max("day").over(Window.partitionBy("document_token"))
    return days.withColumn("latest", latest).filter(F.datediff("latest", "day") <= REACH).groupBy("document_token").agg(F.min("day").alias("anchor"))


def date_audit(raw: DataFrame, redacted: DataFrame) -> DataFrame:
    """``document_token, line_index, ordinal, day, legacy_day, binding, issue``: dates that both layers bear out.

    Lines pair by page and box. Where the redacted line has relative days, its dates must be as many, replay to the
    same tokens and lie as many days from the anchor; where it has only masks, as many masks as dates and days within
    reach count as candidates by place. What does not is one row with its issue. Lines of no date have no row.
    """
    place = ["document_token", "page_number", F.to_json("bbox").alias("place")]
    b = redacted.select(*place, F.col("text").alias("shown"))
    a = raw.select(*place, "line_index", "text", "confidence").join(b, ["document_token", "page_number", "place"]).join(document_anchors(raw), "document_token", "left")
    text = F.coalesce("text", F.lit(""))
    seen = a.withColumns({"found": dates_of(text), "replay": relative_text(text, F.col("anchor"))})
    tokens, again = F.regexp_extract_all("shown", F.lit(TOKEN_PATTERN), 1), F.regexp_extract_all("replay", F.lit(TOKEN_PATTERN), 1)
    seen = seen.select("document_token", "line_index", "anchor", "confidence", F.col("found.dates").alias("dates"), F.col("found.reason").alias("reason"), tokens.alias("tokens"), again.alias("again"), F.size(F.regexp_extract_all("shown", F.lit(MASK_PATTERN), 0)).alias("masks"), text.rlike(MASK_PATTERN).alias("masked_before"))
    offsets = F.transform("dates", lambda d: F.datediff(d, F.col("anchor")).cast("string"))
    unsure = ~F.coalesce(F.col("confidence") >= 0.8, F.lit(False))
    by_token = (
        F.when(F.col("anchor").isNull(), "missing_legacy_anchor").when(F.exists("tokens", lambda t: F.startswith(t, F.lit("-"))), "legacy_malformed_negative_token").when(unsure, "low_confidence_source").when(F.col("again") != F.col("tokens"), "legacy_replay_mismatch")
        .when(F.col("reason").isNotNull(), F.col("reason")).when(F.size("dates") != F.size("tokens"), "date_token_count_mismatch").when(offsets != F.col("tokens"), "explicit_date_relative_value_mismatch")
    )
    any_date = (F.size("dates") > 0) | F.col("reason").isNotNull()
    by_mask = (
        F.when((F.col("masks") == 0) | (F.size("dates") == 0) | F.col("reason").isNotNull(), F.when(any_date, "source_date_not_retained_as_relative_token")).when(F.col("masked_before"), "source_only_preexisting_date_mask")
        .when(F.col("anchor").isNull(), "source_only_missing_anchor").when(unsure, "source_only_low_confidence").when(F.col("masks") != F.size("dates"), "source_only_date_mask_count_mismatch")
    )
    with_tokens = F.size("tokens") > 0
    judged = seen.withColumn("issue", F.when(with_tokens, by_token).otherwise(by_mask)).filter(with_tokens | any_date)
    bad = judged.filter("issue is not null").select("document_token", "line_index", F.lit(0).alias("ordinal"), F.lit(None).cast("date").alias("day"), F.lit(None).cast("int").alias("legacy_day"), F.lit(None).cast("string").alias("binding"), "issue")
    good = judged.filter("issue is null").select("document_token", "line_index", "anchor", "tokens", F.posexplode("dates").alias("ordinal", "day"))
    far = ~F.datediff("day", "anchor").between(0, REACH) & (F.size("tokens") == 0)
    done = good.select("document_token", "line_index", "ordinal", "day", F.try_element_at("tokens", F.col("ordinal") + 1).cast("int").alias("legacy_day"), F.when(F.size("tokens") > 0, "sequence_replay_verified").otherwise("bbox_only_candidate").alias("binding"), F.when(far, "source_only_outside_legacy_window").alias("issue"))
    return bad.unionByName(done)


def case_sidecar(candidates: DataFrame, cases: DataFrame) -> DataFrame:
    """``case_token, document_token, line_index, ordinal, day, coordinate_day, coordinate_id`` of sound candidates.

    The case's origin is the least by (replayed first, day, document, line, ordinal); it stays when later documents
    come in only if it is passed on by the caller as a candidate.
    """
    sound = candidates.filter("issue is null").join(cases.select("document_token", "case_token").distinct(), "document_token")
    first = F.min(F.struct(F.col("legacy_day").isNull().alias("other"), "day", "document_token", "line_index", "ordinal")).over(Window.partitionBy("case_token"))
    seen = sound.withColumn("o", first)
    ident = F.concat(F.lit("day0-"), F.substring(F.sha2(F.concat_ws("|", "case_token", F.col("o.document_token"), F.col("o.day").cast("string"), F.col("o.line_index").cast("string"), F.col("o.ordinal").cast("string")), 256), 1, 12))
    return seen.select("case_token", "document_token", "line_index", "ordinal", "day", F.datediff("day", F.col("o.day")).alias("coordinate_day"), ident.alias("coordinate_id"))


def issue_counts(candidates: DataFrame) -> DataFrame:
    return candidates.filter("issue is not null").groupBy("document_token", "issue").agg(F.count(F.lit(1)).alias("rows"))
