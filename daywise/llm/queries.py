"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daywise.llm.consensus import judged_observations
from daywise.llm.plain_form import disguised_fields
from daywise.llm.redaction import personal_items, redacted_lines
from daywise.llm.scan_repair import paragraphs, scan_noise
from daywise.llm.sentences import sentence_positions
from daywise.llm.source_mix import mix_sources
from daywise.llm.tokenize_corpus import encode_documents
from daywise.llm.top_n import latest_records
from daywise.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_records(table(spark, sf_dir, "record_view"), 3)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_observations(table(spark, sf_dir, "review_template"))[0].select("observation_id", "judgment")


def p4_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_observations(table(spark, sf_dir, "review_template"))[0]


def p4_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_observations(table(spark, sf_dir, "review_template"))[1]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_noise(table(spark, sf_dir, "layout_line"))


def p5_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(table(spark, sf_dir, "layout_line"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disguised_fields(table(spark, sf_dir, "record_view"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_items(table(spark, sf_dir, "layout_line")).select("document_token", "line_index", "pii_kind", "occurrence")


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted_lines(table(spark, sf_dir, "layout_line"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_positions(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p4_found, p4_agreement, p4_reviewers, p5_found, p5_paragraphs, p6_found, p7_found, p7_redacted, p8_ids, p9_mix, p9_shares, p10_found)}

ORACLE: dict[str, str] = {
    "p3_found": r"""
WITH clocked AS (
  SELECT record_id, case_token, CAST(day_offset AS BIGINT) AS day, ingested_at, trim(clock) AS c,
         precision IS NOT NULL AND lower(trim(precision)) NOT IN ('', 'day', 'date') AS timed
  FROM record_view),
parsed AS (
  SELECT record_id, case_token, day, ingested_at,
         CASE WHEN timed AND regexp_full_match(c, '([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?')
              THEN CAST(substr(c, 1, 2) AS INTEGER) * 3600 + CAST(substr(c, 4, 2) AS INTEGER) * 60
                   + CASE WHEN length(c) > 5 THEN CAST(substr(c, 7, 2) AS INTEGER) ELSE 0 END END AS second
  FROM clocked),
newest AS (
  SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ingested_at DESC NULLS LAST, day DESC NULLS LAST,
                               second DESC NULLS LAST, case_token DESC NULLS LAST) AS version
  FROM parsed),
ranked AS (
  SELECT case_token, record_id,
         row_number() OVER (PARTITION BY case_token ORDER BY day DESC, second DESC NULLS LAST, record_id) AS rank_no
  FROM newest WHERE version = 1 AND day IS NOT NULL)
SELECT case_token, CAST(rank_no AS INTEGER) AS rank_no, record_id FROM ranked WHERE rank_no <= 3
""",
}
