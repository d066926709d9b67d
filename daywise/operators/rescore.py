"""Stored responses scored again without asking anyone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daywise.functions.values import brace_object
from daywise.operators.scoring import score_selections

_ANSWER = "status string, decision string, selected array<string>, selected_records array<struct<record_id:string>>"


def parsed_answers(responses: DataFrame) -> DataFrame:
    """``task_id, arm, status, selected`` of ``task_id, arm, response``; no status for a response without an object."""
    a = F.from_json(brace_object(F.col("response")), _ANSWER)
    seen = responses.select("task_id", "arm", a.alias("a"))
    listed = F.coalesce(F.col("a.selected"), F.transform("a.selected_records", lambda r: r["record_id"]), F.array().cast("array<string>"))
    return seen.select("task_id", "arm", F.lower(F.coalesce("a.status", "a.decision")).alias("status"), F.array_compact(listed).alias("selected"))


def rescored(ledger: DataFrame, responses: DataFrame, reference: DataFrame) -> DataFrame:
    """Every ledger row with its score against the reference; a row without a stored response fails.

    ``task_id, arm`` and the columns of ``score_selections``; fields are not judged, so selections count by set.
    """
    jobs = ledger.select("task_id", "arm").distinct()
    key = F.concat_ws("\x01", "task_id", "arm")
    answers = parsed_answers(responses).filter("status is not null").select(key.alias("task_id"), "status", "selected", F.lit(True).alias("fields_match"))
    wanted = jobs.join(reference, "task_id").withColumn("task_id", key)
    out = score_selections(wanted.drop("arm"), answers)
    return out.select(F.split_part("task_id", F.lit("\x01"), F.lit(1)).alias("task_id"), F.split_part("task_id", F.lit("\x01"), F.lit(2)).alias("arm"), *[c for c in out.columns if c != "task_id"])


def arm_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("arm").agg(F.count(F.lit(1)).alias("tasks"), F.count_if("task_success").alias("successes"), F.count_if(F.col("answer_status") == "format_failure").alias("format_failures"))
