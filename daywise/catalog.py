"""All queries of the core, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from daywise.workload import checks, cohort, general, layout, ledger, questions, scoring, selection

FLAGSHIP = "c1_latest_at_or_before"
_FAMILIES = (selection, scoring, layout, checks, ledger, cohort, questions, general)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for f in _FAMILIES for k, v in f.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for f in _FAMILIES for k, v in f.ORACLE.items()}
