"""Drifting schemas and differing units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daywise.operators.schema_drift import consistent_snapshots, schema_changes
from daywise.operators.unify_units import recorded_elsewhere, unify_units
from daywise.sources.tables import table


def _unit_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, t) for t in ("unified_fixture_submission", "item_unit", "item_alias"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "source_snapshot"))


def p1_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_snapshots(table(spark, sf_dir, "source_snapshot"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded_elsewhere(*_unit_tables(spark, sf_dir))


def p2_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify_units(*_unit_tables(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p1_found, p1_snapshots, p2_found, p2_common)}
ORACLE: dict[str, str] = {}
