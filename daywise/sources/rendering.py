"""Text renderings of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("record_id", "case_token", "day_offset", "clock", "value", "unit")


def record_lines(records: DataFrame, columns: Sequence[str] = COLUMNS, limit: int | None = None) -> DataFrame:
    """``record_id, line``: each record as tab-separated text; nulls print as ``None``, whole numbers without a point."""
    parts = [F.coalesce(F.col(c).cast("int").cast("string") if c.endswith("day_offset") else F.col(c).cast("string"), F.lit("None")) for c in columns]
    out = records.select("record_id", F.concat_ws("\t", *parts).alias("line"))
    return out if limit is None else out.orderBy("record_id").limit(limit)


def header_line(columns: Sequence[str] = COLUMNS) -> str:
    return "\t".join(columns)
