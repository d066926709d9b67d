"""The append-only ledger as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daywise.sources.documents import LEDGER


def ledger_stream(spark: SparkSession, folder: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """Ledger rows as their files land; ``landed_at`` is the file's time."""
    rows = spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return rows.withColumn("landed_at", F.col("_metadata.file_modification_time")).filter("task_id is not null")


def first_rows(stream: DataFrame, *, late: str = "7 days") -> DataFrame:
    """Each job's first row; repeats within the watermark are dropped, and state older than it is let go."""
    return stream.withWatermark("landed_at", late).dropDuplicatesWithinWatermark(["task_id", "arm"])


def running_totals(stream: DataFrame, *, late: str = "7 days", width: str = "1 hour") -> DataFrame:
    """Per arm and window: rows, tokens and cost."""
    out = stream.withWatermark("landed_at", late).groupBy(F.window("landed_at", width).alias("w"), "arm")
    return out.agg(F.count(F.lit(1)).alias("rows"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("cost_usd")).select("arm", F.col("w.start").alias("started"), "rows", "tokens_in", "tokens_out", "cost_usd")


def append_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """What is available now, appended as JSON lines; resumed by the checkpoint after a failure."""
    return stream.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
