"""JSON documents, JSON-lines ledgers and their sinks.

Schemas are declared, never inferred; a supported version is required, and missing files are an error with a code
or, for ledgers, an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUPPORTED_VERSIONS = ("0.9", "1.0")
LINE = "struct<case_token:string,document_token:string,page_number:int,bbox:array<array<double>>,text:string,confidence:double,source_kind:string>"
HIT = "array<struct<page_number:int,rule:string>>"
LAYOUT = f"schema_version string, sensitivity string, case_token string, document_token string, page_count int, line_count int, pages array<struct<page_number:int,image_width:int,image_height:int>>, records array<{LINE}>"
REDACTED = f"{LAYOUT}, basic_rule_scan_passed boolean, manual_privacy_review_required boolean, api_ready boolean, redaction_hit_count int, redaction_hits {HIT}, quarantine_required boolean, privacy_status string, residual_scan_hit_count int, residual_scan_hits {HIT}, quality_warning_hit_count int, quality_warning_hits {HIT}"
LEDGER = "task_id string, arm string, model_requested string, model_returned string, status string, attempts int, plan_ok boolean, plan_problems array<string>, execute_problems array<string>, tokens_in long, tokens_out long, cost_usd double, latency_s double, retrieved_lines int, response_file string, identity_digest string"
BUNDLE = "probe_version string, scorer_sha256 string, tasks array<struct<task_id:string,instruction:string,contract:string,reference:string,records:string,context:map<string,string>>>"


class SourceError(ValueError):
    """A source that cannot be used; its text is a stable code."""


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def json_documents(spark: SparkSession, path: str, schema: str = LAYOUT) -> DataFrame:
    """Whole-file JSON documents with their path; unreadable text fails, a path without files is SOURCE_MISSING."""
    if not _exists(spark, path):
        raise SourceError("SOURCE_MISSING")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("source_path", F.col("_metadata.file_path"))


def json_lines(spark: SparkSession, path: str, schema: str = LEDGER) -> DataFrame:
    """A JSON-lines ledger; blank lines are passed over, a missing file is an empty ledger."""
    if not _exists(spark, path):
        return spark.createDataFrame([], T._parse_datatype_string(schema))
    return spark.read.schema(schema).json(path).filter(" or ".join(f"`{c}` is not null" for c in T._parse_datatype_string(schema).names))


def unsupported_versions(documents: DataFrame) -> DataFrame:
    """``document_token, code``: SCHEMA_VERSION_MISSING or SCHEMA_VERSION_UNSUPPORTED."""
    code = F.when(F.col("schema_version").isNull(), "SCHEMA_VERSION_MISSING").when(~F.col("schema_version").isin(*SUPPORTED_VERSIONS), "SCHEMA_VERSION_UNSUPPORTED")
    return documents.select("document_token", code.alias("code")).filter("code is not null")


def document_lines(documents: DataFrame) -> DataFrame:
    """One row per line of each document, with its place."""
    return documents.select("case_token", "document_token", F.posexplode("records").alias("line_index", "line")).select("case_token", "document_token", "line_index", "line.page_number", "line.bbox", "line.text", "line.confidence", "line.source_kind")


def scan_limits(spark: SparkSession, pattern: str, *, files: int = 30, total_bytes: int = 40 << 20) -> DataFrame:
    """``files, bytes, within``: whether a glob of files keeps to the limits; contents are not read."""
    seen = spark.read.format("binaryFile").load(pattern).select("path", "length")
    return seen.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("within", (F.col("files") <= files) & (F.col("bytes") <= total_bytes))


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, sha256`` of whole files, for joins with manifests."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.sha2("content", 256).alias("sha256"))


def saved_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """``task_id, arm, attempt, path`` of files named ``task__arm__attemptN.json``."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*__*__attempt*.json").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    pattern = r"^(.+)__(.+)__attempt(\d+)\.json$"
    return names.select(F.regexp_extract("name", pattern, 1).alias("task_id"), F.regexp_extract("name", pattern, 2).alias("arm"), F.regexp_extract("name", pattern, 3).cast("int").alias("attempt"), "path")


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def replace_table(rows: DataFrame, path: str) -> None:
    """Whole replacement by the commit protocol: readers see the old or the new files."""
    rows.write.mode("overwrite").json(path)


def create_only(rows: DataFrame, path: str) -> None:
    """A sink that refuses to overwrite: SINK_EXISTS."""
    try:
        rows.write.mode("errorifexists").json(path)
    except AnalysisException as e:
        raise SourceError("SINK_EXISTS") from e


def write_with_summary(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Rows and, beside them, their number per key."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).write.mode("overwrite").json(f"{path}/summary")


def write_rendered(lines: DataFrame, path: str, header: str) -> None:
    """Tab-separated text files, each with the header line."""
    parts = lines.select("line").mapInPandas(lambda batches: _with_header(batches, header), "value string")
    parts.write.mode("overwrite").text(path)


def _with_header(batches, header: str):
    import pandas as pd

    first = True
    for batch in batches:
        values = batch["line"].tolist()
        yield pd.DataFrame({"value": [header, *values] if first else values})
        first = False


def heading_sections(spark: SparkSession, path: str) -> DataFrame:
    """``source_path, heading, line_no, line`` of Markdown files: each line under its last heading, numbering taken off."""
    from pyspark.sql import Window

    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    name = F.when(F.col("line").rlike(r"^#{1,6} "), F.regexp_replace(F.regexp_replace("line", r"^#{1,6} +", ""), r"^[\d.]+\s+", ""))
    order = Window.partitionBy("source_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("heading", F.last(name, ignorenulls=True).over(order)).filter(~F.col("line").rlike(r"^#{1,6} "))


def broken_links(manifest: DataFrame, present: DataFrame, key: str = "path") -> DataFrame:
    """Manifest entries without a file, and files in no manifest: ``path, code``."""
    gone = manifest.select(key).distinct().join(present.select(key), key, "left_anti").select(key, F.lit("MISSING_FILE").alias("code"))
    stray = present.select(key).distinct().join(manifest.select(key), key, "left_anti").select(key, F.lit("NOT_LISTED").alias("code"))
    return gone.unionByName(stray)


def paged_text(texts: DataFrame, text: str, mark: str = "=== PAGE ") -> DataFrame:
    """Rows of page-separated text as ``page_label, page_index, line_no, line``; what stands before a mark is page ``?``."""
    lines = texts.select(*[c for c in texts.columns if c != text], F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
    is_mark = F.startswith("line", F.lit(mark))
    label = F.when(is_mark, F.regexp_replace(F.substr("line", F.lit(len(mark) + 1)), r"[ =]+$", ""))
    from pyspark.sql import Window

    keys = [c for c in texts.columns if c != text]
    order = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lines.withColumns({"page_label": F.coalesce(F.last(label, ignorenulls=True).over(order), F.lit("?")), "page_index": F.sum(is_mark.cast("int")).over(order)})
    return seen.filter(~is_mark).select(*keys, "page_label", "page_index", "line_no", "line")
