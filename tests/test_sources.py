import json

import pytest

from daywise.sources import documents as D
from daywise.sources.rendering import header_line, record_lines
from daywise.streaming import ledger as L


def layout(version="1.0"):
    return {"schema_version": version, "case_token": "A", "document_token": "d", "page_count": 1, "line_count": 2, "pages": [], "records": [{"page_number": 1, "text": "x", "bbox": [[0, 1], [2, 3]], "confidence": 0.5}, {"page_number": 1, "text": None}]}


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(layout(), indent=1))
    (tmp_path / "b.json").write_text(json.dumps(layout("0.7") | {"document_token": "e"}))
    docs = D.json_documents(spark, str(tmp_path / "*.json"))
    assert D.document_lines(docs).count() == 4
    assert [(r.document_token, r.code) for r in D.unsupported_versions(docs).collect()] == [("e", "SCHEMA_VERSION_UNSUPPORTED")]
    with pytest.raises(D.SourceError, match="SOURCE_MISSING"):
        D.json_documents(spark, str(tmp_path / "none*.json"))
    assert D.scan_limits(spark, str(tmp_path / "*.json"), files=1).first().within is False
    digests = D.file_digests(spark, str(tmp_path / "*.json"))
    assert digests.count() == 2 and {r.code for r in D.broken_links(digests, digests.limit(1)).collect()} == {"MISSING_FILE"}


def test_ledger_sinks_and_stream(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert D.json_lines(spark, path).count() == 0
    row = [("t", "x", 1.5, 10)]
    rows = spark.createDataFrame(row, "task_id string, arm string, cost_usd double, tokens_in long")
    for _ in range(2):
        D.append_ledger(rows, path)
    assert D.json_lines(spark, path).count() == 2
    with pytest.raises(D.SourceError, match="SINK_EXISTS"):
        D.create_only(rows, path)
    D.replace_table(rows, str(tmp_path / "new"))
    D.write_with_summary(rows, str(tmp_path / "both"), ["arm"])
    assert spark.read.json(str(tmp_path / "both/summary")).first()["rows"] == 1
    first = L.first_rows(L.ledger_stream(spark, path)).select("task_id", "arm", "cost_usd")
    L.append_to(first, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert L.running_totals(L.ledger_stream(spark, path)).isStreaming


def test_text_sources(spark, tmp_path):
    (tmp_path / "m.md").write_text("# 1.2 Scope\nline one\n## Next\nline two\n")
    assert {r.heading: r.line for r in D.heading_sections(spark, str(tmp_path / "m.md")).filter("line <> ''").collect()} == {"Scope": "line one", "Next": "line two"}
    pages = spark.createDataFrame([("c", "head\n=== PAGE 1 ===\na\nb\n=== PAGE 2 ===\nc")], "case string, body string")
    assert sorted((r.page_label, r.line) for r in D.paged_text(pages, "body").collect()) == [("1", "a"), ("1", "b"), ("2", "c"), ("?", "head")]
    (tmp_path / "t__x__attempt2.json").write_text("{}")
    assert [(r.task_id, r.arm, r.attempt) for r in D.saved_attempts(spark, str(tmp_path)).collect()] == [("t", "x", 2)]
    df = spark.createDataFrame([("r", "A", None, None, "1", None)], "record_id string, case_token string, day_offset int, clock string, value string, unit string")
    D.write_rendered(record_lines(df), str(tmp_path / "tsv"), header_line())
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "tsv")).collect()) == "record_id\tcase_token\tday_offset\tclock\tvalue\tunit\nr\tA\tNone\tNone\t1\tNone"
