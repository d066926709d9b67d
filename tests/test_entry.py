import __spark_entry__ as entry
import pytest

from daywise.sources.tables import table


def test_names_and_sql():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p1_found", "p2_found"} <= set(queries)


@pytest.mark.parametrize("name", ["c1_latest_at_or_before", "c10_table_rows", "d18_sessions", "p1_found", "p2_found"])
def test_runs_on_the_smallest_tables(spark, name):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_smoke(spark):
    out = entry.entry(spark)
    assert out.columns[:3] == ["task_id", "case_token", "status"] and out.count() == table(spark, "/root/testdata/sf0.001", "record_view").select("case_token").distinct().count()
