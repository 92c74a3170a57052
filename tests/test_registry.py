import duckdb
import pytest

import __spark_entry__ as driver
from workload import registry
from workload.check import TABLES, check

SF = "/root/testdata/sf0.001"

SAMPLE = (
    "scan_counts secrets_code route_handlers manifest_dispatch affected_dependencies affected_salted"
    " upsert title_search scan_summary diagnostics throttle throttle_one_client debounce live_events"
).split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(registry.SQL) == set(registry.QUERIES)
    assert registry.QUERIES.items() <= driver.queries().items()
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    result = check(spark, con, SF, name)
    assert result.startswith("ok") and "EMPTY" not in result, result


def test_history_reports_every_scan(spark, con, tables):
    result = check(spark, con, SF, "history")
    assert result.startswith("ok") and int(result.split()[1]) == tables("orders").count(), result


def test_entry(spark):
    assert driver.entry(spark).count() > 20
