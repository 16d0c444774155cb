"""Registered queries against their SQL on the smallest tables, and the contract's shape."""

import duckdb
import pytest

import __spark_entry__ as entry
import verify_local

NAMES = ["p4_found", "p6_found", "p6_grid_cell", "qc_station_summary", "qc_flags", "window_metrics_180", "event_catalog", "neighbor_support", "event_grid_match", "window_confusion_scale", "areal_baseline", "displacement", "stratified_skill", "stream_hourly_totals", "p1_found", "p1_instants", "p2_found", "p3_found", "p6_pairs", "event_skill", "support_statistics", "window_confusion_catalog", "displacement_statistics", "region_last_match"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in verify_local.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert verify_local.frame(got) == verify_local.frame(want)


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
