"""The registered queries: names, SQL twins, and a cross-section compared on the smallest tables."""

import os
from collections import Counter

import pytest

import __spark_entry__ as entry_points
from harvestlens.catalog import load
from harvestlens.catalog.base import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "a01_growing_season", "j01_one_scan_seasons", "j03_q01_merged_yield_weather", "a07_q02_state_features", "w08_j04_monthly_anomalies",
    "w11_longest_dry_run", "w12_max_five_day_rain", "j05_stations_in_counties", "a23_impute", "w06_overall_residual_flags", "a22_correlation_rank",
    "a46_q07_summary_levels", "m17_q17_mann_whitney", "m18_q17_chi_square_two_by_two", "s21_upsert_orders", "s25_q18_change_feed", "r04_stream_upsert",
]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_every_query_with_sql_names_its_columns():
    for q in load().values():
        assert (q.sql is None) == (q.columns is None) or q.columns
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert len(entry_points.oracle_sql()) > 225


@needs_data
def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "yield_amount" in df.columns


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql_twin(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry_points.queries()[name](spark, SF)
    rel = con.sql(entry_points.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    got = Counter(tuple(r[n] for n in names) for r in df.collect())
    place = [rel.columns.index(n) for n in names]
    assert got == Counter(tuple(r[i] for i in place) for r in rel.fetchall())
