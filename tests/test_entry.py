"""Contract of the entry module and a spread of queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
SPREAD = [
    "a09_incremental_ingest", "b09_normal_text", "c01_type_category", "c03_poi_category", "d01_point_in_polygon", "d08_densify",
    "d12_merge_coverage", "e09_daily_city", "e18_parcel_statistics", "e24_poi_diversity", "e28_target_balance", "e37_level_preview",
    "f06_abnormal_label", "f12_lift_at_k", "h01_stratified_sample", "h18_rank_metrics", "h21_threshold_strategies",
    "h24_method_metrics", "h36_local_summary", "q03_quality_flags", "q10_leakage_audit", "t02_calendar",
]
NAMES = sorted(entry.catalog.QUERIES) if os.environ.get("CHECK_ALL") else SPREAD


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows_only = set(entry.catalog.QUERIES) - set(entry.oracle_sql())
    assert all(n.startswith(("h05", "h06", "h07", "h14", "h15", "h31", "h32", "h37_perm")) for n in rows_only)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "positive_share" in df.columns


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    assert sorted(df.columns) == sorted(d[0] for d in cur.description)
    assert got == rows([d[0] for d in cur.description], cur.fetchall())
