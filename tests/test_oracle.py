"""Registered queries against their SQL on the smallest test tables."""

import datetime as dt
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidecast.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
# a query of every kind; the full set runs at sf0.01 through the entry module
CHECKED = [
    "daily_history", "funnel_daily", "growth_ladder", "correlation_sweep", "business_day_add",
    "calendar_dimension", "two_window_signature", "model_b", "report_frame", "switch_regime",
    "param_search_ranges", "batch_backtest", "registry_upsert", "anchor_lookup",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, dt.datetime):
        return v.date()
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return float(v) if hasattr(v, "as_tuple") else v


def rows_of(names, columns, rows):
    at = [columns.index(n) for n in names]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.parametrize("key", CHECKED)
def test_query_matches_sql(spark, duck, key):
    df = QUERIES[key].run(spark, SF)
    want = duck.sql(QUERIES[key].oracle())
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert rows_of(names, df.columns, df.collect()) == rows_of(names, want.columns, want.fetchall())


def test_every_query_has_sql_and_matching_names(duck):
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) <= set(entry.oracle_sql())
    for key in QUERIES:
        sql = entry.oracle_sql()[key]
        names = [n for n, _ in QUERIES[key].shape()]
        assert duck.sql(f"SELECT * FROM ({sql}) LIMIT 0").columns == names, key


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
