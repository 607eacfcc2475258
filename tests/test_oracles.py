"""Queries against DuckDB. TABSCOUT_ORACLES=all runs every one of them."""

from __future__ import annotations

import datetime as dt
import os

import pytest

import __spark_entry__ as driver

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TABSCOUT_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUICK = ["missing_rates", "duplicate_rows", "value_counts", "name_rules", "number_texts",
         "text_to_number", "largest_groups", "outcome_rate_by_segment", "metric_by_brand",
         "quantile_ranges", "outcome_rate_by_range", "pair_correlations", "histogram",
         "rows_over_time_with_gaps", "metric_over_time", "select_views", "select_by_ids",
         "overlay_texts"]
NAMES = list(driver.oracle_sql()) if os.environ.get("TABSCOUT_ORACLES") == "all" else QUICK


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return v.isoformat() if isinstance(v, dt.date) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, db, name):
    df = driver.queries()[name](spark, SF_DIR)
    wanted = db.sql(driver.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(wanted.columns)
    places = [wanted.columns.index(c) for c in columns]
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    theirs = sorted(repr([plain(r[i]) for i in places]) for r in wanted.fetchall())
    assert ours == theirs


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
