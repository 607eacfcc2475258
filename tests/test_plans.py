"""Plans: what is read, what is shuffled, and that all of it stays in the JVM."""

from __future__ import annotations

import pytest

from tabscout.operators import groups as g
from tabscout.operators import profile as prof
from tabscout.operators import ranges as r
from tabscout.operators.quantiles import quantiles
from tabscout.plans.pipeline import analyze_table

LINEITEM = "/root/testdata/sf0.001/lineitem.parquet"


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(LINEITEM)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_group_pass_has_one_exchange_and_reads_its_columns(lineitem):
    text = plan(g.group_pass(lineitem, ["l_returnflag", "l_tax"], {"l_linestatus": "O"},
                             ["l_quantity"]))
    assert text.count("Exchange") == 1
    assert ("ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string,"
            "l_linestatus:string>") in text
    assert "partial_count" in text and "partial_sum" in text


def test_statistics_shuffle_only_partial_results(lineitem):
    text = plan(prof.column_stats(lineitem))
    exchanges = [x for x in text.splitlines() if "Exchange" in x]
    assert exchanges and all("SinglePartition" in x for x in exchanges)
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text


def test_distinct_counts_read_one_column_each(lineitem):
    text = plan(prof.distinct_counts(lineitem, ["l_partkey", "l_tax"], mean_lengths={}))
    assert "ReadSchema: struct<l_partkey:bigint>" in text
    assert "ReadSchema: struct<l_tax:double>" in text
    assert "Expand" not in text


def test_filters_reach_the_scan(lineitem):
    text = plan(g.group_pass(lineitem.where("l_quantity > 40"), ["l_returnflag"]))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in text


def test_quantiles_never_deal_out_raw_values(spark, lineitem):
    text = plan(quantiles(lineitem, ["l_returnflag"], "l_extendedprice", [0.5], key_count=3))
    exchanges = [x for x in text.splitlines() if "Exchange hashpartitioning(" in x]
    assert exchanges and not any("_x" in x.split("hashpartitioning(")[1].split(")")[0] for x in exchanges
                                 if "_step" not in x and "_part" not in x)
    windows = [x for x in text.splitlines() if "Window [" in x and "_n" not in x]
    assert all("_step" in x or "_part" in x for x in windows)


def test_pairs_take_one_scan(lineitem):
    names = ["l_quantity", "l_extendedprice", "l_suppkey", "l_tax", "l_discount", "l_partkey"]
    text = plan(r.pair_correlations(lineitem, names))
    assert text.count("FileScan parquet") == 1 and text.count("hashpartitioning") == 1


def test_no_python_and_no_cross_join(lineitem):
    prices = ["l_quantity", "l_extendedprice"]
    for df in (r.outcome_rate_by_range(lineitem, {"l_linestatus": "O"}, prices),
               r.relationship_by_range(lineitem, [("l_quantity", "l_extendedprice")]),
               g.metric_by_segment(lineitem, prices, ["l_returnflag"])):
        for word in ("Python", "BroadcastNestedLoopJoin", "CartesianProduct"):
            assert word not in plan(df)


def test_catalog_is_worked_out_once(lineitem):
    found = analyze_table(lineitem, "lineitem", ["l_orderkey", "l_linenumber"])
    assert "FileScan" not in plan(found.catalog) and "FileScan" not in plan(found.plan())
    row = found.plan().first()
    assert row.candidate_count == found.catalog.where("passes").count() and len(row.cards) <= 12
    assert len(row.profile) == len(lineitem.columns) and row.summary
