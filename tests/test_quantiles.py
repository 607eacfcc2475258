from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscout.operators import quantiles as module
from tabscout.operators.quantiles import group_medians, quantiles
from tabscout.operators.ranges import histogram, quantile_ranges

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def skewed(spark, n=4000):
    """A third of the rows share one value, one key holds most rows."""
    rng = random.Random(3)
    rows = [("hot" if i % 3 else rng.choice("abc"),
             7.0 if i % 3 == 1 else rng.expovariate(0.01)) for i in range(n)]
    rows += [("one", 5.0), ("none", None)]
    return rows, spark.createDataFrame(rows, "k string, v double").repartition(5)


@pytest.mark.parametrize("count", [None, 6, 10**9])
def test_quantiles_match_numpy(spark, count):
    rows, df = skewed(spark)
    found = {r.k: r for r in quantiles(df, ["k"], "v", PROBS, key_count=count).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v"]).dropna()
    assert set(found) == set(pdf.k)
    for k, part in pdf.groupby("k"):
        assert found[k].n == len(part)
        np.testing.assert_allclose(found[k].q, np.quantile(part.v, PROBS), rtol=1e-12)


def test_close_and_odd_values(spark):
    """Rates, one narrow cluster, both signs, zero, and null keys."""
    rng = random.Random(8)
    groups = {"rates": [rng.random() * 0.05 for _ in range(999)], "narrow": [1e9 + rng.random() * 1e-3 for _ in range(500)],
              "signs": [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(501)] + [0.0] * 50,
              "tiny": [5e-324, 0.0, -5e-324, 1.7e308, -1.7e308], None: [float(i % 3) for i in range(100)]}
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    found = {r.k: r for r in quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", PROBS).collect()}
    for k, vs in groups.items():
        with np.errstate(over="ignore", invalid="ignore"):
            wanted = np.quantile(vs, PROBS)
        np.testing.assert_allclose(found[k].q, wanted, rtol=1e-12)


def test_large_buckets_are_split_again_and_again(spark, monkeypatch):
    monkeypatch.setattr(module, "SORT_ROWS", 20)
    rng = random.Random(9)
    values = [1.7e9 + rng.random() * 10 ** rng.uniform(-6, 0) for _ in range(3000)] + [1.7e9] * 500 + [-5.0] * 40
    df = spark.createDataFrame([("a", v) for v in values] + [(None, v) for v in values[:77]], "k string, v double")
    found = {r.k: r for r in quantiles(df, ["k"], "v", PROBS, key_count=2).collect()}
    np.testing.assert_allclose(found["a"].q, np.quantile(values, PROBS), rtol=1e-15)
    np.testing.assert_allclose(found[None].q, np.quantile(values[:77], PROBS), rtol=1e-15)


def test_more_keys_than_come_to_the_driver(spark, monkeypatch):
    monkeypatch.setattr(module, "BROADCAST_ROWS", 3)
    rows, df = skewed(spark)
    found = {r.k: r for r in quantiles(df, ["k"], "v", PROBS).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v"]).dropna()
    for k, part in pdf.groupby("k"):
        np.testing.assert_allclose(found[k].q, np.quantile(part.v, PROBS), rtol=1e-12)


def test_without_keys(spark):
    _, df = skewed(spark)
    values = [r.v for r in df.where("v IS NOT NULL").collect()]
    row = quantiles(df, [], "v", [0.5]).first()
    assert math.isclose(row.q[0], float(np.median(values)))


def test_medians_do_not_depend_on_partitioning(spark):
    _, df = skewed(spark)
    one = group_medians(df.coalesce(1), ["k"], "v").collect()
    many = group_medians(df.repartition(23), ["k"], "v").collect()
    assert sorted(one) == sorted(many)


def test_sketch_is_close(spark):
    rows, df = skewed(spark)
    row = quantiles(df, [], "v", [0.25, 0.75], exact=False).first()
    values = sorted(v for _, v in rows if v is not None)
    assert abs(np.searchsorted(values, row.q[1]) / len(values) - 0.75) < 0.02


@pytest.mark.parametrize("q", [5, 6])
def test_ranges_match_qcut(spark, q):
    rng = random.Random(q)
    columns = {
        "ties": [float(rng.choice([1, 1, 1, 2, 3, 3, 9])) for _ in range(500)],
        "smooth": [rng.gauss(0, 1) for _ in range(500)],
        "low_mass": [0.0] * 300 + [rng.random() for _ in range(200)],
        "flat": [4.0] * 500,
    }
    df = spark.createDataFrame(pd.DataFrame(columns))
    found = quantile_ranges(df, list(columns), q).orderBy("name", "range").collect()
    for name, values in columns.items():
        mine = [r for r in found if r.name == name]
        if name == "flat":
            assert mine == []
            continue
        cut = pd.qcut(pd.Series(values), q, duplicates="drop")
        counts = [n for n in cut.value_counts().sort_index() if n]
        assert [r.n for r in mine] == counts
        assert all(a.hi <= b.lo for a, b in zip(mine, mine[1:]))


def test_histogram_counts_every_value_up_to_the_cap(spark):
    values = [float(i % 97) for i in range(1000)] + [None, math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [(r.lo, r.hi, r.n) for r in histogram(df, {"v": 90.0}).where("bin = 39").collect()] == [
        (90.0, 96.0, sum(v > 90 for v in values[:1000]))]
    bins = histogram(df, {"v": 90.0}, overflow=False).collect()
    assert sum(r.n for r in bins) == sum(1 for v in values[:1000] if v <= 90)
    assert min(r.bin for r in bins) == 1 and max(r.bin for r in bins) == 38
    flat = histogram(spark.createDataFrame([(2.0,)] * 5, "v double"), {"v": None}).collect()
    assert [(r.bin, r.n) for r in flat] == [(1, 5)]
    none = spark.createDataFrame([(None,)], "v double").select(F.col("v").cast("double"))
    assert histogram(none, {"v": None}).count() == 0
