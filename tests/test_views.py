from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabscout.operators import groups as g
from tabscout.operators import overview as o
from tabscout.operators import periods as t
from tabscout.operators import profile as prof
from tabscout.operators import ranges as r


def test_ties_go_by_value(spark):
    df = spark.createDataFrame([(v,) for v in "ccbbaad"], "g string")
    rows = g.largest_groups(df, ["g"]).orderBy("rank").collect()
    assert [x.value for x in rows] == ["a", "b", "c", "d"]
    assert rows[0].concentration == pytest.approx(6 / 7) and rows[0].passes


@pytest.mark.parametrize(("counts", "passes"), [
    ([100], False), ([50, 50], True), ([180] * 3 + [51] * 9, False), ([188] * 3 + [51] * 9, True),
    ([353] + [68] * 11, True), ([351] + [68] * 11, False),
])
def test_composition_gate(spark, counts, passes):
    rows = [(f"g{i}",) for i, n in enumerate(counts) for _ in range(n)]
    shown = g.largest_groups(spark.createDataFrame(rows, "g string"), ["g"]).collect()
    assert {x.passes for x in shown} == {passes}


def grouped(spark, sizes, rates):
    rows = [(f"g{i}", int(k < round(n * p))) for i, (n, p) in enumerate(zip(sizes, rates))
            for k in range(n)]
    return spark.createDataFrame(rows, "seg string, won int")


@pytest.mark.parametrize(("sizes", "rates", "kept", "passes"), [
    ([200, 200], [0.5, 0.585], 2, True), ([200, 200], [0.5, 0.575], 2, False),
    ([15, 15], [0.2, 0.8], 2, True), ([14, 30], [0.5, 1.0], 1, False),
    ([14, 15, 16], [0.0, 0.2, 0.75], 2, True),
])
def test_outcome_gates(spark, sizes, rates, kept, passes):
    found = g.outcome_rate_by_segment(
        grouped(spark, sizes, rates), {"won": "1"}, ["seg"]).collect()
    assert len(found) == kept and {x.passes for x in found} == {passes}
    assert [x.rate for x in sorted(found, key=lambda x: x.rank)] == sorted(
        (x.rate for x in found), reverse=True)


def test_null_groups(spark):
    rows = [("a", 1.0), (None, 5.0)] * 30 + [("b", None)] * 3
    df = spark.createDataFrame(rows, "seg string, height double")
    found = {x.value: x for x in g.metric_by_segment(df, ["height"], ["seg"]).collect()}
    assert {k: (x.n, x.metric) for k, x in found.items()} == {"a": (30, 1.0), "nan": (30, 5.0)}
    assert {x.value for x in g.largest_groups(df, ["seg"]).collect()} == {"a", "b"}


@pytest.mark.parametrize(("agg", "name"), [("sum", "units"), ("mean", "rating"), ("median", "price")])
def test_metrics_match_pandas(spark, agg, name):
    rng = random.Random(4)
    pdf = pd.DataFrame({"seg": [rng.choice("abcd") for _ in range(400)],
                        name: [rng.expovariate(0.1) for _ in range(400)]})
    found = g.metric_by_segment(spark.createDataFrame(pdf), [name], ["seg"]).collect()
    wanted = pdf.groupby("seg")[name].agg(agg)
    assert {x.agg for x in found} == {agg}
    for x in found:
        assert x.metric == pytest.approx(wanted[x.value])
    spread = (wanted.max() - wanted.min()) / abs(wanted.median())
    assert found[0].relative_spread == pytest.approx(spread)


def test_correlation_guards(spark):
    rng = random.Random(9)
    x = [rng.random() for _ in range(150)]
    pdf = pd.DataFrame({
        "x": x, "up": [v + rng.random() * 0.5 for v in x], "down": [-v for v in x],
        "flat": 3.3, "holes": [v if i % 2 else None for i, v in enumerate(x)],
        "few": [v if i < 99 else None for i, v in enumerate(x)]})
    found = {(p.x, p.y): p for p in r.pair_correlations(
        spark.createDataFrame(pdf), list(pdf.columns)).collect()}
    for (a, b), p in found.items():
        both = pdf[[a, b]].dropna()
        assert p.n == len(both)
        if "flat" in (a, b):
            assert p.r is None and not p.passes
        else:
            assert p.r == pytest.approx(np.corrcoef(both[a], both[b])[0, 1])
            assert p.passes == (abs(p.r) >= 0.55 and p.n >= 100)
    assert found["x", "few"].n == 99 and not found["x", "few"].passes


def test_outcome_ranges_match_pandas(spark):
    rng = random.Random(6)
    v = [rng.expovariate(0.01) for _ in range(500)]
    pdf = pd.DataFrame({"v": v, "won": [int(rng.random() < min(x / 300, 1)) for x in v]})
    found = r.outcome_rate_by_range(
        spark.createDataFrame(pdf), {"won": "1"}, ["v"]).orderBy("range").collect()
    wanted = pdf.groupby(pd.qcut(pdf.v, 5), observed=True).agg(
        n=("won", "size"), rate=("won", "mean"), middle=("v", "median"))
    assert [x.n for x in found] == list(wanted.n)
    assert [x.rate for x in found] == pytest.approx(list(wanted.rate))
    assert [x.middle for x in found] == pytest.approx(list(wanted.middle))
    assert found[0].passes and found[0].distinct == 500


def test_few_distinct_values_have_no_outcome_ranges(spark):
    df = spark.range(700).select((F.col("id") % 7).alias("v"), (F.col("id") % 2).alias("won"))
    assert not any(x.passes for x in r.outcome_rate_by_range(df, {"won": "1"}, ["v"]).collect())


def test_distribution_gates(spark):
    rng = random.Random(8)
    pdf = pd.DataFrame({
        "even": [rng.random() for _ in range(200)],
        "tail": [rng.expovariate(1) ** 2 for _ in range(200)],
        "flat": 1.0, "no_iqr": [0.0] * 180 + [float(i) for i in range(20)]})
    found = {x.measure: x.passes for x in r.distribution_stats(
        spark.createDataFrame(pdf), list(pdf.columns)).collect()}
    assert found == {"even": False, "tail": True, "flat": False, "no_iqr": False}
    few = r.distribution_stats(spark.createDataFrame(pdf.head(59)), ["tail"]).first()
    assert not few.passes


def test_months_with_gaps(spark):
    days = ["2023-01-05", "2023-01-31", "2023-04-02", "2023-09-30"] * 20
    df = spark.createDataFrame([(d, 2, 4.0, 8.0) for d in days],
                               "d string, units int, rating double, price double")
    dates = {"d": "yyyy-M-d"}
    counts = {str(x.period): x.n for x in t.rows_over_time(df, dates).collect()}
    assert counts == {
        "2023-01-31": 40, "2023-02-28": 0, "2023-03-31": 0, "2023-04-30": 20, "2023-05-31": 0,
        "2023-06-30": 0, "2023-07-31": 0, "2023-08-31": 0, "2023-09-30": 20}
    found = t.metric_over_time(df, dates, ["units", "rating", "price"]).collect()
    by = {m: {str(x.period): x.metric for x in found if x.measure == m}
          for m in ("units", "rating", "price")}
    assert len(by["units"]) == 9 and by["units"]["2023-02-28"] == 0.0
    assert by["rating"] == {"2023-01-31": 4.0, "2023-04-30": 4.0, "2023-09-30": 4.0}
    assert set(by["price"]) == set(by["rating"]) and all(x.passes for x in found)


def test_short_spans_go_by_day(spark):
    df = spark.range(60).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3 * 2).cast("int")).alias("d"))
    rows = t.rows_over_time(df, {"d": None}).collect()
    assert {str(x.period): x.n for x in rows} == {
        "2024-01-01": 20, "2024-01-02": 0, "2024-01-03": 20, "2024-01-04": 0, "2024-01-05": 20}


def test_no_valid_dates(spark):
    df = spark.createDataFrame([("soon", 1)], "d string, v int")
    assert t.rows_over_time(df, {"d": "yyyy-M-d"}).count() == 0
    assert t.metric_over_time(df, {"d": "yyyy-M-d"}, ["v"]).count() == 0


def test_quality_notes(spark):
    df = spark.range(20).select(
        F.when(F.col("id") > 1, F.col("id")).alias("tenth"),
        F.when(F.col("id") > 0, F.col("id")).alias("less"))
    p = prof.profile_columns(df)
    assert [(x.column, x.issue) for x in o.quality_notes(p, 0).collect()] == [
        ("Tenth", "10% missing")]
    assert [x.issue for x in o.quality_notes(p, 1234).collect()] == [
        "10% missing", "1,234 duplicate rows"]
