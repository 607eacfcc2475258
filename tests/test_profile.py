from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.operators import columns as cols
from tabscout.operators import profile as prof


def profiled(df, **kw):
    return {r.name: r for r in prof.profile_columns(df, **kw).collect()}


@pytest.fixture(scope="module")
def passengers(spark):
    rng = random.Random(5)
    rows = [(i * 3 % 1009, rng.choice([1, 2, 3]), rng.choice(["male", "female"]),
             rng.choice([None, *[float(a) for a in range(1, 80)]]), rng.choice([0, 1, 2]),
             rng.choice([0, 1, 2, 3]), round(rng.expovariate(0.03), 2), int(rng.random() < 0.4))
            for i in range(891)]
    return spark.createDataFrame(rows, "passenger_id int, pclass int, sex string, age double, "
                                       "sibsp int, parch int, fare double, survived int")


def test_roles_of_passengers(passengers):
    p = profiled(passengers)
    assert {c: r.role for c, r in p.items()} == {
        "passenger_id": "identifier", "pclass": "categorical", "sex": "categorical",
        "age": "measure", "sibsp": "categorical", "parch": "categorical", "fare": "measure",
        "survived": "outcome"}
    assert p["pclass"].label == "Passenger Class" and p["pclass"].numeric_codes
    assert p["survived"].positive_value == "1"
    assert p["age"].missing_rate == round(1 - p["age"].non_null / 891, 4) > 0
    assert sum(v.rows for v in p["sex"].top_values) == 891
    assert len(p["fare"].sample_values) == 5


def test_summary_matches_numpy(passengers):
    num = profiled(passengers)["fare"].num
    v = np.array([r.fare for r in passengers.collect()])
    assert num.std == pytest.approx(v.std())
    assert num.skew == pytest.approx((((v - v.mean()) / v.std()) ** 3).mean())
    assert [num.p05, num.p25, num.median, num.p75, num.p95, num.p99] == pytest.approx(
        list(np.quantile(v, prof.QUANTILES)))


def test_sketched_profile_keeps_the_roles(passengers):
    exact, about = profiled(passengers), profiled(passengers, exact=False)
    assert {c: r.role for c, r in exact.items()} == {c: r.role for c, r in about.items()}


def test_listings(spark):
    rng = random.Random(2)
    day = dt.date(2019, 1, 1)
    rows = [(i * 17, f"Nice flat {i}", 40.5 + rng.random(), -74 + rng.random(),
             rng.choice(["Private room", "Entire home"]), rng.randint(20, 500),
             str(day + dt.timedelta(days=i % 200)), rng.random() * 9) for i in range(400)]
    p = profiled(spark.createDataFrame(
        rows, "id bigint, name string, latitude double, longitude double, room_type string, "
              "price int, last_review string, reviews_per_month double"))
    assert {c: (r.role, r.is_candidate) for c, r in p.items()} == {
        "id": ("identifier", False), "name": ("text", False), "latitude": ("latitude", True),
        "longitude": ("longitude", True), "room_type": ("categorical", True),
        "price": ("measure", True), "last_review": ("datetime", False),
        "reviews_per_month": ("measure", True)}
    assert p["last_review"].ts.min == dt.datetime(2019, 1, 1)


def test_names_and_dates(spark):
    n = 300
    df = spark.range(n).select(
        (F.col("id") % 7).cast("string").alias("paid"), (F.col("id") % 5).alias("long_description"),
        (2012 + F.col("id") % 9).alias("year"), (1 + F.col("id") % 12).alias("month"),
        F.concat(F.lit("2024-01-"), (1 + F.col("id") % 28)).alias("created_at"),
        F.when(F.col("id") % 2 == 0, 1).when(F.col("id") % 3 == 0, 0).alias("is_active"),
        F.lit("x").alias("constant"), F.lit(None).cast("string").alias("nothing"),
        F.when(F.col("id") < 30, F.col("id") % 4).alias("rare"),
        F.array(F.col("id")).alias("list"), (F.col("id") + 1000).alias("steps"),
        (F.col("id") + 0.5).alias("half_steps"))
    p = profiled(df)
    assert {c: r.role for c, r in p.items()} == {
        "paid": "identifier", "long_description": "longitude", "year": "datetime",
        "month": "categorical", "created_at": "datetime", "is_active": "outcome",
        "constant": "categorical", "nothing": "categorical", "rare": "categorical",
        "list": "text", "steps": "identifier", "half_steps": "identifier"}
    assert p["year"].ts_format == "yyyy" and p["year"].ts.max == dt.datetime(2020, 1, 1)
    # Nullable 0/1 counts as an outcome.
    assert p["is_active"].positive_value == "1"
    assert (p["rare"].is_candidate, p["rare"].reason_excluded) == (False, "mostly missing")
    assert p["list"].non_null == n and not p["list"].is_candidate


@pytest.mark.parametrize(("first", "share"), [("2024-01-05", 1.0), ("soon", 0.0)])
def test_one_format_per_column(spark, first, share):
    values = [(first, i) for i in range(100)]
    df = spark.createDataFrame(values, "d string, i int")
    found = prof.date_share(df, ["d"]).first()
    assert found.date_share == share


def test_mixed_dates_follow_the_commonest_look(spark):
    values = ["2024-01-05"] * 3 + ["25/12/2024"] * 7 + ["junk 1/1/20"] * 9 + [None]
    df = spark.createDataFrame([(v, v, 7, 2000 + i) for i, v in enumerate(values)],
                               "when string, other string, n int, year int")
    found = {r.name: r for r in prof.date_share(df, df.columns).collect()}
    assert found["when"].ts_format == "d/M/yyyy" and found["when"].date_share == pytest.approx(7 / 19)
    assert found["other"].ts_format == "d/M/yyyy" and found["other"].date_share == pytest.approx(7 / 19)
    assert found["other"].seen == 19 and found["n"].date_share == 0
    assert found["year"].ts_format == "yyyy" and found["year"].date_share == 1


def test_distinct_thresholds(spark):
    n = 600  # numbers: codes up to 20 values; texts: up to 80
    df = spark.range(n).select(
        *[(F.col("id") % k).alias(f"n{k}") for k in (2, 3, 20, 21)],
        *[(F.col("id") % k).alias(f"price{k}") for k in (3, 20)],
        *[F.concat(F.lit("t"), F.col("id") % k).alias(f"t{k}") for k in (60, 61, 80, 81)])
    p = profiled(df)
    roles = {c: r.role for c, r in p.items()}
    assert roles == {
        "n2": "outcome", "n3": "categorical", "n20": "categorical", "n21": "measure",
        "price3": "measure", "price20": "measure", "t60": "categorical", "t61": "categorical",
        "t80": "categorical", "t81": "text"}
    parts = {r.name: r.part for r in cols.eligible(prof.profile_columns(df)).collect()}
    assert parts["t60"] == "segment" and "t61" not in parts


def test_positive_values(spark):
    def positive(low, high, name):
        df = spark.createDataFrame([(low, high, name)], "a string, b string, n string")
        return df.select(prof.positive_value(F.col("a"), F.col("b"), "n")).first()[0]
    assert positive("No", "Yes", "x") == "Yes"
    assert positive("True", "won", "x") == "True"
    assert positive("F", "O", "order_status") == "O"
    assert positive("10", "9", "target") == "10"
    assert positive("F", "O", "kind") is None


@pytest.mark.parametrize("step", [1, 1.0, 0.5, 2])
def test_sequences_match_numpy(spark, step):
    rng = random.Random(int(step * 10))
    values = sorted({round(i * step + (rng.random() < 0.1) * 3, 3) for i in range(-200, 400)})
    values = [v for v in values if rng.random() > 0.1]
    df = spark.createDataFrame([(type(step)(v),) for v in values],
                               "v bigint" if isinstance(step, int) else "v double").repartition(7)
    gaps = np.diff(np.unique([r.v for r in df.collect()]))
    found = prof.sequence_test(df, ["v"]).first()
    assert found.distinct_values == len(gaps) + 1
    assert found.median_gap_is_one == bool(np.median(gaps) == 1)
    assert found.mean_gap == pytest.approx(gaps.mean())


def test_sequence_across_word_borders(spark):
    df = spark.range(63, 330).withColumn("v", F.col("id") * 1)
    assert prof.sequence_test(df, ["v"]).first().is_sequence


def test_duplicate_rows(spark):
    df = spark.createDataFrame(
        [(1, "a"), (1, "a"), (None, "a"), (None, "a"), (None, None), (None, None), (None, None),
         (1, None), (2, "a")], "a int, b string")
    assert prof.duplicate_rows(df).first()[0] == 4
    swapped = spark.createDataFrame([(1, None), (None, 1)], "a int, b int")
    assert prof.duplicate_rows(swapped).first()[0] == 0
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "a double")
    assert prof.duplicate_rows(zeros).first()[0] == 2
    lists = spark.createDataFrame([([1, None],), ([None, 1],), ([1, None],)], "a array<int>")
    assert prof.duplicate_rows(lists).first()[0] == 1


def test_constant_and_odd_numbers(spark):
    df = spark.createDataFrame(
        [(float("nan"), 3.0), (float("inf"), 3.0), (None, None), (1.0, 3.0), (2.0, 3.0)],
        "x double, y double")
    rows = {r.name: r for r in prof.numeric_summary(df, ["x", "y"]).collect()}
    assert (rows["x"].n, rows["x"].mean, rows["x"].skew) == (2, 1.5, 0.0)
    assert (rows["y"].std, rows["y"].skew) == (0.0, 0.0)
    missing = {r.name: r.missing for r in prof.missing_rates(df).collect()}
    assert missing == {"x": 2, "y": 1}


def test_date_share_takes_two_scans_of_any_columns(spark):
    rows = [(f"2020-01-{1 + i % 28:02d}", f"{i} items", f"{1 + i % 12:02d}/03/2021" if i % 10 else "soon", str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "a string, b string, due_date string, c string")
    found = prof.date_share(df, df.columns)
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD[a#") == 1
    got = {r.name: (r.seen, r.ts_format is not None, round(r.date_share, 6)) for r in found.collect()}
    assert got == {"a": (60, True, 1.0), "b": (60, False, 0.0), "due_date": (60, True, 0.9), "c": (60, False, 0.0)}
    assert prof.date_share(df.limit(0), ["a", "due_date"]).where("date_share > 0 OR seen > 0").count() == 0
