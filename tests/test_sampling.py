from __future__ import annotations

from pyspark.sql import functions as F

from tabscout.operators import sampling
from tabscout.operators.places import geo_points
from tabscout.operators.profile import first_values
from tabscout.operators.sampling import fixed_sample


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_sample_is_the_same_on_any_partitioning(spark):
    df = spark.range(200_000).withColumn("v", F.col("id") % 1000)
    one = rows_of(fixed_sample(df, 500))
    assert len(one) == len(set(one)) == 500
    assert one == rows_of(fixed_sample(df.repartition(17), 500))
    assert one != rows_of(fixed_sample(df, 500, seed=7))
    assert one == rows_of(fixed_sample(df, 500, rows=200_000))


def test_sample_in_shares_is_the_same(spark, monkeypatch):
    df = spark.range(20_000).withColumn("v", F.col("id") % 7)
    one = rows_of(fixed_sample(df, 300))
    monkeypatch.setattr(sampling, "TREE_ROWS", 1000)
    monkeypatch.setattr(sampling, "SHARES", 3)
    assert one == rows_of(fixed_sample(df.repartition(7), 300, rows=20_000))


def test_sample_takes_one_scan(spark):
    text = fixed_sample(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), 50)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "TakeOrderedAndProject" in text and "Exchange" not in text


def test_sample_of_a_small_table_is_the_table(spark):
    df = spark.range(30)
    assert rows_of(fixed_sample(df, 500)) == rows_of(df)


def test_sample_with_a_mass_of_copies(spark):
    copies = spark.range(100_000).select(F.lit(-1).cast("bigint").alias("id"))
    df = copies.unionByName(spark.range(40))
    sample = rows_of(fixed_sample(df, 300))
    assert len(sample) == 300
    assert sample == rows_of(fixed_sample(df.repartition(9), 300))


def test_first_values_reach_sparse_columns(spark):
    df = spark.range(50_000).select(
        "id", F.when(F.col("id") % 10_000 == 3, F.lit("rare")).alias("rare"),
        F.when(F.col("id") > 10, F.lit("copy")).alias("copy"))
    found = first_values(df, df.columns, 20, {"id": 50_000, "rare": 5, "copy": 49_989}).collect()
    by = {c: [r.value for r in found if r.name == c] for c in df.columns}
    assert len(by["id"]) == 20 and by["rare"] == ["rare"] * 5 and by["copy"] == ["copy"] * 20
    assert sorted(r.rn for r in found if r.name == "copy") == list(range(1, 21))


def test_map_points_need_finite_pairs(spark):
    df = spark.createDataFrame(
        [(float(i), float(-i), i) for i in range(12)] + [(float("nan"), 1.0, 50), (None, 1.0, 51),
                                                         (1.0, float("inf"), 52)],
        "lat double, lon double, k int")
    points = geo_points(df, "lat", "lon", key=["k"]).collect()
    assert len(points) == 12 and all(p.passes and p.valid == 12 for p in points)
    assert not geo_points(df.limit(9), "lat", "lon").first().passes
