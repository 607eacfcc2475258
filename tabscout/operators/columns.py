"""What a profile says about a table: which columns can play which part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscout.functions import words as w


def eligible(profile: DataFrame) -> DataFrame:
    """`dataset, part, pos, name, label, positive_value, ts_format` of the usable columns.

    Parts: segment, measure, outcome, date. A segment has 2 to 60 values, fewer
    in small tables; an outcome has a positive value.
    """
    role, unique = F.col("role"), F.col("unique")
    most = F.least(F.lit(60), F.greatest(F.lit(8), F.floor(F.col("rows") / 10)))
    part = (
        F.when((role == "categorical") & unique.between(2, most), "segment")
        .when(role == "measure", "measure")
        .when((role == "outcome") & F.col("positive_value").isNotNull(), "outcome")
        .when(role == "datetime", "date")
    )
    return profile.where("is_candidate").withColumn("part", part).where(
        F.col("part").isNotNull()).select(
        "dataset", "part", "pos", "name", "label", "positive_value", "ts_format")


def geo_pair(profile: DataFrame) -> DataFrame:
    """First latitude and first longitude column per dataset, candidate or not."""
    def first(role: str):
        return F.min_by("name", F.when(F.col("role") == role, F.col("pos")))
    return profile.groupBy("dataset").agg(
        first("latitude").alias("lat"), first("longitude").alias("lon"))


def compact_profile(profile: DataFrame, limit: int = w.MAX_COMPACT_COLUMNS) -> DataFrame:
    """Candidates and outcome, date and place columns, the first 90 of each dataset."""
    useful = F.col("is_candidate") | F.col("role").isin(
        "outcome", "datetime", "latitude", "longitude")
    order = Window.partitionBy("dataset").orderBy("pos")
    return profile.where(useful).withColumn("_rank", F.row_number().over(order)).where(
        F.col("_rank") <= limit).drop("_rank")


def column_digest(profile: DataFrame) -> DataFrame:
    """Short form of the compact profile: three sample values and six statistics."""
    return compact_profile(profile).select(
        "dataset", "pos", "name", "label", "role", "missing_rate", "unique",
        F.slice("sample_values", 1, 3).alias("sample_values"),
        F.col("num.min").alias("min"), F.col("num.max").alias("max"),
        F.col("num.mean").alias("mean"), F.col("num.median").alias("median"),
        F.col("ts.min").alias("first_time"), F.col("ts.max").alias("last_time"),
        "top_values", "positive_value")


def table_profile(profile: DataFrame, duplicates: int) -> DataFrame:
    """One row per dataset: rows, columns, missing cells, duplicate rows."""
    return profile.groupBy("dataset").agg(
        F.max("rows").alias("rows"), F.count("*").alias("columns"),
        F.sum(F.col("rows") - F.col("non_null")).alias("missing_cells"),
        F.lit(duplicates).cast("bigint").alias("duplicate_rows"))
