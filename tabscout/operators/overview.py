"""Overview of a table and notes on its quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.functions.exprs import fmt_count

MAX_NOTES = 10


def table_overview(profile: DataFrame, duplicates: int) -> DataFrame:
    """`metric, value` rows: size, columns per role, missing cells, duplicate rows."""
    role = F.col("role")
    facts = profile.agg(
        F.coalesce(F.max("rows"), F.lit(0)).alias("Rows"), F.count("*").alias("Columns"),
        F.count_if(role == "measure").alias("Measures"),
        F.count_if(role == "categorical").alias("Segments"),
        F.count_if(role == "outcome").alias("Outcomes"),
        F.count_if(role == "datetime").alias("Date Fields"),
        F.coalesce(F.sum(F.col("rows") - F.col("non_null")), F.lit(0)).alias("Missing Cells"),
        F.lit(duplicates).cast("bigint").alias("Duplicate Rows"),
    )
    names = facts.columns
    long = facts.unpivot([], [f"`{c}`" for c in names], "metric", "value")
    place = F.array_position(F.array(*[F.lit(c) for c in names]), F.col("metric"))
    return long.select(place.cast("int").alias("place"), "metric", "value")


def quality_notes(profile: DataFrame, duplicates: int, top: int = MAX_NOTES) -> DataFrame:
    """`place, column, issue, impact`: gaps of 10 % and more, then duplicate rows."""
    gaps = profile.where(F.col("missing_rate") >= 0.1).select(
        "pos", F.col("label").alias("column"),
        F.concat(fmt_count(F.round(F.col("missing_rate") * 100, 6)), F.lit("% missing")).alias(
            "issue"),
        F.lit("Use with caution").alias("impact"))
    copies = profile.sparkSession.createDataFrame(
        [(1 << 30, "All rows", "May inflate totals")] if duplicates > 0 else [],
        "pos int, column string, impact string",
    ).select("pos", "column", F.concat(
        fmt_count(F.lit(duplicates)), F.lit(" duplicate rows")).alias("issue"), "impact")
    notes = gaps.unionByName(copies).orderBy("pos").limit(top)
    return notes.orderBy("pos").select(
        F.col("pos").alias("place"), "column", "issue", "impact")


