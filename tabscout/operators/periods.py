"""Views over time: rows and metrics per calendar month or day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscout.functions.exprs import as_number, as_timestamp
from tabscout.operators.common import long_form, union_all
from tabscout.operators.groups import measure_aggs
from tabscout.operators.profile import date_range
from tabscout.operators.quantiles import group_medians

MONTH_SPAN_DAYS = 120


def period_units(df: DataFrame, dates: dict[str, str | None]) -> dict[str, str]:
    """`month` for columns that span more than 120 days, else `day`."""
    units = {}
    for r in date_range(df, dates).collect():
        if r.min is not None:
            units[r.name] = "month" if max(1, (r.max - r.min).days) > MONTH_SPAN_DAYS else "day"
    return units


def period_start(ts: Column, unit: str) -> Column:
    return F.trunc(ts, "month") if unit == "month" else F.to_date(ts)


def period_label(start: Column, unit: Column | str) -> Column:
    """Months carry the date of their last day."""
    return F.when(F.lit(unit) == "month" if isinstance(unit, str) else unit == "month",
                  F.last_day(start)).otherwise(start)


def calendar_buckets(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the empty periods between the first and last one of each key.

    Needs `start` and `unit`; there are at most a few thousand periods per key.
    """
    ends = counts.groupBy(*keys, "unit").agg(F.min("start").alias("_a"), F.max("start").alias("_b"))
    every = F.when(
        F.col("unit") == "month", F.expr("sequence(_a, _b, interval 1 month)")
    ).otherwise(F.expr("sequence(_a, _b, interval 1 day)"))
    spine = ends.select(*keys, "unit", F.explode(every).alias("start"))
    return spine.join(counts, [*keys, "unit", "start"], "left")


def _starts(df: DataFrame, dates: dict[str, str | None], units: dict[str, str],
            column: str) -> Column:
    return period_start(as_timestamp(df, column, dates[column]), units[column])


def rows_over_time(df: DataFrame, dates: dict[str, str | None],
                   units: dict[str, str] | None = None) -> DataFrame:
    """Rows per period of each date column; empty periods are 0."""
    units = period_units(df, dates) if units is None else units
    if not any(c in units for c in dates):
        return df.sparkSession.createDataFrame(
            [], "date_column string, unit string, period date, n bigint, valid bigint, "
                "periods bigint, score double, passes boolean")
    counts = union_all([
        df.select(_starts(df, dates, units, c).alias("start")).where("start IS NOT NULL")
        .groupBy("start").agg(F.count("*").alias("n"))
        .select(F.lit(c).alias("date_column"), F.lit(units[c]).alias("unit"), "start", "n")
        for c in dates if c in units
    ])
    view = Window.partitionBy("date_column")
    return calendar_buckets(counts, ["date_column"]).select(
        "date_column", "unit", period_label(F.col("start"), F.col("unit")).alias("period"),
        F.coalesce("n", F.lit(0)).alias("n"), F.sum("n").over(view).alias("valid"),
        F.count("*").over(view).alias("periods"), F.lit(64.0).alias("score"),
    ).withColumn("passes", (F.col("valid") >= 50) & (F.col("periods") >= 3))


def metric_over_time(df: DataFrame, dates: dict[str, str | None], measures: Sequence[str],
                     rows: int | None = None, units: dict[str, str] | None = None,
                     aggs: dict[str, str] | None = None, exact: bool = True) -> DataFrame:
    """Total, average or typical value per period.

    An empty period is 0 for a total and left out otherwise.
    """
    measures = list(measures)
    units = period_units(df, dates) if units is None else units
    aggs = aggs or measure_aggs(df, measures)
    summed = [m for m in measures if aggs[m] != "median"]
    medians = [m for m in measures if aggs[m] == "median"]
    parts = []
    for c in [c for c in dates if c in units]:
        unit = F.lit(units[c]).alias("unit")
        base = df.select(
            _starts(df, dates, units, c).alias("start"),
            *[as_number(df, m).alias(f"_x{j}") for j, m in enumerate(measures)],
        ).where("start IS NOT NULL")
        if summed:
            spots = {m: measures.index(m) for m in summed}
            sums = base.groupBy("start").agg(*[
                F.struct(
                    F.lit(m).alias("measure"), F.count(f"_x{j}").alias("n"),
                    (F.sum(f"_x{j}") if aggs[m] == "sum" else F.avg(f"_x{j}")).alias("metric"),
                ).alias(f"_s{j}") for m, j in spots.items()])
            parts.append(
                sums.select("start", F.inline(F.array(*[f"_s{j}" for j in spots.values()])))
                .where("n > 0")
                .select(F.lit(c).alias("date_column"), unit, "measure", "start", "n", "metric"))
        if medians:
            cells = long_form(
                base, "measure", "_x", {m: F.col(f"_x{measures.index(m)}") for m in medians},
                [F.col("start")])
            parts.append(
                group_medians(cells, ["measure", "start"], "_x", exact)
                .select(F.lit(c).alias("date_column"), unit, "measure", "start", "n",
                        F.col("median").alias("metric")))
    if not parts:
        return df.sparkSession.createDataFrame(
            [], "date_column string, measure string, agg string, unit string, period date, "
                "n bigint, metric double, valid bigint, periods bigint, score double, "
                "passes boolean")
    agg = F.create_map(*[F.lit(x) for m in measures for x in (m, aggs[m])])
    known = union_all(parts).withColumn("agg", agg[F.col("measure")])
    keys = ["date_column", "measure", "agg"]
    filled = calendar_buckets(known.where("agg = 'sum'"), keys).select(
        *keys, "unit", "start", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("metric", F.lit(0.0)).alias("metric"))
    out = filled.unionByName(known.where("agg <> 'sum'"))
    view = Window.partitionBy("date_column", "measure")
    return out.select(
        *keys, "unit", period_label(F.col("start"), F.col("unit")).alias("period"), "n", "metric",
        F.sum("n").over(view).alias("valid"), F.count("*").over(view).alias("periods"),
        F.lit(61.0).alias("score"),
    ).withColumn("passes", (F.col("valid") >= 60) & (F.col("periods") >= 3))
