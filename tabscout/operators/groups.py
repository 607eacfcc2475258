"""Views by group: largest groups, outcome rates and metrics per segment value.

Segments are columns with few values (at most 60 in the pipeline), so the one
pass over the table leaves a small table of groups; gates and ranks work on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscout.functions.exprs import as_number, group_text, is_positive, min_group, present
from tabscout.functions.names import default_agg
from tabscout.operators.common import long_form, union_all
from tabscout.operators.quantiles import group_medians

SHOWN_GROUPS = 12


def outcome_flag(df: DataFrame, name: str, positive: str) -> Column:
    """1 for the positive class, 0 for another value, null for a missing one."""
    return F.when(
        present(df, name).isNotNull(), is_positive(group_text(df, name), positive).cast("int"))


def group_pass(df: DataFrame, segments: Sequence[str], outcomes: dict[str, str] | None = None,
               measures: Sequence[str] = ()) -> DataFrame:
    """One row per (segment, value): row count, and per outcome and measure count and sum.

    The null value of a segment is a group of its own. Columns `on{i}`/`op{i}`
    count the rows and positives of outcome i, `mn{j}`/`ms{j}` the finite values
    of measure j and their sum. One exchange, of partial sums only.
    """
    outcomes = outcomes or {}
    keep = [outcome_flag(df, o, p).alias(f"_f{i}") for i, (o, p) in enumerate(outcomes.items())]
    keep += [as_number(df, m).alias(f"_x{j}") for j, m in enumerate(measures)]
    cells = long_form(df, "segment", "value", {s: group_text(df, s) for s in segments}, keep)
    sums = [F.count("*").alias("n")]
    for i in range(len(outcomes)):
        sums += [F.count(f"_f{i}").alias(f"on{i}"), F.sum(f"_f{i}").alias(f"op{i}")]
    for j in range(len(measures)):
        sums += [F.count(f"_x{j}").alias(f"mn{j}"), F.sum(f"_x{j}").alias(f"ms{j}")]
    return cells.groupBy("segment", "value").agg(*sums)


def largest_groups(df: DataFrame, segments: Sequence[str], groups: DataFrame | None = None,
                   top: int = SHOWN_GROUPS) -> DataFrame:
    """Most frequent values per segment, with the shares that decide if it is worth showing."""
    groups = group_pass(df, segments) if groups is None else groups
    known = F.col("value").isNotNull()
    totals = groups.groupBy("segment").agg(
        F.sum("n").alias("_rows"), F.sum(F.when(known, F.col("n"))).alias("_known"))
    size = Window.partitionBy("segment").orderBy(F.desc("n"), "value")
    ranked = groups.where(known).select(
        "segment", "value", "n", F.row_number().over(size).alias("rank"),
    ).where(F.col("rank") <= top)
    whole = Window.partitionBy("segment")
    share = F.col("n") / F.col("_known")
    shown = ranked.join(F.broadcast(totals), "segment").select(
        "segment", "value", "n", "rank", share.alias("share"),
        (F.col("n") / F.col("_rows")).alias("share_of_all"))
    return shown.select(
        "*", F.max("share").over(whole).alias("top_share"),
        F.sum(F.when(F.col("rank") <= 3, F.col("share"))).over(whole).alias("concentration"),
        F.count("*").over(whole).alias("_groups"),
    ).select(
        *shown.columns, "top_share", "concentration",
        (54 + 30 * F.col("concentration")).alias("score"),
        ((F.col("_groups") >= 2) & (
            (F.col("concentration") >= 0.55) | (F.col("top_share") >= 0.32))).alias("passes"),
    )


def outcome_rate_by_segment(df: DataFrame, outcomes: dict[str, str], segments: Sequence[str],
                            rows: int | None = None, groups: DataFrame | None = None,
                            top: int | None = SHOWN_GROUPS, rated: int | None = None) -> DataFrame:
    """Share of the positive class per group; only groups of enough rows count.

    `top` is how many of the highest rates are returned, `rated` may bound the rated groups
    to the largest ones; None is all.
    """
    rows = df.count() if rows is None else rows
    least = min_group(rows)
    groups = group_pass(df, segments, outcomes) if groups is None else groups
    known = groups.where(F.col("value").isNotNull())
    rates = union_all([
        known.where((F.col(f"on{i}") > 0) & (F.col("segment") != o)).select(
            F.lit(o).alias("outcome"), "segment", "value", F.col(f"on{i}").alias("n"),
            (F.col(f"op{i}") / F.col(f"on{i}")).alias("rate"))
        for i, o in enumerate(outcomes)
    ])
    view = Window.partitionBy("outcome", "segment")
    by_size = view.orderBy(F.desc("n"), "value")
    by_rate = view.orderBy(F.desc("rate"), F.desc("n"), "value")
    sized = rates.select(
        "*", F.row_number().over(by_size).alias("_size"), F.sum("n").over(view).alias("rows_used"))
    kept = sized.where(F.col("n") >= least)
    if rated is not None:
        kept = kept.where(F.col("_size") <= rated)
    return kept.select(
        "outcome", "segment", "value", "n", "rate", "rows_used",
        F.row_number().over(by_rate).alias("rank"),
        F.count("*").over(view).alias("groups"),
        (F.max("rate").over(view) - F.min("rate").over(view)).alias("spread"),
    ).select(
        "*", (84 + F.least(60 * F.col("spread"), F.lit(16.0))).alias("score"),
        ((F.col("rows_used") >= 2 * least) & (F.col("groups") >= 2)
         & (F.col("spread") >= 0.08)).alias("passes"),
    ).where(F.lit(True) if top is None else F.col("rank") <= top)


def measure_aggs(df: DataFrame, measures: Sequence[str]) -> dict[str, str]:
    """Default aggregate per measure, by its name."""
    names = df.sparkSession.createDataFrame([(m,) for m in measures], "name string")
    return {r.name: r.agg for r in names.select("name", default_agg("name").alias("agg")).collect()}


def _group_medians(df: DataFrame, segments: Sequence[str], measures: Sequence[str],
                   exact: bool) -> DataFrame:
    texts = {s: F.coalesce(group_text(df, s), F.lit("nan")) for s in segments}
    keep = [as_number(df, m).alias(f"_m{j}") for j, m in enumerate(measures)]
    wide = long_form(df, "segment", "value", texts, keep)
    cells = long_form(
        wide, "measure", "_x", {m: F.col(f"_m{j}") for j, m in enumerate(measures)},
        [F.col("segment"), F.col("value")]).where(F.col("_x").isNotNull())
    return group_medians(
        cells, ["measure", "segment", "value"], "_x", exact
    ).withColumnRenamed("median", "metric")


def metric_by_segment(df: DataFrame, measures: Sequence[str], segments: Sequence[str],
                      rows: int | None = None, groups: DataFrame | None = None,
                      aggs: dict[str, str] | None = None, top: int = SHOWN_GROUPS,
                      exact: bool = True) -> DataFrame:
    """Total, average or typical value of a measure per group.

    The null value of a segment is a group, shown as `nan`.
    """
    rows = df.count() if rows is None else rows
    least = min_group(rows)
    aggs = aggs or measure_aggs(df, measures)
    parts = []
    if any(aggs[m] != "median" for m in measures):
        groups = group_pass(df, segments, None, measures) if groups is None else groups
        named = groups.withColumn("value", F.coalesce("value", F.lit("nan")))
        for j, m in enumerate(measures):
            if aggs[m] == "median":
                continue
            total = F.sum(f"ms{j}")
            metric = total if aggs[m] == "sum" else total / F.sum(f"mn{j}")
            parts.append(
                named.where(F.col(f"mn{j}") > 0).groupBy("segment", "value").agg(
                    F.sum(f"mn{j}").alias("n"), metric.alias("metric"))
                .select(F.lit(m).alias("measure"), "segment", "value", "n", "metric"))
    medians = [m for m in measures if aggs[m] == "median"]
    if medians:
        parts.append(_group_medians(df, segments, medians, exact))
    agg = F.create_map(*[F.lit(x) for m in measures for x in (m, aggs[m])])
    view = Window.partitionBy("measure", "segment")
    by_metric = view.orderBy(F.desc("metric"), "value")
    used = union_all(parts).withColumn("rows_used", F.sum("n").over(view))
    kept = used.where(F.col("n") >= least).select(
        "measure", agg[F.col("measure")].alias("agg"), "segment", "value", "n", "metric",
        "rows_used", F.row_number().over(by_metric).alias("rank"),
        F.count("*").over(view).alias("groups"),
        (F.max("metric").over(view) - F.min("metric").over(view)).alias("_range"),
        F.abs(F.median("metric").over(view)).alias("_middle"),
    )
    spread = F.col("_range") / F.when(F.col("_middle") == 0, 1.0).otherwise(F.col("_middle"))
    return kept.withColumn("relative_spread", spread).drop("_range", "_middle").select(
        "*", (68 + F.least(18 * F.col("relative_spread"), F.lit(18.0))).alias("score"),
        ((F.col("rows_used") >= 2 * least) & (F.col("groups") >= 2)
         & (F.col("relative_spread") >= 0.22)).alias("passes"),
    ).where(F.col("rank") <= top)
