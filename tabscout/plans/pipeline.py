"""From a table to its catalog: profile, parts, views, ranking."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.operators.columns import column_digest, eligible, geo_pair
from tabscout.operators.groups import (
    group_pass, largest_groups, measure_aggs, metric_by_segment, outcome_rate_by_segment,
)
from tabscout.operators.overview import quality_notes, table_overview
from tabscout.operators.periods import metric_over_time, period_units, rows_over_time
from tabscout.operators.places import MIN_POINTS, map_rows
from tabscout.operators.profile import duplicate_rows, profile_columns
from tabscout.operators.ranges import (
    distribution_stats, histogram, outcome_rate_by_range, pair_correlations, relationship_by_range,
)
from tabscout.plans import views as v
from tabscout.plans.catalog import build_catalog, catalog_digest, catalog_summary, select_views
from tabscout.sources.tables import preview, to_json_rows


@dataclass
class Analysis:
    """Profile and catalog of one table; both are small DataFrames that are already worked out."""

    dataset: str
    profile: DataFrame
    catalog: DataFrame

    def plan(self) -> DataFrame:
        """One row: summary, the picked views, the profile and `candidate_count`."""
        picked = select_views(self.catalog)
        cards = picked.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct(
            "place", *[c for c in picked.columns if c not in ("dataset", "place", "evidence")]))).alias("cards"))
        columns = self.profile.groupBy(F.lit(self.dataset).alias("dataset")).agg(
            F.collect_list(F.struct("name", "role")).alias("profile"))
        counts = self.catalog.where("passes").groupBy("dataset").agg(F.count("*").alias("candidate_count"))
        return catalog_summary(picked).join(cards, "dataset").join(counts, "dataset").join(columns, "dataset")


def analyze_table(df: DataFrame, dataset: str = "table", key: Sequence[str] | None = None,
                  exact: bool = True) -> Analysis:
    """Profile a table and build the catalog of its views.

    `key` names columns that tell rows apart; samples and first values are then
    ordered by a hash of them, without it by a hash of all columns. With
    `exact=False` high distinct counts and range edges are sketched.
    """
    profile = profile_columns(df, dataset, key, exact)
    rows = profile.collect()
    total = rows[0].rows if rows else 0
    parts: dict[str, list] = {"segment": [], "measure": [], "outcome": [], "date": []}
    for r in eligible(profile).orderBy("pos").collect():
        parts[r.part].append(r)
    segments = [r.name for r in parts["segment"]]
    measures = [r.name for r in parts["measure"]]
    outcomes = {r.name: r.positive_value for r in parts["outcome"]}
    dates = {r.name: r.ts_format for r in parts["date"]}
    places = geo_pair(profile).first()
    duplicates = duplicate_rows(df).first().duplicate_rows
    by_name = {r.name: r for r in rows}
    cols = v.Columns(rows)
    spark = df.sparkSession

    views = [
        v.overview_view(table_overview(profile, duplicates), dataset),
        v.quality_view(quality_notes(profile, duplicates), dataset),
    ]
    if places.lat and places.lon:
        shown = map_rows(df, places.lat, places.lon, key=key)
        views.append(v.map_view(shown.where(f"valid >= {MIN_POINTS}"), dataset))

    groups = None
    try:
        aggs = measure_aggs(df, measures) if measures else {}
        if segments:
            # One pass serves three views; its result has one row per group.
            added = [m for m in measures if aggs[m] != "median"]
            groups = group_pass(df, segments, outcomes, added).persist()
            if outcomes:
                views.append(v.outcome_segment_views(
                    outcome_rate_by_segment(df, outcomes, segments, total, groups), dataset, cols))
            if measures:
                order = added + [m for m in measures if aggs[m] == "median"]
                views.append(v.metric_segment_views(
                    metric_by_segment(df, order, segments, total, groups, aggs, exact=exact), dataset, cols))
            views.append(v.top_category_views(largest_groups(df, segments, groups), dataset, cols))
        if outcomes and measures:
            views.append(v.outcome_measure_views(
                outcome_rate_by_range(df, outcomes, measures, total, exact), dataset, cols))
        if dates:
            units = period_units(df, dates)
            views.append(v.time_count_views(rows_over_time(df, dates, units), dataset, cols))
            if measures:
                views.append(v.time_metric_views(
                    metric_over_time(df, dates, measures, total, units, aggs, exact), dataset, cols))
        if len(measures) > 1:
            linked = [p for p in pair_correlations(df, measures).collect() if p.passes]
            if linked:
                ranges = relationship_by_range(df, [(p.x, p.y) for p in linked], total, exact)
                views.append(v.relationship_views(
                    spark.createDataFrame(linked), ranges, dataset, cols))
        known = {m: by_name[m].num.asDict() for m in measures if by_name[m].num}
        if known:
            spread = [r for r in distribution_stats(df, list(known), total, known).collect()
                      if r.passes]
            if spread:
                caps = {r.measure: r.p99 if r.n > 100 else None for r in spread}
                views.append(v.distribution_views(
                    spark.createDataFrame(spread), histogram(df, caps), dataset, cols))
        # A row per view: worked out once, whatever is asked of it later.
        built = build_catalog(views)
        catalog = spark.createDataFrame(built.collect(), built.schema)
    finally:
        if groups is not None:
            groups.unpersist()
    return Analysis(dataset, spark.createDataFrame(rows, profile.schema), catalog)


def dataset_context(df: DataFrame, found: Analysis, sample: int = 2, key: Sequence[str] | None = None) -> DataFrame:
    """One row that tells a reader of the catalog what it is about.

    File name, rows, columns, `sample` rows as JSON (the first by `key`, else by hash), the
    digest of the columns and that of the catalog.
    """
    name = F.lit(found.dataset).alias("dataset")
    rows = to_json_rows(preview(df, sample, key)).groupBy(name).agg(F.collect_list("json").alias("sample_rows"))
    columns = column_digest(found.profile)
    digest = columns.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(
        "pos", *[c for c in columns.columns if c not in ("pos", "dataset")]))).alias("column_digest"))
    views = catalog_digest(found.catalog).drop("evidence")
    shown = views.groupBy(name).agg(F.array_sort(F.collect_list(F.struct(
        "rank", *[c for c in views.columns if c not in ("rank", "dataset")]))).alias("catalog_digest"))
    size = found.profile.groupBy(name).agg(F.max("rows").alias("rows"), F.count("*").alias("columns"))
    return size.join(rows, "dataset", "left").join(digest, "dataset", "left").join(shown, "dataset", "left")
