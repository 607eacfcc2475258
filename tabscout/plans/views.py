"""From operator results to catalog views: one row per view, sentences filled in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.functions.exprs import fmt_count, fmt_number, fmt_pct, fmt_text
from tabscout.functions.names import agg_label
from tabscout.functions.phrases import OPPOSITE, TOGETHER, VIEW_TEXTS, fill

# Order in which the families are built; ties in score keep it.
STAGES = (
    "snapshot", "quality", "map", "outcome_segment", "outcome_measure", "metric_segment", "time",
    "relationship", "distribution", "top_category",
)


class Columns:
    """Labels and positions of a table's columns, as lookups inside expressions."""

    def __init__(self, profile_rows: list):
        self._labels = F.create_map(*[F.lit(x) for r in profile_rows for x in (r.name, r.label)])
        self._places = F.create_map(*[F.lit(x) for r in profile_rows for x in (r.name, r.pos)])

    def label(self, name: str) -> Column:
        return F.try_element_at(self._labels, F.col(name))

    def place(self, name: str) -> Column:
        return F.try_element_at(self._places, F.col(name)).cast("bigint")


def _ord(stage: str, first: Column | None = None, second: Column | None = None) -> Column:
    zero = F.lit(0).cast("bigint")
    a, b = (zero if c is None else c for c in (first, second))
    return F.lit(STAGES.index(stage)).cast("bigint") * 10**12 + a * 10**6 + b


def _rows(order: str, label: Column, n: Column, value: Column, text: Column,
          x: Column | None = None) -> Column:
    """Aggregate the rows of a view into one array, in order."""
    x = F.lit(None) if x is None else x
    row = F.struct(
        label.cast("string").alias("label"), n.cast("bigint").alias("n"),
        value.cast("double").alias("value"), x.cast("double").alias("x"), text.alias("text"))
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("r"))))
    return F.transform(items, lambda i: i["r"]).alias("rows")


def _finish(df: DataFrame, dataset: str, kind: str, family: str, texts: dict[str, str],
            parts: dict[str, Column], ident: Column, order: Column, x_label: Column,
            y_label: Column, columns: list[Column], evidence: dict[str, Column] | None = None
            ) -> DataFrame:
    facts = [x for k, v in (evidence or {}).items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(dataset).alias("dataset"), order.alias("ord"), ident.alias("id"),
        F.lit(kind).alias("kind"), F.lit(family).alias("family"),
        F.col("score").cast("double").alias("score"),
        *[fill(texts[t], **parts).alias(t) for t in ("question", "title", "why")],
        x_label.alias("x_label"), y_label.alias("y_label"), F.array(*columns).alias("columns"),
        "rows",
        (F.create_map(*facts) if facts else F.create_map()).cast("map<string,string>").alias(
            "evidence"),
        F.col("passes").alias("passes"))


def _lead(field: str) -> Column:
    return F.get("rows", F.lit(0))[field]


def _none() -> Column:
    return F.lit(None).cast("string")


def overview_view(facts: DataFrame, dataset: str) -> DataFrame:
    rows = facts.agg(
        _rows("place", F.col("metric"), F.col("value"), F.col("value"), fmt_count(F.col("value"))))
    return _finish(
        rows.withColumn("score", F.lit(100.0)).withColumn("passes", F.lit(True)), dataset,
        "table", "overview", VIEW_TEXTS["snapshot"], {}, F.lit("snapshot"), _ord("snapshot"),
        _none(), _none(), [F.lit("Metric"), F.lit("Value")])


def quality_view(notes: DataFrame, dataset: str) -> DataFrame:
    rows = notes.agg(_rows("place", F.col("column"), F.lit(None), F.lit(None), F.col("issue")))
    return _finish(
        rows.where(F.size("rows") > 0).withColumn("score", F.lit(96.0)).withColumn(
            "passes", F.lit(True)), dataset,
        "table", "quality", VIEW_TEXTS["quality"], {}, F.lit("quality"), _ord("quality"),
        _none(), _none(), [F.lit("Column"), F.lit("Issue"), F.lit("Impact")])


def map_view(points: DataFrame, dataset: str) -> DataFrame:
    numbered = points.withColumn("o", F.struct("lat", "lon"))
    rows = numbered.groupBy("score", "passes").agg(
        _rows("o", F.lit(None), F.col("n") if "n" in points.columns else F.lit(None), F.col("lat"),
              F.lit(None).cast("string"), F.col("lon")))
    return _finish(
        rows, dataset, "map", "geo", VIEW_TEXTS["map"], {}, F.lit("map"), _ord("map"),
        F.lit("Longitude"), F.lit("Latitude"), [F.lit("lat"), F.lit("lon")])


def outcome_segment_views(rates: DataFrame, dataset: str, cols: Columns) -> DataFrame:
    rows = rates.groupBy("outcome", "segment", "score", "spread", "passes").agg(
        _rows("rank", fmt_text(F.col("value")), F.col("n"), F.col("rate"), fmt_pct(F.col("rate"))))
    outcome, segment = cols.label("outcome"), cols.label("segment")
    y = F.concat(outcome, F.lit(" Rate"))
    return _finish(
        rows, dataset, "bar_table", "outcome", VIEW_TEXTS["outcome_segment"],
        dict(outcome=outcome, outcome_low=F.lower(outcome), segment=segment,
             segment_low=F.lower(segment), lead=_lead("label"), lead_text=_lead("text")),
        F.concat_ws("__", F.lit("outcome_segment"), "outcome", "segment"),
        _ord("outcome_segment", cols.place("outcome"), cols.place("segment")),
        segment, y, [segment, F.lit("Rows"), y],
        dict(outcome=F.col("outcome"), segment=F.col("segment"), spread=F.round("spread", 3)))


def outcome_measure_views(rates: DataFrame, dataset: str, cols: Columns) -> DataFrame:
    shown_rate = F.round(F.col("rate") * 100, 1)
    rows = rates.groupBy("outcome", "measure", "score", "spread", "passes").agg(
        _rows("range", F.col("label"), F.col("n"), F.col("rate"), fmt_pct(F.col("rate")),
              F.col("middle")),
        F.max_by("label", F.struct(shown_rate, -F.col("range"))).alias("best"))
    outcome, measure = cols.label("outcome"), cols.label("measure")
    y = F.concat(outcome, F.lit(" Rate"))
    return _finish(
        rows, dataset, "line_table", "outcome", VIEW_TEXTS["outcome_measure"],
        dict(outcome=outcome, outcome_low=F.lower(outcome), measure=measure,
             measure_low=F.lower(measure), best=F.col("best")),
        F.concat_ws("__", F.lit("outcome_measure"), "outcome", "measure"),
        _ord("outcome_measure", cols.place("outcome"), cols.place("measure")),
        measure, y, [F.concat(measure, F.lit(" Range")), F.lit("Rows"), y],
        dict(outcome=F.col("outcome"), measure=F.col("measure"), spread=F.round("spread", 3)))


def metric_segment_views(metrics: DataFrame, dataset: str, cols: Columns) -> DataFrame:
    rows = metrics.groupBy(
        "measure", "segment", "agg", "score", "relative_spread", "passes").agg(
        _rows("rank", fmt_text(F.col("value")), F.col("n"), F.col("metric"),
              fmt_number(F.col("metric"))))
    segment = cols.label("segment")
    metric = F.concat(agg_label("agg"), F.lit(" "), cols.label("measure"))
    return _finish(
        rows, dataset, "bar_table", "segment", VIEW_TEXTS["metric_segment"],
        dict(segment=segment, segment_low=F.lower(segment), metric=metric,
             metric_low=F.lower(metric), lead=_lead("label"), lead_text=_lead("text")),
        F.concat_ws("__", F.lit("metric_segment"), "measure", "segment"),
        _ord("metric_segment", cols.place("measure"), cols.place("segment")),
        segment, metric, [segment, F.lit("Rows"), metric],
        dict(measure=F.col("measure"), segment=F.col("segment"), aggregation=F.col("agg"),
             relative_spread=F.round("relative_spread", 2)))


def time_count_views(counts: DataFrame, dataset: str, cols: Columns) -> DataFrame:
    rows = counts.groupBy("date_column", "score", "passes").agg(
        _rows("period", F.col("period"), F.col("n"), F.col("n"), fmt_count(F.col("n"))))
    date = cols.label("date_column")
    return _finish(
        rows, dataset, "line", "time", VIEW_TEXTS["time_count"],
        dict(date=date, date_low=F.lower(date)),
        F.concat_ws("__", F.lit("time_count"), "date_column"),
        _ord("time", cols.place("date_column")), date, F.lit("Rows"),
        [F.lit("Date"), F.lit("Rows")])


def time_metric_views(metrics: DataFrame, dataset: str, cols: Columns) -> DataFrame:
    rows = metrics.groupBy("date_column", "measure", "agg", "score", "passes").agg(
        _rows("period", F.col("period"), F.col("n"), F.col("metric"), fmt_number(F.col("metric"))))
    date, measure = cols.label("date_column"), cols.label("measure")
    metric = F.concat(agg_label("agg"), F.lit(" "), measure)
    return _finish(
        rows, dataset, "line", "time", VIEW_TEXTS["time_metric"],
        dict(date=date, measure_low=F.lower(measure), metric=metric),
        F.concat_ws("__", F.lit("time_metric"), "date_column", "measure"),
        _ord("time", cols.place("date_column"), cols.place("measure") + 1), date, metric,
        [F.lit("Date"), metric])


def relationship_views(pairs: DataFrame, ranges: DataFrame, dataset: str, cols: Columns
                       ) -> DataFrame:
    rows = ranges.where(F.col("ranges") >= 3).groupBy("x", "y").agg(
        _rows("range", F.col("label"), F.col("n"), F.col("y_middle"),
              fmt_number(F.col("y_middle")), F.col("x_middle"))).join(pairs, ["x", "y"])
    x, y = cols.label("x"), cols.label("y")
    shown_y = F.concat(F.lit("Typical "), y)
    return _finish(
        rows, dataset, "line_table", "relationship", VIEW_TEXTS["relationship"],
        dict(x=x, y=y, x_low=F.lower(x), y_low=F.lower(y),
             direction=F.when(F.col("r") > 0, TOGETHER).otherwise(OPPOSITE)),
        F.concat_ws("__", F.lit("relationship"), "x", "y"),
        _ord("relationship", cols.place("x"), cols.place("y")), x, shown_y,
        [F.concat(x, F.lit(" Range")), F.lit("Rows"), shown_y],
        dict(x=F.col("x"), y=F.col("y"), relationship_strength=F.round(F.abs("r"), 3),
             direction=F.when(F.col("r") > 0, "positive").otherwise("negative")))


def distribution_views(stats: DataFrame, bins: DataFrame, dataset: str, cols: Columns
                       ) -> DataFrame:
    span = F.concat(fmt_number(F.col("lo")), F.lit(" – "), fmt_number(F.col("hi")))
    filled = bins.groupBy("measure").agg(
        _rows("bin", span, F.col("n"), F.col("n"), fmt_count(F.col("n")), F.col("lo")))
    rows = stats.join(filled, "measure")
    measure = cols.label("measure")
    return _finish(
        rows, dataset, "histogram", "distribution", VIEW_TEXTS["distribution"],
        dict(measure=measure, measure_low=F.lower(measure), low=fmt_number(F.col("p25")),
             high=fmt_number(F.col("p75"))),
        F.concat_ws("__", F.lit("distribution"), "measure"),
        _ord("distribution", cols.place("measure")), measure, F.lit("Rows"), [measure],
        dict(measure=F.col("measure"), skew=F.round("skew", 2),
             outlier_share=F.round("outlier_share", 3)))


def top_category_views(groups: DataFrame, dataset: str, cols: Columns) -> DataFrame:
    rows = groups.groupBy("segment", "score", "passes").agg(
        _rows("rank", fmt_text(F.col("value")), F.col("n"), F.col("share_of_all"),
              fmt_pct(F.col("share_of_all"))))
    segment = cols.label("segment")
    return _finish(
        rows, dataset, "bar_table", "composition", VIEW_TEXTS["top_category"],
        dict(segment=segment, segment_low=F.lower(segment), lead=_lead("label"),
             lead_text=_lead("text")),
        F.concat_ws("__", F.lit("top_category"), "segment"),
        _ord("top_category", cols.place("segment")), segment, F.lit("Rows"),
        [segment, F.lit("Rows"), F.lit("Share")])
