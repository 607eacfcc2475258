"""The catalog of views: union, rank, selection and replacement texts.

Everything is keyed by `dataset`, so the catalogs of many tables are ranked
and selected in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscout.functions import words as w
from tabscout.functions.exprs import fmt_count, fmt_number
from tabscout.functions.phrases import (
    EMPTY_SUMMARY, SPARE_TAKEAWAYS, SUMMARY, TAKEAWAYS, fill,
)
from tabscout.operators.common import union_all
from tabscout.operators.textjobs import json_value, near_same

# `rows` of a view: array<struct<label string, n bigint, value double, x double,
# text string>>, where x is a position on a number axis and text the shown value.
VIEW_COLUMNS = (
    "dataset", "ord", "id", "kind", "family", "score", "question", "title", "why", "x_label",
    "y_label", "columns", "rows", "evidence", "passes",
)
CATALOG_COLUMNS = (
    "dataset", "seq", "id", "kind", "family", "score", "question", "title", "why", "takeaway",
    "x_label", "y_label", "columns", "rows", "evidence", "passes",
)


# --- takeaway sentences -------------------------------------------------------

def _row_of(label: str) -> Column:
    """The row of an overview with this label."""
    return F.get(F.filter("rows", lambda r: r["label"] == label), F.lit(0))["n"]


def _takeaway(texts: dict[str, str], number) -> Column:
    lead, metric = F.get("rows", F.lit(0)), F.element_at("columns", -1)
    values = F.transform("rows", lambda r: r["value"])
    filled = F.size("rows") > 0
    facts = dict(
        rows=fmt_count(_row_of("Rows")), columns=fmt_count(_row_of("Columns")),
        missing=fmt_count(_row_of("Missing Cells")),
        duplicates=fmt_count(_row_of("Duplicate Rows")),
        count=F.size("rows").cast("string"), lead=lead["label"], lead_text=lead["text"],
        metric=metric, metric_low=F.lower(metric), low=number(F.array_min(values)),
        high=number(F.array_max(values)))
    kind, family = F.col("kind"), F.col("family")
    return F.coalesce(
        F.when(family == "overview", fill(texts["overview"], **facts))
        .when(family == "quality", fill(texts["quality"], **facts))
        .when(kind.isin("bar_table", "line_table") & filled, fill(texts["table"], **facts))
        .when((kind == "line") & filled, fill(texts["line"], **facts))
        .when(kind == "histogram", texts["histogram"])
        .when(kind == "map", texts["map"]),
        F.lit(texts["other"]))


def takeaway_text() -> Column:
    """What to notice in a view, from its rows."""
    return _takeaway(TAKEAWAYS, fmt_number)


def spare_takeaway_text() -> Column:
    """The same in other words, for a view whose replacement text was no good."""
    return _takeaway(SPARE_TAKEAWAYS, lambda c: F.format_number(c, 0))


# --- build, rank, select --------------------------------------------------------

def build_catalog(views: Sequence[DataFrame]) -> DataFrame:
    """One row per view id; of equal ids the last built one counts."""
    parts = union_all([v.select(*VIEW_COLUMNS) for v in views])
    same_id = Window.partitionBy("dataset", "id")
    last = F.row_number().over(same_id.orderBy(F.desc("ord")))
    one = parts.withColumn("_last", last).withColumn("ord", F.min("ord").over(same_id)).where(
        F.col("_last") == 1)
    build_order = Window.partitionBy("dataset").orderBy("ord", "id")
    ready = one.withColumn("seq", F.row_number().over(build_order)).withColumn(
        "score", F.round("score", 3)).withColumn("takeaway", takeaway_text())
    return ready.select(*CATALOG_COLUMNS)


def _by_score(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("score"), "seq")


def family_limit() -> Column:
    limits = F.create_map(*[F.lit(x) for pair in w.FAMILY_LIMITS.items() for x in pair])
    return F.coalesce(F.try_element_at(limits, F.col("family")), F.lit(w.OTHER_FAMILY_LIMIT))


def select_views(catalog: DataFrame, max_views: int = w.MAX_VIEWS) -> DataFrame:
    """Best views under the limits per family and in all, numbered by `place`."""
    within = catalog.where("passes").withColumn(
        "_rank", F.row_number().over(_by_score("dataset", "family")))
    # The fixed bound lets Spark cut the ranks before the shuffle.
    most = max(w.FAMILY_LIMITS.values())
    kept = within.where((F.col("_rank") <= most) & (F.col("_rank") <= family_limit()))
    return kept.withColumn("place", F.row_number().over(_by_score("dataset"))).where(
        F.col("place") <= max_views).drop("_rank")


def select_by_ids(catalog: DataFrame, wanted: DataFrame,
                  max_views: int = w.MAX_VIEWS) -> DataFrame:
    """Views by the given ids (`dataset, ids`), in that order; ids of no passing view do not count.

    Fewer than four are filled up from `select_views` to eight; a dataset
    without any gets just the pick of `select_views`. Of more rows for one
    dataset, and of repeated ids, the first places count.
    """
    views = catalog.where("passes")
    asked = wanted.select("dataset", F.posexplode("ids").alias("_pos", "id")).groupBy(
        "dataset", "id").agg(F.min("_pos").alias("_pos"))
    first = Window.partitionBy("dataset").orderBy("_pos", "id")
    given = views.join(asked, ["dataset", "id"]).withColumn("_nth", F.row_number().over(first))
    counts = given.groupBy("dataset").agg(F.count("*").alias("_given"))
    spare = select_views(catalog, max_views).join(
        given.select("dataset", "id"), ["dataset", "id"], "left_anti").join(
        counts, "dataset", "left").withColumn("_given", F.coalesce("_given", F.lit(0)))
    goal = F.when(F.col("_given") == 0, max_views).otherwise(min(max_views, w.FILL_VIEWS))
    room = Window.partitionBy("dataset").orderBy("place")
    fillers = spare.where(F.col("_given") < w.MIN_VIEWS_BY_ID).withColumn(
        "_fill", F.row_number().over(room)).where(F.col("_fill") + F.col("_given") <= goal)
    columns = catalog.columns
    both = given.select(*columns, F.col("_nth").alias("_order")).unionByName(
        fillers.select(*columns, (F.col("place") + 1_000_000).alias("_order")))
    return both.withColumn("place", F.row_number().over(
        Window.partitionBy("dataset").orderBy("_order"))).drop("_order")


def stripped(text: Column | str) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _last_fitting(texts: DataFrame, keys: Sequence[str], fields: dict[str, tuple[int, int]]) -> DataFrame:
    """Per key and field the last text, by `pos` where there is one, that fits; it comes stripped.

    The length of a summary counts before it is stripped, that of other fields after."""
    turn = "pos" if "pos" in texts.columns else "_turn"
    if turn == "_turn":
        texts = texts.withColumn(turn, F.monotonically_increasing_id())
    kept = []
    for field, (low, high) in fields.items():
        if field in texts.columns:
            new = stripped(field)
            kept.append(F.max_by(new, F.when(F.length(field if field == "summary" else new).between(low, high), F.col(turn))).alias(f"_{field}"))
    return texts.groupBy(*keys).agg(F.lit(True).alias("_given"), *kept)


def overlay_texts(views: DataFrame, texts: DataFrame) -> DataFrame:
    """Put replacement texts on the views (`dataset, id` and any of six fields).

    A text counts only if its length without white space at its ends is within the
    field's limit. Several rows for one id apply in turn, by `pos` if there is such a
    column. If that leaves why and takeaway near-same, the old takeaway comes
    back, or a spare one if that one is no better.
    """
    limits = {f: (2, longest) for f, longest in w.TEXT_LIMITS.items()}
    new = _last_fitting(texts, ["dataset", "id"], limits)
    joined = views.join(new, ["dataset", "id"], "left").withColumn("_old", F.col("takeaway"))
    for field in w.TEXT_LIMITS:
        if f"_{field}" in new.columns:
            joined = joined.withColumn(field, F.coalesce(f"_{field}", field))
    why, old = F.col("why"), F.col("_old")
    back = F.when((F.length(old) > 0) & ~near_same(why, old), old).otherwise(spare_takeaway_text())
    repeated = F.coalesce("_given", F.lit(False)) & near_same(why, F.col("takeaway"))
    return joined.withColumn(
        "takeaway", F.when(repeated, back).otherwise(F.col("takeaway"))).select(*views.columns)


def catalog_digest(catalog: DataFrame, limit: int = w.MAX_DIGEST_VIEWS) -> DataFrame:
    """The best views of each dataset with three preview rows."""
    ranked = catalog.where("passes").withColumn(
        "rank", F.row_number().over(_by_score("dataset"))).where(F.col("rank") <= limit)
    return ranked.select(
        "dataset", "rank", "id", "kind", "family", "score", "question", "title", "why", "x_label",
        "y_label", "columns", F.slice("rows", 1, 3).alias("preview_rows"), "evidence")


def catalog_summary(selected: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """One sentence per dataset; a given `summary` of fitting length replaces it."""
    useful = ~F.col("family").isin("overview", "quality")
    found = selected.groupBy("dataset").agg(
        F.count_if(useful).alias("views"),
        F.min_by("title", F.when(useful, F.col("place"))).alias("_title"))
    own = F.when(F.col("views") > 0, fill(
        SUMMARY, count=F.col("views").cast("string"), title=F.col("_title"))
    ).otherwise(EMPTY_SUMMARY)
    if given is None:
        return found.select("dataset", "views", own.alias("summary"))
    new = _last_fitting(given, ["dataset"], {"summary": w.SUMMARY_LENGTH})
    return found.join(new, "dataset", "left").select(
        "dataset", "views", F.coalesce("_summary", own).alias("summary"))


def reply_to_tables(replies: DataFrame, column: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The wanted ids, the replacement texts and the summaries in replies (`dataset` and a text column).

    They are what `select_by_ids`, `overlay_texts` and `catalog_summary` take. A reply
    without JSON, or a card without an id, gives no row.
    """
    fields = ", ".join(f"{f}: string" for f in ("id", *w.TEXT_LIMITS))
    shape = f"selected_ids array<string>, summary string, cards array<struct<{fields}>>"
    read = replies.select("dataset", F.from_json(F.to_json(json_value(F.col(column))), shape).alias("r")).where("r IS NOT NULL")
    ids = read.where("r.selected_ids IS NOT NULL").select("dataset", F.col("r.selected_ids").alias("ids"))
    texts = read.select("dataset", F.posexplode("r.cards").alias("pos", "c")).select(
        "dataset", "pos", "c.*").where("id IS NOT NULL")
    summaries = read.where("r.summary IS NOT NULL").select("dataset", F.col("r.summary").alias("summary"))
    return ids, texts, summaries
