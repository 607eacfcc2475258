"""Views by value range: equal-count ranges, linked pairs and distributions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscout.functions.exprs import as_number, min_group, range_label
from tabscout.operators.common import (
    counts_by_value, join_small, long_form, stack_row,
)
from tabscout.operators.groups import outcome_flag
from tabscout.operators.moments import co_moments
from tabscout.operators.profile import column_quantiles
from tabscout.operators.quantiles import group_medians, quantiles
from tabscout.operators.sampling import fixed_sample, row_key

OUTCOME_RANGES = 5
PAIR_RANGES = 6
BINS = 38


def equal_count_probs(q: int) -> list[float]:
    return [i / q for i in range(q + 1)]


def range_edges(cells: DataFrame, keys: Sequence[str], value: str, q: int,
                key_count: int, exact: bool = True) -> DataFrame:
    """Per key the distinct edges of q equal-count ranges, and the number of values.

    Keys are columns or pairs of them, so there are few edges; they are worked
    out once and kept as a local DataFrame.
    """
    found = quantiles(cells, keys, value, equal_count_probs(q), exact, key_count).select(
        *keys, F.col("n").alias("rows_used"), F.array_distinct("q").alias("edges"))
    return cells.sparkSession.createDataFrame(found.collect(), found.schema)


def range_number(value: str, q: int) -> Column:
    """Number of the right-closed range that holds a value; the first holds its lower edge."""
    cases = " ".join(f"WHEN {value} <= get(edges, {i}) THEN {i}" for i in range(1, q + 1))
    return F.expr(f"CASE {cases} END")


def in_ranges(cells: DataFrame, edges: DataFrame, keys: Sequence[str], value: str, q: int,
              key_count: int) -> DataFrame:
    """Every row with the number and edges of its range; constant columns have none."""
    placed = join_small(cells, edges, keys, key_count).withColumn("range", range_number(value, q))
    return placed.where(F.col("range").isNotNull()).withColumn(
        "lo", F.get("edges", F.col("range") - 1)).withColumn("hi", F.get("edges", F.col("range")))


def _label() -> Column:
    return range_label(F.col("lo"), F.col("hi"), F.col("range") == 1)


def quantile_ranges(df: DataFrame, columns: Sequence[str], q: int, rows: int | None = None,
                    exact: bool = True) -> DataFrame:
    """`name, range, lo, hi, label, n` of q equal-count ranges per column."""
    cells = long_form(df, "name", "value", {c: as_number(df, c) for c in columns}).where(
        F.col("value").isNotNull())
    edges = range_edges(cells, ["name"], "value", q, len(columns), exact)
    placed = in_ranges(cells, edges, ["name"], "value", q, len(columns))
    return placed.groupBy("name", "range", "lo", "hi").agg(F.count("*").alias("n")).select(
        "name", "range", "lo", "hi", _label().alias("label"), "n")


def outcome_rate_by_range(df: DataFrame, outcomes: dict[str, str], measures: Sequence[str],
                          rows: int | None = None, exact: bool = True) -> DataFrame:
    """Share of the positive class per range of a measure."""
    rows = df.count() if rows is None else rows
    least, q = min_group(rows), OUTCOME_RANGES
    flags = {o: f"_f{i}" for i, o in enumerate(outcomes)}
    keep = [outcome_flag(df, o, p).alias(flags[o]) for o, p in outcomes.items()]
    wide = long_form(df, "measure", "value", {m: as_number(df, m) for m in measures}, keep)
    cells = long_form(
        wide.where(F.col("value").isNotNull()), "outcome", "flag",
        {o: F.col(f) for o, f in flags.items()}, [F.col("measure"), F.col("value")],
    ).where(F.col("flag").isNotNull())
    keys, count = ["outcome", "measure"], len(measures) * len(outcomes)
    edges = range_edges(cells, keys, "value", q, count, exact)
    # The pass rule asks for eight different values; a sketch will not do for that.
    different = cells.groupBy(*keys).agg(F.count_distinct("value").alias("distinct"))
    placed = in_ranges(cells, edges, keys, "value", q, count)
    place = [*keys, "range"]
    rates = placed.groupBy(*place, "lo", "hi", "rows_used").agg(
        F.count("*").alias("n"), F.avg("flag").alias("rate"))
    middles = group_medians(
        placed.select(*place, "value"), place, "value", exact, key_count=count * q).drop("n")
    view = Window.partitionBy(*keys)
    kept = join_small(join_small(rates, middles, place, count * q), different, keys, count).where(
        F.col("n") >= least)
    return kept.select(
        *place, "lo", "hi", _label().alias("label"), "n", "rate",
        F.col("median").alias("middle"), "rows_used", "distinct",
        F.count("*").over(view).alias("ranges"),
        (F.max("rate").over(view) - F.min("rate").over(view)).alias("spread"),
    ).select(
        "*", (80 + F.least(60 * F.col("spread"), F.lit(14.0))).alias("score"),
        ((F.col("rows_used") >= 4 * least) & (F.col("distinct") >= 8) & (F.col("ranges") >= 3)
         & (F.col("spread") >= 0.08)).alias("passes"),
    )


# --- pairs ---------------------------------------------------------------------

def _numbers(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """The finite numbers of the columns under short names, and those names."""
    spot = {c: f"x{i}" for i, c in enumerate(columns)}
    return df.select(*[as_number(df, c).alias(x) for c, x in spot.items()]), spot


def pair_correlations(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Pearson r of every pair of measures over the rows where both are finite.

    A measure that is constant on those rows has no r, and then no score. One scan; a task gives
    one row, the packed co-moments of all pairs.
    """
    measures = list(measures)
    schema = "pair int, x string, y string, n bigint, r double, score double, passes boolean"
    pairs = [(k, i * len(measures) + j, a, b) for k, ((i, a), (j, b)) in enumerate(combinations(enumerate(measures), 2))]
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    found = co_moments(_numbers(df, measures)[0]).withColumnRenamed("pair", "_k")
    names = df.sparkSession.createDataFrame(pairs, "_k int, pair int, x string, y string")
    strength = F.abs("r")
    named = names.join(F.broadcast(found), "_k", "left").select("pair", "x", "y", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "r")
    return named.select(
        "*", F.when(strength.isNotNull(), 59 + F.least(22 * strength, F.lit(18.0))).alias("score"),
        F.coalesce((F.col("n") >= 100) & (strength >= 0.55), F.lit(False)).alias("passes"))


def relationship_by_range(df: DataFrame, pairs: Sequence[tuple[str, str]],
                          rows: int | None = None, exact: bool = True) -> DataFrame:
    """Count and typical x and y per equal-count range of x, for linked pairs."""
    base, spot = _numbers(df, sorted({c for p in pairs for c in p}))
    each = F.array(*[F.struct(
        F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(spot[x]).alias("x_value"), F.col(spot[y]).alias("y_value"))
        for x, y in pairs])
    cells = base.select(F.inline(each)).where(F.col("x_value").isNotNull() & F.col("y_value").isNotNull())
    keys, q = ["x", "y"], PAIR_RANGES
    edges = range_edges(cells, keys, "x_value", q, len(pairs), exact)
    placed = in_ranges(cells, edges, keys, "x_value", q, len(pairs))
    place = [*keys, "range"]
    sums = placed.groupBy(*place, "lo", "hi").agg(F.count("*").alias("n"))
    both = long_form(placed, "_side", "_v", {"x_middle": F.col("x_value"), "y_middle": F.col("y_value")},
                     [F.col(c) for c in place])
    middles = group_medians(both, [*place, "_side"], "_v", exact, key_count=2 * len(pairs) * q)
    out = join_small(sums, middles.groupBy(*place).agg(*[
        F.max(F.when(F.col("_side") == m, F.col("median"))).alias(m) for m in ("x_middle", "y_middle")]), place, len(pairs) * q)
    return out.select(
        *place, "lo", "hi", _label().alias("label"), "n", "x_middle", "y_middle",
        F.count("*").over(Window.partitionBy(*keys)).alias("ranges"))


# --- distributions ---------------------------------------------------------------

def distribution_stats(df: DataFrame, measures: Sequence[str], rows: int | None = None,
                       limits: dict[str, dict] | None = None, exact: bool = True) -> DataFrame:
    """Quartiles, high-side outlier share and skew per measure.

    `limits` may bring known `p25`, `median`, `p75`, `p95` and `p99`.
    """
    names = ("p25", "median", "p75", "p95", "p99")
    if limits is None:
        found = column_quantiles(df, measures, (0.25, 0.5, 0.75, 0.95, 0.99), rows, exact)
        limits = {r.name: dict(zip(names, r.q)) for r in found.collect()}
    base = df.select(*[as_number(df, m).alias(f"x{i}") for i, m in enumerate(measures)])

    def one(i: int, m: str) -> Column:
        q = limits.get(m) or dict.fromkeys(names)
        iqr = q["p75"] - q["p25"] if q["p75"] is not None else 0.0
        fence = q["p75"] + 1.5 * iqr if q["p75"] is not None else 0.0
        flat = f"min(x{i}) = max(x{i}) OR count(x{i}) < 3"
        return F.struct(
            F.lit(m).alias("measure"), F.expr(f"count(x{i})").alias("n"),
            *[F.lit(q[k]).cast("double").alias(k) for k in names],
            F.lit(float(iqr)).alias("iqr"),
            F.avg((F.col(f"x{i}") > float(fence)).cast("double")).alias("outlier_share"),
            F.expr(f"CASE WHEN {flat} THEN 0D ELSE abs(skewness(x{i})) END").alias("skew"))

    stats = stack_row([one(i, m) for i, m in enumerate(measures)], base)
    weight = 5 * F.col("skew") + 80 * F.col("outlier_share")
    return stats.select(
        "*", (57 + F.least(weight, F.lit(20.0))).alias("score"),
        F.coalesce((F.col("n") >= 60) & (F.col("iqr") > 0) & (
            (F.col("outlier_share") >= 0.03) | (F.col("skew") >= 1.1)), F.lit(False)
        ).alias("passes"))


def histogram(df: DataFrame, caps: dict[str, float | None], bins: int = BINS,
              overflow: bool = True) -> DataFrame:
    """`measure, bin, lo, hi, n`: equal bins over all values up to a measure's cap.

    Values beyond the cap are counted in one more bin, from the cap to the largest
    value, unless `overflow` is off. Empty bins have no row.
    """
    measures = list(caps)
    numbers = {m: as_number(df, m) for m in measures}
    values = {m: x if caps[m] is None else F.when(x <= float(caps[m]), x) for m, x in numbers.items()}
    ends = stack_row([
        F.struct(F.lit(m).alias("name"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.max(numbers[m]).alias("top"))
        for m, x in values.items()], df).collect()
    ends = {r.name: (r.lo, r.hi, r.top) for r in ends if r.lo is not None}
    if not ends:
        return df.sparkSession.createDataFrame(
            [], "measure string, bin int, lo double, hi double, n bigint")

    def place(m: str) -> Column:
        lo, hi, _ = ends[m]
        within = F.lit(1) if hi == lo else F.least(F.lit(bins), F.floor((values[m] - lo) / ((hi - lo) / bins)) + 1)
        found = F.when(values[m].isNotNull(), within)
        if overflow and caps[m] is not None:
            found = found.when(numbers[m] > float(caps[m]), bins + 1)
        return found.cast("int")

    counted = counts_by_value(df, {m: place(m) for m in ends})
    edges = df.sparkSession.createDataFrame(
        [(m, lo, (hi - lo) / bins, caps[m], top) for m, (lo, hi, top) in ends.items()],
        "name string, _lo double, _width double, _cap double, _top double")
    beyond = F.col("value") > bins
    left = F.col("_lo") + (F.col("value") - 1) * F.col("_width")
    return counted.join(F.broadcast(edges), "name").select(
        F.col("name").alias("measure"), F.col("value").alias("bin"), F.when(beyond, F.col("_cap")).otherwise(left).alias("lo"),
        F.when(beyond, F.col("_top")).otherwise(left + F.col("_width")).alias("hi"), "n")


def capped_sample(df: DataFrame, measure: str, cap: float | None, n: int = 5_000,
                  seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """Seeded sample of the finite values up to the cap.

    Rows are told apart by `key`; without one, by all their columns.
    """
    kept = df.select(as_number(df, measure).alias("value"), row_key(df, key).alias("_row"))
    kept = kept.where(F.col("value").isNotNull() if cap is None else F.col("value") <= float(cap))
    return fixed_sample(kept, n, seed, ["_row"]).select("value")
