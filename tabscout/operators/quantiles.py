"""Exact quantiles, with linear interpolation, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabscout.operators.common import BROADCAST_ROWS

# Equal steps that a bucket with a wanted rank is split into.
SPLITS = 4096
# Rows of a bucket that one task may put in order.
SORT_ROWS = 500_000


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              exact: bool = True, key_count: int | None = None) -> DataFrame:
    """Per key: `n` (non-null values) and `q`, the quantiles at `probs`.

    Only counts are shuffled: values are counted by magnitude, and of the buckets that hold
    wanted ranks only the values, with their number of copies, are put in order. These
    buckets come to the driver, BROADCAST_ROWS of them at most, and go out again with a scan:
    no row leaves its task but for those in a bucket, and buckets of more than SORT_ROWS rows are split
    as often as it takes. Of more keys than that the rows are shuffled to their buckets, which are then split
    into equal steps. `key_count`, a known bound on the number of keys, spares the look
    where there are too many. `exact=False` takes the sketch of `approx_percentile` instead.
    """
    keys = list(keys)
    data = df.where(F.col(value).isNotNull())
    if not exact:
        q = F.percentile_approx(value, list(probs), 10_000)
        return data.groupBy(*keys).agg(F.count("*").alias("n"), q.alias("q"))
    groups = [f"_g{i}" for i in range(max(len(keys), 1))]
    named = [F.col(k).alias(g) for k, g in zip(keys, groups)] or [F.lit(1).alias("_g0")]
    x = F.col("_x").cast("double")
    few = key_count is None or key_count * 2 * len(probs) <= BROADCAST_ROWS
    rows = data.select(*named, F.col(value).alias("_x")).withColumn("_bucket", _magnitude(x))
    sizes = rows.groupBy(*groups, "_bucket").agg(
        F.count("*").alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    upto = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    coarse = _holding(sizes.select(
        *groups, "_bucket", "_n", "_lo", "_hi", (F.sum("_n").over(upto) - F.col("_n")).alias("_start"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("_total")), probs)
    schema = coarse.select(*groups, "_bucket", "_lo", "_hi", "_n", "_start", "_total").schema
    held = coarse.limit(BROADCAST_ROWS + 1).collect() if few else []
    if few and len(held) <= BROADCAST_ROWS:
        parts = [tuple(r[c] for c in schema.names) for r in held]
        found = _pick(_in_order(rows, schema, parts, groups, probs), groups, probs)
        return found.select(*[F.col(g).alias(k) for k, g in zip(keys, groups)], "n", "q")
    step = F.coalesce(F.floor(F.try_divide((x - F.col("_lo")) * SPLITS, F.col("_hi") - F.col("_lo"))), F.lit(0))
    split = _join(rows, coarse, [*groups, "_bucket"], False).withColumn("_step", step).drop("_lo", "_hi", "_n")
    upto = Window.partitionBy(*groups, "_bucket").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    fine = _holding(split.groupBy(*groups, "_bucket", "_step", "_start", "_total").agg(F.count("*").alias("_n")).withColumn(
        "_start", F.col("_start") + F.sum("_n").over(upto) - F.col("_n")), probs)
    place = [*groups, "_bucket", "_step"]
    left = _join(split.drop("_start", "_total"), fine.drop("_n"), place, False)
    counted = left.groupBy(*place, "_start", "_total", "_x").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(*place).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("_first", F.col("_start") + F.sum("_n").over(inside) - F.col("_n"))
    found = _pick(ranked, groups, probs)
    return found.select(*[F.col(g).alias(k) for k, g in zip(keys, groups)], "n", "q")


def _in_order(rows: DataFrame, schema: T.StructType, parts: list[tuple], groups: list[str],
              probs: Sequence[float]) -> DataFrame:
    """The values of the parts that hold wanted ranks, with their first rank and copies.

    A part is an interval of one bucket; there are at most two for each key and quantile."""
    spark, place = rows.sparkSession, [*groups, "_bucket"]
    x = F.col("_x").cast("double")

    def within(some: list[tuple]) -> DataFrame:
        numbered = spark.createDataFrame([(i, *p) for i, p in enumerate(some)], T.StructType(
            [T.StructField("_part", T.IntegerType()), *schema.fields])).drop("_n")
        return _join(rows, numbered, place, True).where(x.between(F.col("_lo"), F.col("_hi")))

    lo, hi, n, start, total = range(len(place), len(schema.names))
    while large := [p for p in parts if p[n] > SORT_ROWS and p[lo] < p[hi]]:
        step = F.floor((x - F.col("_lo")) * SPLITS / (F.col("_hi") - F.col("_lo")))
        split = within(large).groupBy("_part", step.alias("_step")).agg(
            F.count("*").alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.first("_start").alias("_start"),
            F.first("_total").alias("_total"))
        upto = Window.partitionBy("_part").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
        held = _holding(split.withColumn("_start", F.col("_start") + F.sum("_n").over(upto) - F.col("_n")), probs).collect()
        parts = [p for p in parts if p not in large] + [
            (*large[r["_part"]][:lo], r["_lo"], r["_hi"], r["_n"], r["_start"], r["_total"]) for r in held]
    counted = within(parts).groupBy(*groups, "_part", "_start", "_total", "_x").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy("_part").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("_first", F.col("_start") + F.sum("_n").over(inside) - F.col("_n"))


def _magnitude(x: Column) -> Column:
    """A number that grows with the value, in eighths of its binary exponent."""
    size = F.floor(8 * F.log2(F.abs(x))) + 8 * 1080
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * size).cast("bigint")


def _ranks(p: float) -> list[str]:
    return [f"{side}((_total - 1) * {float(p)!r}D)" for side in ("floor", "ceil")]


def _holding(sizes: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Those of the parts (`_start`, `_n`, `_total`) that hold a wanted rank."""
    ranks = dict.fromkeys(r for p in probs for r in _ranks(p))
    return sizes.where(" OR ".join(f"({r} >= _start AND {r} < _start + _n)" for r in ranks))


def _join(rows: DataFrame, parts: DataFrame, on: Sequence[str], few: bool) -> DataFrame:
    """The rows in the wanted parts; null keys are keys like others."""
    other = parts.select(*[F.col(c).alias(f"{c}_at" if c in on else c) for c in parts.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_at"))
    return rows.join(F.broadcast(other) if few else other, same).drop(*[f"{c}_at" for c in on])


def _pick(ranked: DataFrame, groups: list[str], probs: Sequence[float]) -> DataFrame:
    """Interpolate between the values at the two ranks next to each quantile."""
    def at(rank: str) -> Column:
        return F.expr(f"max(CASE WHEN _first <= {rank} AND {rank} < _first + _n THEN _x END)")

    found = ranked.groupBy(*groups).agg(
        F.max("_total").alias("n"),
        *[at(r).alias(f"_{side}{i}") for i, p in enumerate(probs) for side, r in zip(("lo", "hi"), _ranks(p))])

    def mixed(i: int, p: float) -> Column:
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        spot = (F.col("n") - 1) * F.lit(float(p))
        return lo + (hi - lo) * (spot - F.floor(spot))

    return found.select(*groups, "n", F.array(*[mixed(i, p) for i, p in enumerate(probs)]).alias("q"))


def group_medians(df: DataFrame, keys: Sequence[str], value: str, exact: bool = True,
                  key_count: int | None = None) -> DataFrame:
    """Per key: `n` values and their `median`."""
    q = quantiles(df, keys, value, [0.5], exact, key_count)
    return q.select(*keys, "n", F.element_at("q", 1).alias("median"))
