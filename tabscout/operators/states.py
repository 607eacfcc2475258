"""Profiles that merge: what is kept of a table so that its profile and another's give that of both.

A state is one small row per column: counts, moments about the mean, extremes, and two sketches, of the
distinct values and of the quantiles. Saved day by day, states answer for any days without reading them again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.functions.exprs import as_number, is_scalar, present, type_of
from tabscout.operators.common import stack_row, union_all
from tabscout.operators.profile import QUANTILE_NAMES, QUANTILES

#: Size of the sketch of distinct values: 2 ** LG_K cells of a relative standard error of 1.04 / 2 ** (LG_K / 2).
LG_K = 14
#: Size of the sketch of quantiles; their ranks are off by less than RANK_ERROR in 99 cases of 100.
KLL_K, RANK_ERROR = 800, 0.0035
DISTINCT_ERROR = 1.04 / 2 ** (LG_K / 2)


def table_state(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per plain column; null and NaN are missing, only finite numbers have moments and quantiles."""
    columns = list(columns or [c for c in df.columns if is_scalar(type_of(df, c))])

    def one(c: str) -> Column:
        x = as_number(df, c)
        n, var = F.count(x), F.coalesce(F.var_pop(x), F.lit(0.0))
        skew = F.when(F.min(x) < F.max(x), F.skewness(x)).otherwise(F.lit(0.0))
        return F.struct(
            F.lit(df.columns.index(c)).alias("pos"), F.lit(c).alias("name"), F.lit(type_of(df, c).simpleString()).alias("dtype"),
            F.count("*").alias("rows"), F.count(present(df, c)).alias("non_null"), n.alias("n_num"),
            F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), (var * n).alias("m2"), (skew * F.pow(var, F.lit(1.5)) * n).alias("m3"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.hll_sketch_agg(present(df, c).cast("string"), LG_K).alias("distinct"),
            F.kll_sketch_agg_double(x, KLL_K).alias("quantiles"))

    return stack_row([one(c) for c in columns], df)


def merged_states(states: Sequence[DataFrame]) -> DataFrame:
    """The state of the rows of all tables; columns go together by name."""
    whole = F.expr("sum(n_num * mean) OVER (PARTITION BY name) / nullif(sum(n_num) OVER (PARTITION BY name), 0)")
    parts = union_all(list(states)).withColumn("_mean", F.coalesce(whole, F.lit(0.0))).withColumn("_d", F.col("mean") - F.col("_mean"))
    n, d = F.col("n_num"), F.col("_d")
    return parts.groupBy("name").agg(
        F.min("pos").alias("pos"), F.min_by("dtype", "pos").alias("dtype"), *[F.sum(c).alias(c) for c in ("rows", "non_null", "n_num")],
        F.first("_mean").alias("mean"), F.sum(F.col("m2") + n * d * d).alias("m2"),
        F.sum(F.col("m3") + 3 * F.col("m2") * d + n * d * d * d).alias("m3"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("quantiles", KLL_K).alias("quantiles"),
    ).select(*parts.drop("_mean", "_d").columns)


def state_profile(state: DataFrame) -> DataFrame:
    """The profile that a state gives: counts, extremes and moments are exact, `unique` and quantiles are close."""
    n, var = F.col("n_num"), F.try_divide("m2", "n_num")
    has = n > 0
    quantile = lambda p: F.when(has, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))))
    return state.select(
        "pos", "name", "dtype", "rows", "non_null",
        F.try_divide(F.col("rows") - F.col("non_null"), F.col("rows")).alias("missing_rate"),
        F.hll_sketch_estimate("distinct").alias("unique"), "n_num", "min", "max", F.when(has, F.col("mean")).alias("mean"),
        F.when(has, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std"),
        F.when(has, F.coalesce(F.try_divide(F.col("m3") / n, F.pow(var, F.lit(1.5))), F.lit(0.0))).alias("skew"),
        *[quantile(p).alias(name) for name, p in zip(QUANTILE_NAMES, QUANTILES)])
