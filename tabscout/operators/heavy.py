"""The commonest values of a column, found without shuffling all of its values.

Each task keeps a bounded summary of counts: when it holds too many values, all counts are cut by that of
the first value over the bound, and what was cut is added to the task's error. A value's count is at most
its summary count plus all errors. So those that may be among the commonest are known, are counted
again exactly in a second scan, and the result is proven if the last of them is commoner than all errors.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.functions.exprs import group_text
from tabscout.operators.common import BROADCAST_ROWS
from tabscout.operators.profile import TOP_VALUES

#: Values that a task keeps after each cut; up to twice as many are held in between.
HELD_VALUES = 20_000


def cut_counts(counts: Counter, held: int) -> tuple[Counter, int]:
    """The counts less that of the first value over the bound, and what was taken off."""
    if len(counts) <= held:
        return counts, 0
    off = counts.most_common(held + 1)[-1][1]
    return Counter({v: n - off for v, n in counts.items() if n > off}), off


def summaries(values: DataFrame, held: int = HELD_VALUES) -> DataFrame:
    """`value, n, error`: per task the values of its summary, and its error in a row of null.

    values: one column of text; null does not count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        error = 0
        for b in batches:
            for pair in pc.value_counts(b.column(0).drop_null()).to_pylist():
                counts[pair["values"]] += pair["counts"]
            if len(counts) > 2 * held:
                counts, off = cut_counts(counts, held)
                error += off
        counts, off = cut_counts(counts, held)
        yield pa.RecordBatch.from_arrays([
            pa.array([*counts, None], pa.string()), pa.array([*counts.values(), 0], pa.int64()),
            pa.array([0] * len(counts) + [error + off], pa.int64())], ["value", "n", "error"])

    return values.mapInArrow(run, "value string, n bigint, error bigint")


def heavy_values(df: DataFrame, column: str, top: int = TOP_VALUES, held: int = HELD_VALUES) -> DataFrame:
    """`value, rows, share, rank`: the `top` commonest non-null values, equal counts by value; exact.

    Where the summaries cannot prove it, as of a column of many values that are equally common, all
    values are counted."""
    values = df.select(group_text(df, column).alias("value")).where("value IS NOT NULL")
    merged = summaries(values, held).groupBy("value").agg(F.sum("n").alias("n"), F.sum("error").alias("error"))
    best = merged.orderBy(F.desc("n"), "value").limit(top + 1)
    spark = df.sparkSession
    error = merged.agg(F.sum("error")).first()[0] or 0
    least = min((r.n for r in best.where("value IS NOT NULL").limit(top).collect()), default=0)
    may = merged.where((F.col("value").isNotNull()) & (F.col("n") + error >= least)).select("value").limit(BROADCAST_ROWS + 1).collect()
    counted = None
    if len(may) <= BROADCAST_ROWS:
        some = spark.createDataFrame([(r.value,) for r in may], "value string")
        exact = values.join(F.broadcast(some), "value").groupBy("value").agg(F.count("*").alias("rows")).orderBy(
            F.desc("rows"), "value").limit(top).collect()
        if error == 0 or (len(exact) == top and exact[-1].rows > error):
            counted = spark.createDataFrame([tuple(r) for r in exact], "value string, rows bigint")
    if counted is None:
        counted = values.groupBy("value").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "value").limit(top)
    total = values.count()
    rank = F.expr("row_number() OVER (ORDER BY rows DESC, value)")
    return counted.select("value", "rows", (F.col("rows") / F.lit(total)).alias("share"), rank.alias("rank"))
