"""Repeatable samples: the rows with the lowest seeded hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabscout.functions.exprs import is_scalar, quoted, type_of

HASH_STEPS = 1 << 32
# Of tables with more rows the samples of so many shares of the tasks are taken first.
TREE_ROWS, SHARES = 1_000_000_000, 1000


def row_key(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """MD5 of the texts of the named columns (by default of all plain ones), which tells rows apart."""
    columns = columns or [c for c in df.columns if is_scalar(type_of(df, c))]
    return F.md5(F.concat_ws("|", *[F.coalesce(quoted(c).cast("string"), F.lit("")) for c in columns]))


def _hash_text(df: DataFrame, seed: int, columns: Sequence[str] | None) -> Column:
    """The first 15 hex digits of the MD5 of seed and named columns; any engine can work it out."""
    columns = columns or [c for c in df.columns if is_scalar(type_of(df, c))]
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(quoted(c).cast("string"), F.lit("")) for c in columns])
    return F.substring(F.md5(text), 1, 15)


def row_hash(df: DataFrame, seed: int = 0, columns: Sequence[str] | None = None) -> Column:
    """The same as a number of 60 bits."""
    return F.conv(_hash_text(df, seed, columns), 16, 10).cast("bigint")


def hash_share(h: Column) -> Column:
    """The hash as a number in [0, 2**32), even over its range."""
    return F.shiftright(h, 28)


def lowest_hash_rows(df: DataFrame, keys: Sequence[str], values: Sequence[str], h: str,
                     n: int) -> DataFrame:
    """Per key the n rows with the lowest hash `h`, numbered by `rn` from 1.

    Equal rows are counted before they are ranked, so a mass of copies costs no
    more than one of them; their copies come back in the result.
    """
    keys, values = list(keys), list(values)
    counted = df.groupBy(*keys, h, *values).agg(F.count("*").alias("_copies"))
    order = Window.partitionBy(*keys).orderBy(h, *values)
    top = counted.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
    before = F.coalesce(
        F.sum("_copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.least(F.col("_before") + F.col("_copies"), F.lit(n))
    place = F.explode(F.sequence((F.col("_before") + 1).cast("int"), last.cast("int")))
    return (
        top.withColumn("_before", before).where(F.col("_before") < n)
        .select(*keys, *values, place.alias("rn"))
    )


def fixed_sample(df: DataFrame, n: int, seed: int = 42, key: Sequence[str] | None = None,
                 rows: int | None = None) -> DataFrame:
    """n rows without replacement, the same ones on every run and any partitioning.

    They are the n rows of lowest hash, of equal hash those of lowest values. One scan: each
    task keeps a heap of n rows, and the heaps are merged. `rows` is the number of rows, if it is
    known; of a table with more than TREE_ROWS the heaps are merged in shares first.
    """
    if rows is not None and rows <= n:
        return df
    names = [f"c{i}" for i in range(len(df.columns))]
    hashed = df.select(_hash_text(df, seed, key).alias("_h"), *[quoted(c).alias(x) for c, x in zip(df.columns, names)])
    if rows is not None and rows > TREE_ROWS:
        share = Window.partitionBy("_share").orderBy("_h", *names)
        hashed = hashed.withColumn("_share", F.pmod(F.spark_partition_id(), F.lit(SHARES))).withColumn(
            "_rank", F.row_number().over(share)).where(F.col("_rank") <= n)
    return hashed.orderBy("_h", *names).limit(n).select(*[F.col(x).alias(c) for c, x in zip(df.columns, names)])
