"""Small pieces that several operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A table of at most this many rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
# Columns handled by one unpivot; each one multiplies the rows passed on.
COLUMN_CHUNK = 20
# Structs of aggregates worked out by one aggregation.
STRUCT_CHUNK = 4
# Columns whose aggregations go into one job.
JOB_CHUNK = 40


def chunks(items: Sequence, size: int = COLUMN_CHUNK) -> list[list]:
    items = list(items)
    return [items[i:i + size] for i in range(0, len(items), size)]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def long_form(df: DataFrame, name: str, value: str, columns: dict[str, Column],
              keep: Sequence[Column] = ()) -> DataFrame:
    """One row per (row, column): the column's name, its value and the kept columns.

    All columns must have one type. Null values stay in.
    """
    kept = df.select(*keep).columns if keep else []
    held = [f"_k{i}" for i in range(len(kept))]
    parts = []
    for chunk in chunks(list(columns)):
        wide = df.select(*[k.alias(h) for k, h in zip(keep, held)],
                         *[columns[c].alias(c) for c in chunk])
        cells = ["`" + c.replace("`", "``") + "`" for c in chunk]
        parts.append(wide.unpivot(held, cells, name, value))
    return union_all(parts).select(
        *[F.col(h).alias(k) for h, k in zip(held, kept)], name, value)


def stack_row(structs: Sequence[Column], df: DataFrame, size: int = STRUCT_CHUNK) -> DataFrame:
    """Aggregate the table into several structs and give each its own row.

    A few structs at a time: one aggregation over all of them outgrows what the
    JVM compiles, while each of several reads its own columns only.
    """
    parts = [
        df.agg(F.array(*chunk).alias("_a")).select(F.inline("_a"))
        for chunk in chunks(structs, size)
    ]
    return union_all(parts)


def counts_by_value(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`name, value, n`: copies of every non-null value of each column.

    Each column is counted on its own, reading only what it needs and with
    map-side combine; all columns must have one type.
    """
    return union_all([
        df.select(x.alias("value")).where(F.col("value").isNotNull())
        .groupBy("value").agg(F.count("*").alias("n"))
        .select(F.lit(name).alias("name"), "value", "n")
        for name, x in columns.items()
    ])


def join_small(big: DataFrame, small: DataFrame, on: Sequence[str], small_rows: int,
               how: str = "inner") -> DataFrame:
    """Join against a table of known size: broadcast it while it is small."""
    if small_rows <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, list(on), how)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in local mode, where that is unset, a temporary one."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local") or "cluster" in sc.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tabscout-")
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Save a table under the cluster's checkpoint folder and go on from there."""
    folder = shared_folder(df.sparkSession)
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()
