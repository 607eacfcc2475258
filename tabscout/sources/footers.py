"""Facts of a Parquet table from the footers of its files, where these are exact."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.functions.exprs import FLOATING, TEMPORAL, is_scalar, present, quoted, type_of

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
#: With these, Spark answers count, min and max from footers if it can.
FOOTER_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _from_footers(spark: SparkSession, path: str, aggregates) -> tuple | None:
    """The aggregates of a table, a function of its DataFrame, if footers alone can tell them."""
    with _settings(spark, FOOTER_SETTINGS):
        found = spark.read.parquet(path)
        found = found.agg(*aggregates(found))
        try:
            if "PushedAggregation: [COUNT" not in found._jdf.queryExecution().executedPlan().toString():
                return None
            return tuple(found.first())
        except (PySparkException, Py4JJavaError):  # a file without the statistics
            return None


def footer_facts(spark: SparkSession, path: str) -> DataFrame:
    """`name, rows, non_null, missing_rate, low, high, first, last, from_footers`, one row per plain column.

    low and high are of whole numbers and flags, first and last of dates and times. Footers count nulls, and tell
    the extremes of whole numbers, flags and dates; where a file lacks them, the columns are read. Numbers with a
    fraction are read, as their NaN is missing but no null, and so are the extremes of times. from_footers tells
    whose facts all came from footers.
    """
    df = spark.read.parquet(path)
    columns = [c for c in df.columns if is_scalar(type_of(df, c))]
    whole = [c for c in columns if isinstance(type_of(df, c), (*WHOLE, T.DateType))]
    plain = [c for c in columns if not isinstance(type_of(df, c), FLOATING)]

    def facts(some: list[str]):
        return lambda t: [F.count("*"), *[F.count(quoted(c)) for c in plain],
                          *[f(quoted(c)) for c in some for f in (F.min, F.max)]]

    found, extremes = _from_footers(spark, path, facts(whole)), whole
    if found is None:  # counts need less than extremes
        found, extremes = _from_footers(spark, path, facts([])), []
    counts: dict[str, int] = {}
    ends: dict[str, tuple] = {}
    rows = None
    if found is not None:
        rows = found[0]
        counts = dict(zip(plain, found[1:]))
        ends = {c: found[1 + len(plain) + 2 * i:][:2] for i, c in enumerate(extremes)}
    timed = [c for c in columns if isinstance(type_of(df, c), TEMPORAL)]
    unread = [c for c in columns if c not in counts]
    unknown = [c for c in {*whole, *timed} if c not in ends]
    if unread or unknown or rows is None:
        read = df.agg(F.count("*"), *[F.count(present(df, c)) for c in unread], *[f(quoted(c)) for c in unknown for f in (F.min, F.max)]).first()
        rows = read[0]
        counts |= dict(zip(unread, read[1:]))
        ends |= {c: read[1 + len(unread) + 2 * i:][:2] for i, c in enumerate(unknown)}

    def row(c: str) -> tuple:
        low, high = ends.get(c, (None, None))
        number = isinstance(type_of(df, c), WHOLE) and low is not None
        times = (low, high) if c in timed else (None, None)
        return (c, rows, counts[c], (rows - counts[c]) / rows if rows else None, float(low) if number else None, float(high) if number else None,
                *[str(t) if t is not None else None for t in times], c not in unread and c not in unknown)

    made = spark.createDataFrame([row(c) for c in columns], "name string, rows bigint, non_null bigint, missing_rate double, low double, "
                                 "high double, _first string, _last string, from_footers boolean")
    return made.select("name", "rows", "non_null", "missing_rate", "low", "high", F.col("_first").cast("timestamp_ntz").alias("first"),
                       F.col("_last").cast("timestamp_ntz").alias("last"), "from_footers")
