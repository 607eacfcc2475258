"""Column profile: counts, distinct values, numeric summary and roles.

The profile of a table is one row per column. It decides what is worked out
next, so it is small, is brought to the driver once and lives on as a local
DataFrame. Everything that reads the table itself is an aggregation with
map-side combine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabscout.functions import words as w
from tabscout.functions.exprs import (
    FLOATING, TEMPORAL, as_number, as_timestamp, date_format_of, date_like, group_text, is_scalar,
    present, quoted, type_of,
)
from tabscout.functions.names import human_label, name_has, name_is_bad_axis, name_is_id
from tabscout.operators.common import (
    JOB_CHUNK, chunks, counts_by_value, cut_lineage, long_form, stack_row, union_all,
)
from tabscout.operators.quantiles import quantiles
from tabscout.operators.sampling import HASH_STEPS, hash_share, lowest_hash_rows, row_hash

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
QUANTILE_NAMES = ("p05", "p25", "median", "p75", "p95", "p99")
TOP_VALUES = 15
SHOWN_VALUES = 5
# Columns with at most so many distinct values are listed by value.
LISTED_VALUES = 100
# Texts longer than this on average are told apart by digest, not carried along.
DIGEST_LENGTH = 40
# Expected rows per column that come through the hash threshold of the sample.
SAMPLE_ROWS = 4_000

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)

PROFILE_SCHEMA = (
    "dataset string, pos int, name string, label string, role string, dtype string, "
    "rows bigint, non_null bigint, missing_rate double, unique bigint, unique_rate double, "
    "sample_values array<string>, positive_value string, numeric_codes boolean, "
    "num struct<min: double, max: double, mean: double, median: double, std: double, "
    "skew: double, p05: double, p25: double, p75: double, p95: double, p99: double>, "
    "ts struct<min: timestamp_ntz, max: timestamp_ntz>, ts_format string, "
    "top_values array<struct<value: string, rows: bigint, share: double>>, "
    "is_candidate boolean, reason_excluded string"
)


def skew_of(x: Column) -> Column:
    """Population skew; 0 for a constant or fewer than three values."""
    flat = (F.min(x) == F.max(x)) | (F.count(x) < 3)
    return F.when(flat, F.lit(0.0)).otherwise(F.skewness(x))


def std_of(x: Column) -> Column:
    return F.when(F.min(x) == F.max(x), F.lit(0.0)).otherwise(F.stddev_pop(x))


# --- statistics in one pass -------------------------------------------------

def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row of counts and moments per column, from one aggregation without a shuffle."""
    columns = list(columns or df.columns)
    positions = {c: i for i, c in enumerate(df.columns)}
    kinds = {c: type_of(df, c) for c in columns}

    def inputs(i: int, c: str) -> list[Column]:
        cells = [present(df, c).alias(f"p{i}")]
        if isinstance(kinds[c], T.StringType):
            cells.append(F.length(quoted(c)).alias(f"l{i}"))
        if isinstance(kinds[c], TEMPORAL):
            cells.append(as_timestamp(df, c).alias(f"t{i}"))
        elif is_scalar(kinds[c]):
            cells.append(as_number(df, c).alias(f"x{i}"))
        return cells

    def outputs(i: int, c: str) -> Column:
        timed = isinstance(kinds[c], TEMPORAL)
        x = f"x{i}" if is_scalar(kinds[c]) and not timed else None
        length = f"avg(l{i})" if isinstance(kinds[c], T.StringType) else "CAST(NULL AS DOUBLE)"
        flat = f"min({x}) = max({x})"
        moments = {
            "min": f"min({x})", "max": f"max({x})", "mean": f"avg({x})",
            "std": f"CASE WHEN {flat} THEN 0D ELSE stddev_pop({x}) END",
            "skew": f"CASE WHEN {flat} OR count({x}) < 3 THEN 0D ELSE skewness({x}) END",
        }
        times = {"ts_min": f"min(t{i})", "ts_max": f"max(t{i})"}
        fields = {
            "pos": str(positions[c]), "name": f"'{_escaped(c)}'",
            "dtype": f"'{_escaped(kinds[c].simpleString())}'", "rows": "count(*)",
            "non_null": f"count(p{i})", "n_num": f"count({x})" if x else "0L",
            "mean_length": length,
            **{k: v if x else "CAST(NULL AS DOUBLE)" for k, v in moments.items()},
            **{k: v if timed else "CAST(NULL AS TIMESTAMP_NTZ)" for k, v in times.items()},
        }
        return F.expr("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")")

    base = df.select(*[x for i, c in enumerate(columns) for x in inputs(i, c)])
    return stack_row([outputs(i, c) for i, c in enumerate(columns)], base)


def missing_rates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    def one(c: str) -> Column:
        rows, cells = F.count("*"), F.count(present(df, c))
        return F.struct(
            F.lit(c).alias("name"), rows.alias("rows"), (rows - cells).alias("missing"),
            F.try_divide(rows - cells, rows).alias("missing_rate"),
        )
    return stack_row([one(c) for c in columns or df.columns], df)


def numeric_share(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of the non-null cells of a column that are finite numbers."""
    def one(c: str) -> Column:
        cells, numbers = F.count(present(df, c)), F.count(as_number(df, c))
        return F.struct(
            F.lit(c).alias("name"), cells.alias("non_null"), numbers.alias("numbers"),
            F.coalesce(F.try_divide(numbers, cells), F.lit(0.0)).alias("numeric_share"),
        )
    return stack_row([one(c) for c in columns or df.columns], df)


def date_range(df: DataFrame, formats: dict[str, str | None]) -> DataFrame:
    """First and last time of each column; text columns come with their format."""
    def one(c: str) -> Column:
        ts = as_timestamp(df, c, formats[c])
        return F.struct(F.lit(c).alias("name"), F.count(ts).alias("valid"),
                        F.min(ts).alias("min"), F.max(ts).alias("max"))
    return stack_row([one(c) for c in formats], df)


def numeric_summary(df: DataFrame, columns: Sequence[str], rows: int | None = None,
                    exact: bool = True) -> DataFrame:
    """Moments and quantiles of the finite values of each column."""
    def one(c: str) -> Column:
        x = as_number(df, c)
        return F.struct(
            F.lit(c).alias("name"), F.count(x).alias("n"), F.min(x).alias("min"),
            F.max(x).alias("max"), F.avg(x).alias("mean"), std_of(x).alias("std"),
            skew_of(x).alias("skew"))
    moments = stack_row([one(c) for c in columns], df)
    q = column_quantiles(df, columns, QUANTILES, rows, exact).select(
        "name", *[F.element_at("q", i + 1).alias(p) for i, p in enumerate(QUANTILE_NAMES)])
    return moments.join(F.broadcast(q), "name", "left")


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                     rows: int | None = None, exact: bool = True) -> DataFrame:
    """`name, n, q`: quantiles of the finite values of several columns."""
    if not exact:
        def one(c: str) -> Column:
            x = as_number(df, c)
            q = F.percentile_approx(x, list(probs), 10_000)
            return F.struct(F.lit(c).alias("name"), F.count(x).alias("n"), q.alias("q"))
        return stack_row([one(c) for c in columns], df)
    cells = long_form(df, "name", "value", {c: as_number(df, c) for c in columns})
    return quantiles(cells, ["name"], "value", probs, key_count=len(columns))


# --- distinct values --------------------------------------------------------

def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`name, value, rows` of every non-null value of the columns, as text."""
    return counts_by_value(df, {c: group_text(df, c) for c in columns}).withColumnRenamed(
        "n", "rows")


def top_values(counts: DataFrame, top: int = TOP_VALUES) -> DataFrame:
    """Most frequent values per column; `share` is of its non-null rows.

    Ranks are cut before the shuffle, so a column with very many values sends
    only `top` of them per task.
    """
    ranked = Window.partitionBy("name").orderBy(F.desc("rows"), "value")
    first = counts.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    whole = counts.groupBy("name").agg(
        F.count("*").alias("unique"), F.sum("rows").alias("_all"))
    return first.join(F.broadcast(whole), "name").select(
        "name", "value", "rows", (F.col("rows") / F.col("_all")).alias("share"), "rank", "unique")


def _digest(df: DataFrame, c: str, mean_length: float | None) -> Column:
    long_text = isinstance(type_of(df, c), T.StringType) and (mean_length or 0) > DIGEST_LENGTH
    return F.sha2(quoted(c), 256) if long_text else present(df, c)


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True,
                    mean_lengths: dict[str, float | None] | None = None) -> DataFrame:
    """`name, unique` per column, null not counted.

    Each column is counted by its own aggregation, which reads only that
    column and shuffles every value once; long texts travel as SHA-256 digests.
    `exact=False` takes one pass with sketches instead.
    """
    columns = columns or [c for c in df.columns if is_scalar(type_of(df, c))]
    if not exact:
        return stack_row([
            F.struct(F.lit(c).alias("name"),
                     F.approx_count_distinct(present(df, c), 0.01).alias("unique"))
            for c in columns], df)
    if mean_lengths is None:
        texts = [c for c in columns if isinstance(type_of(df, c), T.StringType)]
        lengths = df.agg(*[F.avg(F.length(quoted(c))) for c in texts]).first() if texts else ()
        mean_lengths = dict(zip(texts, lengths))
    return union_all([
        df.agg(F.count_distinct(_digest(df, c, mean_lengths.get(c))).alias("unique"))
        .select(F.lit(c).alias("name"), "unique")
        for c in columns
    ])


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many rows equal an earlier one; nulls are equal to each other.

    Rows are compared by a 128-bit fingerprint (two 64-bit hashes with different
    seeds, over all values and the places of the nulls), so a shuffle moves 16
    bytes per distinct row and copies are counted before it. A false match
    among 1e11 rows has a chance of about 1e-17.
    """
    columns = list(columns or df.columns)

    def same(c: str) -> Column:
        dtype, col = type_of(df, c), present(df, c)
        if isinstance(dtype, FLOATING):
            return col + F.lit(0.0)  # -0.0 and 0.0 are one value
        return col if is_scalar(dtype) or isinstance(dtype, T.BinaryType) else F.to_json(
            F.struct(col), {"ignoreNullFields": "false"})

    # A hash passes over nulls, so their places are hashed as well.
    nulls = F.array(*[present(df, c).isNull() for c in columns])
    cells = [same(c) for c in columns]
    prints = df.select(
        F.xxhash64(F.lit(1), *cells, nulls).alias("_a"),
        F.xxhash64(F.lit(2), *cells, nulls).alias("_b"))
    counted = prints.groupBy("_a", "_b").agg(F.count("*").alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


# --- sequences ---------------------------------------------------------------

def _gap_verdict(gaps: DataFrame, key: Sequence[str]) -> DataFrame:
    """Is the median of the gaps exactly 1? From counts and the values next to 1."""
    below, at = F.count_if(F.col("gap") < 1), F.count_if(F.col("gap") == 1)
    return gaps.groupBy(*key).agg(
        F.count("gap").alias("m"), below.alias("below"), at.alias("at"),
        F.max(F.when(F.col("gap") < 1, F.col("gap"))).alias("last_below"),
        F.min(F.when(F.col("gap") > 1, F.col("gap"))).alias("first_above"),
    )


def _median_is_one(m: Column, below: Column, at: Column, last: Column, first: Column) -> Column:
    low = F.floor((m - 1) / 2)
    high = F.floor(m / 2)

    def nth(i: Column) -> Column:
        return F.when(i < below, last).when(i < below + at, F.lit(1.0)).otherwise(first)

    # The two middle gaps are both 1, or one is just below and one just above.
    return (m > 0) & ((nth(low) + nth(high)) / 2 == 1)


def sequence_test(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Do the sorted distinct values of a column mostly step by one?

    Whole numbers are folded into 64-value bit masks, which shrinks the shuffle
    and leaves neighbours within one word; other numbers are ranked by a range
    partitioning. Neither way brings a column's values into one task.
    """
    whole = {c: isinstance(type_of(df, c), WHOLE) for c in columns}
    unsure = [c for c in columns if not whole[c]]
    if unsure:
        facts = df.agg(*[
            F.count_if(as_number(df, c) != F.floor(as_number(df, c))) for c in unsure]).first()
        whole.update({c: facts[i] == 0 for i, c in enumerate(unsure)})
    parts = []
    masks = [c for c in columns if whole[c]]
    if masks:
        parts.append(_whole_gaps(df, masks))
    other = [c for c in columns if not whole[c]]
    if other:
        parts.append(_ranked_gaps(df, other))
    found = union_all(parts)
    rows = F.col("rows")
    share = F.try_divide("distinct_values", F.greatest(rows, F.lit(1)))
    mean_gap = F.try_divide(F.col("max") - F.col("min"), F.col("distinct_values") - 1)
    one = _median_is_one(*[F.col(x) for x in ("m", "below", "at", "last_below", "first_above")])
    return found.select(
        "name", "rows", "distinct_values", share.alias("distinct_share"),
        mean_gap.alias("mean_gap"), one.alias("median_gap_is_one"),
        F.coalesce(
            (rows > 80) & (F.col("distinct_values") > 8) & (share >= 0.82) & one
            & (mean_gap < 2.5), F.lit(False)).alias("is_sequence"),
    )


def _rows_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return stack_row([
        F.struct(F.lit(c).alias("name"), F.count("*").alias("rows"),
                 F.min(as_number(df, c)).alias("min"), F.max(as_number(df, c)).alias("max"))
        for c in columns], df)


def _whole_gaps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    def whole(c: str) -> Column:
        typed = isinstance(type_of(df, c), WHOLE)
        return (quoted(c) if typed else as_number(df, c)).cast("bigint")

    cells = long_form(df, "name", "value", {c: whole(c) for c in columns})
    cells = cells.where(F.col("value").isNotNull())
    bits = cells.groupBy("name", F.shiftright("value", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(pmod(value, 64))))").alias("mask"))
    mask = F.col("mask")
    # Does this word hold its last value, and does the one before it hold a
    # neighbour of our first value? Each word tells the word before it.
    here = bits.select(
        "name", "word", F.bit_count(mask).cast("bigint").alias("values"),
        F.bit_count(mask.bitwiseAND(F.shiftrightunsigned(mask, 1))).cast("bigint").alias("pairs"),
        (mask < 0).cast("int").alias("has_last"), F.lit(0).alias("next_first"))
    told = bits.where(mask.bitwiseAND(F.lit(1).cast("bigint")) == 1).select(
        "name", (F.col("word") - 1).alias("word"), F.lit(0).cast("bigint").alias("values"),
        F.lit(0).cast("bigint").alias("pairs"), F.lit(0).alias("has_last"),
        F.lit(1).alias("next_first"))
    words = here.unionByName(told).groupBy("name", "word").agg(
        F.sum("values").alias("values"), F.sum("pairs").alias("pairs"),
        (F.max("has_last") * F.max("next_first")).alias("across"))
    sums = words.groupBy("name").agg(
        F.sum("values").alias("distinct_values"),
        (F.sum("pairs") + F.sum("across")).alias("at"))
    # Gaps of whole numbers are 1 or at least 2.
    return _rows_of(df, columns).join(F.broadcast(sums), "name", "left").select(
        "name", "rows", "min", "max", F.coalesce("distinct_values", F.lit(0)).alias(
            "distinct_values"),
        (F.coalesce("distinct_values", F.lit(1)) - 1).alias("m"),
        F.lit(0).cast("bigint").alias("below"), F.coalesce("at", F.lit(0)).alias("at"),
        F.lit(None).cast("double").alias("last_below"), F.lit(2.0).alias("first_above"))


def _ranked_gaps(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = long_form(df, "name", "value", {c: as_number(df, c) for c in columns})
    distinct = cells.where(F.col("value").isNotNull()).groupBy("name", "value").agg(
        F.count("*").alias("n"))
    placed = cut_lineage(distinct.repartitionByRange("name", "value").withColumn(
        "_part", F.spark_partition_id()))
    inside = Window.partitionBy("name", "_part").orderBy("value")
    gap = F.col("value") - F.lag("value").over(inside)
    # The gaps between partitions come from their first and last values.
    ends = placed.groupBy("name", "_part").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"))
    across = ends.select("name", (F.col("lo") - F.lag("hi").over(
        Window.partitionBy("name").orderBy("_part"))).alias("gap"))
    gaps = placed.select("name", gap.alias("gap")).unionByName(across)
    sums = _gap_verdict(gaps, ["name"]).withColumn("distinct_values", F.col("m") + 1)
    return _rows_of(df, columns).join(F.broadcast(sums), "name", "left").select(
        "name", "rows", "min", "max", F.coalesce("distinct_values", F.lit(0)).alias(
            "distinct_values"), "m", "below", "at", "last_below", "first_above")


# --- first values and dates -------------------------------------------------

def _first_values(df: DataFrame, columns: Sequence[str], n: int, non_null: dict[str, int],
                  order: Sequence[str] | None, cut: bool) -> DataFrame:
    hashed = df.withColumn("_h", row_hash(df, 0, order))
    texts = {c: group_text(df, c) for c in columns}
    share = {c: SAMPLE_ROWS / non_null[c] if cut else 1.0 for c in columns}
    # Full columns are cut down by the hash; sparse ones by being null elsewhere.
    full = [c for c in columns if share[c] < 1]
    sparse = [c for c in columns if share[c] >= 1]
    parts = []
    if full:
        def cell(c: str) -> Column:
            return F.when(hash_share(F.col("_h")) < int(share[c] * HASH_STEPS), texts[c])
        widest = int(max(share[c] for c in full) * HASH_STEPS)
        kept = hashed.where(hash_share(F.col("_h")) < widest)
        parts.append(long_form(
            kept, "name", "value", {c: cell(c) for c in full}, [F.col("_h")]))
    if sparse:
        kept = hashed.where(F.coalesce(*[texts[c] for c in sparse]).isNotNull())
        parts.append(long_form(
            kept, "name", "value", {c: texts[c] for c in sparse}, [F.col("_h")]))
    cells = union_all(parts).where(F.col("value").isNotNull())
    return lowest_hash_rows(cells, ["name"], ["value"], "_h", n)


def first_values(df: DataFrame, columns: Sequence[str], n: int, non_null: dict[str, int],
                 order: Sequence[str] | None = None) -> DataFrame:
    """`name, rn, value`: the first n non-null values per column, as text.

    The order is a hash of the row, or of the `order` columns. Per column a
    threshold on the hash lets a few thousand rows through; a column for which
    that is too few (it is nearly all copies) is read again without one.
    """
    first = _first_values(df, columns, n, non_null, order, cut=True)
    cut = [c for c in columns if non_null[c] > SAMPLE_ROWS]
    if not cut:
        return first
    got = {r.name: r.n for r in first.groupBy("name").agg(F.count("*").alias("n")).collect()}
    short = [c for c in cut if got.get(c, 0) < n]
    if not short:
        return first
    return first.where(~F.col("name").isin(*short)).unionByName(
        _first_values(df, short, n, non_null, order, cut=False))


def dated_names(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """The columns whose names have a date word."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "name string")
    return {r.name for r in names.where(name_has("name", w.DATE_WORDS)).collect()}


def date_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`name, seen, ts_format, date_share` over all non-null values of each column.

    One format per column: the one that most values look like, the first of the list
    on a tie. A name with a date word has all values read; another one only those that
    look like a date, and at least 55 % (and five) of them must. Two scans, whatever the number
    of columns (up to COLUMN_CHUNK): looks are counted before the small exchange, then reading succeeds or fails.
    """
    spark, named = df.sparkSession, dated_names(df, columns)
    if not columns:
        return spark.createDataFrame([], "name string, seen bigint, ts_format string, date_share double")
    texts = {c: group_text(df, c) for c in columns}

    def look(c: str) -> Column:
        fmt = F.coalesce(date_format_of(texts[c]), F.lit(""))
        return fmt if c in named else F.when(date_like(texts[c]), fmt)

    looks = long_form(df, "name", "value", {c: look(c) for c in columns}).where("value IS NOT NULL").groupBy(
        "name", "value").agg(F.count("*").alias("n")).collect()
    order = {fmt: i for i, (_, fmt) in reversed(list(enumerate(w.DATE_FORMATS)))}
    best: dict[str, tuple] = {}
    like = dict.fromkeys(columns, 0)
    for r in looks:
        like[r.name] += r.n
        if r.value:
            best[r.name] = max(best.get(r.name, (0, 0, "")), (r.n, -order[r.value], r.value))
    formats = {c: best[c][2] if c in best else None for c in columns}

    def read(c: str) -> Column:
        """1 for a value, 2 for one that is read as a time."""
        time = as_timestamp(df, c, formats[c])
        good = (time if c in named else F.when(date_like(texts[c]), time)).isNotNull()
        return F.when(texts[c].isNotNull(), F.when(good, 2).otherwise(1))

    counted = long_form(df, "name", "value", {c: read(c) for c in columns}).where("value IS NOT NULL").groupBy("name").agg(
        F.count("*").alias("_seen"), F.count_if(F.col("value") == 2).alias("_good"))
    rows = spark.createDataFrame([(c, formats[c], like[c], c in named) for c in columns], "name string, ts_format string, _like bigint, _named boolean")
    seen = F.coalesce("_seen", F.lit(0).cast("bigint"))
    enough = F.col("_named") | (F.col("_like") >= F.greatest(F.lit(5.0), seen * 0.55))
    return rows.join(F.broadcast(counted), "name", "left").select(
        "name", seen.alias("seen"), "ts_format", F.coalesce(F.when(enough, F.try_divide("_good", "_like")), F.lit(0.0)).alias("date_share"))


# --- roles -------------------------------------------------------------------

def positive_value(low: Column, high: Column, name: Column | str) -> Column:
    """Positive class of a column whose only values are `low` and `high`."""
    both = F.array(low, high)
    norm = F.transform(both, lambda v: F.lower(F.trim(v)))
    known = F.lit(None).cast("string")
    for p in reversed(w.POSITIVE_VALUES):
        spot = F.array_position(norm, p)
        known = F.when(spot > 0, F.try_element_at(both, spot.cast("int"))).otherwise(known)
    a, b = low.try_cast("double"), high.try_cast("double")
    larger = F.when(a.isNotNull() & b.isNotNull() & (a > b), low).otherwise(high)
    return F.coalesce(known, F.when(name_has(name, w.OUTCOME_WORDS), larger))


def assign_roles(stats: DataFrame) -> DataFrame:
    """Role, candidate flag and reason per column, from its statistics.

    Needs: name, complex, typed_date, rows, non_null, unique, unique_rate,
    numeric_share, date_share, min_text, max_text, mean_length, is_sequence.
    """
    rows, unique = F.col("rows"), F.col("unique")
    positive = F.when(unique.between(1, 2), positive_value(
        F.col("min_text"), F.col("max_text"), "name"))
    few_codes = unique <= F.least(F.lit(20.0), F.greatest(F.lit(3.0), rows * 0.04))
    few_texts = unique <= F.least(F.lit(80.0), F.greatest(F.lit(12.0), rows * 0.25))
    codes = few_codes & ~name_has("name", w.MEASURE_GUARD_WORDS)
    geo = F.col("role").isin("latitude", "longitude")
    number = F.col("numeric_share") >= 0.85
    role = (
        F.when(F.col("complex"), "text")
        .when(name_has("name", w.LATITUDE_WORDS), "latitude")
        .when(name_has("name", w.LONGITUDE_WORDS), "longitude")
        .when(name_is_id("name"), "identifier")
        .when(F.col("date_share") >= 0.75, "datetime")
        .when(unique.between(1, 2) & positive.isNotNull(), "outcome")
        .when(unique.between(1, 2), "categorical")
        .when(number & F.col("is_sequence"), "identifier")
        .when(number & codes, "categorical")
        .when(number, "measure")
        .when(few_texts, "categorical")
        .otherwise("text")
    )
    bad = name_is_bad_axis("name") & ~geo
    mostly_missing = F.col("missing_rate_raw") > 0.85
    free_text = (F.col("unique_rate_raw") > 0.5) | (F.coalesce("mean_length", F.lit(0.0)) > 50)
    reason = (
        F.when(bad & ~F.col("role").isin("identifier", "text"),
               "name/code/text field; not used as chart axis")
        .when(mostly_missing, "mostly missing")
        .when((F.col("role") == "identifier") & name_is_id("name"), "identifier-like column")
        .when(F.col("role") == "identifier", "numeric sequence / identifier-like")
        .when((F.col("role") == "text") & free_text, "free text or mostly unique")
        .when(F.col("role") == "text", "not useful for charts")
    )
    return (
        stats.withColumn("role", role)
        .withColumn("positive_value", F.when(F.col("role") == "outcome", positive))
        .withColumn("numeric_codes", (F.col("role") == "categorical") & number & (unique > 2))
        .withColumn("is_candidate",
                    ~F.col("role").isin("identifier", "text") & ~mostly_missing & ~bad)
        .withColumn("reason_excluded", reason)
    )


_STATS_SCHEMA = (
    "pos int, name string, dtype string, complex boolean, rows bigint, non_null bigint, "
    "unique bigint, missing_rate_raw double, unique_rate_raw double, numeric_share double, "
    "date_share double, ts_format string, min_text string, max_text string, "
    "mean_length double, is_sequence boolean, sample_values array<string>, "
    "ts struct<min: timestamp_ntz, max: timestamp_ntz>"
)


def _two_values(top: list) -> tuple[str | None, str | None]:
    """Lowest and highest value of a column with at most two, by text."""
    values = sorted(v for _, v, _, _ in top)
    return (values[0], values[-1]) if 1 <= len(values) <= 2 else (None, None)


def _is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def profile_columns(df: DataFrame, dataset: str = "table", order: Sequence[str] | None = None,
                    exact: bool = True) -> DataFrame:
    """The profile: one row per column (PROFILE_SCHEMA), held as a local DataFrame.

    Steps, each one job over the columns that it needs: statistics; distinct
    counts; values of the columns with few of them; first values and date
    share; then, only where the rules ask for it, the sequence test, date
    ranges and quantiles. With `exact=False` distinct counts above 100 and
    quantiles are sketched, which spares the shuffles that grow with the number
    of distinct values.
    """
    spark = df.sparkSession
    stats = {r.name: r.asDict() for r in column_stats(df).collect()}
    rows = next(iter(stats.values()))["rows"]
    scalars = [c for c in df.columns if is_scalar(type_of(df, c))]

    unique = dict.fromkeys(df.columns, 0)
    tops: dict[str, list] = {c: [] for c in df.columns}
    if scalars:
        lengths = {c: stats[c]["mean_length"] for c in scalars}
        for some in chunks(scalars, JOB_CHUNK):
            counts = distinct_counts(df, some, exact, lengths)
            unique.update({r.name: r.unique for r in counts.collect()})
    # No rule looks at the values of a column with more than 80 of them; the
    # margin is for sketched counts.
    listed = [c for c in scalars if 0 < unique[c] <= LISTED_VALUES]
    for some in chunks(listed, JOB_CHUNK):
        for r in top_values(value_counts(df, some)).collect():
            unique[r.name] = r.unique
            tops[r.name].append((r.rank, r.value, r.rows, r.share))

    # Typed dates need no reading; a number can be a date only by its name.
    non_null = {c: stats[c]["non_null"] for c in scalars if stats[c]["non_null"] > 0}
    named = dated_names(df, list(non_null))
    read = [c for c in non_null if not _is_temporal(type_of(df, c)) and not isinstance(type_of(df, c), T.BooleanType)
            and (c in named or isinstance(type_of(df, c), T.StringType))]
    shares = {r.name: r for some in chunks(read, JOB_CHUNK) for r in date_share(df, some).collect()}
    shown: dict[str, list[str]] = {c: [] for c in scalars}
    if non_null:
        for r in first_values(df, list(non_null), SHOWN_VALUES, non_null, order).orderBy("name", "rn").collect():
            shown[r.name].append(r.value)

    def facts(c: str, sequences: dict[str, bool]) -> tuple:
        s, dtype = stats[c], type_of(df, c)
        cells = s["non_null"]
        dated = shares.get(c)
        # Flags and typed dates are never read as dates from their text.
        share = 1.0 if _is_temporal(dtype) and cells else (dated.date_share if dated else 0.0)
        return (
            s["pos"], c, s["dtype"], not is_scalar(dtype), rows, cells, unique[c],
            (rows - cells) / max(rows, 1), unique[c] / max(rows, 1), s["n_num"] / max(cells, 1),
            float(share), dated.ts_format if dated else None, *_two_values(tops[c]),
            s["mean_length"], sequences.get(c, False), shown.get(c, []),
            (s["ts_min"], s["ts_max"]) if s["ts_min"] else None,
        )

    # A sequence needs nearly as many values as rows and a mean gap below 2.5;
    # a median gap of 1 needs half of the gaps to be at least 1, so a mean of
    # 0.5. The numbers at hand rule out the other columns (the margins are for
    # sketched counts).
    def maybe(c: str) -> bool:
        s = stats[c]
        return bool(
            s["n_num"] and rows > 80 and unique[c] > 8 and unique[c] >= 0.75 * rows
            and s["n_num"] >= 0.82 * rows
            and 0.4 * (s["n_num"] * 0.82) <= s["max"] - s["min"] < 3 * unique[c])

    wanted = [c for c in scalars if maybe(c)]
    sequences = {}
    if wanted:
        sequences = {r.name: r.is_sequence for r in sequence_test(df, wanted).collect()}
    roles = assign_roles(spark.createDataFrame(
        [facts(c, sequences) for c in df.columns], _STATS_SCHEMA))
    chosen = {r.name: r for r in roles.withColumn("label", human_label("name")).collect()}

    dates = {c: r.ts_format for c, r in chosen.items()
             if r.role == "datetime" and not _is_temporal(type_of(df, c))}
    spans = {r.name: (r.min, r.max) for r in date_range(df, dates).collect()} if dates else {}
    measures = [c for c, r in chosen.items() if r.role == "measure"]
    quants = {}
    if measures:
        quants = {r.name: dict(zip(QUANTILE_NAMES, r.q or []))
                  for r in column_quantiles(df, measures, QUANTILES, rows, exact).collect()}

    def row(c: str) -> tuple:
        r, s, q = chosen[c], stats[c], quants.get(c, {})
        num = None
        if r.role == "measure" and s["n_num"]:
            num = (s["min"], s["max"], s["mean"], q["median"], s["std"], s["skew"], q["p05"],
                   q["p25"], q["p75"], q["p95"], q["p99"])
        span = spans.get(c) or (r.ts.asDict().values() if r.ts else None)
        top = None
        if r.role in ("categorical", "outcome"):
            top = [(v, n, share) for _, v, n, share in sorted(tops[c])]
        return (
            dataset, r.pos, c, r.label, r.role, r.dtype, rows, r.non_null,
            round(r.missing_rate_raw, 4), unique[c], round(r.unique_rate_raw, 4),
            r.sample_values, r.positive_value, r.numeric_codes, num,
            tuple(span) if span and r.role == "datetime" else None,
            r.ts_format if r.role == "datetime" else None, top, r.is_candidate,
            r.reason_excluded,
        )

    return spark.createDataFrame([row(c) for c in df.columns], PROFILE_SCHEMA)
