"""Reading, cleaning, previewing and writing tables."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.functions import words as w
from tabscout.functions.exprs import FLOATING, TEMPORAL, quoted, text_number, type_of
from tabscout.operators.common import union_all
from tabscout.operators.sampling import fixed_sample
from tabscout.sources.records import csv_records

ENCODINGS = ("UTF-8", "ISO-8859-1")


def clean_names(names: Sequence[str]) -> list[str]:
    """Stripped names; blank ones become `Column i`, repeats get `.1`, `.2`, ...

    Names that differ in case alone count as repeats, as Spark cannot tell them apart.
    """
    stripped = [n.lstrip("﻿").strip() or f"Column {i + 1}" for i, n in enumerate(names)]
    taken, used, out = {n.lower() for n in stripped}, set(), []
    for name in stripped:
        unique, k = name, 0
        while unique.lower() in used or (k and unique.lower() in taken):
            k += 1
            unique = f"{name}.{k}"
        used.add(unique.lower())
        out.append(unique)
    return out


def clean_header(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def null_tokens(df: DataFrame, tokens: Sequence[str] = w.NULL_TOKENS) -> DataFrame:
    """Text cells that spell a missing value become null."""
    return df.select(*[
        F.when(~quoted(c).isin(*tokens), quoted(c)).alias(c)
        if isinstance(type_of(df, c), T.StringType) else quoted(c)
        for c in df.columns
    ])


def infer_types(df: DataFrame) -> DataFrame:
    """Type text columns by their content: whole numbers, numbers, true/false, else text.

    One aggregation over the table; a column changes type only when every
    non-null cell of it fits.
    """
    texts = [c for c in df.columns if isinstance(type_of(df, c), T.StringType)]
    if not texts:
        return df

    def fits(c: str) -> list:
        cell = quoted(c)
        whole = cell.rlike(r"^\s*[+-]?\d{1,19}\s*$") & cell.try_cast("bigint").isNotNull()
        return [
            F.count(cell), F.count_if(whole), F.count(text_number(cell)),
            F.count_if(F.lower(cell).isin("true", "false")),
        ]

    counts = df.agg(*[x for c in texts for x in fits(c)]).first()
    kinds: dict[str, str] = {}
    for i, c in enumerate(texts):
        cells, whole, numbers, flags = counts[4 * i:4 * i + 4]
        if cells and whole == cells:
            kinds[c] = "bigint"
        elif cells and numbers == cells:
            kinds[c] = "double"
        elif cells and flags == cells:
            kinds[c] = "boolean"
    return df.select(*[
        quoted(c).try_cast(kinds[c]).alias(c) if c in kinds else quoted(c) for c in df.columns
    ])


def _csv_modes(spark: SparkSession, path: str) -> dict[tuple[bool, bool | None], list[str]]:
    """The files under a path by (is UTF-8, has cells over several lines), from one look at their lines.

    The latter is None for a file with carriage returns and no line feed, which one task has to read."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    # A line with an odd number of quotes, of which one begins a cell, opens a cell that goes
    # on. A lone quote inside a cell does not.
    opened = (quotes % 2 == 1) & F.col("value").rlike(r'(^|,)\s*"')
    facts = lines.groupBy("file").agg(
        F.min(F.is_valid_utf8("value")).alias("utf8"), F.max(opened).alias("long"), F.count(F.lit(1)).alias("n"),
        F.max(F.col("value").rlike(r"\r[^\r]")).alias("returns")).orderBy("file").collect()
    modes: dict[tuple[bool, bool | None], list[str]] = {}
    for r in facts:
        long = None if r.n == 1 and r.returns else r.long
        modes.setdefault((r.utf8, long), []).append(unquote(r.file))
    return modes


def _read_csv(spark: SparkSession, path: str, encodings: Sequence[str]) -> DataFrame:
    modes = _csv_modes(spark, path)

    def options(mode: tuple[bool, bool | None]) -> dict:
        utf8, long = mode
        return dict(multiLine=long is not False, quote='"', escape='"', encoding=encodings[0] if utf8 else encodings[-1])

    first = min(modes, key=lambda m: modes[m][0], default=None)
    head = spark.read.csv(modes[first][:1], header=False, inferSchema=False, **options(first)).head(1) if modes else []
    if not head:
        raise ValueError("the table has no rows")
    names = clean_names([
        f"Unnamed: {i}" if v is None or v == "" else v for i, v in enumerate(head[0])
    ])
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])

    def cells_of(mode: tuple[bool, bool | None], files: list[str]) -> DataFrame:
        chosen = options(mode)
        if not mode[1]:
            return spark.read.csv(files, schema=schema, header=True, enforceSchema=True, **chosen)
        text = F.decode("record", chosen["encoding"])
        cells = F.from_csv(text, schema.simpleString()[len("struct<"):-1].replace(":", " "), {
            "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
        return csv_records(spark, files).where(~F.col("first")).select(cells.alias("cells")).select("cells.*")

    cells = union_all([cells_of(mode, files) for mode, files in modes.items()])
    return infer_types(null_tokens(cells.toDF(*names)))


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               encodings: Sequence[str] = ENCODINGS, save_to: str | None = None) -> DataFrame:
    """A table with a clean header and typed columns; an empty one is refused.

    `fmt` defaults to the file ending. Each CSV file is read as UTF-8 (with or
    without a byte-order mark), or as Latin-1 where its bytes are not UTF-8; all have
    the header of the first. `save_to` is where the table is saved as Parquet and
    read back, so that later passes need not parse text again.
    """
    fmt = fmt or ("csv" if str(path).lower().endswith(".csv") else "parquet")
    if fmt == "csv":
        df = _read_csv(spark, path, encodings)
    else:
        df = clean_header(spark.read.format(fmt).load(path))
    if df.isEmpty():
        raise ValueError("the table has no rows")
    if save_to is not None:
        save_table(df, save_to)
        df = spark.read.parquet(save_to)
    return df


def save_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def table_meta(df: DataFrame, name: str) -> DataFrame:
    """One row: table name, rows, columns."""
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(name).alias("filename"), "rows", F.lit(len(df.columns)).alias("columns")
    )


def preview(df: DataFrame, n: int = 10, order: Sequence[str] | None = None) -> DataFrame:
    """First n rows in a stated order; without one, n rows that are the same every time."""
    if order:
        return df.orderBy(*[quoted(c) for c in order]).limit(n)
    return fixed_sample(df, n, seed=0)


def _json_ready(col: Column, dtype: T.DataType) -> Column:
    """A value of any depth as JSON can hold it: NaN and infinities null, times as ISO text."""
    if isinstance(dtype, FLOATING):
        return F.when(~F.isnan(col) & (F.abs(col) < float("inf")), col)
    if isinstance(dtype, T.DateType):
        return F.date_format(col, "yyyy-MM-dd")
    if isinstance(dtype, TEMPORAL):
        return F.regexp_replace(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _json_ready(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        keyed = col if not isinstance(dtype.keyType, TEMPORAL) else F.transform_keys(col, lambda k, _: _json_ready(k, dtype.keyType))
        return F.transform_values(keyed, lambda _, x: _json_ready(x, dtype.valueType))
    if isinstance(dtype, T.StructType) and dtype.fields:
        return F.when(col.isNotNull(), F.struct(*[_json_ready(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
    return col


def to_json_rows(df: DataFrame, keep_nulls: bool = True) -> DataFrame:
    """One JSON text per row: at any depth NaN and infinities are null, times are ISO text."""
    options = {"ignoreNullFields": str(not keep_nulls).lower()}
    return df.select(F.to_json(F.struct(*[_json_ready(quoted(c), type_of(df, c)).alias(c) for c in df.columns]), options).alias("json"))
