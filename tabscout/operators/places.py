"""Map points, and counts of all rows by cells of the map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.functions.exprs import as_number
from tabscout.operators.sampling import fixed_sample, row_key

MAP_POINTS = 5_000
MIN_POINTS = 10
# Halvings of the map in each direction: cells of about 600 m at the equator.
DEPTH = 16


def geo_points(df: DataFrame, lat: str, lon: str, n: int = MAP_POINTS, seed: int = 42,
               key: Sequence[str] | None = None) -> DataFrame:
    """Seeded sample of the rows with finite coordinates: `lat, lon`.

    `valid` is the number of such rows; fewer than ten are not worth a map.
    Rows are told apart by `key`; without one, by all their columns.
    """
    points = df.select(as_number(df, lat).alias("lat"), as_number(df, lon).alias("lon"),
                       row_key(df, key).alias("_row"))
    points = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    valid = points.count()
    return fixed_sample(points, n, seed, ["_row"], valid).select(
        "lat", "lon", F.lit(valid).cast("bigint").alias("valid"), F.lit(78.0).alias("score"),
        F.lit(valid >= MIN_POINTS).alias("passes"))


def cell_key(lat: Column, lon: Column, depth: int = DEPTH) -> Column:
    """The cell of a place as `depth` digits in Z-order: the first digits name the larger cells that hold it.

    Each digit is a quarter of the cell before: 1 more for the east, 2 more for the north.
    Places off the map lie in the cells at its edge.
    """
    def step(x: Column, low: float, span: float) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(2 ** depth - 1), F.floor((x - low) / span * 2 ** depth))).cast("int")

    x, y = step(lon, -180.0, 360.0), step(lat, -90.0, 180.0)
    bit = lambda v, i: F.shiftright(v, i).bitwiseAND(F.lit(1))
    return F.concat(*[(bit(y, i) * 2 + bit(x, i)).cast("string") for i in range(depth - 1, -1, -1)])


def place_cells(df: DataFrame, lat: str, lon: str, depth: int = DEPTH) -> DataFrame:
    """`level, cell, n, lat, lon`: at every level the rows of each cell and the middle of their places.

    All rows with finite coordinates count. The smallest cells are counted before the one
    exchange of the rows' counts; the levels above are sums of these.
    """
    places = df.select(as_number(df, lat).alias("lat"), as_number(df, lon).alias("lon")).where("lat IS NOT NULL AND lon IS NOT NULL")
    smallest = places.groupBy(cell_key(F.col("lat"), F.col("lon"), depth).alias("_cell")).agg(
        F.count("*").alias("n"), F.sum("lat").alias("_lat"), F.sum("lon").alias("_lon"))
    levels = smallest.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(depth))))
    sums = levels.groupBy("level", F.expr("left(_cell, level)").alias("cell")).agg(
        *[F.sum(c).alias(c) for c in ("n", "_lat", "_lon")])
    return sums.select("level", "cell", "n", (F.col("_lat") / F.col("n")).alias("lat"), (F.col("_lon") / F.col("n")).alias("lon"))


def drill_down(cells: DataFrame, cell: str, levels: int = 1) -> DataFrame:
    """Of `place_cells` the cells so many levels below a cell."""
    return cells.where(F.col("cell").startswith(cell) & (F.col("level") == len(cell) + levels))


def map_cells(df: DataFrame, lat: str, lon: str, most: int = MAP_POINTS, depth: int = DEPTH) -> DataFrame:
    """`lat, lon, n, cell, valid, score, passes` of the smallest cells of which there are at most `most`.

    Every row with finite coordinates is in one of them; `valid` is the number of these rows, and
    fewer than ten are not worth a map.
    """
    cells = place_cells(df, lat, lon, depth)
    sizes = cells.groupBy("level").agg(F.count("*").alias("cells"), F.sum("n").alias("valid"))
    best = sizes.where((F.col("cells") <= most) | (F.col("level") == 1)).agg(F.max(F.struct("level", "valid")).alias("b")).select("b.*")
    return cells.join(F.broadcast(best), "level").select(
        "lat", "lon", "n", "cell", "valid", F.lit(78.0).alias("score"), (F.col("valid") >= MIN_POINTS).alias("passes"))


def map_rows(df: DataFrame, lat: str, lon: str, most: int = MAP_POINTS, key: Sequence[str] | None = None) -> DataFrame:
    """What a map shows: `lat, lon, n, valid, score, passes`, in which every row with finite coordinates counts.

    At most `most` rows are shown each, as `geo_points` gives them; more are shown by cells.
    """
    valid = df.where(as_number(df, lat).isNotNull() & as_number(df, lon).isNotNull()).count()
    if valid <= most:
        return geo_points(df, lat, lon, most, key=key).withColumn("n", F.lit(1).cast("bigint"))
    return map_cells(df, lat, lon, most).drop("cell")
