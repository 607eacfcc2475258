"""Tables written, saved and read back; summaries that merge; cells of the map."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import query, rounded, table
from checks.view_queries import LOCATED, located
from tabscout.functions import words as w
from tabscout.operators import heavy, places, states
from tabscout.operators.common import long_form, shared_folder
from tabscout.operators.profile import distinct_counts
from tabscout.sources import tables as src
from tabscout.sources.footers import footer_facts

TOKENS = ", ".join("'" + t.replace("'", "''") + "'" for t in w.NULL_TOKENS)


def _cell(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({TOKENS}) THEN {c} END AS {c}"


def _new_path(spark, ending: str) -> str:
    return f"{shared_folder(spark)}/tabscout/{uuid.uuid4().hex}.{ending}"


def _through_csv(df: DataFrame, header: bool = True) -> DataFrame:
    """df, written as CSV with all cells quoted and read again."""
    path = _new_path(df.sparkSession, "csv")
    df.write.csv(path, header=header, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return src.read_table(df.sparkSession, path)


@query("csv_of_texts_with_line_breaks", f"""
    SELECT doc_id, {_cell("text")}, {_cell("lang")}, {_cell("source")}, n_chars FROM documents
""")
def csv_of_texts_with_line_breaks(spark, sf_dir):
    return _through_csv(table(spark, sf_dir, "documents"))


@query("csv_with_missing_tokens", f"""
    SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN o_totalprice END AS price,
      CASE WHEN o_custkey % 2 = 0 THEN o_orderpriority END AS priority, o_custkey % 5 = 0 AS fifth FROM orders
""")
def csv_with_missing_tokens(spark, sf_dir):
    third, half = F.pmod("o_custkey", F.lit(3)), F.pmod("o_custkey", F.lit(2))
    return _through_csv(table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(third > 0, F.col("o_totalprice").cast("string")).otherwise("NA").alias("price"),
        F.when(half == 0, F.col("o_orderpriority")).otherwise("n/a").alias("priority"),
        (F.pmod("o_custkey", F.lit(5)) == 0).alias("fifth")))


@query("saved_table", "SELECT * FROM conversations")
def saved_table(spark, sf_dir):
    path = _new_path(spark, "parquet")
    src.save_table(table(spark, sf_dir, "conversations"), path)
    return src.read_table(spark, path)


@query("table_with_clean_header", """
    SELECT n_nationkey AS key, n_name AS "key.1", n_regionkey AS "Column 3" FROM nation
""")
def table_with_clean_header(spark, sf_dir):
    path = _new_path(spark, "parquet")
    src.save_table(table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias(" key"), F.col("n_name").alias("key  "), F.col("n_regionkey").alias("   ")), path)
    return src.read_table(spark, path)


@query("facts_from_footers", " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(*) AS rows, count({c}) AS non_null, 0.0::DOUBLE AS missing_rate, {low} AS low, {high} AS high, "
    f"{first} AS first, {last} AS last, {exact} AS from_footers FROM orders"
    for c, low, high, first, last, exact in [
        *[(c, f"min({c})::DOUBLE", f"max({c})::DOUBLE", "NULL::TIMESTAMP", "NULL::TIMESTAMP", "true") for c in ("o_orderkey", "o_custkey")],
        *[(c, "NULL::DOUBLE", "NULL::DOUBLE", "NULL::TIMESTAMP", "NULL::TIMESTAMP", exact) for c, exact in (
            ("o_orderstatus", "true"), ("o_totalprice", "false"), ("o_orderpriority", "true"))],
        ("o_orderdate", "NULL::DOUBLE", "NULL::DOUBLE", "min(o_orderdate)", "max(o_orderdate)", "false")]))
def facts_from_footers(spark, sf_dir):
    return footer_facts(spark, f"{sf_dir}/orders.parquet")


@query("profile_of_merged_states", " UNION ALL ".join(f"""
    SELECT '{c}' AS name, count(*) AS rows, count({c}) AS non_null, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
      round(avg({c}), 6) AS mean, round(stddev_pop({c}), 4) AS std, round(skewness({c}) * (count({c}) - 2) / sqrt(count({c}) * (count({c}) - 1.0)), 4)
      AS skew, true AS unique_close, true AS median_close FROM lineitem""" for c in ("l_quantity", "l_extendedprice", "l_partkey")))
def profile_of_merged_states(spark, sf_dir):
    """From the saved states of three parts of lineitem, none of which is read again."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_partkey")
    saved = []
    for k in range(3):
        path = _new_path(spark, "parquet")
        states.table_state(line.where(F.pmod("l_orderkey", F.lit(3)) == k), line.columns[1:]).write.parquet(path)
        saved.append(spark.read.parquet(path))
    found = states.state_profile(states.merged_states(saved))
    exact = distinct_counts(line, line.columns[1:]).withColumnRenamed("unique", "_unique")
    cells = long_form(line, "name", "v", {c: F.col(c).cast("double") for c in line.columns[1:]}).join(
        F.broadcast(found.select("name", F.col("median").alias("_m"))), "name")
    below = cells.groupBy("name").agg(F.avg((F.col("v") < F.col("_m")).cast("double")).alias("_below"), F.avg((F.col("v") <= F.col("_m")).cast("double")).alias("_upto"))
    both = found.join(exact, "name").join(below, "name")
    return rounded(both.select(
        "name", "rows", "non_null", "min", "max", "mean", "std", "skew",
        (F.abs(F.col("unique") - F.col("_unique")) <= 4 * states.DISTINCT_ERROR * F.col("_unique")).alias("unique_close"),
        ((F.col("_below") <= 0.5 + states.RANK_ERROR) & (F.col("_upto") >= 0.5 - states.RANK_ERROR)).alias("median_close")),
        mean=6, std=4, skew=4)


HEAVY = "SELECT 'v' || (1000000 // (1 + l_orderkey * 7 % 5003))::VARCHAR AS v FROM lineitem"


@query("heavy_values", f"""
    SELECT v AS value, count(*) AS rows, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS share,
      row_number() OVER (ORDER BY count(*) DESC, v)::INT AS rank FROM ({HEAVY}) GROUP BY v ORDER BY rank LIMIT 15
""")
def heavy_values(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("v"), F.expr("1000000 DIV (1 + l_orderkey * 7 % 5003)").cast("string")).alias("v"))
    return rounded(heavy.heavy_values(made, "v", held=300), share=9)


@query("json_rows_nested", """
    SELECT '{"o_orderkey":' || o_orderkey || ',"pair":[' || CASE WHEN o_custkey % 2 = 0 THEN 'null' ELSE '1.5' END || ',2.5],"at":{"day":"'
      || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","list":[{"x":' || CASE WHEN o_custkey % 2 = 0 THEN 'null' ELSE '1.5' END
      || '}]},"by":{"k":' || CASE WHEN o_custkey % 2 = 0 THEN 'null' ELSE '1.5' END || '}}' AS json FROM orders
""")
def json_rows_nested(spark, sf_dir):
    odd = F.when(F.pmod("o_custkey", F.lit(2)) == 0, float("nan")).otherwise(1.5)
    return src.to_json_rows(table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array(odd, F.lit(2.5)).alias("pair"),
        F.struct(F.col("o_orderdate").alias("day"), F.array(F.struct(odd.alias("x"))).alias("list")).alias("at"),
        F.create_map(F.lit("k"), odd).alias("by")))


_X = "least(greatest(floor((lon + 180) / 360 * 64), 0), 63)::INT"
_Y = "least(greatest(floor((lat + 90) / 180 * 64), 0), 63)::INT"
PYRAMID = f"""
    p AS (SELECT lat, lon, {_X} AS x, {_Y} AS y FROM ({LOCATED})),
    c AS (SELECT lat, lon, {" || ".join(f"(((y >> {i}) & 1) * 2 + ((x >> {i}) & 1))::VARCHAR" for i in range(5, -1, -1))} AS whole FROM p),
    cells AS (SELECT level::INT AS level, left(whole, level::INT) AS cell, count(*) AS n, avg(lat) AS lat, avg(lon) AS lon
      FROM c, unnest(range(1, 7)) AS r(level) GROUP BY ALL)"""


@query("place_cells", f"WITH {PYRAMID} SELECT level, cell, n, round(lat, 6) AS lat, round(lon, 6) AS lon FROM cells")
def place_cells(spark, sf_dir):
    return rounded(places.place_cells(located(spark, sf_dir), "latitude", "longitude", depth=6), lat=6, lon=6)


@query("map_cells", f"""
    WITH {PYRAMID}, best AS (SELECT max(level) AS level FROM (SELECT level, count(*) AS k FROM cells GROUP BY level) WHERE k <= 100)
    SELECT round(lat, 6) AS lat, round(lon, 6) AS lon, n, cell, (SELECT count(*) FROM p) AS valid, 78.0::DOUBLE AS score, true AS passes
    FROM cells JOIN best USING (level)
""")
def map_cells(spark, sf_dir):
    return rounded(places.map_cells(located(spark, sf_dir), "latitude", "longitude", most=100, depth=6), lat=6, lon=6)


@query("cells_below_a_cell", f"WITH {PYRAMID} SELECT level, cell, n, round(lat, 6) AS lat, round(lon, 6) AS lon FROM cells WHERE level = 4 AND cell LIKE '21%'")
def cells_below_a_cell(spark, sf_dir):
    cells = places.place_cells(located(spark, sf_dir), "latitude", "longitude", depth=6)
    return rounded(places.drill_down(cells, "21", 2), lat=6, lon=6)
