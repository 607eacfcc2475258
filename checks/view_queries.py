"""Views: groups, ranges, pairs, distributions, time, places, overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import query, rounded, table
from tabscout.operators import groups as g
from tabscout.operators import overview as o
from tabscout.operators import periods as t
from tabscout.operators import places as m
from tabscout.operators import profile as prof
from tabscout.operators import ranges as r
from tabscout.operators.quantiles import group_medians

LABELLED = "SELECT * FROM documents LEFT JOIN labels USING (doc_id)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their texts, and the labels that some have."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in names})


# --- groups ----------------------------------------------------------------------

def _largest(source: str, segments: list[str]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{s}' AS segment, {s}::VARCHAR AS value FROM ({source})" for s in segments)
    return f"""
    WITH cells AS ({cells}),
    sizes AS (SELECT segment, value, count(*) AS n FROM cells GROUP BY ALL),
    totals AS (SELECT segment, count(*) AS all_rows, count(value) AS known FROM cells GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY n DESC, value) AS rank
      FROM sizes WHERE value IS NOT NULL),
    shown AS (SELECT segment, value, n, rank, 1.0 * n / known AS share,
      1.0 * n / all_rows AS share_of_all FROM ranked JOIN totals USING (segment) WHERE rank <= 12),
    gates AS (SELECT segment, max(share) AS top, sum(share) FILTER (rank <= 3) AS conc,
      count(*) AS groups FROM shown GROUP BY ALL)
    SELECT segment, value, n, rank, round(share, 6)::DOUBLE AS share,
      round(share_of_all, 6)::DOUBLE AS share_of_all, round(top, 6)::DOUBLE AS top_share,
      round(conc, 6)::DOUBLE AS concentration, round(54 + 30 * conc, 6)::DOUBLE AS score,
      groups >= 2 AND NOT (conc < 0.55 AND top < 0.32) AS passes
    FROM shown JOIN gates USING (segment)"""


def _rounded_largest(df: DataFrame) -> DataFrame:
    return rounded(longs(df, "rank"), share=6, share_of_all=6, top_share=6, concentration=6, score=6)


@query("largest_groups", _largest(
    "SELECT lang, source, CASE WHEN source > 'src3' THEN lang END AS part FROM documents",
    ["lang", "source", "part"]))
def largest_groups(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").withColumn(
        "part", F.when(F.col("source") > "src3", F.col("lang")))
    return _rounded_largest(g.largest_groups(documents, ["lang", "source", "part"]))


@query("largest_groups_of_lineitem", _largest(
    "SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    ["l_returnflag", "l_linestatus", "l_linenumber"]))
def largest_groups_of_lineitem(spark, sf_dir):
    return _rounded_largest(g.largest_groups(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]))


LEAST = "(SELECT greatest(15, least(80, count(*) // 100)) FROM ({0}))"


def _outcome_segment(source: str, outcomes: dict[str, str], segments: list[str]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{o}' AS outcome, '{s}' AS segment, {s}::VARCHAR AS value, "
        f"(lower({o}::VARCHAR) = lower('{p}'))::INT AS flag FROM ({source}) "
        f"WHERE {o} IS NOT NULL AND {s} IS NOT NULL"
        for o, p in outcomes.items() for s in segments if s != o)
    least = LEAST.format(source)
    return f"""
    WITH cells AS ({cells}),
    sizes AS (SELECT outcome, segment, value, count(*) AS n, avg(flag) AS rate FROM cells
      GROUP BY ALL),
    placed AS (SELECT *, sum(n) OVER v AS rows_used FROM sizes WINDOW v AS (PARTITION BY outcome, segment)),
    kept AS (SELECT *, count(*) OVER v AS groups, max(rate) OVER v - min(rate) OVER v AS spread,
      row_number() OVER (PARTITION BY outcome, segment ORDER BY rate DESC, n DESC, value) AS rank
      FROM placed WHERE n >= {least}
      WINDOW v AS (PARTITION BY outcome, segment))
    SELECT outcome, segment, value, n, round(rate, 6) AS rate, rows_used::BIGINT AS rows_used, rank,
      groups, round(spread, 6) AS spread, round(84 + least(60 * spread, 16), 6) AS score,
      rows_used >= 2 * {least} AND groups >= 2 AND spread >= 0.08 AS passes
    FROM kept WHERE rank <= 12"""


@query("outcome_rate_by_segment", _outcome_segment(
    LABELLED, {"quality": "1", "toxic": "1"}, ["lang", "source"]))
def outcome_rate_by_segment(spark, sf_dir):
    rates = g.outcome_rate_by_segment(
        labelled(spark, sf_dir), {"quality": "1", "toxic": "1"}, ["lang", "source"])
    return rounded(longs(rates, "rank"), rate=6, spread=6, score=6)


@query("outcome_rate_by_segment_of_lineitem", _outcome_segment(
    "SELECT nullif(l_linestatus, 'O') AS half, l_linestatus, l_linenumber, l_suppkey, "
    "nullif(l_returnflag, 'R') AS l_returnflag FROM lineitem",
    {"l_linestatus": "O", "half": "F"}, ["l_linenumber", "l_returnflag", "l_linestatus"]))
def outcome_rate_by_segment_of_lineitem(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn(
        "half", F.nullif("l_linestatus", F.lit("O"))).withColumn(
        "l_returnflag", F.nullif("l_returnflag", F.lit("R")))
    rates = g.outcome_rate_by_segment(
        line, {"l_linestatus": "O", "half": "F"}, ["l_linenumber", "l_returnflag", "l_linestatus"])
    return rounded(longs(rates, "rank"), rate=6, spread=6, score=6)


def _metric_segment(source: str, aggs: dict[str, str], segments: list[str]) -> str:
    sql = {"sum": "sum(x)", "mean": "avg(x)", "median": "median(x)"}
    groups = " UNION ALL ".join(
        f"SELECT '{m}' AS measure, '{a}' AS agg, '{s}' AS segment, value, count(x) AS n, "
        f"{sql[a]}::DOUBLE AS metric FROM (SELECT coalesce({s}::VARCHAR, 'nan') AS value, "
        f"{m}::DOUBLE AS x FROM ({source})) WHERE x IS NOT NULL GROUP BY value"
        for m, a in aggs.items() for s in segments)
    least = LEAST.format(source)
    return f"""
    WITH groups AS ({groups}),
    used AS (SELECT *, sum(n) OVER (PARTITION BY measure, segment) AS rows_used FROM groups),
    kept AS (SELECT *, count(*) OVER v AS groups, max(metric) OVER v - min(metric) OVER v AS span,
      abs(median(metric) OVER v) AS middle,
      row_number() OVER (PARTITION BY measure, segment ORDER BY metric DESC, value) AS rank
      FROM used WHERE n >= {least} WINDOW v AS (PARTITION BY measure, segment)),
    gates AS (SELECT *, span / CASE WHEN middle = 0 THEN 1 ELSE middle END AS rel FROM kept)
    SELECT measure, agg, segment, value, n, round(metric, 4) AS metric,
      rows_used::BIGINT AS rows_used, rank, groups, round(rel, 6) AS relative_spread,
      round(68 + least(18 * rel, 18), 6) AS score,
      rows_used >= 2 * {least} AND groups >= 2 AND rel >= 0.22 AS passes
    FROM gates WHERE rank <= 12"""


def _rounded_metric(df: DataFrame) -> DataFrame:
    return rounded(longs(df, "rank"), metric=4, relative_spread=6, score=6)


@query("metric_by_segment", _metric_segment(
    "SELECT l_quantity, l_extendedprice, l_suppkey, l_linenumber, l_tax, "
    "nullif(l_returnflag, 'R') AS l_returnflag FROM lineitem",
    {"l_quantity": "sum", "l_extendedprice": "median", "l_suppkey": "mean"},
    ["l_returnflag", "l_linenumber"]))
def metric_by_segment(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn(
        "l_returnflag", F.nullif("l_returnflag", F.lit("R")))
    return _rounded_metric(g.metric_by_segment(
        line, ["l_quantity", "l_extendedprice", "l_suppkey"], ["l_returnflag", "l_linenumber"]))


@query("metric_by_source", _metric_segment(
    LABELLED, {"n_chars": "mean"}, ["lang", "source"]))
def metric_by_source(spark, sf_dir):
    return _rounded_metric(g.metric_by_segment(
        labelled(spark, sf_dir), ["n_chars"], ["lang", "source"]))


@query("metric_by_brand", _metric_segment(
    "SELECT * FROM part", {"p_retailprice": "median", "p_size": "mean"}, ["p_brand", "p_type"]))
def metric_by_brand(spark, sf_dir):
    return _rounded_metric(g.metric_by_segment(
        table(spark, sf_dir, "part"), ["p_retailprice", "p_size"], ["p_brand", "p_type"]))


# --- ranges -----------------------------------------------------------------------

def _cells(source: str, columns: list[str], name: str = "name", more: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS {name}, {c}::DOUBLE AS v {more} FROM ({source})" for c in columns)


def _placed(keys: str, q: int) -> str:
    """CTEs that put `cells(keys, v, ...)` into q equal-count ranges."""
    probs = ", ".join(str(i / q) for i in range(q + 1))
    return f"""
    edges AS (SELECT {keys}, count(v) AS rows_used, count(DISTINCT v) AS distinct_values,
      list_sort(list_distinct(quantile_cont(v, [{probs}]))) AS e FROM cells GROUP BY {keys}),
    ranged AS (SELECT cells.*, e, rows_used, distinct_values,
      greatest(1, len(list_filter(e, lambda x: x < v))) AS range FROM cells JOIN edges USING ({keys})
      WHERE len(e) > 1)"""


def _range_text(digits: str = "3") -> str:
    def num(x: str) -> str:
        return (f"CASE WHEN {x} = floor({x}) THEN ({x})::BIGINT::VARCHAR ELSE ({x})::VARCHAR END")
    lo = f"round(CASE WHEN range = 1 THEN lo - 0.001 ELSE lo END, {digits})"
    return f"'(' || {num(lo)} || ', ' || {num(f'round(hi, {digits})')} || ']'"


@query("quantile_ranges", f"""
    WITH cells AS ({_cells("SELECT * FROM lineitem", ["l_quantity", "l_discount", "l_extendedprice"])}),
    {_placed("name", 6)},
    counts AS (SELECT name, range, e[range] AS lo, e[range + 1] AS hi, count(*) AS n FROM ranged
      GROUP BY ALL)
    SELECT name, range, round(lo, 6) AS lo, round(hi, 6) AS hi, {_range_text()} AS label, n
    FROM counts
""")
def quantile_ranges(spark, sf_dir):
    found = r.quantile_ranges(
        table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], 6)
    return rounded(longs(found, "range"), lo=6, hi=6)


@query("group_medians", """
    SELECT l_returnflag, l_linenumber, count(*) AS n, round(median(l_extendedprice), 6) AS median
    FROM lineitem GROUP BY ALL
""")
def medians(spark, sf_dir):
    return rounded(group_medians(
        table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linenumber"], "l_extendedprice"),
        median=6)


def _outcome_range(source: str, outcomes: dict[str, str], measures: list[str]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{o}' AS outcome, '{m}' AS measure, {m}::DOUBLE AS v, "
        f"(lower({o}::VARCHAR) = lower('{p}'))::INT AS flag FROM ({source}) "
        f"WHERE {o} IS NOT NULL AND {m} IS NOT NULL"
        for o, p in outcomes.items() for m in measures)
    least = LEAST.format(source)
    return f"""
    WITH cells AS ({cells}), {_placed("outcome, measure", 5)},
    rates AS (SELECT outcome, measure, range, e[range] AS lo, e[range + 1] AS hi, count(*) AS n,
      avg(flag) AS rate, median(v) AS middle, rows_used, distinct_values
      FROM ranged GROUP BY ALL),
    kept AS (SELECT *, count(*) OVER v AS ranges, max(rate) OVER v - min(rate) OVER v AS spread
      FROM rates WHERE n >= {least} WINDOW v AS (PARTITION BY outcome, measure))
    SELECT outcome, measure, range, round(lo, 6) AS lo, round(hi, 6) AS hi,
      {_range_text()} AS label, n, round(rate, 6) AS rate, round(middle, 6) AS middle, rows_used,
      distinct_values AS distinct, ranges, round(spread, 6) AS spread,
      round(80 + least(60 * spread, 14), 6) AS score,
      rows_used >= 4 * {least} AND distinct_values >= 8 AND ranges >= 3 AND spread >= 0.08 AS passes
    FROM kept"""


def _rounded_outcome_range(df: DataFrame) -> DataFrame:
    return rounded(longs(df, "range"), lo=6, hi=6, rate=6, middle=6, spread=6, score=6)


@query("outcome_rate_by_range", _outcome_range(
    LABELLED, {"quality": "1", "toxic": "1"}, ["n_chars"]))
def outcome_rate_by_range(spark, sf_dir):
    return _rounded_outcome_range(r.outcome_rate_by_range(
        labelled(spark, sf_dir), {"quality": "1", "toxic": "1"}, ["n_chars"]))


@query("outcome_rate_by_range_of_lineitem", _outcome_range(
    "SELECT CASE WHEN l_returnflag <> 'A' THEN l_linestatus END AS status, l_extendedprice, "
    "nullif(l_quantity, 7) AS l_quantity FROM lineitem",
    {"status": "O"}, ["l_extendedprice", "l_quantity"]))
def outcome_rate_by_range_of_lineitem(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn(
        "status", F.when(F.col("l_returnflag") != "A", F.col("l_linestatus"))).withColumn(
        "l_quantity", F.nullif("l_quantity", F.lit(7.0)))
    return _rounded_outcome_range(r.outcome_rate_by_range(
        line, {"status": "O"}, ["l_extendedprice", "l_quantity"]))


NET = ("SELECT l_quantity, l_extendedprice, l_extendedprice * (1 - l_discount) AS net, "
       "CASE WHEN l_linenumber > 3 THEN -l_extendedprice * (1 - l_tax) END AS back, "
       "CASE WHEN l_returnflag = 'A' THEN 5.0 END AS flat FROM lineitem")
NET_COLUMNS = ["l_quantity", "l_extendedprice", "net", "back", "flat"]


def with_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity", price, (price * (1 - F.col("l_discount"))).alias("net"),
        F.when(F.col("l_linenumber") > 3, -price * (1 - F.col("l_tax"))).alias("back"),
        F.when(F.col("l_returnflag") == "A", 5.0).alias("flat"))


def _pairs() -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, CASE WHEN min({a}) < max({a}) AND "
        f"min({b}) < max({b}) THEN corr({b}, {a}) END AS r FROM ({NET}) "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, a in enumerate(NET_COLUMNS) for b in NET_COLUMNS[i + 1:])


@query("pair_correlations", f"""
    SELECT x, y, n, round(r, 6) AS r, CASE WHEN r IS NOT NULL THEN round(59 + least(22 * abs(r), 18), 6) END AS score,
      coalesce(n >= 100 AND abs(r) >= 0.55, false) AS passes FROM ({_pairs()})
""")
def pair_correlations(spark, sf_dir):
    found = r.pair_correlations(with_net(spark, sf_dir), NET_COLUMNS).drop("pair")
    return rounded(found, r=6, score=6)


SIXTEEN = [f"sin(l_orderkey * {k} + l_linenumber) * l_quantity AS m{k}" for k in range(1, 16)]


@query("correlations_of_sixteen", " UNION ALL ".join(
    f"SELECT 'm{i}' AS x, 'm{j}' AS y, count(*) AS n, round(corr(m{j}, m{i}), 6) AS r FROM m" for i in range(1, 17)
    for j in range(i + 1, 17)).join((f"WITH m AS (SELECT {', '.join(SIXTEEN)}, l_quantity AS m16 FROM lineitem) ", "")))
def correlations_of_sixteen(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    made = line.select(*[(F.sin(F.col("l_orderkey") * k + F.col("l_linenumber")) * F.col("l_quantity")).alias(f"m{k}")
                         for k in range(1, 16)], F.col("l_quantity").alias("m16"))
    return rounded(r.pair_correlations(made, made.columns).select("x", "y", "n", "r"), r=6)


def _relationship(pairs: list[tuple[str, str]]) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, {a} AS v, {b} AS w FROM ({NET}) "
        f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in pairs)
    return f"""
    WITH cells AS ({cells}), {_placed("x, y", 6)},
    counts AS (SELECT x, y, range, e[range] AS lo, e[range + 1] AS hi, count(*) AS n,
      median(v) AS x_middle, median(w) AS y_middle FROM ranged GROUP BY ALL)
    SELECT x, y, range, round(lo, 6) AS lo, round(hi, 6) AS hi, {_range_text()} AS label, n,
      round(x_middle, 6) AS x_middle, round(y_middle, 6) AS y_middle,
      count(*) OVER (PARTITION BY x, y) AS ranges FROM counts"""


@query("relationship_by_range", _relationship([("l_extendedprice", "net"), ("net", "back")]))
def relationship_by_range(spark, sf_dir):
    found = r.relationship_by_range(
        with_net(spark, sf_dir), [("l_extendedprice", "net"), ("net", "back")])
    return rounded(longs(found, "range"), lo=6, hi=6, x_middle=6, y_middle=6)


def _distribution(source: str, measures: list[str]) -> str:
    parts = []
    for c in measures:
        q = (f"(SELECT quantile_cont({c}, 0.25) AS p25, median({c}) AS median, "
             f"quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.95) AS p95, "
             f"quantile_cont({c}, 0.99) AS p99, avg({c}) AS mu, stddev_pop({c}) AS sd "
             f"FROM {source})")
        parts.append(f"""SELECT '{c}' AS measure, count(*) AS n, any_value(p25) AS p25,
          any_value(median) AS median, any_value(p75) AS p75, any_value(p95) AS p95,
          any_value(p99) AS p99, avg(({c} > p75 + 1.5 * (p75 - p25))::INT) AS out,
          abs(avg(pow(({c} - mu) / sd, 3))) AS skew FROM {source}, {q}""")
    return f"""
    SELECT measure, n, round(p25, 6)::DOUBLE AS p25, round(median, 6)::DOUBLE AS median,
      round(p75, 6)::DOUBLE AS p75, round(p95, 6)::DOUBLE AS p95, round(p99, 6)::DOUBLE AS p99,
      round(p75 - p25, 6)::DOUBLE AS iqr, round(out, 6) AS outlier_share, round(skew, 6) AS skew,
      round(57 + least(5 * skew + 80 * out, 20), 6) AS score,
      n >= 60 AND p75 > p25 AND NOT (out < 0.03 AND skew < 1.1) AS passes
    FROM ({" UNION ALL ".join(parts)})"""


def _rounded_distribution(df: DataFrame) -> DataFrame:
    return rounded(df, p25=6, median=6, p75=6, p95=6, p99=6, iqr=6, outlier_share=6, skew=6, score=6)


@query("distribution_of_events", _distribution("events", ["value"]))
def distribution_of_events(spark, sf_dir):
    return _rounded_distribution(r.distribution_stats(table(spark, sf_dir, "events"), ["value"]))


@query("distribution_of_lineitem", _distribution("lineitem", ["l_extendedprice", "l_quantity"]))
def distribution_of_lineitem(spark, sf_dir):
    return _rounded_distribution(r.distribution_stats(
        table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_quantity"]))


@query("distribution_of_documents", _distribution("documents", ["n_chars"]))
def distribution_of_documents(spark, sf_dir):
    return _rounded_distribution(
        r.distribution_stats(table(spark, sf_dir, "documents"), ["n_chars"]))


@query("histogram", """
    WITH cut AS (SELECT value FROM events WHERE value <= (SELECT quantile_cont(value, 0.99)
      FROM events)),
    ends AS (SELECT min(value) AS lo, max(value) AS hi FROM cut),
    bins AS (SELECT least(38, floor((value - lo) / ((hi - lo) / 38)) + 1) AS bin, lo,
      (hi - lo) / 38 AS width FROM cut, ends)
    SELECT 'value' AS measure, bin::BIGINT AS bin,
      round(any_value(lo) + (bin - 1) * any_value(width), 6) AS lo,
      round(any_value(lo) + (bin - 1) * any_value(width) + any_value(width), 6) AS hi,
      count(*) AS n FROM bins GROUP BY bin
    UNION ALL SELECT 'value', 39, round((SELECT quantile_cont(value, 0.99) FROM events), 6), round(max(value), 6), count(*)
      FROM events WHERE value > (SELECT quantile_cont(value, 0.99) FROM events)
""")
def histogram(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    cap = r.distribution_stats(events, ["value"]).first().p99
    return rounded(longs(r.histogram(events, {"value": cap}), "bin"), lo=6, hi=6)


@query("capped_sample", """
    SELECT value FROM events WHERE value <= 200 ORDER BY substr(md5('42|' || md5(event_id::VARCHAR)), 1, 15), value LIMIT 1000
""")
def capped_sample(spark, sf_dir):
    return r.capped_sample(table(spark, sf_dir, "events"), "value", 200.0, 1_000, key=["event_id"])


# --- time ---------------------------------------------------------------------------

def _time(source: str, column: str, value: str, unit: str, keep: str = "true") -> str:
    label = "last_day(start)" if unit == "month" else "start::DATE"
    return f"""
    SELECT {label} AS period, {value} FROM (
      SELECT unnest(generate_series(min(p), max(p), INTERVAL 1 {unit})) AS start FROM
        (SELECT date_trunc('{unit}', {column})::TIMESTAMP AS p FROM ({source}))) s
    LEFT JOIN (SELECT *, date_trunc('{unit}', {column})::TIMESTAMP AS p FROM ({source})) d
      ON d.p = s.start GROUP BY start HAVING {keep}"""


def _rows_over_time(source: str, column: str, unit: str) -> str:
    return f"""
    SELECT '{column}' AS date_column, '{unit}' AS unit, period, n, (sum(n) OVER ())::BIGINT AS valid,
      count(*) OVER () AS periods, 64.0::DOUBLE AS score,
      sum(n) OVER () >= 50 AND count(*) OVER () >= 3 AS passes
    FROM ({_time(source, column, f"count({column}) AS n", unit)})"""


@query("rows_over_time", _rows_over_time("SELECT * FROM lineitem", "l_shipdate", "month"))
def rows_over_time(spark, sf_dir):
    return t.rows_over_time(table(spark, sf_dir, "lineitem"), {"l_shipdate": None})


@query("rows_over_days", _rows_over_time("SELECT * FROM events", "ts", "day"))
def rows_over_days(spark, sf_dir):
    return t.rows_over_time(table(spark, sf_dir, "events"), {"ts": None})


# Every row stays; months are put off so that some have none.
GAPS = ("SELECT * REPLACE (CASE WHEN year(l_shipdate) = 1998 THEN TIMESTAMP '1997-12-03' "
        "WHEN month(l_shipdate) BETWEEN 2 AND 4 THEN make_timestamp(year(l_shipdate), 5, 2, 0, 0, 0) "
        "WHEN month(l_shipdate) = 11 THEN make_timestamp(year(l_shipdate), 12, 2, 0, 0, 0) "
        "ELSE l_shipdate END AS l_shipdate) FROM lineitem")


def with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = F.col("l_shipdate")

    def second(month: int) -> Column:
        return F.make_date(F.year(ship), F.lit(month), F.lit(2)).cast("timestamp_ntz")

    moved = F.when(F.year(ship) == 1998, F.lit("1997-12-03").cast("timestamp_ntz")).when(
        F.month(ship).between(2, 4), second(5)).when(F.month(ship) == 11, second(12)).otherwise(ship)
    return table(spark, sf_dir, "lineitem").withColumn("l_shipdate", moved)


@query("rows_over_time_with_gaps", _rows_over_time(GAPS, "l_shipdate", "month"))
def rows_over_time_with_gaps(spark, sf_dir):
    return t.rows_over_time(with_gaps(spark, sf_dir), {"l_shipdate": None})


def _metric_over_time(source: str, column: str, aggs: dict[str, str], unit: str) -> str:
    value = {"sum": "coalesce(sum($), 0)", "mean": "avg($)", "median": "median($)"}
    parts = []
    for m, a in aggs.items():
        keep = "true" if a == "sum" else f"count({m}) > 0"
        inner = _time(source, column, f"count({m}) AS n, {value[a].replace('$', m)}::DOUBLE AS metric",
                      unit, keep)
        parts.append(f"""
        SELECT '{column}' AS date_column, '{m}' AS measure, '{a}' AS agg, '{unit}' AS unit, period,
          n, round(metric, 4) AS metric, (sum(n) OVER ())::BIGINT AS valid,
          count(*) OVER () AS periods, 61.0::DOUBLE AS score,
          sum(n) OVER () >= 60 AND count(*) OVER () >= 3 AS passes FROM ({inner})""")
    return " UNION ALL ".join(parts)


PER_MONTH = {"l_quantity": "sum", "l_extendedprice": "median", "l_suppkey": "mean"}


@query("metric_over_time", _metric_over_time("SELECT * FROM lineitem", "l_shipdate", PER_MONTH, "month"))
def metric_over_time(spark, sf_dir):
    return rounded(t.metric_over_time(
        table(spark, sf_dir, "lineitem"), {"l_shipdate": None}, list(PER_MONTH)), metric=4)


@query("metric_over_time_with_gaps", _metric_over_time(GAPS, "l_shipdate", PER_MONTH, "month"))
def metric_over_time_with_gaps(spark, sf_dir):
    return rounded(t.metric_over_time(
        with_gaps(spark, sf_dir), {"l_shipdate": None}, list(PER_MONTH)), metric=4)


# Four dates and six measures: none is left out.
MANY = ("SELECT *, l_shipdate + INTERVAL 40 DAY AS d1, l_shipdate - INTERVAL 9 DAY AS d2, "
        "l_shipdate + INTERVAL 1 DAY AS d3, l_tax * 2 AS m1, l_quantity + l_tax AS m2, l_discount - 1 AS m3 FROM lineitem")
MANY_SUMS = {"l_quantity": "sum", "l_discount": "mean", "l_tax": "mean", "m1": "mean", "m2": "sum", "m3": "sum"}


@query("metrics_of_many_dates", " UNION ALL ".join(
    f"({_metric_over_time(MANY, d, MANY_SUMS, 'month')})" for d in ("l_shipdate", "d1", "d2", "d3")))
def metrics_of_many_dates(spark, sf_dir):
    ship, days = F.col("l_shipdate"), {"d1": 40, "d2": -9, "d3": 1}
    line = table(spark, sf_dir, "lineitem").withColumns({
        **{d: ship + F.make_dt_interval(F.lit(n)) for d, n in days.items()}, "m1": F.col("l_tax") * 2,
        "m2": F.col("l_quantity") + F.col("l_tax"), "m3": F.col("l_discount") - 1})
    return rounded(t.metric_over_time(
        line, dict.fromkeys(["l_shipdate", *days]), list(MANY_SUMS), aggs=MANY_SUMS), metric=4)


@query("metric_over_days", _metric_over_time(
    "SELECT * FROM events", "ts", {"value": "median"}, "day"))
def metric_over_days(spark, sf_dir):
    return rounded(t.metric_over_time(
        table(spark, sf_dir, "events"), {"ts": None}, ["value"]), metric=4)


# --- places, overview, quality ------------------------------------------------------

def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with coordinates made of their keys; some are missing or not finite."""
    k = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.pmod(k * 7, F.lit(180)) - 90).cast("double").alias("latitude"),
        F.when(F.pmod(k, F.lit(11)) == 0, float("nan")).when(F.pmod(k, F.lit(13)) == 0, None)
        .otherwise((F.pmod(k * 31, F.lit(360)) - 180).cast("double")).alias("longitude"))


LOCATED = ("SELECT (o_custkey * 7 % 180 - 90)::DOUBLE AS lat, (o_custkey * 31 % 360 - 180)::DOUBLE "
           "AS lon FROM orders WHERE o_custkey % 11 <> 0 AND o_custkey % 13 <> 0")


@query("geo_points", f"""
    SELECT lat, lon, (SELECT count(*) FROM ({LOCATED})) AS valid, 78.0::DOUBLE AS score,
      true AS passes FROM ({LOCATED})
""")
def all_geo_points(spark, sf_dir):
    """A sample as large as the table is the table."""
    located_rows = located(spark, sf_dir)
    n = located_rows.count()
    return m.geo_points(located_rows, "latitude", "longitude", n, key=["o_orderkey"])


@query("geo_points_sampled", f"""
    SELECT lat, lon, (SELECT count(*) FROM ({LOCATED})) AS valid, 78.0::DOUBLE AS score, true AS passes
    FROM ({LOCATED.replace("SELECT ", "SELECT o_orderkey, ", 1)})
    ORDER BY substr(md5('42|' || md5(o_orderkey::VARCHAR)), 1, 15), lat, lon LIMIT 1000
""")
def geo_points_sampled(spark, sf_dir):
    return m.geo_points(located(spark, sf_dir), "latitude", "longitude", 1_000, key=["o_orderkey"])


GAPPY_ORDERS = ("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus, "
                "CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS o_totalprice, "
                "o_orderpriority FROM orders")


def gappy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"),
        F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderpriority")


@query("table_overview", f"""
    WITH t AS ({GAPPY_ORDERS}),
    f AS (SELECT count(*) AS n, count(*) - count(o_orderstatus) + count(*) - count(o_totalprice)
      AS missing FROM t)
    SELECT unnest(['Rows', 'Columns', 'Measures', 'Segments', 'Outcomes', 'Date Fields',
        'Missing Cells', 'Duplicate Rows']) AS metric,
      unnest([n, 4, 1, 1, 1, 0, missing, 0])::BIGINT AS value FROM f
""")
def table_overview(spark, sf_dir):
    orders = gappy_orders(spark, sf_dir)
    duplicates = prof.duplicate_rows(orders).first().duplicate_rows
    return o.table_overview(prof.profile_columns(orders, "orders"), duplicates).select(
        "metric", "value")


@query("quality_notes", """
    WITH t AS (SELECT nullif(l_returnflag, 'R') AS l_returnflag,
        CASE WHEN l_quantity > 7 THEN l_linestatus END AS l_linestatus,
        CASE WHEN l_quantity > 2 THEN l_linenumber END AS l_linenumber FROM lineitem),
    f AS (SELECT count(*) AS n, count(l_returnflag) AS a, count(l_linestatus) AS b,
        count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS copies FROM t)
    SELECT 'L Returnflag' AS "column", printf('%.0f%% missing', round(1 - a / n, 4) * 100) AS issue,
      'Use with caution' AS impact FROM f
    UNION ALL SELECT 'L Linestatus', printf('%.0f%% missing', round(1 - b / n, 4) * 100),
      'Use with caution' FROM f
    UNION ALL SELECT 'All rows', format('{:,}', copies) || ' duplicate rows', 'May inflate totals'
      FROM f
""")
def quality_notes(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(
        F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"),
        F.when(F.col("l_quantity") > 7, F.col("l_linestatus")).alias("l_linestatus"),
        F.when(F.col("l_quantity") > 2, F.col("l_linenumber")).alias("l_linenumber"))
    duplicates = prof.duplicate_rows(line).first().duplicate_rows
    notes = o.quality_notes(prof.profile_columns(line, "lineitem"), duplicates)
    return notes.select("column", "issue", "impact")
