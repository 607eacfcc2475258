"""Catalog: build, select, overlay, digest. The views are made of table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import query, table
from tabscout.functions import words as w
from tabscout.operators import columns as cols
from tabscout.operators.profile import profile_columns
from tabscout.plans import catalog as c
from tabscout.plans.pipeline import analyze_table

FAMILIES = [*w.FAMILY_LIMITS, "extra"]
KINDS = ["table", "bar_table", "line_table", "line", "histogram", "map"]


def order_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog for every 75 orders in a row: each order stands for a view."""
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    row = F.struct(
        F.col("o_orderpriority").alias("label"), key.alias("n"),
        F.col("o_totalprice").alias("value"), F.lit(None).cast("double").alias("x"),
        F.col("o_orderstatus").alias("text"))
    families = F.array(*[F.lit(x) for x in FAMILIES])
    kinds = F.array(*[F.lit(x) for x in KINDS])
    return table(spark, sf_dir, "orders").select(
        F.floor(key / 75).cast("string").alias("dataset"), key.alias("ord"),
        F.concat(F.lit("v"), key.cast("string")).alias("id"),
        F.element_at(kinds, (F.pmod(key, F.lit(len(KINDS))) + 1).cast("int")).alias("kind"),
        F.element_at(families, (F.pmod("o_custkey", F.lit(len(FAMILIES))) + 1).cast("int")
                     ).alias("family"),
        F.floor(F.col("o_totalprice") / 5000).cast("double").alias("score"),
        F.lit("?").alias("question"), F.concat(F.lit("Orders of "), day).alias("title"),
        F.concat(F.lit("why "), "o_orderpriority").alias("why"), F.lit("Day").alias("x_label"),
        F.lit("Orders").alias("y_label"), F.array(F.lit("Priority"), F.lit("Status")).alias("columns"),
        F.array(row).alias("rows"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("evidence"),
        (F.col("o_orderstatus") != "P").alias("passes"))


VIEWS = f"""
    SELECT (o_orderkey // 75)::VARCHAR AS dataset, 'v' || o_orderkey AS id,
      ({KINDS!r})[o_orderkey % {len(KINDS)} + 1] AS kind,
      ({FAMILIES!r})[o_custkey % {len(FAMILIES)} + 1] AS family,
      floor(o_totalprice / 5000) AS score, 'Orders of ' || strftime(o_orderdate, '%Y-%m-%d') AS title,
      'why ' || o_orderpriority AS why, o_orderpriority, o_orderstatus, o_totalprice,
      o_orderstatus <> 'P' AS passes,
      row_number() OVER (PARTITION BY o_orderkey // 75 ORDER BY o_orderkey) AS seq FROM orders
"""
LIMITS = "CASE family " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in w.FAMILY_LIMITS.items()) + f" ELSE {w.OTHER_FAMILY_LIMIT} END"
SELECTED = f"""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, seq) AS place
      FROM (SELECT *, row_number() OVER (PARTITION BY dataset, family ORDER BY score DESC, seq) AS k
            FROM ({VIEWS}) WHERE passes) WHERE k <= {LIMITS}) WHERE place <= {w.MAX_VIEWS}
"""


def _takeaway(table_text: str, line_text: str, histogram: str, map_text: str, other: str,
              quality: str, overview: str) -> str:
    return f"""CASE WHEN family = 'overview' THEN coalesce({overview}, '{other}')
      WHEN family = 'quality' THEN '{quality}'
      WHEN kind IN ('bar_table', 'line_table') THEN o_orderpriority || '{table_text}' || o_orderstatus || '.'
      WHEN kind = 'line' THEN {line_text} WHEN kind = 'histogram' THEN '{histogram}'
      WHEN kind = 'map' THEN '{map_text}' ELSE '{other}' END"""


SHORT = """CASE WHEN o_totalprice >= 1e3 THEN printf('%.1fK', o_totalprice / 1e3)
      WHEN o_totalprice >= 100 THEN printf('%.0f', o_totalprice) ELSE 'small' END"""
BUILT_TAKEAWAY = _takeaway(
    " is the first item to inspect, with status of ",
    f"'Status ranges from ' || {SHORT} || ' to ' || {SHORT} || ' over the period shown.'",
    "Most records are concentrated in the tallest bars; long tails usually deserve a closer look.",
    "The densest areas on the map show where records are most concentrated.",
    "Start with the highest and lowest values; they usually explain the main pattern.",
    "There are 1 data-quality note(s) to review before trusting every result.", "NULL")


@query("build_catalog", f"""
    WITH twice AS (SELECT *, 0 AS late FROM ({VIEWS})
      UNION ALL SELECT * REPLACE (score + 1 AS score), 1 FROM ({VIEWS}) WHERE kind = 'map')
    SELECT dataset, seq::INT AS seq, id, kind, family, score, title, {BUILT_TAKEAWAY} AS takeaway, passes
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset, id ORDER BY late DESC) AS last FROM twice)
    WHERE last = 1
""")
def build_catalog(spark, sf_dir):
    views = order_views(spark, sf_dir)
    again = views.where("kind = 'map'").withColumn("score", F.col("score") + 1).withColumn(
        "ord", F.col("ord") + 10**9)
    return c.build_catalog([views, again]).select(
        "dataset", "seq", "id", "kind", "family", "score", "title", "takeaway", "passes")


@query("select_views", f"SELECT dataset, id, family, score, place::INT AS place FROM ({SELECTED})")
def select_views(spark, sf_dir):
    return c.select_views(c.build_catalog([order_views(spark, sf_dir)])).select(
        "dataset", "id", "family", "score", "place")


ASKED = ("SELECT (o_orderkey // 75)::VARCHAR AS dataset, list('v' || (o_orderkey "
         "+ CASE WHEN o_orderkey // 75 % 5 < 2 THEN 1000000000000 ELSE 0 END) "
         "ORDER BY o_totalprice, o_orderkey)[1:o_orderkey // 75 % 11] AS ids FROM orders "
         "GROUP BY o_orderkey // 75")


@query("select_by_ids", f"""
    WITH views AS ({VIEWS}), picked AS ({SELECTED}), asked AS ({ASKED}),
    flat AS (SELECT dataset, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM asked),
    given AS (SELECT v.dataset, v.id, pos FROM views v JOIN flat USING (dataset, id) WHERE passes),
    counts AS (SELECT v.dataset, (SELECT count(*) FROM given g
      WHERE g.dataset = v.dataset) AS given FROM (SELECT DISTINCT dataset FROM views) v
      LEFT JOIN asked USING (dataset) GROUP BY v.dataset),
    spare AS (SELECT p.dataset, p.id, p.place, c.given,
      row_number() OVER (PARTITION BY p.dataset ORDER BY p.place) AS k
      FROM picked p JOIN counts c USING (dataset)
      WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.dataset = p.dataset AND g.id = p.id)),
    both_parts AS (SELECT dataset, id, pos AS o FROM given UNION ALL
      SELECT dataset, id, 1000000 + place FROM spare WHERE given < 4 AND k + given <=
        CASE WHEN given = 0 THEN 12 ELSE 8 END)
    SELECT dataset, id, row_number() OVER (PARTITION BY dataset ORDER BY o)::INT AS place FROM both_parts
""")
def select_by_ids(spark, sf_dir):
    part = F.floor(F.col("o_orderkey") / 75)
    ident = F.concat(F.lit("v"), (F.col("o_orderkey") + F.when(
        F.pmod(part, F.lit(5)) < 2, 10**12).otherwise(0)).cast("string"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct(
        "o_totalprice", "o_orderkey", ident.alias("id")))), lambda s: s["id"])
    wanted = table(spark, sf_dir, "orders").groupBy(part.alias("_part")).agg(
        ids.alias("_ids")).select(
        F.col("_part").cast("string").alias("dataset"),
        F.slice("_ids", F.lit(1), F.pmod("_part", F.lit(11)).cast("int")).alias("ids"))
    return c.select_by_ids(c.build_catalog([order_views(spark, sf_dir)]), wanted).select(
        "dataset", "id", "place")


SPARE_TAKEAWAY = _takeaway(
    " stands out with status of ",
    "'Status ranges from ' || format('{:,}', round_even(o_totalprice, 0)::BIGINT) || ' to ' || "
    "format('{:,}', round_even(o_totalprice, 0)::BIGINT) || ' across the period shown.'",
    "The tallest bars show where most records are concentrated.",
    "The densest areas show where records are most concentrated.",
    "Focus first on the highest and lowest values in this view.",
    "Review 1 data-quality note(s) before relying on every result.", "NULL")


@query("overlay_texts", f"""
    WITH v AS (SELECT *, {BUILT_TAKEAWAY} AS old, {SPARE_TAKEAWAY} AS spare,
        substr(id, 2)::BIGINT % 5 AS k FROM ({VIEWS})),
    t AS (SELECT *, CASE k WHEN 0 THEN 'New title of ' || id WHEN 1 THEN 'x'
        WHEN 2 THEN repeat('long ', 40) END AS new_title,
        CASE k WHEN 0 THEN 'Because of ' || o_orderpriority WHEN 3 THEN old END AS new_why,
        CASE k WHEN 0 THEN 'because, of ' || lower(o_orderpriority) || '!' WHEN 1 THEN '  fine  '
          WHEN 3 THEN old || ' ' END AS new_takeaway FROM v)
    SELECT dataset, id, CASE WHEN k = 0 THEN new_title ELSE title END AS title,
      CASE WHEN k IN (0, 3) THEN new_why ELSE why END AS why,
      CASE k WHEN 0 THEN old WHEN 1 THEN 'fine' WHEN 3 THEN spare ELSE old END AS takeaway FROM t
""")
def overlay_texts(spark, sf_dir):
    catalog = c.build_catalog([order_views(spark, sf_dir)])
    k = F.pmod(F.substring("id", 2, 20).cast("bigint"), F.lit(5))
    priority = F.col("evidence")["priority"]
    texts = catalog.select(
        "dataset", "id",
        F.when(k == 0, F.concat(F.lit("New title of "), "id")).when(k == 1, "x").when(
            k == 2, F.repeat(F.lit("long "), 40)).alias("title"),
        F.when(k == 0, F.concat(F.lit("Because of "), priority)).when(
            k == 3, F.col("takeaway")).alias("why"),
        F.when(k == 0, F.concat(F.lit("because, of "), F.lower(priority), F.lit("!"))).when(
            k == 1, "  fine  ").when(k == 3, F.concat("takeaway", F.lit(" "))).alias("takeaway"),
    )
    return c.overlay_texts(catalog, texts).select("dataset", "id", "title", "why", "takeaway")


@query("overlay_texts_in_turn", f"""
    SELECT dataset, id, CASE WHEN substr(id, 2)::BIGINT % 3 = 0 THEN 'Second of ' || id ELSE 'First of ' || id END AS title,
      CASE WHEN substr(id, 2)::BIGINT % 2 = 0 THEN 'Reason of ' || id ELSE why END AS why FROM ({VIEWS})
""")
def overlay_texts_in_turn(spark, sf_dir):
    catalog = c.build_catalog([order_views(spark, sf_dir)])
    k = F.substring("id", 2, 20).cast("bigint")
    none = F.lit(None).cast("string")
    first = catalog.select("dataset", "id", F.concat(F.lit("\n First of "), "id", F.lit("\t\r\n")).alias("title"),
                           F.when(k % 2 == 0, F.concat(F.lit("Reason of "), "id")).alias("why"), F.lit(1).alias("pos"))
    second = catalog.select("dataset", "id", F.when(k % 3 == 0, F.concat(F.lit("Second of "), "id")).when(
        k % 3 == 1, F.repeat(F.lit("long "), 40)).alias("title"), none.alias("why"), F.lit(2).alias("pos"))
    return c.overlay_texts(catalog, second.unionByName(first)).select("dataset", "id", "title", "why")


@query("catalog_digest", f"""
    SELECT * FROM (SELECT dataset, id, score, why,
      row_number() OVER (PARTITION BY dataset ORDER BY score DESC, seq)::INT AS rank, 1 AS previews
      FROM ({VIEWS}) WHERE passes) WHERE rank <= 45
""")
def catalog_digest(spark, sf_dir):
    return c.catalog_digest(c.build_catalog([order_views(spark, sf_dir)])).select(
        "dataset", "id", "score", "why", "rank", F.size("preview_rows").alias("previews"))


@query("catalog_summary", f"""
    WITH s AS (SELECT dataset, count(*) FILTER (family NOT IN ('overview', 'quality')) AS views,
      arg_min(title, place) FILTER (family NOT IN ('overview', 'quality')) AS title
      FROM ({SELECTED}) GROUP BY dataset)
    SELECT dataset, views, CASE WHEN dataset::INT % 3 = 0 THEN 'A summary of its own, number ' || dataset
      WHEN views > 0 THEN 'Found ' || views || ' useful insight views. Start with ' || title
        || ' because it has the strongest evidence in this file.'
      ELSE 'Insights are generated from the strongest patterns found in the file. Review the first '
        || 'few cards for the clearest opportunities or risks.' END AS summary FROM s
""")
def catalog_summary(spark, sf_dir):
    chosen = c.select_views(c.build_catalog([order_views(spark, sf_dir)]))
    own = chosen.select("dataset").distinct().select("dataset", F.when(
        F.pmod(F.col("dataset").cast("int"), F.lit(3)) == 0,
        F.concat(F.lit("A summary of its own, number "), "dataset")).otherwise("short").alias(
        "summary"))
    return c.catalog_summary(chosen, own)


# --- whole pipeline ---------------------------------------------------------------------

def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@query("catalog_of_labelled_documents")
def catalog_of_labelled_documents(spark, sf_dir):
    return analyze_table(labelled_documents(spark, sf_dir), "labelled", ["doc_id"]).catalog.select(
        "seq", "id", "kind", "family", "score", "title", "why", "takeaway", "passes",
        F.size("rows").alias("row_count"))


@query("catalog_of_events", """
    WITH e AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi,
        quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75, avg(value) AS mu,
        stddev_pop(value) AS sd FROM events),
    d AS (SELECT abs(avg(pow((value - mu) / sd, 3))) AS skew,
        avg((value > p75 + 1.5 * (p75 - p25))::INT) AS out FROM events, e),
    g AS (SELECT event_type, count(*) AS n FROM events GROUP BY ALL),
    top AS (SELECT sum(n) FILTER (k <= 3) / sum(n) AS conc, max(n) / sum(n) AS top FROM
        (SELECT n, row_number() OVER (ORDER BY n DESC, event_type) AS k FROM g)),
    m AS (SELECT event_type, count(*) AS n, median(value) AS v FROM events GROUP BY ALL
        HAVING count(*) >= (SELECT greatest(15, least(80, n // 100)) FROM e)),
    s AS (SELECT (max(v) - min(v)) / median(v) AS rel FROM m)
    SELECT 'snapshot' AS id, 'overview' AS family, 100.0::DOUBLE AS score, true AS passes
    UNION ALL SELECT 'metric_segment__value__event_type', 'segment',
      round(68 + least(18 * rel, 18), 3), rel >= 0.22 FROM s
    UNION ALL SELECT 'time_count__ts', 'time', 64.0, true
    UNION ALL SELECT 'time_metric__ts__value', 'time', 61.0, true
    UNION ALL SELECT 'distribution__value', 'distribution',
      round(57 + least(5 * skew + 80 * out, 20), 3), true FROM d WHERE out >= 0.03 OR skew >= 1.1
    UNION ALL SELECT 'top_category__event_type', 'composition', round(54 + 30 * conc, 3),
      conc >= 0.55 OR top >= 0.32 FROM top
""")
def catalog_of_events(spark, sf_dir):
    return analyze_table(table(spark, sf_dir, "events"), "events", ["event_id"]).catalog.select(
        "id", "family", "score", "passes")


@query("geo_pair", """
    SELECT 'orders' AS dataset, 'x_lat' AS lat, 'x_lon' AS lon FROM orders
    GROUP BY ALL HAVING count(*) > 0
""")
def geo_pair(spark, sf_dir):
    k = F.col("o_custkey").cast("double")
    located = table(spark, sf_dir, "orders").select(
        "o_orderstatus", (k % 90).alias("x_lat"), (k % 180).alias("x_lon"),
        (k % 45).alias("y_latitude"))
    return cols.geo_pair(profile_columns(located, "orders"))




def _short(x: str) -> str:
    x = f"{x}::DOUBLE"
    return (f"CASE WHEN {x} >= 1e3 THEN printf('%.1fK', {x} / 1e3) WHEN {x} >= 100 THEN printf('%.0f', {x}) "
            f"WHEN {x} >= 10 THEN printf('%.1f', {x}) ELSE regexp_replace(printf('%.2f', {x}), '\\.?0+$', '') END")


@query("sentences_of_events", f"""
    WITH e AS (SELECT count(*) AS n, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.75) AS p75 FROM events),
    g AS (SELECT event_type, count(*) AS n, median(value) AS v FROM events GROUP BY ALL),
    day AS (SELECT date_trunc('day', ts) AS day, count(*) AS n, median(value) AS v FROM events GROUP BY ALL),
    span AS (SELECT min(n) AS n0, max(n) AS n1, min(v) AS v0, max(v) AS v1 FROM day),
    best AS (SELECT event_type AS t, {_short("v")} AS v FROM g ORDER BY g.v DESC, event_type LIMIT 1),
    most AS (SELECT event_type AS t, printf('%.1f%%', 100.0 * g.n / e.n) AS p FROM g, e ORDER BY g.n DESC, event_type LIMIT 1)
    SELECT 'snapshot' AS id, 'Dataset Overview' AS title,
      'This gives a quick baseline before interpreting the rest of the dashboard.' AS why,
      'The dataset has ' || format('{{:,}}', n) || ' rows, 6 columns, 0 missing cells, and 0 duplicate rows.' AS takeaway FROM e
    UNION ALL SELECT 'metric_segment__value__event_type', 'Typical Value by Event Type',
      t || ' stands out with the highest typical value (' || v || ').',
      t || ' is the first item to inspect, with typical value of ' || v || '.' FROM best
    UNION ALL SELECT 'time_count__ts', 'Rows Over Ts',
      'This shows whether activity is rising, falling, or concentrated in specific periods.',
      'Rows ranges from ' || {_short("n0")} || ' to ' || {_short("n1")} || ' over the period shown.' FROM span
    UNION ALL SELECT 'time_metric__ts__value', 'Typical Value Over Ts', 'This tracks how value changes over time.',
      'Typical Value ranges from ' || {_short("v0")} || ' to ' || {_short("v1")} || ' over the period shown.' FROM span
    UNION ALL SELECT 'distribution__value', 'Spread of Value',
      'Most value values are between ' || {_short("p25")} || ' and ' || {_short("p75")} || ', with some high outliers.',
      'Most records are concentrated in the tallest bars; long tails usually deserve a closer look.' FROM e
    UNION ALL SELECT 'top_category__event_type', 'Largest Event Type Groups',
      'The largest event type group is ' || t || ', representing ' || p || ' of rows.',
      t || ' is the first item to inspect, with share of ' || p || '.' FROM most
""")
def sentences_of_events(spark, sf_dir):
    return analyze_table(table(spark, sf_dir, "events"), "events", ["event_id"]).catalog.select("id", "title", "why", "takeaway")
