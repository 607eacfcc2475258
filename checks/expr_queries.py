"""Scalar expressions, sources and text jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.profile_queries import IS_ID, _has
from checks.registry import query, rounded, table
from tabscout.functions import exprs as e
from tabscout.functions import names
from tabscout.functions import words as w
from tabscout.operators import sampling
from tabscout.operators.textjobs import json_from_text, near_same_text
from tabscout.sources import tables as src


# --- names ---------------------------------------------------------------------

NAMES = """
    SELECT DISTINCT replace(p_name, ' ', '_') || CASE p_size % 8 WHEN 0 THEN '' WHEN 1 THEN '_id'
      WHEN 2 THEN '_price' WHEN 3 THEN '-Rate' WHEN 4 THEN ' total_sales' WHEN 5 THEN '_date'
      WHEN 6 THEN '_lat' ELSE '_last_status' END AS name FROM part
"""


@query("name_rules", f"""
    SELECT name, {_has(w.DATE_WORDS)} AS has_date, {_has(w.OUTCOME_WORDS)} AS has_outcome,
      {_has(w.LATITUDE_WORDS)} AS has_latitude, {IS_ID} AS is_id,
      {IS_ID} OR {_has(w.BAD_AXIS_WORDS)} AS is_bad_axis,
      CASE WHEN {_has(w.SUM_WORDS)} THEN 'sum' WHEN {_has(w.MEAN_WORDS)} THEN 'mean'
           WHEN {_has(w.MEDIAN_WORDS)} THEN 'median' ELSE 'mean' END AS agg
    FROM ({NAMES})
""")
def name_rules(spark, sf_dir):
    k = F.pmod(F.col("p_size"), F.lit(8))
    ends = ["", "_id", "_price", "-Rate", " total_sales", "_date", "_lat", "_last_status"]
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")),
                    F.element_at(F.array(*[F.lit(x) for x in ends]), k + 1))
    n = F.col("name")
    return table(spark, sf_dir, "part").select(name.alias("name")).distinct().select(
        "name", names.name_has(n, w.DATE_WORDS).alias("has_date"),
        names.name_has(n, w.OUTCOME_WORDS).alias("has_outcome"),
        names.name_has(n, w.LATITUDE_WORDS).alias("has_latitude"),
        names.name_is_id(n).alias("is_id"), names.name_is_bad_axis(n).alias("is_bad_axis"),
        names.default_agg(n).alias("agg"))


@query("human_labels", """
    SELECT DISTINCT p_name || '_' || lower(p_brand) || '-ID' AS name,
      array_to_string(list_transform(string_split(p_name, ' '),
        lambda x: upper(x[1]) || lower(x[2:])), ' ') || ' '
        || upper(p_brand[1]) || lower(p_brand[2:]) || ' ID' AS label FROM part
""")
def human_labels(spark, sf_dir):
    name = F.concat_ws("", "p_name", F.lit("_"), F.lower("p_brand"), F.lit("-ID"))
    return table(spark, sf_dir, "part").select(name.alias("name")).distinct().select(
        "name", names.human_label("name").alias("label"))


# --- numbers and texts ------------------------------------------------------------

@query("number_texts", """
    WITH t AS (SELECT event_id, value * CASE event_id % 6 WHEN 0 THEN 0.01 WHEN 1 THEN 1
      WHEN 2 THEN 10 WHEN 3 THEN 1000 WHEN 4 THEN 1000000 ELSE -100000000 END AS x FROM events)
    SELECT event_id, CASE
      WHEN abs(x) >= 1e9 THEN printf('%.1fB', x / 1e9) WHEN abs(x) >= 1e6 THEN printf('%.1fM', x / 1e6)
      WHEN abs(x) >= 1e3 THEN printf('%.1fK', x / 1e3) WHEN abs(x) >= 100 THEN printf('%.0f', x)
      WHEN abs(x) >= 10 THEN printf('%.1f', x)
      ELSE rtrim(rtrim(printf('%.2f', x), '0'), '.') END AS short,
      printf('%.1f%%', (event_id % 1000) / 1000.0 * 100) AS pct FROM t
""")
def number_texts(spark, sf_dir):
    k = F.pmod(F.col("event_id"), F.lit(6))
    scale = F.when(k == 0, 0.01).when(k == 1, 1.0).when(k == 2, 10.0).when(k == 3, 1000.0).when(
        k == 4, 1e6).otherwise(-1e8)
    share = F.pmod(F.col("event_id"), F.lit(1000)) / 1000
    return table(spark, sf_dir, "events").select(
        "event_id", e.fmt_number(F.col("value") * scale).alias("short"),
        e.fmt_pct(share).alias("pct"))


@query("text_cuts", """
    SELECT doc_id, CASE WHEN length(text) > 42 THEN text[1:41] || '…' ELSE text END AS short,
      length(text) AS length FROM documents
""")
def text_cuts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", e.fmt_text(F.col("text")).alias("short"),
        F.length("text").cast("bigint").alias("length"))


@query("text_to_number", """
    WITH t AS (SELECT l_orderkey AS k, l_linenumber AS i, CASE l_linenumber
      WHEN 1 THEN l_quantity::VARCHAR WHEN 2 THEN ' ' || l_extendedprice::VARCHAR || ' '
      WHEN 3 THEN l_orderkey::VARCHAR || 'd' WHEN 4 THEN 'NaN' WHEN 5 THEN 'inf'
      WHEN 6 THEN '-1.5e3' ELSE l_returnflag END AS c FROM lineitem)
    SELECT k, i, c, CASE WHEN i IN (1, 2, 6) THEN try_cast(trim(c) AS DOUBLE) END AS number FROM t
""")
def text_to_number(spark, sf_dir):
    i = F.col("l_linenumber")
    text = (
        F.when(i == 1, F.col("l_quantity").cast("string"))
        .when(i == 2, F.concat(F.lit(" "), F.col("l_extendedprice").cast("string"), F.lit(" ")))
        .when(i == 3, F.concat(F.col("l_orderkey").cast("string"), F.lit("d")))
        .when(i == 4, "NaN").when(i == 5, "inf").when(i == 6, "-1.5e3")
        .otherwise(F.col("l_returnflag")))
    made = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), i.alias("i"), text.alias("c"))
    return made.select("k", "i", "c", e.as_number(made, "c").alias("number"))


@query("finite_numbers", """
    SELECT l_orderkey AS k, l_linenumber AS i,
      CASE WHEN l_discount > 0 THEN l_extendedprice / l_discount END AS x FROM lineitem
""")
def finite_numbers(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    zero = F.col("l_discount") == 0
    odd = F.when(zero & (F.col("l_linenumber") > 3), float("inf")).when(zero, float("nan"))
    made = line.select("l_orderkey", "l_linenumber", F.coalesce(
        odd, F.try_divide("l_extendedprice", "l_discount")).alias("x"))
    return made.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"),
                       e.as_number(made, "x").alias("x"))


@query("text_to_timestamp", """
    SELECT o_orderkey AS k, CASE WHEN o_custkey % 3 <> 0 THEN o_orderdate END AS ts,
      o_custkey % 3 <> 1 AS looks_like_date FROM orders
""")
def text_to_timestamp(spark, sf_dir):
    k = F.pmod(F.col("o_custkey"), F.lit(3))
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(
        k == 1, F.date_format("o_orderdate", "MMM d, yyyy")).otherwise(
        F.date_format("o_orderdate", "MMM d, yyyy"))
    made = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), k.alias("kind"), text.alias("t"))
    like = F.when(F.col("kind") == 2, F.lit("2020-01-05")).otherwise(F.col("t"))
    return made.select("k", e.as_timestamp(made, "t", "MMM d, yyyy").alias("ts"),
                       e.date_like(like).alias("looks_like_date"))


# How a date is written, and what of it the text keeps: d the day, m the month.
LOOKS = {
    "yyyy-MM-dd'T'HH:mm:ss'+02:00'": ("yyyy-M-d'T'H:m:sXXX", "o_orderdate - INTERVAL 2 HOUR"),
    "M/d/yyyy h:mm a": ("M/d/yyyy h:m a", "o_orderdate"),
    "yyyy-MM-dd hh:mm:ss a": ("yyyy-M-d h:m:s a", "o_orderdate"),
    "d MMMM yyyy": ("d MMMM yyyy", "o_orderdate"),
    "MMM-yyyy": ("MMM-yyyy", "date_trunc('month', o_orderdate)::TIMESTAMP"),
    "MMMM yyyy": ("MMMM yyyy", "date_trunc('month', o_orderdate)::TIMESTAMP"),
}


@query("text_to_timestamp_by_look", " UNION ALL ".join(
    f"SELECT o_orderkey AS k, {i} AS look, ({ts})::TIMESTAMP AS ts FROM orders" for i, (_, ts) in enumerate(LOOKS.values())))
def text_to_timestamp_by_look(spark, sf_dir):
    """Each text finds its format by its look and is read with it."""
    parts = []
    for i, (look, (fmt, _)) in enumerate(LOOKS.items()):
        made = table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("k"), F.lit(i).alias("look"), F.date_format("o_orderdate", look).alias("t"))
        # May looks like its short form.
        right = e.date_format_of(F.col("t")).isin(fmt, fmt.replace("MMMM", "MMM"))
        parts.append(made.select("k", "look", F.when(right, e.as_timestamp(made, "t", fmt)).alias("ts")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("positive_flags", """
    SELECT l_linestatus AS value, lower(l_linestatus) = 'o' AS flag, count(*) AS n
    FROM lineitem GROUP BY ALL
""")
def positive_flags(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("value")).agg(
        F.count("*").alias("n")).select(
        "value", e.is_positive(F.col("value"), "O").alias("flag"), "n")


@query("min_group", """
    SELECT l_suppkey AS k, count(*) AS n, greatest(15, least(80, count(*) // 100)) AS least_rows
    FROM lineitem GROUP BY ALL
""")
def min_group(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(
        F.count("*").alias("n"))
    return sizes.select(
        "k", "n", e.min_group_expr(F.col("n")).cast("bigint").alias("least_rows"))


# --- sources -----------------------------------------------------------------------

@query("missing_tokens", """
    SELECT doc_id, nullif(lang, 'fr') AS lang, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END
      AS size FROM documents
""")
def missing_tokens(spark, sf_dir):
    """Everything as text with missing-value tokens, read back by content."""
    text = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.when(F.col("lang") == "fr", "N/A").otherwise(F.col("lang")).alias("lang"),
        F.when(F.pmod("doc_id", F.lit(5)) == 0, "null").otherwise(
            F.col("n_chars").cast("string")).alias("size"))
    return src.infer_types(src.null_tokens(text))


@query("table_meta", "SELECT 'orders' AS filename, count(*) AS rows, 6 AS columns FROM orders")
def table_meta(spark, sf_dir):
    return src.table_meta(table(spark, sf_dir, "orders"), "orders")


@query("preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 25")
def preview(spark, sf_dir):
    return src.preview(table(spark, sf_dir, "customer"), 25, ["c_custkey"])


@query("fixed_sample", """
    SELECT * FROM lineitem ORDER BY substr(md5('42|' || l_orderkey || '|' || l_linenumber), 1, 15),
      l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice LIMIT 500
""")
def fixed_sample(spark, sf_dir):
    return sampling.fixed_sample(table(spark, sf_dir, "lineitem"), 500, key=["l_orderkey", "l_linenumber"])


@query("clean_header", """
    SELECT n_nationkey AS "key", n_name AS "Column 2", n_regionkey AS "key.1" FROM nation
""")
def clean_header(spark, sf_dir):
    return src.clean_header(table(spark, sf_dir, "nation").toDF(" key", "  ", "key "))


@query("json_rows", """
    SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderdate":"'
      || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '","ratio":'
      || CASE WHEN o_custkey % 2 = 0 THEN 'null' ELSE '1.5' END || '}' AS json FROM orders
""")
def json_rows(spark, sf_dir):
    odd = F.when(F.pmod("o_custkey", F.lit(2)) == 0, float("nan")).otherwise(1.5)
    return src.to_json_rows(table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", odd.alias("ratio")))


# --- text jobs ------------------------------------------------------------------------

WORDS = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
SET = f"list_distinct(list_filter(string_split({WORDS}, ' '), lambda x: x <> ''))"


def _near_same_sql(pairs: str, keys: str) -> str:
    a, b = SET.format("a"), SET.format("b")
    return f"""
    WITH pairs AS ({pairs}),
    sets AS (SELECT {keys}, a, b, {WORDS.format("a")} = {WORDS.format("b")} AS same,
      {a} AS wa, {b} AS wb FROM pairs),
    sizes AS (SELECT *, len(list_intersect(wa, wb)) AS shared FROM sets),
    shares AS (SELECT *, CASE WHEN len(wa) > 0 AND len(wb) > 0
      THEN shared / (len(wa) + len(wb) - shared) END AS o FROM sizes)
    SELECT {keys}, round(o, 6)::DOUBLE AS overlap,
      a IS NOT NULL AND b IS NOT NULL AND a <> '' AND b <> '' AND (same OR coalesce(o > 0.82, false))
        AS near_same FROM shares"""


@query("near_same_turns", _near_same_sql(
    "SELECT conv_id, turn, text AS a, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b "
    "FROM conversations", "conv_id, turn"))
def near_same_turns(spark, sf_dir):
    """Each turn with the one before it: a join on both keys, so a very long
    conversation is spread over the tasks like any other."""
    turns = table(spark, sf_dir, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("b"))
    pairs = turns.select("conv_id", "turn", F.col("text").alias("a")).join(
        before, ["conv_id", "turn"], "left")
    return rounded(near_same_text(pairs, "a", "b").drop("a", "b"), overlap=6)


@query("near_same_edits", _near_same_sql(
    "SELECT doc_id, text AS a, CASE doc_id % 3 WHEN 0 THEN replace(text, ' ', ' - ') || ' !' "
    "WHEN 1 THEN text || ' one more line of words' ELSE text[1:length(text) // 2] END AS b "
    "FROM documents", "doc_id"))
def near_same_edits(spark, sf_dir):
    k = F.pmod("doc_id", F.lit(3))
    other = F.when(k == 0, F.concat(F.replace("text", F.lit(" "), F.lit(" - ")), F.lit(" !"))).when(
        k == 1, F.concat("text", F.lit(" one more line of words"))).otherwise(
        F.expr("substring(text, 1, length(text) div 2)"))
    pairs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("a"), other.alias("b"))
    return rounded(near_same_text(pairs, "a", "b").drop("a", "b"), overlap=6)


@query("json_from_text", """
    SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL
      ELSE (props::JSON->>'k')::BIGINT END AS k FROM events
""")
def json_in_replies(spark, sf_dir):
    k = F.pmod("event_id", F.lit(5))
    reply = (
        F.when(k == 0, F.col("props"))
        .when(k == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("Here it is: "), "props", F.lit(" — done.")))
        .when(k == 3, F.concat(F.lit("```\n"), "props", F.lit("```  ")))
        .otherwise(F.concat(F.lit("no object {"), "event_type")))
    replies = table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
    found = json_from_text(replies, "reply")
    return found.select(
        "event_id", F.get_json_object("json", "$.k").cast("bigint").alias("k"))
