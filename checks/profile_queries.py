"""Column profile: counts, summaries, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import query, rounded, table
from tabscout.functions import words as w
from tabscout.operators import columns as cols
from tabscout.operators import profile as prof

GAPPY = ("SELECT l_orderkey, nullif(l_tax, 0) AS l_tax, nullif(l_returnflag, 'R') AS l_returnflag, "
         "CASE WHEN l_quantity > 5 THEN l_quantity END AS l_quantity FROM lineitem")


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with holes: the given data has no nulls."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"),
        F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"),
        F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("l_quantity"))


def _each(names: list[str], select: str, source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS name, {select.replace('$', c)} FROM {source}" for c in names)


GAPPY_COLUMNS = ["l_orderkey", "l_tax", "l_returnflag", "l_quantity"]
LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("missing_rates", _each(
    GAPPY_COLUMNS, "count(*) AS rows, count(*) - count($) AS missing, "
    "round(1.0 * (count(*) - count($)) / count(*), 6)::DOUBLE AS missing_rate", f"({GAPPY})"))
def missing_rates(spark, sf_dir):
    return rounded(prof.missing_rates(gappy(spark, sf_dir)), missing_rate=6)


@query("distinct_counts", _each(LINEITEM, "count(DISTINCT $) AS unique", "lineitem"))
def distinct_counts(spark, sf_dir):
    return prof.distinct_counts(table(spark, sf_dir, "lineitem"))


@query("distinct_counts_of_texts", _each(
    ["doc_id", "text", "lang", "source", "n_chars"], "count(DISTINCT $) AS unique", "documents"))
def distinct_counts_of_texts(spark, sf_dir):
    return prof.distinct_counts(table(spark, sf_dir, "documents"))


def _number_as_text(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN {c}::BIGINT::VARCHAR ELSE {c}::VARCHAR END"


@query("value_counts", f"""
    WITH cells AS (
      SELECT 'l_returnflag' AS name, l_returnflag AS value FROM lineitem
      UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem
      UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem
      UNION ALL SELECT 'l_quantity', {_number_as_text("l_quantity")} FROM lineitem
      UNION ALL SELECT 'l_discount', {_number_as_text("l_discount")} FROM lineitem),
    counts AS (SELECT name, value, count(*) AS rows FROM cells GROUP BY ALL),
    ranked AS (SELECT *, rows / sum(rows) OVER (PARTITION BY name) AS share,
      row_number() OVER (PARTITION BY name ORDER BY rows DESC, value) AS rank FROM counts)
    SELECT name, value, rows, round(share, 6)::DOUBLE AS share, rank FROM ranked WHERE rank <= 15
""")
def value_counts(spark, sf_dir):
    counts = prof.value_counts(table(spark, sf_dir, "lineitem"), [
        "l_returnflag", "l_linestatus", "l_linenumber", "l_quantity", "l_discount"])
    top = prof.top_values(counts).select(
        "name", "value", "rows", "share", F.col("rank").cast("bigint").alias("rank"))
    return rounded(top, share=6)


def _summary(names: list[str], source: str) -> str:
    q = ", ".join(f"round(quantile_cont($, {p}), 6) AS {n}"
                  for p, n in zip(prof.QUANTILES, prof.QUANTILE_NAMES))
    stats = (f"count($) AS n, min($)::DOUBLE AS min, max($)::DOUBLE AS max, "
             f"round(avg($), 6) AS mean, round(stddev_pop($), 6) AS std, "
             f"round(avg(pow(($ - mu) / sd, 3)), 6) AS skew, {q}")
    parts = []
    for c in names:
        moments = f"(SELECT avg({c}) AS mu, stddev_pop({c}) AS sd FROM {source}) m"
        parts.append(f"SELECT '{c}' AS name, {stats.replace('$', c)} FROM {source}, {moments}")
    return " UNION ALL ".join(parts)


def _rounded_summary(df: DataFrame) -> DataFrame:
    return rounded(df, **{c: 6 for c in ("mean", "std", "skew", *prof.QUANTILE_NAMES)})


@query("numeric_summary", _summary(
    ["l_quantity", "l_extendedprice", "l_discount", "l_suppkey"], "lineitem"))
def numeric_summary(spark, sf_dir):
    return _rounded_summary(prof.numeric_summary(
        table(spark, sf_dir, "lineitem"),
        ["l_quantity", "l_extendedprice", "l_discount", "l_suppkey"]))


@query("numeric_summary_skewed", _summary(["value"], "events"))
def numeric_summary_skewed(spark, sf_dir):
    return _rounded_summary(prof.numeric_summary(table(spark, sf_dir, "events"), ["value"]))


@query("numeric_share", """
    WITH t AS (SELECT CASE WHEN l_linenumber = 7 THEN 'n/a ' ELSE l_quantity::VARCHAR END AS a,
      CASE WHEN l_linenumber < 3 THEN NULL WHEN l_linenumber = 3 THEN '12d'
           ELSE ' ' || l_orderkey::VARCHAR || 'e2' END AS b, l_returnflag AS c, l_tax AS d
      FROM lineitem)
    SELECT 'a' AS name, count(a) AS non_null, count(try_cast(a AS DOUBLE)) AS numbers,
      round(1.0 * count(try_cast(a AS DOUBLE)) / count(a), 6)::DOUBLE AS numeric_share FROM t
    UNION ALL SELECT 'b', count(b), count(try_cast(b AS DOUBLE)),
      round(1.0 * count(try_cast(b AS DOUBLE)) / count(b), 6)::DOUBLE FROM t
    UNION ALL SELECT 'c', count(c), 0, 0.0 FROM t
    UNION ALL SELECT 'd', count(d), count(d), 1.0 FROM t
""")
def numeric_share(spark, sf_dir):
    n = F.col("l_linenumber")
    texts = table(spark, sf_dir, "lineitem").select(
        F.when(n == 7, "n/a ").otherwise(F.col("l_quantity").cast("string")).alias("a"),
        F.when(n < 3, None).when(n == 3, "12d").otherwise(
            F.concat(F.lit(" "), F.col("l_orderkey").cast("string"), F.lit("e2"))).alias("b"),
        F.col("l_returnflag").alias("c"), F.col("l_tax").alias("d"))
    return rounded(prof.numeric_share(texts), numeric_share=6)


@query("date_range", """
    SELECT 'l_shipdate' AS name, count(l_shipdate) AS valid, min(l_shipdate) AS min,
      max(l_shipdate) AS max FROM lineitem
    UNION ALL SELECT 'as_text', count(*), min(l_shipdate), max(l_shipdate) FROM lineitem
      WHERE l_linenumber <> 7
""")
def date_range(spark, sf_dir):
    text = F.when(F.col("l_linenumber") == 7, "soon").otherwise(
        F.date_format("l_shipdate", "d/M/yyyy"))
    dated = table(spark, sf_dir, "lineitem").select("l_shipdate", text.alias("as_text"))
    return prof.date_range(dated, {"l_shipdate": None, "as_text": "d/M/yyyy"})


@query("duplicate_rows_of_texts",
       "SELECT count(*) - count(DISTINCT text) AS duplicate_rows FROM documents")
def duplicate_rows_of_texts(spark, sf_dir):
    return prof.duplicate_rows(table(spark, sf_dir, "documents").select("text"))


@query("duplicate_rows", f"""
    WITH t AS (SELECT l_tax, l_returnflag, l_quantity FROM ({GAPPY}))
    SELECT (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t))
      AS duplicate_rows
""")
def duplicate_rows(spark, sf_dir):
    return prof.duplicate_rows(gappy(spark, sf_dir).drop("l_orderkey"))


def _sequence(names: list[str], source: str) -> str:
    parts = []
    for c in names:
        parts.append(f"""
        SELECT '{c}' AS name, (SELECT count(*) FROM {source}) AS rows, count(*) AS distinct_values,
          round(1.0 * count(*) / (SELECT count(*) FROM {source}), 6)::DOUBLE AS distinct_share,
          round((max(v) - min(v)) / (count(*) - 1.0), 6)::DOUBLE AS mean_gap,
          median(gap) = 1 AS median_gap_is_one,
          (SELECT count(*) FROM {source}) > 80 AND count(*) > 8
            AND 1.0 * count(*) / (SELECT count(*) FROM {source}) >= 0.82 AND median(gap) = 1
            AND (max(v) - min(v)) / (count(*) - 1.0) < 2.5 AS is_sequence
        FROM (SELECT v, v - lag(v) OVER (ORDER BY v) AS gap
              FROM (SELECT DISTINCT {c}::DOUBLE AS v FROM {source}))""")
    return " UNION ALL ".join(parts)


@query("sequence_test", _sequence(["o_orderkey", "o_custkey", "o_totalprice"], "orders"))
def sequence_test(spark, sf_dir):
    found = prof.sequence_test(
        table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_totalprice"])
    return rounded(found, distinct_share=6, mean_gap=6)


# --- roles: the rule chain over aggregates, in SQL --------------------------------

def _has(words) -> str:
    whole = "list_has_any(string_split_regex(lower(name), '[^a-z0-9]+'), [{}])".format(
        ", ".join(f"'{x}'" for x in words))
    inside = "|".join(x for x in words if len(x) > 4)
    return f"({whole} OR regexp_matches(lower(name), '{inside}'))" if inside else whole


IS_ID = ("(list_has_any(string_split_regex(lower(name), '[^a-z0-9]+'), [{}]) "
         "OR lower(name) LIKE '%id' OR lower(name) LIKE 'id\\_%' ESCAPE '\\')").format(
    ", ".join(f"'{x}'" for x in w.ID_WORDS))


def _facts(source: str, c: str, kind: str) -> str:
    """Statistics of one column; kind is number, text or time."""
    number = {"number": f"{c}::DOUBLE", "text": f"try_cast({c} AS DOUBLE)"}.get(kind)
    share = f"1.0 * count({number}) / count(*)" if number else "0.0"
    gaps = "false"
    if kind == "number":
        gaps = (f"(SELECT median(gap) = 1 AND (max(v) - min(v)) / greatest(count(*) - 1, 1) < 2.5 "
                f"AND count(*) > 8 FROM (SELECT v, v - lag(v) OVER (ORDER BY v) AS gap FROM "
                f"(SELECT DISTINCT {c} AS v FROM {source})))")
    length = f"avg(length({c}))" if kind == "text" else "NULL"
    return (f"SELECT '{c}' AS name, count(*) AS rows, count(DISTINCT {c}) AS uniq, "
            f"{share} AS numbers, {'1.0' if kind == 'time' else '0.0'} AS dates, "
            f"min({c}::VARCHAR) AS low, max({c}::VARCHAR) AS high, {length} AS len, "
            f"{gaps} AS steps FROM {source}")


def _roles(tables: dict[str, dict[str, str]]) -> str:
    positive = ", ".join(f"'{x}'" for x in w.POSITIVE_VALUES)
    facts = " UNION ALL ".join(
        f"SELECT '{t}' AS dataset, * FROM ({_facts(t, c, k)})"
        for t, cs in tables.items() for c, k in cs.items())
    guard, bad = _has(w.MEASURE_GUARD_WORDS), f"({IS_ID} OR {_has(w.BAD_AXIS_WORDS)})"
    return f"""
    WITH facts AS ({facts}),
    positive AS (SELECT *, CASE WHEN uniq <= 2 THEN
        CASE WHEN lower(high) IN ({positive}) OR {_has(w.OUTCOME_WORDS)} THEN high
             WHEN lower(low) IN ({positive}) THEN low END END AS pos FROM facts),
    roles AS (SELECT *, CASE
        WHEN {_has(w.LATITUDE_WORDS)} THEN 'latitude' WHEN {_has(w.LONGITUDE_WORDS)} THEN 'longitude'
        WHEN {IS_ID} THEN 'identifier' WHEN dates >= 0.75 THEN 'datetime'
        WHEN uniq <= 2 AND pos IS NOT NULL THEN 'outcome' WHEN uniq <= 2 THEN 'categorical'
        WHEN numbers >= 0.85 AND rows > 80 AND 1.0 * uniq / rows >= 0.82 AND steps THEN 'identifier'
        WHEN numbers >= 0.85 AND uniq <= least(20, greatest(3, rows * 0.04)) AND NOT {guard}
          THEN 'categorical'
        WHEN numbers >= 0.85 THEN 'measure'
        WHEN uniq <= least(80, greatest(12, rows * 0.25)) THEN 'categorical'
        ELSE 'text' END AS role FROM positive)
    SELECT dataset, name, role, uniq AS unique, printf('%.4f', 1.0 * uniq / rows)::DOUBLE AS unique_rate,
      CASE WHEN role = 'outcome' THEN pos END AS positive_value,
      role NOT IN ('identifier', 'text') AND NOT {bad} AS is_candidate,
      CASE WHEN {bad} AND role NOT IN ('identifier', 'text')
             THEN 'name/code/text field; not used as chart axis'
           WHEN role = 'identifier' AND {IS_ID} THEN 'identifier-like column'
           WHEN role = 'identifier' THEN 'numeric sequence / identifier-like'
           WHEN role = 'text' AND (1.0 * uniq / rows > 0.5 OR len > 50)
             THEN 'free text or mostly unique'
           WHEN role = 'text' THEN 'not useful for charts' END AS reason_excluded
    FROM roles"""


ROLE_COLUMNS = ("dataset", "name", "role", "unique", "unique_rate", "positive_value",
                "is_candidate", "reason_excluded")
STAR = {
    "customer": dict(c_custkey="number", c_name="text", c_nationkey="number", c_acctbal="number",
                     c_mktsegment="text"),
    "part": dict(p_partkey="number", p_name="text", p_brand="text", p_type="text",
                 p_size="number", p_retailprice="number"),
    "orders": dict(o_orderkey="number", o_custkey="number", o_orderstatus="text",
                   o_totalprice="number", o_orderdate="time", o_orderpriority="text"),
}
LINE = {"lineitem": {
    c: "time" if c == "l_shipdate" else "text" if c in ("l_returnflag", "l_linestatus")
    else "number" for c in LINEITEM}}
TEXTS = {
    "documents": dict(doc_id="number", text="text", lang="text", source="text", n_chars="number"),
    "labels": dict(doc_id="number", quality="number", toxic="number"),
    "conversations": dict(conv_id="number", turn="number", role="text", text="text"),
    "events": dict(event_id="number", ts="time", user_id="number", event_type="text",
                   value="number", props="text"),
}


def _profiles(spark: SparkSession, sf_dir: str, tables) -> DataFrame:
    parts = [prof.profile_columns(table(spark, sf_dir, t), t) for t in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("roles_of_lineitem", _roles(LINE))
def roles_of_lineitem(spark, sf_dir):
    return _profiles(spark, sf_dir, LINE).select(*ROLE_COLUMNS)


@query("roles_of_star_tables", _roles(STAR))
def roles_of_star_tables(spark, sf_dir):
    return _profiles(spark, sf_dir, STAR).select(*ROLE_COLUMNS)


@query("roles_of_text_tables", _roles(TEXTS))
def roles_of_text_tables(spark, sf_dir):
    return _profiles(spark, sf_dir, TEXTS).select(*ROLE_COLUMNS)


@query("eligible_columns", f"""
    SELECT dataset, CASE role WHEN 'measure' THEN 'measure' WHEN 'outcome' THEN 'outcome'
      WHEN 'datetime' THEN 'date' ELSE 'segment' END AS part, name
    FROM (SELECT r.*, (SELECT count(*) FROM orders) AS n FROM ({_roles(
        {"orders": STAR["orders"]})}) r)
    WHERE is_candidate AND (role IN ('measure', 'datetime') OR positive_value IS NOT NULL
      OR (role = 'categorical' AND "unique" BETWEEN 2 AND least(60, greatest(8, n // 10))))
""")
def eligible_columns(spark, sf_dir):
    profile = _profiles(spark, sf_dir, ["orders"])
    return cols.eligible(profile).select("dataset", "part", "name")


@query("compact_profile", f"""
    SELECT dataset, name, role FROM ({_roles(LINE)})
    WHERE is_candidate OR role IN ('outcome', 'datetime', 'latitude', 'longitude')
""")
def compact_profile(spark, sf_dir):
    return cols.compact_profile(_profiles(spark, sf_dir, LINE)).select("dataset", "name", "role")


@query("column_digest", """
    SELECT 'value' AS name, 'Value' AS label, count(DISTINCT value) AS unique,
      round(min(value), 6) AS min, round(max(value), 6) AS max, round(avg(value), 6) AS mean,
      round(median(value), 6) AS median, NULL::TIMESTAMP AS first_time,
      NULL::TIMESTAMP AS last_time FROM events
    UNION ALL SELECT 'ts', 'Ts', count(DISTINCT ts), NULL, NULL, NULL, NULL, min(ts), max(ts)
      FROM events
    UNION ALL SELECT 'event_type', 'Event Type', count(DISTINCT event_type), NULL, NULL, NULL, NULL,
      NULL, NULL FROM events
""")
def column_digest(spark, sf_dir):
    digest = cols.column_digest(_profiles(spark, sf_dir, ["events"])).select(
        "name", "label", "unique", "min", "max", "mean", "median", "first_time", "last_time")
    return rounded(digest, min=6, max=6, mean=6, median=6)


@query("table_profile", """
    SELECT 'labels' AS dataset, count(*) AS rows, 3::BIGINT AS columns, 0::BIGINT AS missing_cells,
      count(*) - count(DISTINCT (doc_id, quality, toxic)) AS duplicate_rows FROM labels
""")
def table_profile(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return cols.table_profile(
        prof.profile_columns(labels, "labels"),
        prof.duplicate_rows(labels).first().duplicate_rows)


DOCUMENT_HASH = "substr(md5('0|' || doc_id || '|' || text || '|' || lang || '|' || source || '|' || n_chars), 1, 15)"


@query("first_values", " UNION ALL ".join(f"""
    SELECT * FROM (SELECT '{c}' AS name, row_number() OVER (ORDER BY {DOCUMENT_HASH}, {c}::VARCHAR)::INT AS rn,
      {c}::VARCHAR AS value FROM documents) WHERE rn <= 5""" for c in ("doc_id", "text", "lang", "source", "n_chars")))
def first_values(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    n = documents.count()
    names = documents.columns
    return prof.first_values(documents, names, 5, dict.fromkeys(names, n))


def _date_share(names: list[str], source: str) -> str:
    like = f"regexp_matches($, '{w.DATE_PATTERN}')"
    good = ("coalesce(try_strptime($, '%Y-%m-%d'), try_strptime($, '%Y/%m/%d'))")
    return _each(
        names, f"count($) AS seen, CASE WHEN 1.0 * count(*) FILTER ({like}) / count($) "
        f">= 0.55 THEN 1.0 * count(*) FILTER ({like} AND {good} IS NOT NULL) / "
        f"count(*) FILTER ({like}) ELSE 0 END::DOUBLE AS date_share", f"({source})")


@query("date_share", _date_share(["plain", "iso", "numbers"], """
    SELECT 'no ' || l_returnflag AS numbers, strftime(l_shipdate, '%Y-%m-%d') AS iso,
      CASE WHEN l_linenumber > 4 THEN strftime(l_shipdate, '%Y/%m/%d') ELSE 'soon' END AS plain
    FROM lineitem"""))
def date_share(spark, sf_dir):
    made = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("no "), "l_returnflag").alias("numbers"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("iso"),
        F.when(F.col("l_linenumber") > 4, F.date_format("l_shipdate", "yyyy/MM/dd")).otherwise(
            "soon").alias("plain"))
    return prof.date_share(made, made.columns).select("name", "seen", "date_share")
