"""Queries over the given tables that apply each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tabscout.llm import bpe, chat, decontaminate, exact_dedup, periods, pii, quality, sharding, simhash_dedup, spelling, suffix_dedup, toxicity, url_filter
from tabscout.llm.common import id_bucket, landed, scratch_path

TOKENIZER = "byte_bpe_50k.json"
#: The key of the query's pseudonyms; a user takes a secret one.
PII_KEY = "documents"
#: Columns whose numbers are features of quality.
METADATA = ("n_chars",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the query: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


OP1_SQL = r"""
WITH r(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, row_number() OVER () AS k, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
f AS (SELECT k, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC) AS n
  FROM s JOIN r ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM s LEFT JOIN (SELECT * FROM f WHERE n = 1) USING (k)
"""


def quality_machine(docs: DataFrame, labels: DataFrame) -> quality.Machine:
    return quality.train(docs, labels, "quality", id_bucket("doc_id", 3) != 1, metadata=METADATA)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality_machine(docs, table(spark, sf_dir, "labels")), metadata=METADATA)
    return found.select(F.col("id").alias("doc_id"), (id_bucket("id", 3) == 1).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"), all_digests=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, words(text) AS w FROM documents),
i AS (SELECT item_id, words(text) AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(s) WHERE len(w) > 0),
p AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS t
  FROM d, (SELECT DISTINCT k FROM win), unnest(range(1, len(w) - k + 2)) AS r(s)),
hit AS (SELECT doc_id, s, p.k, item_id FROM p JOIN win ON p.k = win.k AND p.t = win.t),
n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM hit, unnest(range(s, s + k)) AS r(pos) GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
#: The words of a text, A-Z lower-cased.
OP4_SQL = OP4_SQL.replace("words(text)", r"regexp_extract_all(translate(coalesce(text, ''), "
                          r"'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymized(docs, key=PII_KEY)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"), "toxic", id_bucket("doc_id", 4) != 2)
    return toxicity.score(docs, lexicon).select(
        F.col("id").alias("doc_id"), (id_bucket("id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.encode(docs, public_tokenizers.path(TOKENIZER), decoded_col="decoded")
    return found.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


#: A conversation whose texts hold control strings.
HARD_CONVERSATION = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(HARD_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat.digests(given.unionByName(hard)).withColumnRenamed("conv", "conv_id")


OP8_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
  + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
  + length('<s>[INST]  [/INST]</s>') AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = landed(suffix_dedup.repeated_spans(docs))
    kept = suffix_dedup.kept_bytes(docs, found).select("digest", F.sha2("kept", 256).alias("sha"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return found.join(kept, "digest", "left").select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.when(F.col("whole"), nothing).otherwise(F.coalesce("sha", "digest")).alias("kept_sha256"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id", "n_links")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_places(table(spark, sf_dir, "documents"), 24, scratch_path(spark))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                        F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "version")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(table(spark, sf_dir, "documents"), plant=True).withColumn("longest", periods.longest_run())
    start, length, period = (F.col(f"longest.{c}") for c in ("start", "length", "period"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"),
        period.alias("period"), F.expr("1000 * longest.length DIV longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality": op2_quality,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_chat": op8_chat,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_sharding": op11_sharding,
    "op12_spelling": op12_spelling,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLES = {
    "op1_url_filter": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op4_decontamination": OP4_SQL,
    "op8_chat": OP8_SQL,
}
