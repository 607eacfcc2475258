"""A pipeline over documents: quality, exact copies, near copies, benchmark passages, tokens.

STAGES: (name, function); each function takes (spark, docs, sf_dir). The next one
works on what it returns, written as Parquet and read again. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tabscout.llm import bpe, decontaminate, exact_dedup, quality, similar_dedup
from tabscout.llm.common import released
from tabscout.llm.queries import METADATA, TOKENIZER, quality_machine, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels of this table, scores at least 0.5."""
    machine = quality_machine(docs, table(spark, sf_dir, "labels"))
    return quality.drop_rejected(docs, machine, metadata=METADATA)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their 5-word shingles, or more, the one with the smallest doc_id."""
    return similar_dedup.drop_similar(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and whether they decode to the text."""
    path = public_tokenizers.path(TOKENIZER)
    found = bpe.encode(docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest")),
                       path, decoded_col="decoded")
    return found.select("doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"),
                        (F.sha2(F.col("decoded").cast("binary"), 256) == F.col("digest")).alias("round_trip"))


STAGES = [("quality", keep_quality), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("decontaminate", drop_benchmark), ("tokenize", tokenize)]

#: A factorisation machine and a graph search: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage wrote on its way is deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = released(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
