"""Exact dedup by refinement: equal length, then equal head, then equal digest of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.llm.common import landed, text_of, without

#: Characters of the head whose hash refines groups of equal length.
HEAD_CHARS = 128
#: Up to so many lengths, or pairs of length and head, are broadcast, a few MB; beyond, the texts are shuffled to them.
BROADCAST_PAIRS = 200_000
#: Groups of over one in so many rows, so fewer than that many groups, are broadcast to their rows.
HOT = 10_000


def normal_text(text_col: str) -> Column:
    """White space runs as one space; null counts as empty."""
    return F.regexp_replace(text_of(text_col), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 all_digests: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest.

    Texts are equal when identical after white space runs become one space; null counts
    as empty. Of equal texts the row with the smallest id stays, null ids come last; of
    repeated rows (same id and text) one stays. The digest is the SHA-256 of the
    normalised text; texts that are already alone by length and head are not hashed
    and have none, unless all_digests asks for it. An empty table gives no rows.

    Lengths are counted first, then the heads of rows whose length repeats, then the digests of
    rows whose length and head repeat. Lengths and pairs that repeat are broadcast if few, so that
    texts stay where they are read. Rows of a group with more than a HOT share of all find it by a broadcast."""
    keys = docs.select(F.col(f"`{id_col}`").alias("_id"), normal_text(f"`{text_col}`").alias("_norm")).select(
        "_id", "_norm", F.length("_norm").alias("_len"))
    lengths = repeated_lengths(keys)
    alike = repeated_heads(keys, lengths)
    full = F.sha2(F.col("_norm").cast("binary"), 256)
    rows = keys.join(lengths.withColumn("_same", F.lit(True)), "_len", "left").select(
        "_id", "_len", "_norm", F.when(F.col("_same"), head_of()).alias("_head"))
    if all_digests:
        rows = rows.select("_id", "_len", "_head", full.alias("_full")).join(alike, ["_len", "_head"], "left")
    else:
        rows = rows.join(alike, ["_len", "_head"], "left").withColumn("_full", F.when(F.col("_alike"), full))
    rows = landed(rows.select("_id", "_full", "_alike", F.monotonically_increasing_id().alias("_tag")))
    first = F.min(F.struct(F.col("_id").isNull().alias("_none"), "_id", "_tag")).alias("_first")
    groups = landed(rows.where("_alike").groupBy("_full").agg(first, F.count(F.lit(1)).alias("_size")).where("_size > 1"))
    hot = groups.where(F.col("_size") * HOT > rows.count())
    some = rows.where("_alike")
    found = some.join(F.broadcast(hot), "_full").unionByName(some.join(F.broadcast(hot.select("_full")), "_full", "left_anti").join(
        groups, "_full", "left")).unionByName(rows.where("_alike is null"), allowMissingColumns=True)
    size = F.coalesce("_size", F.lit(1)).cast("long")
    return found.select(
        F.col("_id").alias("id"),
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_first._id")).alias("keep_id"),
        size.alias("group_size"), F.coalesce(F.col("_first._tag") == F.col("_tag"), F.lit(True)).alias("kept"),
        F.col("_full").alias("digest"))


def head_of() -> Column:
    return F.xxhash64(F.substring("_norm", 1, HEAD_CHARS))


def few_or_not(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_PAIRS else df


def repeated_lengths(keys: DataFrame) -> DataFrame:
    """The lengths (_len) that two rows have; there are at most as many as characters in the longest text."""
    return few_or_not(landed(keys.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_len")))


def repeated_heads(keys: DataFrame, lengths: DataFrame) -> DataFrame:
    """The lengths and heads (_len, _head) that two rows have, from rows of repeated lengths."""
    heads = keys.join(lengths, "_len", "left_semi").groupBy("_len", head_of().alias("_head")).agg(F.count(F.lit(1)).alias("_n"))
    return few_or_not(landed(heads.where("_n > 1").select("_len", "_head", F.lit(True).alias("_alike"))))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept.

    Rows that repeat id and text are first made one. See exact_groups for the rest."""
    found = landed(exact_groups(docs, id_col, text_col).where("group_size > 1"))
    per_key = found.groupBy("id", "digest").agg(F.max("kept").alias("some"), F.count(F.lit(1)).alias("n"))
    digest = F.sha2(normal_text(f"`{text_col}`").cast("binary"), 256)
    return without(docs, per_key.where("not some"), per_key.where("some and n > 1"),
                   {"id": F.col(f"`{id_col}`"), "digest": digest})
