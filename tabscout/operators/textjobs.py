"""Text helpers of the overlay: near-same sentences and JSON inside a reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR_SAME = 0.82


def plain_words(c: Column) -> Column:
    """Lower-cased alphanumeric words, separated by single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def word_set(plain: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(plain, " "), ""))


def overlap_of(a: Column, b: Column) -> Column:
    """Shared part of two sets of distinct words; null where one is empty."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / either)


def _given(a: Column, b: Column) -> Column:
    return F.coalesce((F.length(a) > 0) & (F.length(b) > 0), F.lit(False))


def near_same(a: Column, b: Column) -> Column:
    """Equal once cleaned, or nearly the same words; false where one is missing."""
    pa, pb = plain_words(a), plain_words(b)
    close = F.coalesce(overlap_of(word_set(pa), word_set(pb)) > NEAR_SAME, F.lit(False))
    return F.when(_given(a, b), (pa == pb) | close).otherwise(False)


def near_same_text(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add `overlap` and `near_same`; every text is cleaned and split once."""
    plain = df.withColumns({"_pa": plain_words(F.col(a)), "_pb": plain_words(F.col(b))})
    sets = plain.withColumns({"_wa": word_set(F.col("_pa")), "_wb": word_set(F.col("_pb"))})
    found = sets.withColumn("overlap", overlap_of(F.col("_wa"), F.col("_wb")))
    same = (F.col("_pa") == F.col("_pb")) | F.coalesce(
        F.col("overlap") > NEAR_SAME, F.lit(False))
    return found.withColumn(
        "near_same", F.when(_given(F.col(a), F.col(b)), same).otherwise(False)
    ).drop("_pa", "_pb", "_wa", "_wb")


def json_value(c: Column) -> Column:
    """The JSON in a reply, as a variant: all of it, or from the first `{` to the last `}`."""
    bare = F.regexp_replace(F.regexp_replace(c, "```(json)?", ""), r"^\s+|\s+$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner))


def json_from_text(df: DataFrame, column: str) -> DataFrame:
    """Add `json`: the reply's JSON as text, null where there is none."""
    return df.withColumn("json", F.to_json(json_value(F.col(column))))
