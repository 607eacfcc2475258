"""Benchmark decontamination as a prefix-filtered set join.

Every window of an item is a set of word shingles. A document that holds the window
holds all its shingles, so the rarest one alone is a necessary prefix. Rarity is
counted over all documents; a window with a shingle that no document has is dropped.
Documents are joined on the rarest shingles only, positions and lengths bound where the
window must lie, and the words there are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscout.llm.common import chunks, filter_bits, landed, text_of, without
from tabscout.llm.textbytes import (alnum_bytes, byte_table, has_bit, prefix_hash, shingle_hash, span_hash, utf8,
                                    word_spans)

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
CANDIDATES = "array<struct<shingle:long,pos:int,before:int,words:array<string>>>"


def shingles_of(column: pa.Array, widths: list[int]):
    """(lower-cased bytes, word starts, word ends, first word of each text, {width: (hashes, which are whole)})."""
    raw, at = utf8(column)
    word = alnum_bytes()
    starts, ends, first = word_spans(raw, at, word)
    low = byte_table(word)[raw]
    hashes = span_hash(prefix_hash(low), starts, ends)
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(starts))
    return low, starts, ends, first, {k: (shingle_hash(hashes, k), left >= k) for k in widths if k}


def word_list(low: bytes, starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> list[str]:
    return [low[s:e].decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]


def windows_of(items: DataFrame, id_col: str, text_col: str, window: int, width: int) -> DataFrame:
    """(id, words, shingles) of every window of every item; an item without words has none."""
    rows = items.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            low, starts, ends, first, hashes = shingles_of(b.column("text"), list(range(1, width + 1)))
            view = low.tobytes()
            place, words, keys = [], [], []
            for n, (f, g) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                size = min(window, g - f)
                k = min(width, size)
                for a in range(f, g - size + 1) if size else ():
                    place.append(n)
                    words.append(word_list(view, starts, ends, a, a + size))
                    keys.append(hashes[k][0][a:a + size - k + 1].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(pa.array(place, pa.int64())), pa.array(words, pa.list_(pa.string())),
                 pa.array(keys, pa.list_(pa.int64()))], ["id", "words", "shingles"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, words array<string>, shingles array<long>")


def shingle_counts(docs: DataFrame, text_col: str, bits: np.ndarray, widths: list[int]) -> DataFrame:
    """(shingle, n): how often all documents hold each shingle that the filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            hashes = shingles_of(b.column("text"), widths)[-1]
            found = [h[whole & has_bit(shared.value, h)] for h, whole in hashes.values()]
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["shingle", "n"])

    parts = docs.select(text_of(f"`{text_col}`").alias("text")).mapInArrow(run, "shingle long, n long")
    return parts.groupBy("shingle").agg(F.sum("n").alias("n"))


def rarest_shingles(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(words, shingle, offset) of each different window all of whose shingles some document has."""
    each = windows.select("words", "shingles").distinct().select(
        "words", F.size("shingles").alias("m"), F.posexplode("shingles").alias("offset", "shingle"))
    ranked = each.join(counts, "shingle").groupBy("words", "m").agg(
        F.count(F.lit(1)).alias("k"), F.min(F.struct("n", "shingle", "offset")).alias("rarest"))
    return ranked.where("k = m").select("words", "rarest.shingle", "rarest.offset")


def candidates(docs: DataFrame, id_col: str, text_col: str, bits: np.ndarray, widths: list[int],
               window: int) -> DataFrame:
    """One row per row of docs: id, text_hash, n_words, and where it may hold a wanted shingle, with the words around."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(f"`{text_col}`")).alias("text_hash"),
                       text_of(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            low, starts, ends, first, hashes = shingles_of(b.column("text"), widths)
            view = low.tobytes()
            found = [[] for _ in range(len(first) - 1)]
            for h, whole in hashes.values():
                for p in np.flatnonzero(whole & has_bit(shared.value, h)).tolist():
                    n = int(np.searchsorted(first, p, "right")) - 1
                    f, g = int(first[n]), int(first[n + 1])
                    a, z = max(f, p - window + 1), min(g, p + window)
                    found[n].append({"shingle": int(h[p].view(np.int64)), "pos": p - f, "before": p - a,
                                     "words": word_list(view, starts, ends, a, z)})
            kind = pa.list_(pa.struct([("shingle", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()),
                                       ("words", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_hash"), pa.array(np.diff(first)), pa.array(found, kind)],
                ["id", "text_hash", "n_words", "found"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_hash long, n_words long, found {CANDIDATES}")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = WINDOW_WORDS,
                  width: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of docs: id, text_hash, n_words, n_hit, item_ids (sorted as strings).

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. A
    window is `window` words of an item in a row, or all words of a shorter item; a
    document word inside an occurrence of one is hit. Null and wordless texts have no
    words and no hits; so have wordless items. Null item ids are named by the empty
    string; equal item ids count once. Repeated rows are judged one by one. Empty
    tables give no rows, or rows without hits."""
    windows = landed(windows_of(items, item_id, item_text, window, width))
    sizes = [r[0] for r in windows.select(F.least(F.size("words"), F.lit(width))).distinct().collect()]
    bits = filter_bits(windows.select(F.explode("shingles").alias("hash")))
    counts = landed(shingle_counts(docs, text_col, bits, sizes))
    rarest = landed(rarest_shingles(windows, counts))
    wanted = filter_bits(rarest.select(F.col("shingle").alias("hash")))
    rows = landed(candidates(docs, id_col, text_col, wanted, sizes, window).withColumn(
        "tag", F.monotonically_increasing_id()))
    places = rows.where(F.size("found") > 0).select("tag", "n_words", F.explode("found").alias("c"))
    places = places.select("tag", "n_words", "c.*")
    begin = F.col("pos") - F.col("offset")
    size = F.size("w_words")
    fits = (F.col("offset") <= F.col("before")) & (begin >= 0) & (begin + size <= F.col("n_words"))
    same = F.slice("words", F.greatest(F.col("before") - F.col("offset"), F.lit(0)) + 1, size) == F.col("w_words")
    hits = places.join(rarest.withColumnRenamed("words", "w_words"), "shingle").where(fits & same).select(
        "tag", "w_words", begin.alias("begin"), (begin + size).alias("end"))
    hits = landed(hits)
    in_order = Window.partitionBy("tag").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(in_order), F.lit(0))
    n_hit = hits.select("tag", F.greatest(F.col("end") - F.greatest("begin", reach), F.lit(0)).alias("new")).groupBy(
        "tag").agg(F.sum("new").alias("n_hit"))
    names = windows.select(F.col("words").alias("w_words"), F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item"))
    item_ids = hits.select("tag", "w_words").distinct().join(names.distinct(), "w_words").groupBy("tag").agg(
        F.array_sort(F.collect_set("item")).alias("item_ids"))
    found = n_hit.join(item_ids, "tag")
    return rows.select("tag", "id", "text_hash", "n_words").join(found, "tag", "left").select(
        "id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options: object) -> DataFrame:
    """docs less those with a hit word; all columns kept."""
    found = contamination(docs, items, id_col, text_col, **options).where("n_hit > 0")
    gone = landed(found.select("id", "text_hash").distinct())
    keys: dict[str, Column] = {"id": F.col(f"`{id_col}`"), "text_hash": F.xxhash64(text_of(f"`{text_col}`"))}
    return without(docs, gone, gone.limit(0), keys)
