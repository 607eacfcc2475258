"""Repeated passages by suffix arrays, built in two stages.

A string of `length` bytes that starts in two places is a window. Every window is known by
the least hash of its pieces of PIECE bytes, so equal windows have the same key. A run of
window starts with one key, with the bytes up to the end of its last window, is a
context. Contexts whose key is alone need no look; equal contexts become one row with
a count; the others meet by key, and their suffixes are sorted in two stages: those
smaller than their successor directly, all others induced from them by one scan over
the buckets of first bytes. Where neighbours share `length` bytes, both windows repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.llm.common import chunks, filter_bits, landed, passes_filter, text_of
from tabscout.llm.textbytes import U, has_bit, mixed, powers, prefix_hash, utf8

LENGTH = 400
#: Bytes of the pieces whose least hash names a window.
PIECE = 64
#: Bytes of contexts that are sorted together; the contexts of one key are never parted below KEY_BYTES.
SORT_BYTES = 2 << 20
#: Contexts of keys with more bytes are cut down, and dealt to parts of at most about that size, before they are sorted.
KEY_BYTES = 4 << 20


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row, in one pass over blocks of that width."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def contexts_of(raw: np.ndarray, at: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, ...]:
    """(text, key, first window, windows, inner) of the contexts of many texts; places count from each text's start.

    inner: the piece of the key stands in the context twice, so that a window may repeat in it."""
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none.astype(np.uint64), none, none, none.astype(bool)
    sums = prefix_hash(raw)
    hashes = mixed((sums[piece:] - sums[:-piece]) * powers(len(sums))[1][:len(raw) - piece + 1])
    keys = sliding_min(hashes, length - piece + 1)
    sizes = np.diff(at)
    windows = np.maximum(sizes - length + 1, 0)
    whole = np.zeros(len(raw) + 1, np.int32)
    np.add.at(whole, at[:-1][windows > 0], 1)
    np.add.at(whole, (at[:-1] + windows)[windows > 0], -1)
    inside = np.cumsum(whole)[:len(keys)] > 0
    new = inside.copy()
    starts_text = np.zeros(len(raw) + 1, bool)
    starts_text[at[:-1]] = True
    new[1:] &= ~inside[:-1] | (keys[1:] != keys[:-1]) | starts_text[1:len(keys)]
    first = np.flatnonzero(new)
    text = np.searchsorted(at, first, "right") - 1
    end = np.minimum(np.append(first[1:], len(raw)), at[text] + windows[text])
    spans = zip(first.tolist(), (end + length - piece).tolist(), keys[first])
    inner = np.array([np.count_nonzero(hashes[a:z] == k) > 1 for a, z, k in spans], bool)
    return text, keys[first], first - at[text], end - first, inner


def direct_sort(t: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first `depth` symbols, eight at a time; only ties are looked at again."""
    view = np.ndarray((len(t) - 7,), ">u8", t.data, strides=(1,))
    out = places.copy()
    group = np.zeros(len(places), np.int64)
    live = np.arange(len(places))
    for off in range(0, depth, 8):
        if not len(live):
            break
        key = view[out[live] + off].astype(np.uint64)
        order = np.lexsort((key, group[live]))
        key, g = key[order], group[live][order]
        out[live] = out[live][order]
        same = np.zeros(len(live) + 1, bool)
        same[1:-1] = (key[1:] == key[:-1]) & (g[1:] == g[:-1])
        fresh = ~same[:-1]
        group[live] = live[np.maximum.accumulate(np.where(fresh, np.arange(len(live)), 0))]
        live = live[same[:-1] | same[1:]]
    return out


def suffix_order(t: np.ndarray, needed: np.ndarray, smaller: np.ndarray, depth: int) -> np.ndarray:
    """The needed places in suffix order, by two-stage sorting.

    smaller: which suffixes are smaller than their successors. These are sorted directly;
    then, bucket by bucket, a suffix in place puts the one before it, if that is
    larger than it, at the next free place of its own bucket. needed holds, with each
    place whose suffix is larger than its successor, the successor too."""
    direct = direct_sort(t, np.flatnonzero(needed & smaller), depth)
    heads = np.searchsorted(t[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []

    def put(place: np.ndarray, bucket: int) -> np.ndarray:
        """Give the predecessors of a sorted run to their buckets; those of this same bucket come back."""
        before = place[place > 0] - 1
        before = before[needed[before] & ~smaller[before]]
        symbol = t[before]
        sorted_by = np.argsort(symbol, kind="stable")
        before, symbol = before[sorted_by], symbol[sorted_by]
        cut = np.flatnonzero(np.diff(symbol)) + 1
        back = before[:0]
        for part in np.split(before, cut) if len(before) else ():
            c = int(t[part[0]])
            if c == bucket:
                back = part
            else:
                waiting[c].append(part)
        return back

    for c in range(256):
        run = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(run):  # longer and longer runs of the symbol
            order.append(run)
            run = put(run, c)
        own = direct[heads[c]:heads[c + 1]]
        if len(own):
            order.append(own)
            put(own, c)
    return np.concatenate([direct[:0], *order])


def repeats(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each context, which of its windows start elsewhere among all of them too."""
    sizes = np.array([len(x) for x in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    # One string; that suffixes run on into the next context changes no window. The end
    # counts as smaller than what follows, so that every chain of larger suffixes ends.
    t = np.frombuffer(b"".join(texts) + bytes(length + 16), np.uint8)
    step = np.sign(np.diff(t.astype(np.int16), append=256))
    nearest = np.minimum.accumulate(np.where(step != 0, np.arange(len(t)), len(t) - 1)[::-1])[::-1]
    smaller = step[nearest] > 0
    window = np.zeros(len(t) + 1, np.int32)
    np.add.at(window, begin, 1)
    np.add.at(window, begin + sizes - length + 1, -1)
    window = np.cumsum(window)[:-1] > 0
    # From the last window on to the first suffix that is sorted directly.
    sorted_at = np.flatnonzero(smaller)
    last = begin + sizes - length
    until = sorted_at[np.searchsorted(sorted_at, last)]
    more = np.zeros(len(t) + 1, np.int32)
    np.add.at(more, begin, 1)
    np.add.at(more, until + 1, -1)
    needed = np.cumsum(more)[:-1] > 0
    order = suffix_order(t, needed, smaller, length)
    order = order[window[order]]
    hit = np.zeros(len(t), bool)
    same = common(t, order[:-1], order[1:], length)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [hit[b:b + s - length + 1] for b, s in zip(begin.tolist(), sizes.tolist())]


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a and b begin with the same `length` bytes."""
    view = np.ndarray((len(t) - 7,), "<u8", t.data, strides=(1,))
    out = np.zeros(len(a), bool)
    live = np.arange(len(a))
    offsets = [*range(0, length - 7, 8), length - 8] if length >= 8 else []
    for off in offsets:
        live = live[view[a[live] + off] == view[b[live] + off]]
    for off in range(length) if length < 8 else ():
        live = live[t[a[live] + off] == t[b[live] + off]]
    out[live] = True
    return out


def runs(mask: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and lengths of the runs of true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()


def keyed_contexts(docs: DataFrame, length: int, piece: int) -> DataFrame:
    """(id, digest, n_bytes, keys) of every row; a key stands twice if its context may repeat itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            raw, at = utf8(b.column("text"))
            text, key, _, _, inner = contexts_of(raw, at, length, piece)
            twice = 1 + inner
            text, key = np.repeat(text, twice), np.repeat(key, twice)
            ends = np.searchsorted(text, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("digest"), pa.array(np.diff(at)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(key.view(np.int64)))], ["id", "digest", "n_bytes", "keys"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, digest string, n_bytes long, keys array<long>")


def cut_contexts(wanted: DataFrame, length: int, piece: int) -> DataFrame:
    """(key, digest, copies, first, n, inner, context) of the contexts of each text that have one of its wanted keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            raw, at = utf8(b.column("text"))
            text, key, first, windows, inner = contexts_of(raw, at, length, piece)
            keep = np.zeros(len(text), bool)
            edges = np.searchsorted(text, np.arange(b.num_rows + 1))
            for n, keys in enumerate(b.column("wanted")):
                part = slice(edges[n], edges[n + 1])
                keep[part] = np.isin(key[part], keys.values.to_numpy().view(np.uint64))
            text, key, first, windows, inner = text[keep], key[keep], first[keep], windows[keep], inner[keep]
            start = at[text] + first
            view = raw.tobytes()
            of = pa.array(text)
            for k in range(0, max(len(text), 1), 4096):  # small batches: contexts overlap in their text
                cut = slice(k, k + 4096)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[cut].view(np.int64)), b.column("digest").take(of[cut]), b.column("copies").take(of[cut]),
                     pa.array(first[cut]), pa.array(windows[cut]), pa.array(inner[cut]),
                     pa.array([view[s:s + w + length - 1] for s, w in zip(start[cut].tolist(), windows[cut].tolist())], pa.binary())],
                    ["key", "digest", "copies", "first", "n", "inner", "context"])

    return wanted.mapInArrow(run, "key long, digest string, copies long, first long, n long, inner boolean, context binary")


def sorted_repeats(contexts: DataFrame, length: int, sort_bytes: int) -> DataFrame:
    """(key, mark, at, n): the runs of repeated windows of each different context; all rows of a key are together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, int, int, bytes]] = []
        size = 0

        def result() -> pa.RecordBatch:
            out = []
            for (key, mark, count, _), mask in zip(waiting, repeats([w[3] for w in waiting], length)):
                out += [(key, mark, a, n) for a, n in zip(*runs(mask | (count > 1)))]
            columns = zip(*out) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["key", "mark", "at", "n"])

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("key", "mark", "count", "context")]):
                if size > sort_bytes and row[0] != waiting[-1][0]:
                    yield result()
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[3])
        if waiting:
            yield result()

    return contexts.select("key", "mark", "count", "context").mapInArrow(run, "key long, mark long, at long, n long")


def ends_of(context: bytes, key: int, length: int, piece: int) -> np.ndarray:
    """A hash of the key and of the first and last bytes of each window of a context."""
    raw = np.frombuffer(context, np.uint8)
    sums = prefix_hash(raw)
    pieces = mixed((sums[piece:] - sums[:-piece]) * powers(len(sums))[1][:len(raw) - piece + 1])
    windows = len(raw) - length + 1
    return mixed(pieces[:windows] * U(0xFF51AFD7ED558CCD) + pieces[length - piece:] + U(key % (1 << 64)))


def hot_pieces(hot: DataFrame, length: int, piece: int, key_bytes: int) -> DataFrame:
    """(key, part, mark, shift, count, context) of the contexts of keys with too many bytes for one task, made small.

    Windows whose ends are alone in their key go; what is left of a context are shorter ones, of which most
    are equal where a passage is common. Of a key that still has too many bytes the windows are dealt to
    parts by their ends, so that equal windows stay together. shift: where a piece begins in its context."""
    columns = hot.select("key", "mark", "count", "context")
    kind = "key long, mark long, shift long, count long, part long, context binary"

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for b in batches if b.num_rows):
            keys, counts, texts = (b.column(c).to_pylist() for c in ("key", "count", "context"))
            hashes = [ends_of(x, k, length, piece) for x, k in zip(texts, keys)]
            times = np.repeat(np.array(counts, np.int64), [len(h) for h in hashes])
            found, place = np.unique(np.concatenate(hashes), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(place, times).astype(np.int64))], ["hash", "n"])

    bits = columns.mapInArrow(seen, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    shared = hot.sparkSession.sparkContext.broadcast(filter_bits(bits))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, mark, count, context in zip(*[b.column(c).to_pylist() for c in ("key", "mark", "count", "context")]):
                again = has_bit(shared.value, ends_of(context, key, length, piece))
                out += [(key, mark, a, count, 0, context[a:a + n + length - 1]) for a, n in zip(*runs(again))]
            yield rows_batch(out)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, mark, shift, count, parts, context in zip(*[b.column(c).to_pylist() for c in ("key", "mark", "shift", "count", "parts", "context")]):
                part = (ends_of(context, key, length, piece) % U(parts)).astype(np.int64)
                edge = np.flatnonzero(np.diff(part)) + 1
                yield rows_batch([(key, mark, shift + a, count, int(part[a]), context[a:z + length - 1])
                                  for a, z in zip([0, *edge.tolist()], [*edge.tolist(), len(part)])])

    pieces = landed(columns.mapInArrow(cut, kind))
    windows = F.length("context") - length + 1
    unlike = pieces.select("key", F.xxhash64("context", F.length("context")).alias("same"), windows.alias("n"), F.length("context").alias("size"))
    sizes = unlike.dropDuplicates(["key", "same"]).groupBy("key").agg(F.sum("size").alias("bytes"), F.sum("n").alias("n")).where(
        F.col("bytes") > key_bytes).select(F.col("key").alias("_key"), F.ceil(F.col("n") * length / max(key_bytes, 1)).alias("parts"))
    sizes = landed(sizes)
    large = pieces.join(sizes, pieces["key"] == sizes["_key"]).drop("_key")
    small = pieces.join(sizes, pieces["key"] == sizes["_key"], "left_anti")
    return landed(small.unionAll(large.select("key", "mark", "shift", "count", "parts", "context").mapInArrow(deal, kind)))


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 5, pa.binary()]
    columns = zip(*rows) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["key", "mark", "shift", "count", "part", "context"])


def hot_repeats(hot: DataFrame, length: int, piece: int, sort_bytes: int, key_bytes: int) -> DataFrame:
    """(key, mark, at, n) of sorted_repeats for the contexts of keys with too many bytes for one task."""
    pieces = hot_pieces(hot, length, piece, key_bytes).withColumn("same", F.xxhash64("context", F.length("context")))
    unlike = pieces.groupBy(F.xxhash64("key", "part").alias("key"), F.col("same").alias("mark")).agg(
        F.sum("count").alias("count"), F.first("context").alias("context"))
    found = sorted_repeats(unlike.repartition("key").sortWithinPartitions("key"), length, sort_bytes).select(
        F.col("key").alias("_place"), F.col("mark").alias("_same"), F.col("at").alias("_at"), "n")
    of = pieces.select("key", "mark", "shift", "same", F.xxhash64("key", "part").alias("place"))
    return of.join(found, (F.col("place") == F.col("_place")) & (F.col("same") == F.col("_same"))).select(
        "key", "mark", (F.col("shift") + F.col("_at")).alias("at"), "n")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   piece: int = PIECE, sort_bytes: int = SORT_BYTES, key_bytes: int = KEY_BYTES) -> DataFrame:
    """One row per row of docs: id, digest (SHA-256 of the text), n_bytes, whole, spans.

    spans are the maximal runs (start, stop) of bytes of the UTF-8 text under a string of
    `length` bytes that starts elsewhere too, in the same text or another; no string
    crosses texts. whole: the text has copies and is at least that long, so all of it
    goes. Null counts as empty; texts shorter than `length` have no spans. Repeated rows
    are copies. Copies of a text are worked on once; only texts with a window whose key
    another has are read again."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    rows = rows.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")
    marks = landed(keyed_contexts(rows, length, piece))
    copies = marks.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(
        F.col("id").isNull().alias("none"), "id")).alias("least"), F.first("n_bytes").alias("n_bytes"))
    copies = landed(copies)
    # The keys of one row of each text: the one with the least id.
    one = marks.join(copies.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(
        F.col("least.id"))).select("digest", "keys", "copies", "id").dropDuplicates(["digest"])
    each = one.select("digest", "copies", "id", F.explode("keys").alias("key"))
    known = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    wanted = landed(each.join(known, "key").groupBy("digest", "copies", "id").agg(F.collect_set("key").alias("wanted")))
    row_key = F.xxhash64("digest", F.col("id").cast("string"))
    again = rows.where(passes_filter(wanted.select(row_key.alias("hash")), row_key))
    read = again.join(wanted.select(F.col("digest").alias("d"), F.col("id").alias("i"), "copies", "wanted"),
                      (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i")))
    read = read.select("digest", "copies", "text", "wanted")
    found = landed(cut_contexts(read, length, piece).withColumn(
        "mark", F.xxhash64("context", F.length("context"))).dropDuplicates(["digest", "first"]))
    unlike = found.groupBy("key", "mark").agg(
        F.sum("copies").alias("count"), F.first("context").alias("context"), F.max("n").alias("n"), F.max("inner").alias("inner"))
    unlike = landed(unlike.withColumn("size", F.length("context")))
    sizes = landed(unlike.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("k"), F.max("inner").alias("inner")))
    alone = (F.col("k") == 1) & ~F.col("inner")
    whole_runs = unlike.where(F.col("count") > 1).join(sizes.where(alone), "key", "left_semi").select(
        "key", "mark", F.lit(0).cast("long").alias("at"), "n")
    mates = unlike.join(sizes.where(~alone & (F.col("bytes") <= key_bytes)), "key", "left_semi")
    hot = unlike.join(sizes.where(~alone & (F.col("bytes") > key_bytes)), "key", "left_semi")
    together = mates.repartition("key").sortWithinPartitions("key")
    hits = whole_runs.unionAll(sorted_repeats(together, length, sort_bytes))
    if not hot.isEmpty():
        hits = hits.unionAll(hot_repeats(hot, length, piece, sort_bytes, key_bytes))
    hits = landed(hits)
    spans = hits.withColumnRenamed("n", "run").join(found.select("key", "mark", "digest", "first"), ["key", "mark"]).groupBy("digest").agg(
        F.array_sort(F.collect_list(F.struct((F.col("first") + F.col("at")).alias("start"),
                                             (F.col("first") + F.col("at") + F.col("run") - 1 + length).alias("stop")))).alias("parts"))
    classes = copies.join(spans, "digest", "left").select(
        F.col("digest"), ((F.col("copies") > 1) & (F.col("n_bytes") >= length)).alias("whole"), merged("parts").alias("parts"))
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    return marks.select("id", "digest", "n_bytes").join(classes, "digest").select(
        "id", "digest", "n_bytes", "whole", F.when(F.col("whole"), all_of_it).otherwise(F.col("parts")).alias("spans"))


def merged(parts: str):
    """Sorted spans of one text with those joined that meet or overlap; null gives none."""
    def merge(column: pa.Array) -> pa.Array:
        out = []
        for spans in column.to_pylist():
            kept: list[dict] = []
            for s in spans or ():
                if kept and s["start"] <= kept[-1]["stop"]:
                    kept[-1]["stop"] = max(kept[-1]["stop"], s["stop"])
                else:
                    kept.append(dict(s))
            out.append(kept)
        return pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))

    return F.arrow_udf(merge, "array<struct<start:long,stop:long>>")(F.col(parts))


def kept_bytes(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, kept) of each different text that has spans but does not go as a whole; kept is what is left of its bytes.

    spans is the result of repeated_spans for docs."""
    parts = landed(spans.where(~F.col("whole") & (F.size("spans") > 0)).select("id", "digest", "spans").dropDuplicates(["digest"]))
    passes = passes_filter(parts.select(F.xxhash64("digest").alias("hash")), F.xxhash64("digest"))
    def cut(texts: pa.Array, columns: pa.Array) -> pa.Array:
        out = []
        for text, spans in zip(texts, columns.to_pylist()):
            raw, at, left = text.as_py().encode(), 0, []
            for s in spans:
                left.append(raw[at:s["start"]])
                at = s["stop"]
            out.append(b"".join([*left, raw[at:]]))
        return pa.array(out, pa.binary())

    rows = docs.select(text_of(f"`{text_col}`").alias("text"))
    rows = rows.select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text").where(passes)
    return rows.join(parts.select("digest", "spans"), "digest").select(
        "digest", F.arrow_udf(cut, "binary")("text", "spans").alias("kept")).dropDuplicates(["digest"])
