"""SimHash near-dedup: fingerprints of word shingles, linked when few bits differ.

Links are found by the pigeonring principle. For a budget of k bits the 64 bits are a ring of
k + 1 segments, three for 2 bits. If two fingerprints differ in at most k bits, some segment starts a
chain whose cumulative differences stay within the proportional budgets k/(k+1), 2k/(k+1)
and so on, that is 0 bits after one segment and 1 after two. Of the second segment, which may
differ in 1 bit, one half is equal; so the join key is the first segment and one half
of the second. Longer chains make longer keys, which fewer unlike fingerprints share: of what
is free in l segments, which may differ in l - 1 bits, one l-th is equal. A bucket with too many fingerprints is refined: its free bits form a
ring of as many segments again, of which one must be equal. A pair is taken where its first key is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.llm.common import chunks, landed, released, text_of, without
from tabscout.llm.textbytes import byte_table, nonspace_bytes, utf8, word_spans

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
#: Segments in the chain that a join key is made of.
CHAIN = 2
#: With more bits half a segment is empty.
WIDEST = 31
#: Buckets of more fingerprints are refined instead of compared.
BUCKET_ROWS = 64
#: Keys are counted by so many to a task.
KEYS_TO_A_TASK = 1 << 18
#: How often a bucket is refined; after that its key holds all but a few bits.
REFINEMENTS = 4
ALL_BITS = (1 << 64) - 1
LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of each text from the hashes of its shingles, which follow each other; shingles: how many each text has."""
    out = np.zeros(len(shingles), np.uint64)
    if not len(hashes):
        return out
    # Count bits in eight byte lanes at a time, at most 255 hashes to a block.
    blocks = -(-shingles // 255)
    n_blocks = int(blocks.sum())
    doc = np.repeat(np.arange(len(shingles)), blocks)
    inner = np.arange(n_blocks) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    cut = (np.cumsum(shingles) - shingles)[doc] + 255 * inner
    counts = np.zeros((n_blocks, 64), np.int64)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, cut)
        counts[:, k::8] = lanes.view(np.uint8).reshape(-1, 8)
    some = np.flatnonzero(shingles)
    totals = np.add.reduceat(counts, np.searchsorted(doc, some), axis=0)
    bits = totals * 2 > shingles[some][:, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints_of(column: pa.Array, width: int = SHINGLE_WORDS) -> np.ndarray:
    """The fingerprint of each text: a bit is set if over half the shingle hashes have it."""
    raw, at = utf8(column)
    space = nonspace_bytes()
    starts, ends, first = word_spans(raw, at, space)
    if not len(starts):
        return np.zeros(len(column), np.uint64)
    low = byte_table(np.ones(256, bool))[raw]
    # The words with one space after each: a shingle is then one slice.
    sizes = ends - starts + 1
    place = np.concatenate([[0], np.cumsum(sizes)])
    line = np.full(place[-1], 32, np.uint8)
    line[np.arange(place[-1]) - np.repeat(place[:-1], sizes) < np.repeat(sizes - 1, sizes)] = low[space[raw]]
    words = np.diff(first)
    shingles = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    begin = np.repeat(first[:-1], shingles) + np.arange(shingles.sum()) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    last = np.minimum(begin + width, np.repeat(first[1:], shingles))
    view, digest = line.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(place[begin].tolist(), (place[last] - 1).tolist())),
                         np.uint64, len(begin))
    return majority_bits(hashes, shingles)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = SHINGLE_WORDS) -> DataFrame:
    """(id, text_hash, fp as a signed long) of every row; texts without words, and null, have 0."""
    ids = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(f"`{text_col}`")).alias("text_hash"),
                      text_of(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text"):
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_hash"), pa.array(fingerprints_of(b.column("_text"), width).view(np.int64))],
                ["id", "text_hash", "fp"])

    kind = ids.schema["id"].dataType.simpleString()
    return ids.mapInArrow(run, f"id {kind}, text_hash long, fp long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def split_bits(bits: list[int], parts: int) -> list[int]:
    """Masks of `parts` segments of the given bits, as even as may be."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(np.array(bits, dtype=object), parts)]


def first_masks(max_bits: int = MAX_BITS, chain: int = CHAIN) -> list[int]:
    """The bits that a join key holds: one segment, half of the next, a third of what is then free in three, and so on."""
    n = max_bits + 1
    segments = [[b for b in range(64) if part >> b & 1] for part in split_bits(list(range(64)), n)]
    out = []
    for i in range(n):
        masks = [sum(1 << b for b in segments[i])]
        for size in range(2, min(chain, n) + 1):
            bits = [b for k in range(size) for b in segments[(i + k) % n]]
            masks = [m | share for m in masks for share in split_bits([b for b in bits if not m >> b & 1], size)]
        out += masks
    return out


def finer_masks(mask: int, max_bits: int = MAX_BITS) -> list[int]:
    """The masks that refine a bucket: its bits and one of max_bits + 1 shares of the others."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | m for m in split_bits(free, max_bits + 1)]


def spanning_pairs(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (u > v) within max_bits that connect what all such pairs connect: one fewer than there are members."""
    left = np.unique(fps)
    us, vs = [left[:0]], [left[:0]]
    while len(left):
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            one = reached.pop()
            near = np.bitwise_count((left ^ one).view(np.uint64)) <= max_bits
            found, left = left[near], left[~near]
            us.append(np.maximum(found, one))
            vs.append(np.minimum(found, one))
            reached.extend(found)
    return np.concatenate(us), np.concatenate(vs)


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS, chain: int = CHAIN,
          all_rows: int | None = None) -> DataFrame:
    """Pairs (u > v) of distinct fingerprints that differ in 1 to max_bits bits; fps: column fp, each once.

    Every pair is found whatever the sizes of the buckets: one with more than bucket_rows
    is not compared but dealt out again by more bits, and each refinement
    keeps every pair within the budget together in one bucket at least. Of the buckets that hold a pair
    the one of the first mask counts, and of that its first finer mask, so each pair comes once.

    With all_rows, a bucket of more fingerprints gives a spanning forest of its pairs instead of all: what the pairs
    connect stays connected, and a group of near copies makes pairs in proportion to its size, not to its square."""
    if not 1 <= max_bits <= WIDEST:
        raise ValueError(f"segments can be laid out for 1 to {WIDEST} bits")
    spark = fps.sparkSession
    masks = first_masks(max_bits, chain)
    earlier = [masks[:i] for i in range(len(masks))]
    # A small table comes in few partitions, but each row makes many keys.
    spread = fps.repartition(fps.count() * len(masks) // KEYS_TO_A_TASK + 1, "fp")
    rows = spread.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("path", "key"))
    found = []

    def forest(bucket: pa.Table) -> pa.Table:
        u, v = spanning_pairs(bucket["fp"].to_numpy(), max_bits)
        return pa.table({"u": u, "v": v})

    for level in range(REFINEMENTS + 1):
        sizes = landed(rows.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        shared = landed(rows.join(sizes, ["path", "key"]).select("path", "key", "fp", "n"))
        last = level == REFINEMENTS
        few = shared if last else shared.where(F.col("n") <= bucket_rows)
        if all_rows is not None:
            found.append(few.where(F.col("n") > all_rows).groupBy("path", "key").applyInArrow(forest, "u long, v long"))
            few = few.where(F.col("n") <= all_rows)
        before = spark.createDataFrame([(i, [signed(m) for m in e]) for i, e in enumerate(earlier)], "_path int, earlier array<long>")
        few = few.select("path", "key", "fp")
        other = few.withColumnRenamed("fp", "v")
        one = few.withColumnRenamed("fp", "u").join(F.broadcast(before), F.col("path") == F.col("_path"))
        differ = F.col("u").bitwiseXOR(F.col("v"))
        pair = one.join(
            other, (one["path"] == other["path"]) & (one["key"] == other["key"]) & (F.col("u") > F.col("v"))
            & (F.bit_count(differ) <= max_bits) & F.forall("earlier", lambda m: differ.bitwiseAND(m) != 0)).select("u", "v")
        found.append(pair)
        if last or sizes.where(F.col("n") > bucket_rows).isEmpty():
            break
        finer = [(i, m, [*e, *ms[:k]]) for i, (mask, e) in enumerate(zip(masks, earlier))
                 for ms in [finer_masks(mask, max_bits)] for k, m in enumerate(ms)]
        table = spark.createDataFrame([(i, k, signed(m)) for k, (i, m, _) in enumerate(finer)], "path int, finer int, mask long")
        rows = shared.where(F.col("n") > bucket_rows).join(F.broadcast(table), "path").select(
            "fp", F.col("finer").alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        masks, earlier = [m for _, m, _ in finer], [e for _, _, e in finer]
    out = found[0]
    for f in found[1:]:
        out = out.unionAll(f)
    return out if all_rows is None else out.distinct()


def stars(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    large = landed(large.distinct())
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
        low.select("u", F.col("m").alias("v"))).where("u > v")
    return small.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of pairs (u, v) reaches.

    Alternates large-star and small-star steps until nothing changes. Each step is
    two grouped minima and joins on the links; none is collected."""
    edges = landed(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        edges = released(lambda edges=edges: stars(edges))
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS,
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of docs: id, text_hash, fp, component_id, n_links, first.

    component_id is the smallest id that links reach, null only if all its ids are null.
    n_links counts the other fingerprints within 2 bits. Null texts and texts without
    words have fingerprint 0, linked like any other; texts shorter than a shingle are one
    shingle. `first` marks the rows with the component's smallest id (and, of rows with that
    id, one text). Repeated rows fall in one component. Equal fingerprints are one node,
    so copies cost one row. An empty table gives no rows."""
    rows = landed(fingerprints(docs, id_col, text_col, width))
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    nodes = landed(rows.groupBy("fp").agg(smallest.alias("least")))
    pairs = landed(links(nodes.select("fp"), bucket_rows=bucket_rows))
    roots = released(lambda: components(pairs))
    degree = pairs.select(F.explode(F.array("u", "v")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("name"))
    classes = rooted.join(names, "root").join(degree, "fp", "left").select(
        "fp", "name", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    is_first = F.col("id").eqNullSafe(F.col("name.id")) & (F.col("text_hash") == F.col("name.text_hash"))
    return rows.join(classes, "fp").select(
        "id", "text_hash", "fp", F.col("name.id").alias("component_id"), "n_links", is_first.alias("first"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     width: int = SHINGLE_WORDS) -> DataFrame:
    """docs with one row of each group of linked fingerprints, the one with the smallest id; all columns kept."""
    found = landed(near_groups(docs, id_col, text_col, width).select("id", "text_hash", "first"))
    per_key = found.groupBy("id", "text_hash").agg(F.max("first").alias("some"), F.count(F.lit(1)).alias("n"))
    return without(docs, per_key.where("not some"), per_key.where("some and n > 1"),
                   {"id": F.col(f"`{id_col}`"), "text_hash": F.xxhash64(text_of(f"`{text_col}`"))})
