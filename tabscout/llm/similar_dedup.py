"""Near copies by exact similarity: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates are first the documents whose SimHash fingerprints differ in PRINT_BITS bits or fewer, found by the
pigeonring of simhash_dedup, of large groups as many pairs as connect them; they are compared by all their shingles, and the similar ones are linked.
Similar documents of the tables at hand differ in up to 10 of 64 bits, too many for keys of few bits. Those
that no links connect yet meet by a prefix filter, which misses none. All shingles have one order;
of n shingles the first n - ceil(0.8 n) + 1 are a document's prefix, and two documents
that are similar share a shingle of both prefixes. Shingles common in a sample are last
in the order: that moves work, not results. These candidates are compared in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscout.llm import simhash_dedup
from tabscout.llm.common import FILTER_BITS, chunks, filter_bits, landed, released, text_of, without
from tabscout.llm.simhash_dedup import components, majority_bits
from tabscout.llm.textbytes import U, byte_table, has_bit, mixed, nonspace_bytes, prefix_hash, shingle_hash, span_hash, utf8, word_spans

SHINGLE_WORDS = 5
#: Least similarity as a fraction.
LIKE, OF = 4, 5
#: Fingerprints that differ in so many bits are compared by shingles; their buckets are refined above so many rows.
PRINT_BITS = 4
PRINT_BUCKET = 1024
#: Segments that a fingerprint's key is made of: 25 to 27 bits. Buckets of more rows give the pairs that connect them.
PRINT_CHAIN = 3
PRINT_ALL = 16
#: One of so many documents is looked at for common shingles; so many finds make one common.
SAMPLE, COMMON = 16, 6
#: In buckets of more documents those already linked are not compared.
BUCKET_ROWS = 64
#: Of so many documents before it in a large bucket each one is first compared with a few.
NEIGHBOURS = 5
#: 64-bit words of a node's sketch: for each bit whether an odd number of its shingles point to it.
SKETCH_WORDS = 8


def shingles_of(column: pa.Array, width: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all distinct shingles, in order; a text of fewer words than a shingle is one shingle."""
    raw, at = utf8(column)
    starts, ends, first = word_spans(raw, at, nonspace_bytes())
    words = np.diff(first)
    hashes = span_hash(prefix_hash(byte_table(np.ones(256, bool))[raw]), starts, ends)
    count = np.where(words > 0, np.maximum(words - width + 1, 1), 0)
    doc = np.repeat(np.arange(len(column)), count)
    begin = np.repeat(first[:-1], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found = shingle_hash(hashes, width)[begin]
    for k in range(1, width):
        short = words[doc] == k
        if short.any():
            found[short] = shingle_hash(hashes, k)[begin[short]]
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (found[1:] != found[:-1])
    return doc[new], found[new]


def nodes_of(doc: np.ndarray, found: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text a hash of its set of shingles, and their number; (0, 0) without words."""
    size = np.bincount(doc, minlength=texts)
    node = np.zeros(texts, U)
    some = np.flatnonzero(size)
    if len(some):
        node[some] = mixed(np.add.reduceat(mixed(found ^ U(0x5851F42D4C957F2D)), np.searchsorted(doc, some)) + size[some].astype(U))
    return node, size


def sketches_of(doc: np.ndarray, found: np.ndarray, texts: int) -> pa.Array:
    """Of each text the parities of the numbers of its shingles that point to each bit.

    Two sets differ in at least as many shingles as their sketches differ in bits."""
    bits = 64 * SKETCH_WORDS
    odd = np.bincount(doc * bits + (mixed(found) % U(bits)).astype(np.int64), minlength=texts * bits).astype(np.uint8) & 1
    words = np.packbits(odd.reshape(-1, 8), axis=1).ravel().view(np.int64)
    return pa.ListArray.from_arrays(np.arange(0, len(words) + 1, SKETCH_WORDS, dtype=np.int32), pa.array(words))


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(values.view(np.int64)))


def keyed_rows(docs: DataFrame, id_col: str, text_col: str, bits: np.ndarray | None) -> DataFrame:
    """(id, text_hash, node, n, fp, sketch, keys) of every row: its SimHash, and the prefix, shingles whose bit is set being last in the order."""
    ids = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(f"`{text_col}`")).alias("text_hash"),
                      text_of(f"`{text_col}`").alias("_text"))
    common = docs.sparkSession.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text"):
            doc, found = shingles_of(b.column("_text"))
            node, size = nodes_of(doc, found, b.num_rows)
            keys, kept = found, size
            if common is not None:
                keys = found[np.lexsort((found, has_bit(common.value, found), doc))]
                kept = np.where(size > 0, size - -(-LIKE * size // OF) + 1, 0)
                keys = keys[np.arange(len(doc)) - (np.cumsum(size) - size)[doc] < kept[doc]]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("text_hash"), pa.array(node.view(np.int64)), pa.array(size.astype(np.int32)),
                 pa.array(majority_bits(mixed(found), size).view(np.int64)), sketches_of(doc, found, b.num_rows), lists(keys, kept)], ["id", "text_hash", "node", "n", "fp", "sketch", "keys"])

    kind = ids.schema["id"].dataType.simpleString()
    return ids.mapInArrow(run, f"id {kind}, text_hash long, node long, n int, fp long, sketch array<long>, keys array<long>")


def common_bits(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """A filter of fixed size of the shingles that are common in a sample."""
    some = docs.where(F.pmod(F.xxhash64(text_of(f"`{id_col}`"), text_of(f"`{text_col}`")), F.lit(SAMPLE)) == 0)
    seen = landed(keyed_rows(some, id_col, text_col, None).select(F.explode("keys").alias("hash")).groupBy("hash").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON))
    least = COMMON
    while seen.where(F.col("n") >= least).count() > FILTER_BITS // 8:
        least *= 2
    return filter_bits(seen.where(F.col("n") >= least))


def sets_of(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(node, keys): all shingles of the nodes in wanted."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(wanted.select(F.col("node").alias("hash"))))
    texts = docs.select(text_of(f"`{text_col}`").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_text"):
            doc, found = shingles_of(b.column("_text"))
            node, size = nodes_of(doc, found, b.num_rows)
            kept = has_bit(bits.value, node)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[kept].view(np.int64)), lists(found[kept[doc]], size[kept])], ["node", "keys"])

    return texts.mapInArrow(run, "node long, keys array<long>").join(wanted, "node", "left_semi").dropDuplicates(["node"])


def may_be_like(n: Column, at: Column, m: Column, place: Column) -> Column:
    """Whether sets of n and m can be similar if their first shared shingle is at these places: at most what follows is shared."""
    return F.least(n - at, m - place) * (LIKE + OF) >= (n + m) * LIKE


def alike(pairs: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """Of pairs (u, v) those whose sets are similar."""
    sets = landed(sets_of(docs, text_col, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()))
    left, right = sets.select(F.col("node").alias("u"), F.col("keys").alias("a")), sets.select(F.col("node").alias("v"), F.col("keys").alias("b"))
    both = pairs.join(left, "u").join(right, "v")
    shared = F.size(F.array_intersect("a", "b"))
    return landed(both.where(shared * (LIKE + OF) >= (F.size("a") + F.size("b")) * LIKE).select("u", "v"))


def near_prints(rows: DataFrame, max_bits: int = PRINT_BITS, bucket_rows: int = PRINT_BUCKET) -> DataFrame:
    """Pairs (u > v) of nodes whose fingerprints differ in at most max_bits bits; of equal fingerprints the least node stands for all.

    Of buckets with over PRINT_ALL fingerprints only so many as connect what all of them connect."""
    prints = rows.where("n > 0").select("fp", "node").distinct()
    least = landed(prints.groupBy("fp").agg(F.min("node").alias("least")))
    same = prints.join(least, "fp").where("node != least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    pairs = simhash_dedup.links(least.select("fp"), max_bits, bucket_rows, PRINT_CHAIN, PRINT_ALL)
    for side in ("u", "v"):
        pairs = pairs.withColumnRenamed(side, "fp").join(least.withColumnRenamed("least", side), "fp").drop("fp")
    return same.unionAll(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))


def links(rows: DataFrame, docs: DataFrame, text_col: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs (u > v) of similar nodes, enough to connect what is connected.

    First those near by fingerprint; then, of nodes that these leave apart, all that share a shingle
    of both prefixes. Members of a large bucket are first compared with a few of their neighbours in an order of its own;
    then all pairs that these links left apart are compared."""
    near = landed(near_prints(rows))
    linked = alike(near, docs, text_col)
    known = released(lambda: components(linked))
    nodes = rows.join(known, "node", "left").select(
        "node", "n", F.coalesce("root", "node").alias("root"), F.posexplode("keys").alias("at", "key"))
    apart = Window.partitionBy("key").orderBy(F.xxhash64("key", "node"), "node")
    other = F.lag("node").over(apart)
    seen = landed(nodes.withColumns({"other": other, "rows": F.count(F.lit(1)).over(Window.partitionBy("key"))}).where(
        "rows > 1 and (other is null or other != node)"))  # equal sets are one node

    few, many = seen.where(F.col("rows") <= bucket_rows), seen.where(F.col("rows") > bucket_rows)
    large = landed(many.groupBy("node").agg(F.count(F.lit(1)).alias("large")))

    def pairs(bucket: DataFrame) -> DataFrame:
        mate = bucket.select("key", *[F.col(c).alias(f"_{c}") for c in bucket.columns if c != "key"])
        return bucket.join(mate, "key").where((F.col("node") > F.col("_node")) & (F.col("n") * LIKE <= F.col("_n") * OF) & (F.col("_n") * LIKE <= F.col("n") * OF))

    # Shingles up to the earlier end of both prefixes are all counted; of the rest at most those behind a prefix are shared.
    counted = pairs(few.select("key", "node", "n", "at", "root")).where("root != _root").groupBy(F.col("node").alias("u"), F.col("_node").alias("v"), "n", "_n").agg(
        F.count(F.lit(1)).alias("shared"), F.max(F.least(F.col("n") - F.col("at"), F.col("_n") - F.col("_at"))).alias("most"))
    for side in ("u", "v"):
        counted = counted.join(large.select(F.col("node").alias(side), F.col("large").alias(f"large_{side}")), side, "left")
    either = F.least(F.coalesce("large_u", F.lit(0)), F.coalesce("large_v", F.lit(0)))
    behind = F.ceil(F.greatest("n", "_n") * LIKE / OF) - 1
    least = (F.col("n") + F.col("_n")) * LIKE
    small = counted.where(((F.col("shared") + either + behind) * (LIKE + OF) >= least) & ((F.col("most") + either) * (LIKE + OF) >= least))
    if many.isEmpty():
        return linked.unionAll(alike(landed(small.select("u", "v").join(near, ["u", "v"], "left_anti")), docs, text_col))
    drawn = landed(with_sketches(many.select("key", "node", "n", "at"), rows))
    first = landed(small.select("u", "v").unionAll(some_neighbours(drawn)).distinct().join(near, ["u", "v"], "left_anti"))
    found = linked.unionAll(alike(first, docs, text_col))
    roots = released(lambda: components(found))
    named = landed(drawn.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    rest = landed(unlinked_pairs(named).join(first.unionAll(near), ["u", "v"], "left_anti"))
    return found if rest.isEmpty() else found.unionAll(alike(rest, docs, text_col))


def with_sketches(members: DataFrame, rows: DataFrame) -> DataFrame:
    """members (with a column node) and w0, w1, ..., the sketch of each node."""
    sketches = rows.groupBy("node").agg(F.first("sketch").alias("sketch"))
    words = [F.get("sketch", F.lit(k)).alias(f"w{k}") for k in range(SKETCH_WORDS)]
    return members.join(sketches, "node").select(*members.columns, *words)


def bits_apart(one, other) -> Column:
    """In how many bits two sketches differ; one and other give a word of each."""
    return sum((F.bit_count(one(f"w{k}").bitwiseXOR(other(f"w{k}"))) for k in range(SKETCH_WORDS)), F.lit(0))


def some_neighbours(drawn: DataFrame) -> DataFrame:
    """Pairs (u, v): each node of a large bucket with up to three others that may be similar.

    They are the nearest by sketch, and two at random, of its NEIGHBOURS before it in each of its buckets. The near one is
    most likely similar, those at random tie groups together."""
    before = Window.partitionBy("key").orderBy(F.xxhash64("key", "node"), "node").rowsBetween(-NEIGHBOURS, -1)
    fields = [c for c in drawn.columns if c != "key"]
    met = drawn.withColumn("mates", F.collect_list(F.struct(*fields)).over(before)).select(*fields, F.explode("mates").alias("mate"))
    apart = bits_apart(F.col, lambda w: F.col(f"mate.{w}"))
    may = met.where((apart * (LIKE + OF) <= F.col("n") + F.col("mate.n")) & may_be_like(
        F.col("n"), F.col("at"), F.col("mate.n"), F.col("mate.at"))).select("node", F.col("mate.node").alias("mate"), apart.alias("apart"))
    chance = F.struct(F.xxhash64("node", "mate").alias("h"), "mate")
    best = may.groupBy("node").agg(F.min(F.struct("apart", "mate")).alias("a"), F.min(chance).alias("b"), F.max(chance).alias("c"))
    pair = best.select("node", F.explode(F.array("a.mate", "b.mate", "c.mate")).alias("mate"))
    return pair.select(F.greatest("node", "mate").alias("u"), F.least("node", "mate").alias("v")).distinct()


def unlinked_pairs(named: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes in one bucket, of different roots, that may be similar by size, place and sketch.

    named: key, node, n, at, root and the sketches. The nodes of a bucket that agree in size and place are a class. First it is
    found which classes may hold similar nodes, so that a line which many unlike texts share costs
    pairs of classes, not of texts. Then the sketches of two nodes may differ in no more
    bits than similar sets of their sizes do in shingles."""
    kinds = ["key", "n", "at"]
    classes = landed(named.groupBy(*kinds).agg(F.min("root").alias("low"), F.max("root").alias("high")))
    mate = classes.select("key", *[F.col(c).alias(f"_{c}") for c in classes.columns if c != "key"])
    near_size = (F.col("n") * LIKE <= F.col("_n") * OF) & (F.col("_n") * LIKE <= F.col("n") * OF)
    one_root = (F.col("low") == F.col("high")) & (F.col("_low") == F.col("_high")) & (F.col("low") == F.col("_low"))
    allowed = landed(classes.join(mate, "key").where(
        near_size & ~one_root & may_be_like(F.col("n"), F.col("at"), F.col("_n"), F.col("_at"))).select(*kinds, "_n", "_at"))
    other = named.select("key", *[F.col(c).alias(f"_{c}") for c in named.columns if c != "key"])
    differ = bits_apart(F.col, lambda w: F.col(f"_{w}"))
    found = named.join(allowed, kinds).join(other, ["key", "_n", "_at"]).where(
        (F.col("node") > F.col("_node")) & (F.col("root") != F.col("_root")) & (differ * (LIKE + OF) <= F.col("n") + F.col("_n")))
    return found.select(F.col("node").alias("u"), F.col("_node").alias("v")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per row of docs: id, text_hash, component_id, first.

    component_id is the smallest id that links reach, null only if all its ids are null; `first` marks the rows
    that have it (and, of rows with that id, one text). Texts of equal sets of shingles are linked, and so are
    texts without words, null ones too. Repeated rows fall in one group; texts of any length are taken whole; an empty table gives no rows."""
    rows = landed(keyed_rows(docs, id_col, text_col, common_bits(docs, id_col, text_col)))
    roots = released(lambda: components(links(rows, docs, text_col, bucket_rows)))
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_hash"))
    nodes = rows.groupBy("node").agg(smallest.alias("least")).join(roots, "node", "left").select(
        "node", "least", F.coalesce("root", "node").alias("root"))
    nodes = landed(nodes)
    names = nodes.groupBy("root").agg(F.min("least").alias("name"))
    classes = nodes.join(names, "root").select("node", "name")
    is_first = F.col("id").eqNullSafe(F.col("name.id")) & (F.col("text_hash") == F.col("name.text_hash"))
    return rows.select("id", "text_hash", "node").join(classes, "node").select(
        "id", "text_hash", F.col("name.id").alias("component_id"), is_first.alias("first"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of similar texts, the one with the smallest id; all columns kept."""
    found = landed(similar_groups(docs, id_col, text_col).select("id", "text_hash", "first"))
    per_key = found.groupBy("id", "text_hash").agg(F.max("first").alias("some"), F.count(F.lit(1)).alias("n"))
    return without(docs, per_key.where("not some"), per_key.where("some and n > 1"),
                   {"id": F.col(f"`{id_col}`"), "text_hash": F.xxhash64(text_of(f"`{text_col}`"))})
