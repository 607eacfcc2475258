"""Shards by fixed virtual slots.

Every record hashes to one of thousands of slots, for good. Which shard a slot lies in is
kept in a small table, the slot map, that has a version. Bytes are summed per
slot in one pass; a map is rebalanced by moving a few slots, and each edit is a new
version. So records are looked up by hash and map, whatever has been moved since.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabscout.llm.common import free_name, landed, text_of

#: Slots of a map; its tables have so many rows at most, whatever is sharded.
SLOTS = 4096
#: Bytes that each record has besides its text.
RECORD_BYTES = 8
#: Rebalancing ends when no shard is further from the mean than this part of it.
SLACK = 0.001
#: Copies of one record that are spread out again at a time.
COPIES = 10_000


@dataclass(frozen=True)
class SlotMap:
    """The shard of each slot; version counts the edits."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    @property
    def slots(self) -> int:
        return len(self.shard_of)


@dataclass(frozen=True)
class SlotSizes:
    """Bytes and rows of each slot."""

    bytes: np.ndarray
    rows: np.ndarray


def record_hash(id_col: str, text_col: str) -> Column:
    """A hash of id and text, so that rows that share an id alone are spread."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("string"), text_of(f"`{text_col}`"))


def slot_of(hash_col: Column, slots: int) -> Column:
    return F.pmod(hash_col, F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, hash, virtual_slot, size, text_crc32) of every row; a null text is empty.

    size: UTF-8 bytes of the text and RECORD_BYTES more."""
    text = text_of(f"`{text_col}`")
    hashed = record_hash(id_col, text_col)
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), hashed.alias("hash"), slot_of(hashed, slots).alias("virtual_slot"),
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> SlotSizes:
    """Bytes and rows of the slots of records(); summed where they are read, `slots` rows come to the driver."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    out = SlotSizes(np.zeros(slots, np.int64), np.zeros(slots, np.int64))
    for r in found:
        out.bytes[r["virtual_slot"]], out.rows[r["virtual_slot"]] = r["bytes"], r["n"]
    return out


def first_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 1: slots dealt out in turn, before anything is known of the records."""
    if not 0 < shards <= slots:
        raise ValueError("a map needs from one shard up to as many as slots")
    return SlotMap(1, shards, tuple(s % shards for s in range(slots)))


def loads(slot_map: SlotMap, sizes: SlotSizes) -> np.ndarray:
    """Bytes of each shard."""
    return np.bincount(slot_map.shard_of, weights=sizes.bytes, minlength=slot_map.shards).astype(np.int64)


def _move(sizes: np.ndarray, shard_of: np.ndarray, full: int, empty: int, gap: int) -> tuple[int, int] | None:
    """A slot of the fuller shard to move, or two to change over (else -1), that bring both nearest to even."""
    own = np.flatnonzero((shard_of == full) & (sizes > 0))
    best = None
    if len(own):
        moved = sizes[own]
        k = int(np.argmin(np.abs(2 * moved - gap)))
        if moved[k] < gap:
            best = (abs(2 * int(moved[k]) - gap), int(own[k]), -1)
    theirs = np.flatnonzero((shard_of == empty) & (sizes > 0))
    if best is None and len(own) and len(theirs):
        theirs = theirs[np.argsort(sizes[theirs], kind="stable")]
        near = np.searchsorted(sizes[theirs], sizes[own] - gap / 2)
        for step in (-1, 0):
            mate = theirs[np.clip(near + step, 0, len(theirs) - 1)]
            moved = sizes[own] - sizes[mate]
            off = np.where((moved > 0) & (moved < gap), np.abs(2 * moved - gap), np.iinfo(np.int64).max)
            k = int(np.argmin(off))
            if off[k] < (best[0] if best else np.iinfo(np.int64).max):
                best = (int(off[k]), int(own[k]), int(mate[k]))
    return best[1:] if best else None


def rebalanced(slot_map: SlotMap, sizes: SlotSizes, slack: float = SLACK) -> SlotMap:
    """The next version: slots moved, or changed over, from fuller to emptier shards.

    Ends when all shards are within slack of the mean, or when no slot moved or
    changed over between two shards would bring these nearer. A map that is even
    enough stays as it is."""
    shard_of = np.array(slot_map.shard_of)
    load = loads(slot_map, sizes)
    mean = load.sum() / slot_map.shards
    changed = False
    while np.abs(load - mean).max() > slack * mean:
        found = None
        for full in np.argsort(-load, kind="stable"):
            for empty in np.argsort(load, kind="stable"):
                gap = int(load[full] - load[empty])
                if gap <= slack * mean:
                    break
                if found := _move(sizes.bytes, shard_of, full, empty, gap):
                    break
            if found:
                break
        if not found:
            break
        slot, back = found
        moved = int(sizes.bytes[slot]) - (int(sizes.bytes[back]) if back >= 0 else 0)
        shard_of[slot] = empty
        if back >= 0:
            shard_of[back] = full
        load[full] -= moved
        load[empty] += moved
        changed = True
    if not changed:
        return slot_map
    return replace(slot_map, version=slot_map.version + 1, shard_of=tuple(shard_of.tolist()))


def grown(slot_map: SlotMap, sizes: SlotSizes | None = None) -> SlotMap:
    """The next version with one shard more: slots move into it from the fullest, and nowhere else.

    It takes slots until it has its share of the bytes (of the slots, if no sizes are given)."""
    if slot_map.shards >= slot_map.slots:
        raise ValueError("there are no more shards than slots")
    shard_of = np.array(slot_map.shard_of)
    weight = sizes.bytes if sizes is not None else np.ones(slot_map.slots, np.int64)
    load = np.bincount(shard_of, weights=weight, minlength=slot_map.shards + 1).astype(np.int64)
    new, share = slot_map.shards, int(weight.sum()) // (slot_map.shards + 1)
    while load[new] < share:
        fits = None
        for full in np.argsort(-load[:new], kind="stable"):
            own = np.flatnonzero((shard_of == full) & (weight > 0) & (weight <= share - load[new]))
            if len(own):
                fits = own[np.argmax(weight[own])] if sizes is None else own[np.argmin(np.abs(weight[own] - (load[full] - share)))]
                break
        if fits is None:
            break
        load[new] += weight[fits]
        load[full] -= weight[fits]
        shard_of[fits] = new
    return SlotMap(slot_map.version + 1, slot_map.shards + 1, tuple(shard_of.tolist()))


def map_table(spark: SparkSession, slot_map: SlotMap) -> DataFrame:
    """(version, shards, virtual_slot, shard): one row per slot."""
    rows = [(slot_map.version, slot_map.shards, s, shard) for s, shard in enumerate(slot_map.shard_of)]
    return spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")


def save_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Add a version to the maps at path; a version that is there already is an error, not replaced."""
    map_table(spark, slot_map).drop("version").coalesce(1).write.parquet(f"{path}/version={slot_map.version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A version of the maps at path, the last one if none is named."""
    kind = "shards int, virtual_slot int, shard int, version int"
    stored = spark.read.schema(kind).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    rows = stored.where(F.col("version") == version).orderBy("virtual_slot").collect()
    if not rows:
        raise ValueError(f"there is no version {version} at {path}")
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def sharded(docs: DataFrame, slot_map: SlotMap, id_col: str = "doc_id", text_col: str = "text", shard_col: str = "shard") -> DataFrame:
    """docs with the shard of every row; all rows and columns kept, none shuffled.

    A column that is named like shard_col is replaced. Null ids and texts have slots
    like any other; repeated rows (same id and text) are one record and share a shard.
    An empty table gives no rows."""
    hashed = slot_of(record_hash(id_col, text_col), slot_map.slots)
    slot, found = free_name(docs, "slot"), free_name(docs, "found")
    lookup = map_table(docs.sparkSession, slot_map).select(F.col("virtual_slot").alias(slot), F.col("shard").alias(found))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != shard_col.lower()]
    return docs.withColumn(slot, hashed).join(F.broadcast(lookup), slot).select(*kept, F.col(found).alias(shard_col))


def write_shards(docs: DataFrame, slot_map: SlotMap, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs as Parquet, a folder for each shard; each task writes a part of one or two shards."""
    salted = record_hash(id_col, text_col)
    out = sharded(docs, slot_map, id_col, text_col, "shard")
    out.repartitionByRange(F.col("shard"), salted).write.partitionBy("shard").parquet(path)


def placed(rows: DataFrame, slot_map: SlotMap, sizes: SlotSizes) -> DataFrame:
    """records() with shard and place: the number of the record in its shard, from 0 without gaps.

    Records of a shard are numbered by slot, hash and id. A slot's first number comes from
    the sizes, so that only the rows of one slot are put in order together; copies of
    a record are one row until they have their numbers."""
    order = sorted(range(slot_map.slots), key=lambda s: (slot_map.shard_of[s], s))
    first, at, shard = {}, 0, -1
    for s in order:
        at = at if slot_map.shard_of[s] == shard else 0
        shard, first[s] = slot_map.shard_of[s], at
        at += int(sizes.rows[s])
    lookup = rows.sparkSession.createDataFrame(
        [(s, slot_map.shard_of[s], first[s]) for s in order], "virtual_slot int, shard int, first long")
    alone = rows.groupBy("virtual_slot", "hash", "id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("virtual_slot").orderBy("hash", "id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    ranked = alone.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(F.broadcast(lookup), "virtual_slot")
    blocks = ranked.withColumn("block", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)")))
    copies = blocks.withColumn("copy", F.explode(F.expr(f"sequence(block, least(block + {COPIES}L, n) - 1)")))
    return copies.select("id", "hash", "virtual_slot", "size", "text_crc32", "shard",
                         (F.col("first") + F.col("before") + F.col("copy")).alias("place"))


def shard_places(docs: DataFrame, shards: int, path: str, id_col: str = "doc_id", text_col: str = "text",
                 slots: int = SLOTS, slack: float = SLACK) -> DataFrame:
    """One row per row of docs: id, hash, virtual_slot, size, text_crc32, shard, place, version.

    Shards hold near equal bytes: the first map is rebalanced by the bytes of the slots, and
    both versions are saved at path (see save_map). An identical row shares its copy's shard, so only many copies
    of one row, or one text as long as a shard, can keep shards from being even. Nulls
    count as empty; an empty table gives no rows."""
    spark = docs.sparkSession
    rows = landed(records(docs, id_col, text_col, slots))
    sizes = slot_sizes(rows, slots)
    start = first_map(shards, slots)
    save_map(spark, start, path)
    even = rebalanced(start, sizes, slack)
    if even is not start:
        save_map(spark, even, path)
    used = load_map(spark, path)
    return placed(rows, used, sizes).withColumn("version", F.lit(used.version))
