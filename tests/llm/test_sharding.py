"""Shards: sizes, places, the map and its versions."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.llm import queries, sharding as sh

SF = "/root/testdata/sf0.01"


def sizes_of(weights):
    return sh.SlotSizes(np.array(weights, np.int64), np.ones(len(weights), np.int64))


def test_query_over_all_documents(spark):
    rows = queries.op11_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, SF, "documents").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    load, places = Counter(), defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24
        load[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    mean = sum(load.values()) / 24
    assert len(load) == 24 and max(abs(v - mean) for v in load.values()) <= 0.02 * mean
    assert len({(r.virtual_slot, r.shard) for r in rows}) == len({r.virtual_slot for r in rows})


ROWS = [(None, None), (None, "a"), (1, ""), (1, "b"), (1, "b"), (1, "b"), (2, "é" * 3000), (3, "x" * 100_000), (4, "x" * 100_000)]


def test_odd_tables(spark, tmp_path):
    rows = [(*r, "s", 7, "h") for r in ROWS * 3 + [(9, f"t{i}") for i in range(50)]]
    docs = spark.createDataFrame(rows, "doc_id int, text string, shard string, _slot int, hash string").repartition(3)
    found = sh.shard_places(docs, 5, str(tmp_path / "maps")).collect()
    assert Counter((r.id, r.size, r.text_crc32) for r in found) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    places = defaultdict(list)
    for r in found:
        places[r.shard].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    used = sh.load_map(spark, str(tmp_path / "maps"))
    kept = sh.sharded(docs, used)
    assert kept.columns == ["doc_id", "text", "_slot", "hash", "shard"]
    by_shard = Counter((r.doc_id, len((r.text or "").encode()) + 8, r.shard) for r in kept.collect())
    assert by_shard == Counter((r.id, r.size, r.shard) for r in found)
    sh.write_shards(docs, used, str(tmp_path / "out"))
    again = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, len((r.text or "").encode()) + 8, r.shard) for r in again.collect()) == by_shard
    assert sh.shard_places(docs.limit(0), 5, str(tmp_path / "none")).count() == 0


def test_a_record_repeated_many_times(spark, tmp_path):
    docs = spark.range(30_000).select(F.lit(1).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("same").alias("text"))
    found = sh.shard_places(docs, 3, str(tmp_path / "maps"))
    got = found.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("place").alias("d"), F.max("place").alias("m")).collect()
    assert sum(r.n for r in got) == 30_000 and all(r.n == r.d == r.m + 1 for r in got)


def test_rebalancing_is_near_even_and_moves_little():
    rng = random.Random(1)
    for _ in range(20):
        sizes = sizes_of([rng.choice([0, 1, 5, 100, rng.randint(0, 10_000)]) for _ in range(512)])
        start = sh.first_map(7, 512)
        even = sh.rebalanced(start, sizes)
        load = sh.loads(even, sizes)
        assert load.max() - load.min() <= max(0.002 * load.mean(), 2) and even.version == 2
        assert sum(a != b for a, b in zip(start.shard_of, even.shard_of)) < 64
        assert sh.rebalanced(even, sizes) is even
    huge = sh.rebalanced(sh.first_map(3, 16), sizes_of([1000, *[1] * 15]))
    assert sorted(sh.loads(huge, sizes_of([1000, *[1] * 15]))) == [7, 8, 1000]
    assert sh.rebalanced(sh.first_map(3, 16), sizes_of([0] * 16)).version == 1


def test_growing_moves_into_the_new_shard_only():
    rng = random.Random(2)
    for sizes in (None, sizes_of([rng.randint(0, 9000) for _ in range(4096)])):
        old = sh.first_map(24)
        new = sh.grown(old, sizes)
        assert (new.version, new.shards) == (2, 25)
        moved = [(a, b) for a, b in zip(old.shard_of, new.shard_of) if a != b]
        assert moved and all(b == 24 for _, b in moved)
        load = np.bincount(new.shard_of, weights=sizes.bytes if sizes else None)
        assert 0.97 < load[24] / load.mean() <= 1.001 and load.max() / load.mean() < 1.06


def test_versions_stay_as_they_are(spark, tmp_path):
    path = str(tmp_path / "maps")
    one = sh.first_map(4, 64)
    two = sh.grown(one)
    sh.save_map(spark, one, path)
    sh.save_map(spark, two, path)
    assert sh.load_map(spark, path) == two and sh.load_map(spark, path, 1) == one
    with pytest.raises(Exception, match="(?i)exist"):
        sh.save_map(spark, two, path)
    with pytest.raises(ValueError, match="no version 9"):
        sh.load_map(spark, path, 9)
    with pytest.raises(ValueError):
        sh.first_map(5, 4)
