"""Exact and SimHash dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tabscout.llm import exact_dedup as ex
from tabscout.llm import queries
from tabscout.llm import simhash_dedup as sh

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, id string, _id int"


def rows_of(texts):
    return [(i, t, "en", "x", None) for i, t in enumerate(texts)]


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, "a", "A", "a b C", "one two", "one  two\t", " one two ", "x " * 1000, "ÀÉ straße ÀÉ straße",
         "\x00 \x1c\x1d z", "1 2 3 4 5 6", "w " * 255 + "v " * 255, "only\nline\r\nends\x0b\x0c"]


def test_fingerprints_match_plain_ones():
    rng = random.Random(1)
    texts = TEXTS + [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (3, 4, 254, 255, 256, 257, 600)]
    assert sh.fingerprints_of(pa.array(texts)).tolist() == [plain_fingerprint(t) for t in texts]
    assert sh.fingerprints_of(pa.array(texts).slice(3, 5)).tolist() == [plain_fingerprint(t) for t in texts[3:8]]
    assert sh.fingerprints_of(pa.array([], pa.string())).tolist() == []


def test_query_over_all_documents(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    ids = sorted(texts)
    fps = [plain_fingerprint(texts[i]) for i in ids]
    root = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if root[i] != root[j] and (fps[i] ^ fps[j]).bit_count() <= 2:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_near_dedup(spark, SF).collect()}
    assert got == {i: (f"{fp:016x}", ids[root[k]]) for k, (i, fp) in enumerate(zip(ids, fps))}


def test_every_link_is_found_in_large_buckets_too(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = set(base)
    for b in base:
        for _ in range(60):
            x = b
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    wanted = {(a, b) for a in fps for b in fps if sh.signed(a) > sh.signed(b) and bin(a ^ b).count("1") <= 2}
    df = spark.createDataFrame([(sh.signed(x),) for x in fps], "fp long")
    for limit in (64, 4):
        got = {(r.u % 2**64, r.v % 2**64) for r in sh.links(df, bucket_rows=limit).collect()}
        assert got == wanted


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(20, 60)] + [(-5, 3), (3, -9)]
    got = {r.node: r.root for r in sh.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{k: 7 for k in [7, *range(20, 60)]}, -5: -9, 3: -9, -9: -9}
    assert sh.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_groups_of_odd_rows(spark):
    rows = [*rows_of(TEXTS), (2, "a", "en", "x", None), (None, "a", None, None, 1), (None, "q r s", None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sh.near_groups(df).collect()
    assert len(got) == len(rows)
    fps = [plain_fingerprint(r[1]) for r in rows]
    reach = {i: {i} for i in range(len(rows))}
    for _ in rows:
        for i in reach:
            reach[i] |= {k for j in list(reach[i]) for k in range(len(rows)) if bin(fps[j] ^ fps[k]).count("1") <= 2}
    ids = [r[0] for r in rows]
    wanted = sorted((repr(ids[i]), fps[i], repr(min((ids[j] for j in reach[i] if ids[j] is not None), default=None)))
                    for i in reach)
    assert sorted((repr(r.id), r.fp % 2**64, repr(r.component_id)) for r in got) == wanted
    kept = sh.drop_near_copies(df)
    assert kept.columns == df.columns
    texts = kept.collect()
    assert len(texts) == len({min(reach[i]) for i in reach})
    assert sh.near_groups(df.limit(0)).count() == 0 and sh.drop_near_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("all_digests", [True, False])
def test_exact_groups(spark, all_digests):
    rows = [*rows_of([*TEXTS, "same  text", "same\ttext", "same texT"]), (15, "same  text", "en", "x", 3),
            (None, "same text", None, None, None), (None, "alone", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = ex.exact_groups(df, all_digests=all_digests).collect()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    assert len(got) == len(rows)
    wanted = []
    for r, n in zip(rows, norm):
        mates = [q[0] for q, m in zip(rows, norm) if m == n]
        keep = min((m for m in mates if m is not None), default=None)
        wanted.append((repr(r[0]), repr(keep), len(mates)))
    assert sorted((repr(r.id), repr(r.keep_id), r.group_size) for r in got) == sorted(wanted)
    assert sum(r.kept for r in got) == len(set(norm))
    if all_digests:
        assert sorted(r.digest for r in got) == sorted(hashlib.sha256(n.encode()).hexdigest() for n in norm)
    kept = ex.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()) == sorted(set(norm))
    assert ex.exact_groups(df.limit(0)).count() == 0 and ex.drop_exact_copies(df.limit(0)).count() == 0


def test_one_text_in_a_third_of_the_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(
        F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    assert ex.drop_exact_copies(df).count() == 2001
    sizes = {r.group_size for r in ex.exact_groups(df).collect()}
    assert sizes == {1, 1000}


def test_rows_left_after_each_step_of_exact_dedup(spark):
    texts = ["a" * 9, "b" * 8, "b" * 8, "c" * 8, "d" * 7, "x" * 300 + "1", "x" * 300 + "2", "y" * 301, "only one has this length"]
    keys = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_id long, _norm string").withColumn("_len", F.length("_norm"))
    lengths = ex.repeated_lengths(keys)
    assert sorted(r[0] for r in lengths.collect()) == [8, 301]
    left = keys.join(lengths, "_len", "left_semi")
    assert left.count() == 6
    alike = ex.repeated_heads(keys, lengths)
    assert sorted(r._len for r in alike.collect()) == [8, 301]
    assert left.withColumn("_head", ex.head_of()).join(alike, ["_len", "_head"], "left_semi").count() == 4
    plan = ex.repeated_heads(keys, lengths)
    found = ex.exact_groups(keys.select(F.col("_id").alias("doc_id"), F.col("_norm").alias("text"))).collect()
    assert sorted(r.id for r in found if r.digest) == [1, 2, 5, 6] and plan.count() == 2
    assert sorted((r.id, r.keep_id) for r in found if r.group_size > 1) == [(1, 1), (2, 1)]


def test_extra_columns_with_the_names_of_helpers(spark):
    df = spark.createDataFrame([(1, "a", 5, "z"), (2, "a", 6, "y"), (2, "a", 6, "y"), (None, "b", 7, None)],
                               "doc_id long, text string, _other_id long, _other_digest string")
    for kept in (ex.drop_exact_copies(df), sh.drop_near_copies(df)):
        assert kept.columns == df.columns and sorted(r._other_id for r in kept.collect()) == [5, 7]


def test_links_of_wider_budgets(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(5):
        b = rng.getrandbits(64)
        for _ in range(50):
            x = b
            for k in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(sh.signed(x),) for x in fps], "fp long")
    for bits, limit in ((1, 64), (4, 3), (6, 64), (6, 20)):
        wanted = sorted((a, b) for a in fps for b in fps if sh.signed(a) > sh.signed(b) and (a ^ b).bit_count() <= bits)
        assert sorted((r.u % 2**64, r.v % 2**64) for r in sh.links(df, bits, bucket_rows=limit).collect()) == wanted
    with pytest.raises(ValueError):
        sh.links(df, 32)


@pytest.mark.parametrize(("bits", "chain", "limit"), [(4, 3, 64), (4, 3, 5), (1, 3, 64)])
def test_longer_keys_find_the_same_links(spark, bits, chain, limit):
    rng = random.Random(8)
    fps = set()
    for _ in range(4):
        b = rng.getrandbits(64)
        for _ in range(50):
            x = b
            for k in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << k
            fps.add(x)
    df = spark.createDataFrame([(sh.signed(x),) for x in fps], "fp long")
    wanted = {(sh.signed(a), sh.signed(b)) for a in fps for b in fps if sh.signed(a) > sh.signed(b) and (a ^ b).bit_count() <= bits}
    got = sh.links(df, bits, limit, chain).collect()
    assert {(r.u, r.v) for r in got} == wanted and len(got) == len(wanted)
    some = {(r.u, r.v) for r in sh.links(df, bits, limit, chain, all_rows=3).collect()}
    assert some <= wanted and (len(some) < len(wanted) or bits == 1)  # stars are forests
    ends = [spark.createDataFrame(sorted(p), "u long, v long") for p in (wanted, some)]
    assert sorted(sh.components(ends[0]).collect()) == sorted(sh.components(ends[1]).collect())


def test_spanning_pairs_connect_a_group_with_one_pair_fewer_than_members():
    rng = np.random.default_rng(9)
    fps = np.concatenate([np.arange(200) * 3, (1 << 60) + (1 << rng.integers(0, 50, 100)), [-1, -2, 1 << 62]])
    u, v = sh.spanning_pairs(fps, 2)
    assert (u > v).all() and (np.bitwise_count((u ^ v).view(np.uint64)) <= 2).all()
    distinct = np.unique(fps)
    root = {x: x for x in distinct.tolist()}
    for a in distinct.tolist():
        for b in distinct.tolist():
            if root[a] != root[b] and (a ^ b) % 2**64 and ((a ^ b) % 2**64).bit_count() <= 2:
                low, high = sorted((root[a], root[b]))
                root = {x: low if r == high else r for x, r in root.items()}
    mine = {x: x for x in distinct.tolist()}
    for a, b in zip(u.tolist(), v.tolist()):
        assert mine[a] != mine[b]
        low, high = sorted((mine[a], mine[b]))
        mine = {x: low if r == high else r for x, r in mine.items()}
    assert mine == root
    assert [len(x) for x in sh.spanning_pairs(fps[:0], 2)] == [0, 0]
