"""Near copies by shingle similarity against brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabscout.llm import similar_dedup as sd

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def like(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def roots_of(texts):
    """For each text the least index that links reach."""
    sets = [plain_set(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and like(sets[i], sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def edited(rng, words, changes):
    out = list(words)
    for k in rng.sample(range(len(out)), changes):
        out[k] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def some_texts():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    line = " ".join(rng.choices(words, k=30))
    texts = []
    for n, copies in ((300, 40), (60, 40), (120, 5), (9, 5), (45, 3), (800, 3)):
        base = rng.choices(words, k=n)
        texts += [edited(rng, base, rng.randint(0, max(1, n // 30))) for _ in range(copies)]
    texts += [f"{' '.join(rng.choices(words, k=rng.randint(5, 80)))} {line}" for _ in range(60)]
    # Five of 45 shingles each: at 0.8 exactly, and just below.
    a = [f"z{k}" for k in range(49)]
    texts += [" ".join(a), " ".join(a[:-5] + [f"y{k}" for k in range(5)]), " ".join(a[6:] + [f"x{k}" for k in range(6)])]
    texts += ["", None, " \n", "a", "A", "a b", "b a", "One two\tthree", "one  two three ", "é ü"]
    return texts


@pytest.mark.parametrize("bucket_rows", [64, 3])
def test_groups_match_brute_force(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(sd, "SAMPLE", 2)
    texts = some_texts()
    root = roots_of(texts)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = sd.similar_groups(df, bucket_rows=bucket_rows).collect()
    assert {r.id: r.component_id for r in got} == dict(enumerate(root))
    assert sorted(r.id for r in got if r["first"]) == sorted(set(root))


def test_stage_drops_copies_of_four_fifths_and_no_others(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    root = roots_of([t for _, t in rows])
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == [i for k, (i, _) in enumerate(rows) if root[k] == k]


def test_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    base = rng.choices(words, k=120)
    texts = [edited(rng, base, k) for k in (0, 0, 1, 3, 9, 40)] + ["", "a", "a b c d e f", None]
    doc, found = sd.shingles_of(pa.array(texts))
    sketches = [np.array(x, np.int64).view(np.uint64) for x in sd.sketches_of(doc, found, len(texts)).to_pylist()]
    sets = [plain_set(t) for t in texts]
    for i, a in enumerate(sketches):
        for j, b in enumerate(sketches):
            bits = sum(int(x).bit_count() for x in a ^ b)
            assert len(a) == sd.SKETCH_WORDS and bits <= len(sets[i] ^ sets[j]) and (bits + len(sets[i] ^ sets[j])) % 2 == 0


def test_a_line_shared_by_unlike_texts_makes_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(sd, "SAMPLE", 1)
    line = " ".join(f"l{k}" for k in range(8))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("own"), F.col("id").cast("string"), F.lit(" " + line)).alias("text"))
    rows = sd.landed(sd.keyed_rows(df, "doc_id", "text", sd.common_bits(df, "doc_id", "text")))
    named = rows.select("node", "n", F.posexplode("keys").alias("at", "key")).select("key", "node", "n", "at", F.col("node").alias("root"))
    assert named.groupBy("key").count().agg(F.max("count")).first()[0] == 3000
    assert sd.unlinked_pairs(sd.with_sketches(named, rows)).count() == 0 and sd.some_neighbours(sd.with_sketches(named.drop("root"), rows)).count() == 0
    assert sd.similar_groups(df).where("component_id != id").count() == 0


def test_near_fingerprints_are_compared_and_linked_first(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(3000)]
    texts = []
    for _ in range(6):
        base = rng.choices(words, k=400)
        texts += [edited(rng, base, k) for k in (0, 1, 2, 40)]
    texts += ["", None, "a b", "one two three four five six"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    rows = sd.landed(sd.keyed_rows(df, "doc_id", "text", sd.common_bits(df, "doc_id", "text")))
    prints = {r.node: r.fp % 2**64 for r in rows.collect() if r.n}
    wanted = {(a, b) for a in prints for b in prints if a > b and (prints[a] ^ prints[b]).bit_count() <= sd.PRINT_BITS}
    assert {(r.u, r.v) for r in sd.near_prints(rows).collect()} == wanted and len(wanted) > 6
    seen = []
    whole = sd.alike
    monkeypatch.setattr(sd, "alike", lambda pairs, *rest: seen.append({(r.u, r.v) for r in pairs.collect()}) or whole(pairs, *rest))
    got = {r.id: r.component_id for r in sd.similar_groups(df).collect()}
    assert seen[0] == wanted and not any(wanted & s for s in seen[1:])
    assert got == dict(enumerate(roots_of(texts)))


def test_a_large_group_makes_pairs_in_proportion_to_its_size(spark):
    rng = random.Random(10)
    made = []
    for members in (300, 1500):
        prints = set()
        while len(prints) < members:
            x = 0x0123456789ABCDEF
            for k in rng.sample(range(63), rng.randint(0, 3)):
                x ^= 1 << k
            prints.add(x)
        rows = spark.createDataFrame([(x, -x, 9) for x in prints], "fp long, node long, n int")
        got = {(r.u, r.v) for r in sd.near_prints(rows).collect()}
        assert all(u > v and ((-u) ^ (-v)).bit_count() <= sd.PRINT_BITS for u, v in got)
        roots = sd.components(spark.createDataFrame(sorted(got), "u long, v long")).collect()
        assert len(roots) == members and len({r.root for r in roots}) == 1
        made.append((len(got), sum((a ^ b).bit_count() <= sd.PRINT_BITS for a in prints for b in prints if a > b)))
    assert made[1][0] < 8 * made[0][0] and made[1][1] > 15 * made[0][1], made


def test_few_unlike_fingerprints_share_a_key(spark, monkeypatch):
    seen = []
    write = sd.simhash_dedup.landed
    monkeypatch.setattr(sd.simhash_dedup, "landed", lambda df: seen.append(write(df)) or seen[-1])
    rows = spark.range(40000).select(F.xxhash64("id").alias("fp"), F.col("id").alias("node"), F.lit(9).alias("n"))
    assert sd.near_prints(rows).count() == 0
    assert max(x.count() for x in seen if "fp" in x.columns) < 40000 // 20


def test_groups_of_near_copies_match_brute_force_if_pairs_are_few(spark, monkeypatch):
    monkeypatch.setattr(sd, "SAMPLE", 2)
    monkeypatch.setattr(sd, "PRINT_ALL", 2)
    texts = some_texts()
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    assert {r.id: r.component_id for r in sd.similar_groups(df).collect()} == dict(enumerate(roots_of(texts)))
