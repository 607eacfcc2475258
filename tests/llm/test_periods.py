"""Periodic runs against comparing words at every distance."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.llm import periods as pe, queries

SF = "/root/testdata/sf0.01"


def plain_runs(words):
    t, best = np.array(words, np.int64), {}
    for q in range(1, len(t) // 4 + 1):
        same = np.concatenate([[False], t[q:] == t[:-q], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for start, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if z + q - start >= max(6, 4 * q):
                best.setdefault((start, z + q), q)
    return sorted(((s, e - s, q) for (s, e), q in best.items()), key=lambda r: (r[0], r[2]))


def plain_row(ident, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(("" if ident is None else str(ident)).encode()), len(words)
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    runs = plain_runs([names[w] for w in words])
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return words, runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_over_all_documents(spark):
    texts = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.op13_periodic_runs(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    some = 0
    for r in rows:
        _, runs, kept = plain_row(r.doc_id, texts[r.doc_id])
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        some += best is not None
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *(best or (None,) * 3))
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r.collapsed_sha256 == sha(kept)
    assert some > 50


def random_text(rng):
    words = rng.choice([1, 2, 3, 5, 50])
    t = [rng.randrange(words) for _ in range(rng.randint(0, rng.choice([8, 40, 150])))]
    for _ in range(rng.randint(0, 3) if t else 0):
        a, p = rng.randrange(len(t)), rng.randint(1, 9)
        t = t[:a] + t[a:a + p] * rng.randint(2, 9) + t[a:]
    return np.array(t, np.int32)


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_texts(seed):
    rng = random.Random(seed)
    for _ in range(200):
        texts = [random_text(rng) for _ in range(rng.randint(1, 6))]
        assert pe.runs_of(texts) == [plain_runs(t) for t in texts]


def test_suffix_array_and_common_words():
    rng = random.Random(9)
    for _ in range(50):
        t = np.array([rng.randrange(3) for _ in range(rng.randint(0, 60))] + [7], np.int64)
        order, common = pe.suffixes(t)
        ends = [t[i:].tolist() for i in range(len(t))]
        assert order.tolist() == sorted(range(len(t)), key=lambda i: ends[i])
        for a, b, c in zip(order, order[1:], common):
            assert ends[a][:c] == ends[b][:c] and ends[a][c:c + 1] != ends[b][c:c + 1]


def test_regions_hold_every_run():
    rng = random.Random(11)
    for _ in range(200):
        texts = [random_text(rng) for _ in range(4)]
        sizes = np.array([len(t) for t in texts], np.int64)
        words = np.concatenate([x for k, t in enumerate(texts) for x in (t.astype(np.int64), [1000 + k])])
        parts = pe.regions(words, sizes)
        assert all(z < a for (_, z), (a, _) in zip(parts, parts[1:]))
        for k, t in enumerate(texts):
            begin = int(sizes[:k].sum()) + k
            for s, n, _ in plain_runs(t):
                assert any(a <= max(begin, begin + s - 1) and min(begin + len(t), begin + s + n + 1) <= z for a, z in parts)


def test_long_texts_are_done_in_time():
    rng = np.random.default_rng(1)
    assert pe.runs_of([np.zeros(100_000, np.int32)]) == [[(0, 100_000, 1)]]
    assert pe.runs_of([np.tile(rng.permutation(20_000).astype(np.int32), 5)]) == [[(0, 100_000, 20_000)]]
    lefts = np.array([w for i in range(5000) for w in (100 + i, 1, 2, 3, 4, 5)], np.int32)
    assert pe.runs_of([np.tile(lefts, 4)]) == [[(0, 120_000, 30_000)]]


TEXTS = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "a\tb\x0ba b\x0c\r\na b a b", "x a b a b a b a b y", "é z " * 7, "\x1c \x1c \x1c \x1c \x1c \x1c \x1c",
         "p q r " * 3 + "p q", "p q r " * 4 + "p q", "w " * 70_000, " ".join(f"w{i % 700}" for i in range(3000)), "A a " * 4]


@pytest.mark.parametrize("plant", [False, True])
def test_odd_tables(spark, monkeypatch, plant):
    monkeypatch.setattr(pe, "SPLIT_BYTES", 5)
    rows = [(i, t, 3, "r") for i, t in enumerate(TEXTS)] * 2 + [(None, TEXTS[5], 3, "r"), (None, "b c d e f g", 3, "r")]
    df = spark.createDataFrame(rows, "doc_id int, text string, ident int, runs string").repartition(3)
    got = sorted((repr(r.id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in pe.periodic_runs(df, plant=plant).collect())
    wanted = sorted((repr(i), len(w), runs, kept) for i, t, *_ in rows for w, runs, kept in [plain_row(i, t, plant)])
    assert got == wanted
    assert pe.periodic_runs(df.limit(0)).count() == 0
    assert pe.periodic_runs(df.limit(0)).withColumn("longest", pe.longest_run()).where(F.col("longest").isNotNull()).count() == 0
