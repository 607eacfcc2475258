"""Repeated passages against looking at every window."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.llm import queries
from tabscout.llm import suffix_dedup as sd

SF = "/root/testdata/sf0.01"


def plain_mask(texts, length):
    seen: dict[bytes, int] = {}
    for x in texts:
        for i in range(len(x) - length + 1):
            seen[x[i:i + length]] = seen.get(x[i:i + length], 0) + 1
    out = []
    for x in texts:
        m = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i:i + length]] > 1:
                m[i:i + length] = b"\1" * length
        out.append(m)
    return out, seen


def test_suffix_arrays_find_every_repeat():
    rng = random.Random(1)
    for _ in range(300):
        length = rng.choice([1, 2, 3, 5, 8, 9, 16, 20])
        letters = rng.choice([b"ab", b"a", b"abc", bytes(range(256)), b"\x00\xff\x01"])
        texts = [bytes(rng.choice(letters) for _ in range(rng.randint(length, length + rng.choice([0, 3, 40]))))
                 for _ in range(rng.randint(1, 6))]
        seen = plain_mask(texts, length)[1]
        wanted = [[seen[x[i:i + length]] > 1 for i in range(len(x) - length + 1)] for x in texts]
        assert [r.tolist() for r in sd.repeats(texts, length)] == wanted


def test_suffix_order_is_the_order_of_suffixes():
    rng = random.Random(2)
    for _ in range(50):
        body = bytes(rng.choice(b"abA\xff") for _ in range(60))
        t = np.frombuffer(body + bytes(100), np.uint8)
        step = np.sign(np.diff(t.astype(np.int16), append=256))
        nearest = np.minimum.accumulate(np.where(step != 0, np.arange(len(t)), len(t) - 1)[::-1])[::-1]
        needed = np.zeros(len(t), bool)
        needed[:61] = True
        order = sd.suffix_order(t, needed, step[nearest] > 0, 80).tolist()
        assert [i for i in order if i < 60] == sorted(range(60), key=lambda i: body[i:])


@pytest.mark.parametrize("options", [{}, {"sort_bytes": 100}, {"key_bytes": 0}, {"key_bytes": 900}])
def test_spans_of_odd_tables(spark, options):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefé ") for _ in range(9)) for _ in range(400)]
    passage = "".join(words[:8])
    texts = ["".join(rng.sample(words, 12)) for _ in range(20)]
    texts += [t[:40] + passage + t[40:] for t in texts[:7]] + [passage + passage, passage[1:], passage[:-1], "x" * 200,
              "ab" * 60, None, "", "short", texts[0], texts[0], "x" * 41]
    rows = [(i, t, "d", 1) for i, t in enumerate(texts)] + [(0, texts[0], "d", 1), (None, texts[3], "d", 1), (None, "y" + texts[4], "d", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, whole int").repartition(3)
    raw = [(r[1] or "").encode() for r in rows]
    masks, _ = plain_mask(raw, 40)
    found = sd.repeated_spans(df, length=40, piece=16, **options)
    got = found.collect()
    wanted = sorted((repr(r[0]), len(x), bytes(m)) for r, x, m in zip(rows, raw, masks))
    spans = []
    for r in got:
        m = bytearray(r.n_bytes)
        for s in r.spans:
            m[s.start:s.stop] = b"\1" * (s.stop - s.start)
            assert s.stop == r.n_bytes or s.stop < r.n_bytes
        spans.append((repr(r.id), r.n_bytes, bytes(m)))
    assert sorted(spans) == wanted
    kept = {r.digest: bytes(r.kept) for r in sd.kept_bytes(df, found).collect()}
    by_digest = {hashlib.sha256(x).hexdigest(): bytes(b for b, gone in zip(x, m) if not gone) for x, m in zip(raw, masks)}
    assert kept and all(by_digest[d] == k for d, k in kept.items())
    assert sd.repeated_spans(df.limit(0), length=40, piece=16).count() == 0


def test_query_over_all_documents(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in queries.table(spark, SF, "documents").collect()}
    seen: dict[int, int] = {}
    for x in texts.values():
        for i in range(len(x) - 399):
            h = hash(x[i:i + 400])
            seen[h] = seen.get(h, 0) + 1
    got = {r.doc_id: r for r in queries.op9_suffix_dedup(spark, SF).collect()}
    assert got.keys() == texts.keys()
    some = 0
    for i, x in texts.items():
        edges = np.zeros(len(x) + 1, np.int64)
        for k in range(len(x) - 399):
            if seen[hash(x[k:k + 400])] > 1:
                edges[k] += 1
                edges[k + 400] -= 1
        gone = np.cumsum(edges)[:-1] > 0
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        kept = bytes(np.frombuffer(x, np.uint8)[~gone])
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
        some += spans > 0
    assert some > 20


def test_a_passage_in_every_text(spark):
    passage = " ".join(f"word{i}" for i in range(100))
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(
        F.sha2(F.col("id").cast("string").cast("binary"), 256), F.lit(passage), F.sha2((F.col("id") + 7000).cast("string").cast("binary"), 256)).alias("text"))
    sizes = {(len(r.spans), r.spans[0].start, r.spans[0].stop) for r in sd.repeated_spans(df).collect()}
    # Signs beside the passage may be alike by chance.
    assert all(n == 1 and 56 <= a <= 64 and 0 <= b - 64 - len(passage) <= 8 for n, a, b in sizes)
