"""Spelling variants against trying every edit."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabscout.llm import queries, spelling as sp

SF = "/root/testdata/sf0.01"


def plain_words(rows, slip=97):
    counts = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{low}".encode())
            if slip and h % slip == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            counts[low] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain_edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    return out - {word}


def plain_variants(rows, slip=97):
    words = plain_words(rows, slip)
    letters = sorted({c for w in words for c in w})
    near = {w: [v for v in plain_edits(w, letters) if v in words] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words[form[w]] if w in form else None))
    return sorted(out)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query_over_all_documents(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").collect()
    got = rows_of(queries.op12_spelling(spark, SF))
    assert got == plain_variants(docs)
    assert len({r[2] for r in got}) < len(got) and any(r[1] and r[2] != r[1] for r in got)


def test_neighbourhoods_are_all_edits_once():
    rng = random.Random(1)
    words = ["".join(rng.choice("abÀé÷z") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["a", "aaaaaaa"]
    for symbols in (2, 3, 7):
        symbol, at = sp.reduced(words, symbols)
        small = ["".join(map(str, symbol[a:b])) for a, b in zip(at, at[1:])]
        found = [[] for _ in words]
        for word, key in sp.neighbourhood(symbol, at, symbols):
            for w, k in zip(word.tolist(), key.tolist()):
                found[w].append(k)
        for word, keys in zip(small, found):
            edits = sorted(plain_edits(word, [str(c) for c in range(symbols)]) | {word})
            sym = np.array([int(c) for e in edits for c in e], np.int64)
            ends = np.concatenate([[0], np.cumsum([len(e) for e in edits])])
            wanted = sp.reduced_hash(sym, ends).tolist()
            assert sorted(keys) == sorted(wanted) and len(set(keys)) == len(keys)


TEXTS = ["Color colour colors COLOR colour. color", None, "", "color " * 40, "ÀÉabc Àéabc ÀÉabc ÀÉabc ÀÉabd", "× ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷÷ ÷÷÷÷÷÷ ÷÷÷÷÷÷",
         "abcde_abcdf-abcde1abcde abcdf abcdf", "colxur colxur colxur colyur colyur colyur", " ".join(["y" * 5000, "y" * 5001] * 3), "z" * 200_000]


@pytest.mark.parametrize("symbols", [2, 12])
@pytest.mark.parametrize("slip", [0, 2, 97])
def test_odd_tables(spark, symbols, slip):
    rows = [(i, t, "w", 1) for i, t in enumerate(TEXTS)] * 3 + [(None, TEXTS[0], "w", 1)]
    df = spark.createDataFrame(rows, "doc_id int, text string, word string, n int").repartition(3)
    got = rows_of(sp.variants(df, symbols=symbols, slip=slip))
    long = {w for w in (r[0] for r in got) if len(w) > 100}
    wanted = plain_variants([(r[0], r[1] if r[1] is None or len(r[1]) < 9000 else None) for r in rows], slip)
    assert [r for r in got if r[0] not in long] == wanted
    if not slip:
        assert [(r[0], r[4], r[1]) for r in got if r[0] in long] == [("y" * 5000, 1, None), ("y" * 5001, 1, None), ("z" * 200_000, 0, None)]
    assert sp.variants(df.limit(0)).count() == 0


def test_counts_are_given_out_in_parts(spark, monkeypatch):
    docs = [(i, " ".join(random.Random(i % 7).choice(["alpha", "alpho", "gamma", "gammas"]) for _ in range(30))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(sp, "HELD_LETTERS", 3)
    found = sp.variants(df)
    assert rows_of(found) == plain_variants(docs)
    groups = {r.root: (r.members, r.n) for r in sp.variant_groups(found).collect()}
    assert sum(n for _, n in groups.values()) == sum(r[3] for r in plain_variants(docs))


def test_long_chains_end_at_one_root(spark):
    chain = [("a" * k + "b" * (12 - k), 3 * 2 ** k) for k in range(13)]
    words = spark.createDataFrame(chain, "word string, n long")
    found = sp.forms(words, sp.near_pairs(words))
    assert {r.root for r in sp.roots(found).collect()} == {"a" * 12}


def test_no_table_of_words_is_broadcast(spark, monkeypatch):
    docs = [(i, " ".join(random.Random(i % 7).choice(["alpha", "alpho", "alphas", "gamma", "gammas"]) for _ in range(30))) for i in range(100)]
    plans = []

    def ran(df):
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    write = sp.landed
    monkeypatch.setattr(sp, "landed", lambda df: write(ran(df)))
    found = ran(sp.variants(spark.createDataFrame(docs, "doc_id long, text string")))
    assert rows_of(found) == plain_variants(docs) and any(r.form for r in found.collect())
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
