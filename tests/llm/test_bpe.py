"""BPE against the tokenizers library, and round trips."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tabscout.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
OURS = bpe.Vocabulary(bpe.tokenizer_text(PATH))
TEXTS = ["", None, "aaaaaaa aaa  aaaa", "<|endoftext|>x<|endoftext|><|endof", "  \n\n x  ", "it's'll 'LL", "x" * 3000,
         "naïve Straße 日本語 \x00\x1c  ٣٤", "ab" * 50, "\U0001f600 ́e"]


def ids_of(texts):
    flat, sizes = OURS.encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_ids_match_on_any_text(texts):
    assert ids_of(texts) == [e.ids for e in THEIRS.encode_batch(texts, add_special_tokens=False)]


def test_every_code_point():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::17]
    for k in range(0, len(points), 5000):
        texts = [f"a{chr(c)}1 {chr(c)}{chr(c)} b" for c in points[k:k + 5000]]
        assert ids_of(texts) == [e.ids for e in THEIRS.encode_batch(texts, add_special_tokens=False)]


def test_forgetting_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    rng = random.Random(4)
    for _ in range(20):
        texts = ["".join(rng.choice("abc 'sé\n") for _ in range(50)) for _ in range(3)]
        assert ids_of(texts) == [e.ids for e in THEIRS.encode_batch(texts, add_special_tokens=False)]


def test_whole_table(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(0, "", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rest string, ids int")
    got = bpe.decode(bpe.encode(df, PATH, decoded_col="again"), PATH).collect()
    assert [r.token_ids for r in got] == [THEIRS.encode(t or "", add_special_tokens=False).ids for _, t, *_ in rows]
    assert [r.decoded for r in got] == [t or "" for _, t, *_ in rows] == [r.again for r in got]
    assert [(r.doc_id, r.rest, r.ids) for r in got] == [(r[0], r[2], r[3]) for r in rows]
    assert bpe.encode(df.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([([220, 160],), (None,), ([],)], "token_ids array<int>")
    assert [r.decoded for r in bpe.decode(odd, PATH).collect()] == [THEIRS.decode([220, 160]), None, ""]
    with pytest.raises(Exception, match="vocabulary lacks"):
        bpe.decode(spark.createDataFrame([([60000],)], "token_ids array<int>"), PATH).collect()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary(bpe.tokenizer_text(public_tokenizers.path("word_bpe_49k.json")))
