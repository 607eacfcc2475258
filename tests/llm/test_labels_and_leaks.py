"""Classifiers by held-out accuracy and odd rows, decontamination by brute force, the pipeline by its stages."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from test_similar import roots_of

import corpus_pipeline
from tabscout.llm import decontaminate as dc
from tabscout.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def held_out(df, spark, label):
    labels = queries.table(spark, SF, "labels").select("doc_id", label)
    rows = df.join(labels, "doc_id").where("held_out").collect()
    pos = [r.score for r in rows if r[label] == 1]
    neg = [r.score for r in rows if r[label] == 0]
    return np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos]), rows


def test_quality_of_unseen_documents(spark):
    df = queries.op2_quality(spark, SF)
    auc, rows = held_out(df, spark, "quality")
    assert auc > 0.97
    assert sum(r.predicted for r in rows if r.quality == 1) >= 0.98 * sum(r.quality for r in rows)
    assert df.count() == 1000


def test_toxicity_of_unseen_documents(spark):
    auc, rows = held_out(queries.op6_toxicity(spark, SF), spark, "toxic")
    assert auc > 0.9 and sum(r.predicted for r in rows if r.toxic == 0) <= 1
    assert sum(r.predicted for r in rows if r.toxic == 1) >= 0.9 * sum(r.toxic for r in rows)


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(3)
    m = quality.Machine(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    doc, place = np.array([0, 0, 0, 2, 2]), np.array([3, 7, 11, 3, 49])
    value = rng.normal(size=5).astype(np.float32)
    plain = []
    for d in range(3):
        at = np.flatnonzero(doc == d)
        z = 0.3 + sum(m.w[place[i]] * value[i] for i in at)
        z += sum(m.v[place[i]] @ m.v[place[j]] * value[i] * value[j] for i in at for j in at if i < j)
        plain.append(z)
    assert np.allclose(m.logits(doc, place, value, 3), plain, atol=1e-5)


ODD = [(1, "a b c", 3, "x"), (1, "a b c", 3, "x"), (None, "Good text here.", None, None), (2, None, 5, None), (3, "", None, None),
       (4, "w " * 200_000, 1, None), (5, "你 ﷽ \x00", -7, None)]


def test_classifiers_on_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, n_chars long, label string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (9, 0), (1, 1), (4, None)], "doc_id long, label int")
    machine = quality.train(df, labels, "label", metadata=("n_chars",))
    got = quality.score(df, machine, metadata=("n_chars",)).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    kept = quality.drop_rejected(df, machine, metadata=("n_chars",))
    assert kept.columns == df.columns and kept.count() == sum(r.score >= 0.5 for r in got)
    assert quality.score(df.limit(0), machine, metadata=("n_chars",)).count() == 0
    none = quality.train(df, labels.limit(0), "label")
    assert {r.score for r in quality.score(df, none).collect()} == {0.5}
    one = quality.train(df, labels.where("label = 1"), "label")
    assert min(r.score for r in quality.score(df, one).collect()) > 0.9
    lexicon = toxicity.train(df, labels, "label")
    got = toxicity.score(df, lexicon).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(df.limit(0), toxicity.train(df, labels.limit(0), "label")).count() == 0


def test_folding_and_phrases():
    assert toxicity.fold("An ÍD10T, iԁiоt! 1d1ot ＩＤＩＯＴ ídiot id​iot 2024") == " an idiot idiot idiot idiot idiot idiot "
    assert toxicity.fold("") == "  " and toxicity.fold("STUPID!! stup1d**") == " stupid stupid "
    lexicon = toxicity.Lexicon({"trash": 2.0, "lowe*": 3.0}, ["trash can"])
    found = lexicon.automaton()
    damp = lambda n: 1 + 0.1 * np.log1p(n + 1)
    assert toxicity.weight_of(toxicity.fold("trash trash"), found) == pytest.approx(4 / damp(2))
    assert toxicity.weight_of(toxicity.fold("the trash can, trash"), found) == pytest.approx(2 / damp(4))
    assert toxicity.weight_of(toxicity.fold("loweient slowest"), found) == pytest.approx(3 / damp(2))
    assert toxicity.weight_of(toxicity.fold("nothing"), toxicity.Lexicon({}).automaton()) == 0


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_contamination_by_brute_force(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [("1", item), ("2", "short one"), ("10", "ZÉ"), ("3", None), ("4", "..."), (None, "null item words"), ("1", item), ("5", "a " * 12)]
    docs = [(1, item.upper() + " x"), (2, "x " + item[:60] + "!"), (3, "alpha, beta-gamma delta epsilon zeta eta theta iota kappa"),
            (4, None), (5, ""), (6, "a short one zé null item words"), (7, "a " * 30), (1, item.upper() + " x"), (None, "zÉ ze short"),
            (8, "beta gamma " * 50_000), (9, item + " " + item), (10, "zÉ")]
    df = spark.createDataFrame([(*d, "t") for d in docs], "doc_id long, text string, item_id string")
    it = spark.createDataFrame(items, "item_id string, text string")
    got = dc.contamination(df, it).collect()
    windows = []
    for i, t in items:
        w = plain_words(t)
        k = min(10, len(w))
        windows += [(i or "", w[a:a + k]) for a in range(len(w) - k + 1)] if k else []
    wanted = []
    for i, t in docs:
        w = plain_words(t)
        hit, names = set(), set()
        for name, x in windows:
            for a in range(len(w) - len(x) + 1):
                if w[a:a + len(x)] == x:
                    hit |= set(range(a, a + len(x)))
                    names.add(name)
        wanted.append((repr(i), len(w), len(hit), sorted(names)))
    assert sorted((repr(r.id), r.n_words, r.n_hit, r.item_ids) for r in got) == sorted(wanted)
    kept = dc.drop_contaminated(df, it)
    assert kept.columns == df.columns and kept.count() == sum(w[2] == 0 for w in wanted)
    assert dc.contamination(df.limit(0), it).count() == 0
    assert {r.n_hit for r in dc.contamination(df, it.limit(0)).collect()} == {0}


def test_sql_of_the_queries(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        ours = queries.QUERIES[name](spark, SF)
        theirs = con.sql(sql)
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        at = [theirs.columns.index(c) for c in columns]
        assert sorted(repr([r[c] for c in columns]) for r in ours.collect()) == sorted(
            repr([r[i] for i in at]) for r in theirs.fetchall())


def test_pipeline_is_its_stages(spark):
    docs = queries.table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    machine = queries.quality_machine(docs, queries.table(spark, SF, "labels"))
    scores = {r.id: r.score for r in quality.score(docs, machine, metadata=queries.METADATA).collect()}
    left = sorted(i for i in rows if scores[i] >= 0.5)
    seen: set[str] = set()
    left = [i for i in left if (n := re.sub(r"[\x20\x09-\x0D]+", " ", rows[i])) not in seen and not seen.add(n)]
    root = roots_of([rows[i] for i in left])
    left = [d for k, d in enumerate(left) if root[k] == k]
    items = [plain_words(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    windows = {" ".join(w[a:a + 10]) for w in items for a in range(len(w) - 9)}
    assert all(len(w) >= 10 for w in items)
    left = [d for d in left if not windows & {" ".join(w[a:a + 10]) for w in [plain_words(rows[d])] for a in range(len(w) - 9)}]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == left
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)


def test_stages_take_empty_and_odd_documents(spark, tmp_path):
    docs = queries.table(spark, SF, "documents")
    odd = docs.limit(30).unionByName(docs.limit(2)).unionByName(spark.createDataFrame(
        [(None, None, None, None, None), (None, None, None, None, None), (5_000_000, "", "en", None, 0), (5_000_001, None, "en", "s", None)], docs.schema))
    for df in (odd, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, SF)
            assert df.columns == docs.columns, name
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            df = spark.read.parquet(f"{tmp_path}/{name}")
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() == df.count()
