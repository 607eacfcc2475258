from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tabscout.functions import words as w
from tabscout.operators.textjobs import json_from_text, near_same_text
from tabscout.plans import catalog as c
from tabscout.plans.pipeline import analyze_table, dataset_context

CARD = ("dataset string, seq int, id string, kind string, family string, score double, "
        "question string, title string, why string, takeaway string, x_label string, "
        "y_label string, columns array<string>, "
        "rows array<struct<label: string, n: bigint, value: double, x: double, text: string>>, "
        "evidence map<string, string>, passes boolean")


def cards(spark, n=60, datasets=20, seed=1):
    rng = random.Random(seed)
    rows = []
    for d in range(datasets):
        for i in range(rng.randint(0, n)):
            family = rng.choice([*w.FAMILY_LIMITS, "other", "new"])
            rows.append((f"d{d}", i + 1, f"v{i}", "bar_table", family, float(rng.randint(50, 60)),
                         "q?", f"Title {i}", f"why {i}", f"take {i}", "x", "y", ["A", "B"],
                         [("lead", 3, 0.5, None, "50.0%")], {}, rng.random() < 0.9))
    return spark.createDataFrame(rows, CARD)


def view(dataset, seq, name, family, score, passes=True):
    return (dataset, seq, name, "bar_table", family, score, "q?", f"Title {name}", f"why {name}", f"take {name}",
            "x", "y", ["A", "B"], [("lead", 3, 0.5, None, "50.0%")], {}, passes)


# Two datasets with the picks written by hand.
HAND = [
    view("a", 1, "o1", "overview", 100.0), view("a", 2, "o2", "overview", 99.0), view("a", 3, "t1", "time", 64.0),
    view("a", 4, "t2", "time", 64.0), view("a", 5, "t3", "time", 61.0), view("a", 6, "t4", "time", 60.0),
    view("a", 7, "weak", "segment", 98.0, False), view("a", 8, "s1", "segment", 70.0), view("a", 9, "x1", "new", 90.0),
    view("a", 10, "x2", "new", 89.0), view("a", 11, "x3", "new", 88.0),
    *[view("b", i, f"u{i}", "outcome", 80.0 - i) for i in range(1, 8)],
    *[view("b", i, f"s{i}", "segment", 70.0) for i in range(8, 14)],
    *[view("b", i, f"r{i}", "relationship", 75.5 + i) for i in range(14, 17)],
    view("b", 17, "d", "distribution", 57.0), view("b", 18, "d2", "distribution", 58.0), view("b", 19, "g", "geo", 10.0)]
PICKS = {"a": ["o1", "x1", "x2", "s1", "t1", "t2", "t3"],
         "b": ["r16", "r15", "u1", "u2", "u3", "u4", "u5", "s8", "s9", "s10", "s11", "d2"]}


def by_dataset(df):
    rows = df.orderBy("place").collect()
    return {d: [r.id for r in rows if r.dataset == d] for d in sorted({r.dataset for r in rows})}


def test_best_views_under_the_limits(spark):
    assert by_dataset(c.select_views(spark.createDataFrame(HAND, CARD))) == PICKS


@pytest.mark.parametrize("asked, wanted", [
    (["t4", "nope", "weak", "o2", "t4"], ["t4", "o2", "o1", "x1", "x2", "s1", "t1", "t2"]),
    (["x3", "t4", "o2", "s1", "x1"], ["x3", "t4", "o2", "s1", "x1"]),
    (["nope"] * 10, PICKS["a"]), ([], PICKS["a"]), (["weak"], PICKS["a"]),
    (["t4", "o2"] + ["nope"] * 9, ["t4", "o2", "o1", "x1", "x2", "s1", "t1", "t2"])])
def test_ids_in_order_and_filled_up(spark, asked, wanted):
    found = c.select_by_ids(spark.createDataFrame(HAND, CARD), spark.createDataFrame(
        [("a", asked)], "dataset string, ids array<string>"))
    assert by_dataset(found) == {"a": wanted, "b": PICKS["b"]}


def test_texts_given_twice_apply_in_turn(spark):
    texts = spark.createDataFrame([
        ("a", "o1", "First title\n", None, 1), ("a", "o1", "\t Second title", "x" * 300, 2), ("a", "o1", "y" * 91, " w1 ", 3),
        ("a", "t1", "Title\u00a0", "w2", 1), ("a", "nope", "zz", None, 1)],
        "dataset string, id string, title string, why string, pos int")
    found = c.overlay_texts(spark.createDataFrame(HAND, CARD), texts).collect()
    assert len(found) == len(HAND)
    rows = {r.id: r for r in found if r.dataset == "a"}
    assert (rows["o1"].title, rows["o1"].why) == ("Second title", "w1")
    assert (rows["t1"].title, rows["t1"].why) == ("Title", "w2")


def test_reply_becomes_tables(spark):
    replies = spark.createDataFrame([
        ("a", 'Sure: {"selected_ids": ["t4", "o2"], "summary": "' + "s" * 30 + '", "cards": [{"id": "t4", "title": "New"},'
              ' {"id": "t4", "why": "Because it is"}, {"title": "no id"}]} bye'), ("b", "no json"), ("b", None)],
        "dataset string, reply string")
    ids, texts, summaries = c.reply_to_tables(replies, "reply")
    assert [(r.dataset, r.ids) for r in ids.collect()] == [("a", ["t4", "o2"])]
    assert [(r.id, r.title, r.why, r.pos) for r in texts.orderBy("pos").collect()] == [
        ("t4", "New", None, 0), ("t4", None, "Because it is", 1)]
    assert [r.summary for r in summaries.collect()] == ["s" * 30]


def test_last_of_equal_ids_wins(spark):
    made = cards(spark, datasets=1).withColumn("ord", F.col("seq").cast("bigint"))
    again = made.where("id = 'v3'").withColumn("ord", F.lit(10**6).cast("bigint")).withColumn(
        "title", F.lit("Newer"))
    rows = {r.id: r for r in c.build_catalog([made, again]).collect()}
    assert rows["v3"].title == "Newer" and rows["v3"].seq == 4
    assert len(rows) == made.count()


def test_overlay_limits_and_repeats(spark):
    catalog = cards(spark, datasets=1).where("seq <= 6")
    texts = spark.createDataFrame([
        ("d0", "v0", "t" * 90, "w" * 220, None), ("d0", "v1", "t" * 91, "w" * 221, "x"),
        ("d0", "v2", " ok ", "take 2", "Take: 2!"), ("d0", "v3", None, "So why", "so  WHY?"),
        ("zz", "v4", "Other dataset", None, None)],
        "dataset string, id string, title string, why string, takeaway string")
    rows = {r.id: r for r in c.overlay_texts(catalog, texts).collect()}
    assert (rows["v0"].title, rows["v0"].why, rows["v0"].takeaway) == ("t" * 90, "w" * 220, "take 0")
    assert (rows["v1"].title, rows["v1"].why, rows["v1"].takeaway) == ("Title 1", "why 1", "take 1")
    # The new takeaway repeats the why, and so does the old one: a spare one.
    assert rows["v2"].title == "ok" and rows["v2"].takeaway == "lead stands out with b of 50.0%."
    assert rows["v3"].takeaway == "take 3"
    assert rows["v4"].title == "Title 4"


def test_summary(spark):
    chosen = c.select_views(cards(spark, datasets=3, n=40, seed=5))
    rows = {r.dataset: r for r in c.catalog_summary(chosen).collect()}
    for d, r in rows.items():
        useful = [x for x in chosen.where(F.col("dataset") == d).orderBy("place").collect()
                  if x.family not in ("overview", "quality")]
        assert r.summary.startswith(f"Found {len(useful)} useful insight views. Start with "
                                    f"{useful[0].title} because")
    given = spark.createDataFrame([("d0", "x" * 700), ("d1", "x" * 701), ("d2", "short")],
                                  "dataset string, summary string")
    rows = {r.dataset: r.summary for r in c.catalog_summary(chosen, given).collect()}
    assert rows["d0"] == "x" * 700 and rows["d1"].startswith("Found")


def test_near_same_text(spark):
    words = [f"w{i}" for i in range(100)]
    pairs = [("A b-C!", "a B c", True), ("", "", False), (None, "a", False), ("!!", "??", True),
             ("!!", "a", False), (" ".join(words), " ".join(words[:83]), True),
             (" ".join(words), " ".join(words[:82]), False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    assert [r.near_same for r in near_same_text(df, "a", "b").collect()] == [x for *_, x in pairs]


def test_json_from_text(spark):
    replies = ['{"a": 1}', '```json\n{"a": 1}\n```', 'Sure! {"a": 1} Bye', "junk", "{not json}",
               None, '{"a": {"b": "}"}} tail', ""]
    df = spark.createDataFrame([(x,) for x in replies], "reply string")
    assert [r.json for r in json_from_text(df, "reply").collect()] == [
        '{"a":1}', '{"a":1}', '{"a":1}', None, None, None, '{"a":{"b":"}"}}', None]


@pytest.fixture(scope="module")
def shop(spark):
    rng = random.Random(12)
    rows = []
    for i in range(600):
        kind = rng.choice(["new", "old", "odd"])
        price = round(rng.expovariate(0.02) + 1, 2)
        rows.append((f"2023-{1 + i % 9:02d}-{1 + i % 27:02d}", kind, price,
                     round(price * 1.1 + rng.random(), 2), 50 + rng.random(), 4 + rng.random(),
                     "yes" if rng.random() < {"new": 0.7, "old": 0.3, "odd": 0.5}[kind] else "no",
                     None if i % 5 else "gift"))
    rows += rows[:7]
    return spark.createDataFrame(rows, "order_date string, kind string, price double, "
                                       "total_amount double, lat double, lng double, "
                                       "returned string, note_kind string")


def test_whole_pipeline(spark, shop):
    found = analyze_table(shop, "shop")
    rows = {r.id: r for r in found.catalog.collect()}
    for wanted in ("snapshot", "quality", "map", "outcome_segment__returned__kind",
                   "time_count__order_date", "time_metric__order_date__price",
                   "relationship__price__total_amount", "distribution__price"):
        assert rows[wanted].passes, wanted
    assert rows["snapshot"].takeaway == (
        "The dataset has 607 rows, 8 columns, 485 missing cells, and 7 duplicate rows.")
    lead = rows["outcome_segment__returned__kind"]
    assert lead.rows[0].label == "new" and lead.why.startswith("new has the highest returned rate")
    assert len(rows["map"].rows) == 607
    assert sum(r.n for r in rows["distribution__price"].rows) <= 607
    assert rows["relationship__price__total_amount"].evidence["direction"] == "positive"
    chosen = c.select_views(found.catalog).orderBy("place").collect()
    assert [r.id for r in chosen][:2] == ["snapshot", lead.id]
    assert {r.id for r in chosen} <= set(rows) and len(chosen) <= 12


def test_context_of_a_dataset(spark, shop):
    found = analyze_table(shop, "shop")
    row = dataset_context(shop, found, key=["order_date", "kind"]).first()
    assert (row.dataset, row.rows, row.columns, len(row.sample_rows)) == ("shop", 607, 8, 2)
    assert json.loads(row.sample_rows[0])["order_date"] == "2023-01-01"
    assert [c.name for c in row.column_digest][:2] == ["order_date", "kind"]
    ranks = [v.rank for v in row.catalog_digest]
    assert ranks == list(range(1, len(ranks) + 1)) and row.catalog_digest[0].id == "snapshot"


def test_catalog_does_not_depend_on_partitioning(spark, shop):
    def key(df):
        return sorted((r.id, r.score, r.title, r.takeaway, str(r.rows)) for r in
                      analyze_table(df, "shop").catalog.collect() if r.id != "map")
    one, many = key(shop.coalesce(1)), key(shop.repartition(11))
    assert [x[:2] for x in one] == [x[:2] for x in many]
    assert [x[2:4] for x in one] == [x[2:4] for x in many]
