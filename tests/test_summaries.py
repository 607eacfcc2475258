"""Summaries that merge, facts from footers, heavy values, map cells, nested JSON."""

from __future__ import annotations

import datetime as dt
import json
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabscout.operators import heavy, places, states
from tabscout.sources import tables as src
from tabscout.sources.footers import footer_facts


# --- states -----------------------------------------------------------------------

def state_rows(seed, n):
    rng = random.Random(seed)
    return [(i, rng.choice([None, math.nan, math.inf, rng.gauss(seed, 3)]), f"t{rng.randrange(500)}" if i % 4 else None, i % 2 == 0, 5.0) for i in range(n)]


KIND = "id long, x double, t string, flag boolean, flat double"


def test_merged_state_is_the_state_of_all_rows(spark, tmp_path):
    parts = [state_rows(k, n) for k, n in enumerate((3000, 1, 700, 0))]
    tables = [spark.createDataFrame(p, KIND) for p in parts]
    for k, t in enumerate(tables):
        states.table_state(t).write.parquet(str(tmp_path / f"s{k}"))
    saved = [spark.read.parquet(str(tmp_path / f"s{k}")) for k in range(4)]
    merged = {r.name: r for r in states.state_profile(states.merged_states(saved)).collect()}
    rows = [r for p in parts for r in p]
    assert list(sorted(merged, key=lambda c: merged[c].pos)) == ["id", "x", "t", "flag", "flat"]
    for i, c in enumerate(["id", "x", "t", "flag", "flat"]):
        cells = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        m = merged[c]
        assert (m.rows, m.non_null) == (len(rows), len(cells))
        assert abs(m.unique - len(set(cells))) <= 4 * states.DISTINCT_ERROR * len(set(cells)) + 1
        if c == "t":
            assert m.n_num == 0 and m.mean is None and m.median is None
            continue
        numbers = np.array([float(v) for v in cells if math.isfinite(v)])
        assert m.n_num == len(numbers) and (m.min, m.max) == (numbers.min(), numbers.max())
        assert math.isclose(m.mean, numbers.mean(), rel_tol=1e-9) and math.isclose(m.std, numbers.std(), rel_tol=1e-9, abs_tol=1e-12)
        third = ((numbers - numbers.mean()) ** 3).mean() / numbers.std() ** 3 if numbers.std() else 0.0
        assert math.isclose(m.skew, third, rel_tol=1e-6, abs_tol=1e-9)
        numbers.sort()
        for p, name in ((0.05, "p05"), (0.5, "median"), (0.99, "p99")):
            low, high = (np.searchsorted(numbers, m[name], side) / len(numbers) for side in ("left", "right"))
            assert low - states.RANK_ERROR <= p <= high + states.RANK_ERROR


def test_state_of_no_rows(spark):
    empty = spark.createDataFrame([], KIND)
    found = states.state_profile(states.merged_states([states.table_state(empty)] * 2)).collect()
    assert len(found) == 5 and all(r.rows == 0 and r.unique == 0 and r.mean is None and r.missing_rate is None for r in found)


# --- footers ------------------------------------------------------------------------

def test_footers_tell_what_a_scan_tells(spark, tmp_path):
    rows = [(i, i % 7 == 0, dt.date(2020, 1, 1) + dt.timedelta(i), math.nan if i % 3 else 1.5, None if i % 5 else "a", dt.datetime(2021, 1, 1, i % 24)) for i in range(50)]
    df = spark.createDataFrame(rows + [(None,) * 6], "n int, f boolean, d date, x double, s string, t timestamp_ntz").repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    found = {r.name: r for r in footer_facts(spark, str(tmp_path / "t")).collect()}
    assert {c: r.from_footers for c, r in found.items()} == {"n": True, "f": True, "d": True, "x": False, "s": True, "t": False}
    assert all(r.rows == 51 for r in found.values())
    assert [found[c].non_null for c in "nfdxst"] == [50, 50, 50, 17, 10, 50]
    assert (found["n"].low, found["n"].high, found["f"].high) == (0.0, 49.0, 1.0)
    assert (found["d"].first, found["d"].last) == (dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 19))
    assert (found["t"].first, found["t"].last) == (dt.datetime(2021, 1, 1), dt.datetime(2021, 1, 1, 23))
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false" and "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_files_without_statistics_are_read(spark, tmp_path):
    (tmp_path / "t").mkdir()
    pq.write_table(pa.table({"a": [3, None, 1], "b": ["x", "y", None]}), tmp_path / "t" / "1.parquet", write_statistics=False)
    pq.write_table(pa.table({"a": [7], "b": ["z"]}), tmp_path / "t" / "2.parquet")
    found = {r.name: r for r in footer_facts(spark, str(tmp_path / "t")).collect()}
    assert (found["a"].rows, found["a"].non_null, found["a"].low, found["a"].high) == (4, 3, 1.0, 7.0)
    assert found["b"].non_null == 3 and not found["a"].from_footers


# --- heavy values --------------------------------------------------------------------

@pytest.mark.parametrize("held", [30, 5000])
def test_heavy_values_are_exact(spark, held):
    rng = random.Random(3)
    values = [f"v{int(rng.paretovariate(0.7))}" for _ in range(20_000)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(6)
    counts = Counter(v for v in values if v is not None)
    wanted = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:15]
    got = sorted(heavy.heavy_values(df, "v", held=held).collect(), key=lambda r: r.rank)
    assert [(r.value, r.rows) for r in got] == wanted and [r.rank for r in got] == list(range(1, 16))
    assert math.isclose(got[0].share, wanted[0][1] / 20_000)


def test_values_that_are_all_as_common_are_counted(spark):
    df = spark.range(4000).select((F.col("id") % 2000).alias("v"))
    got = heavy.heavy_values(df, "v", top=3, held=10).collect()
    assert sorted((r.value, r.rows) for r in got) == [("0", 2), ("1", 2), ("10", 2)]
    assert heavy.heavy_values(df.limit(0), "v").count() == 0


def test_summaries_bound_every_count(spark):
    rng = random.Random(5)
    values = [str(int(rng.expovariate(0.01))) for _ in range(9000)]
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(4)
    rows = heavy.summaries(df, held=20).collect()
    error = sum(r.error for r in rows)
    seen = Counter()
    for r in rows:
        if r.value is not None:
            seen[r.value] += r.n
    assert error > 0 and len(rows) <= 4 * 21
    assert all(seen[v] <= n <= seen[v] + error for v, n in Counter(values).items())


# --- map cells -----------------------------------------------------------------------

def test_cells_count_every_place_once_a_level(spark):
    rng = random.Random(7)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(500)] + [(90.0, 180.0), (-90.0, -180.0), (95.0, 200.0), (None, 1.0), (math.nan, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double")
    cells = places.place_cells(df, "a", "b", depth=5).collect()
    for level in range(1, 6):
        mine = [c for c in cells if c.level == level]
        assert sum(c.n for c in mine) == 503 and all(len(c.cell) == level for c in mine)
        for c in mine:
            assert sum(d.n for d in cells if d.level == level + 1 and d.cell.startswith(c.cell)) in (c.n, 0)
    assert {c.cell for c in cells if c.level == 1} <= {"0", "1", "2", "3"}
    east, north = int(cells[0].cell[0]) % 2, int(cells[0].cell[0]) // 2
    one = next(c for c in cells if c.level == 1 and c.cell == cells[0].cell[0])
    assert (one.lon >= 0) == bool(east) and (one.lat >= 0) == bool(north)


def test_a_map_shows_rows_or_cells(spark):
    df = spark.range(900).select((F.col("id") % 90).cast("double").alias("lat"), (F.col("id") % 170).cast("double").alias("lon"))
    few = places.map_rows(df, "lat", "lon").collect()
    assert len(few) == 900 and all(r.n == 1 and r.valid == 900 for r in few)
    many = places.map_rows(df, "lat", "lon", most=40).collect()
    assert 10 < len(many) <= 40 and sum(r.n for r in many) == 900 and all(r.valid == 900 and r.passes for r in many)


# --- nested JSON ---------------------------------------------------------------------

def test_nested_values_are_clean(spark):
    schema = "a array<double>, m map<string,double>, s struct<t:timestamp_ntz,`x.y`:array<struct<d:date,f:float>>>, n map<date,int>"
    rows = [([1.0, math.nan, math.inf, None], {"k": math.nan, "j": 2.0}, (dt.datetime(2020, 1, 2, 3), [(dt.date(2020, 5, 6), math.nan), None]), {dt.date(2020, 1, 1): 3}),
            (None, None, None, None)]
    found = [json.loads(r.json) for r in src.to_json_rows(spark.createDataFrame(rows, schema)).collect()]
    assert found[0] == {"a": [1.0, None, None, None], "m": {"k": None, "j": 2.0}, "s": {"t": "2020-01-02T03:00:00", "x.y": [{"d": "2020-05-06", "f": None}, None]},
                        "n": {"2020-01-01": 3}}
    assert found[1] == {"a": None, "m": None, "s": None, "n": None}
