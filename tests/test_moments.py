from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest

from tabscout.operators import moments as mo
from tabscout.operators.ranges import pair_correlations


def some_rows(n=700):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        x = rng.gauss(0, 1)
        rows.append((x, 1e9 + x + rng.gauss(0, 0.1), None if i % 3 else -x, 0.1, math.nan if i % 5 else rng.random(),
                     None if i % 100 else 7.0, math.inf if i == 4 else float(i)))
    return rows


NAMES = ["a", "far", "sparse", "flat", "nan", "rare", "row"]


@pytest.mark.parametrize("parts", [1, 9])
def test_pairs_match_numpy(spark, parts):
    rows = some_rows()
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in NAMES)).repartition(parts)
    x = pd.DataFrame(rows, columns=NAMES, dtype=float).replace([np.inf], np.nan)
    found = {(r.x, r.y): r for r in pair_correlations(df, NAMES).collect()}
    assert len(found) == 21
    for (a, b), r in found.items():
        both = x[[a, b]].dropna()
        assert r.n == len(both)
        if both.nunique().min() < 2:
            assert r.r is None and r.score is None and not r.passes
        else:
            assert math.isclose(r.r, np.corrcoef(both[a], both[b])[0, 1], abs_tol=1e-6 if "far" in (a, b) else 1e-12)
    assert {r.n for r in pair_correlations(df.limit(0), NAMES).collect()} == {0}


def test_states_merge_as_if_all_rows_were_seen_together():
    x = np.array([[math.nan if v is None or not math.isfinite(v) else v for v in r] for r in some_rows(300)])
    whole = mo.batch_state(x)
    for cuts in ([100, 101, 250], [0, 300], [1]):
        state = None
        for part in np.split(x, cuts):
            state = mo.merged(state, mo.batch_state(part))
        np.testing.assert_allclose(state, whole, rtol=1e-9, atol=1e-4)


def test_a_task_gives_one_row(spark):
    df = spark.range(10_000).selectExpr("cast(id as double) a", "cast(id % 7 as double) b", "cast(-id as double) c").repartition(5)
    text = pair_correlations(df, ["a", "b", "c"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "HashAggregate" not in text
