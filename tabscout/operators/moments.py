"""Co-moments of all pairs of columns, as one packed upper triangle per task.

A task goes through its rows once and keeps ten numbers for each pair: rows with both values,
two means, three sums of squares and products about them, and the extremes. Batches are matrix
products; states are merged by the rule for pairs of samples, first in shares, then in one task. So as
many rows as tasks are moved, whatever the number of rows and pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Rows of a state, in this order; lowest and highest values come last.
STATE = ("n", "mean_a", "mean_b", "aa", "bb", "ab", "low_a", "low_b", "high_a", "high_b")
#: Shares in which the states of tasks are merged first.
SHARES = 64


def batch_state(x: np.ndarray) -> np.ndarray:
    """The state of some rows; x: rows by columns, NaN where there is no value."""
    first, second = np.triu_indices(x.shape[1], 1)
    here = ~np.isnan(x)
    w = here.astype(float)
    count = here.sum(0)
    centre = np.divide(np.where(here, x, 0).sum(0), count, out=np.zeros(x.shape[1]), where=count > 0)
    y = np.where(here, x - centre, 0)
    n, s, q, p = w.T @ w, y.T @ w, (y * y).T @ w, y.T @ y
    low, high = (np.empty((x.shape[1],) * 2) for _ in range(2))
    for j in range(x.shape[1]):  # extremes of all columns where column j has a value
        both = here & here[:, j:j + 1]
        low[:, j] = np.where(both, x, np.inf).min(0, initial=np.inf)
        high[:, j] = np.where(both, x, -np.inf).max(0, initial=-np.inf)
    rows = n[first, second]
    over = np.divide(1, rows, out=np.zeros(len(rows)), where=rows > 0)
    a, b = s[first, second], s[second, first]
    return np.stack([
        rows, (centre[first] + a * over) * (rows > 0), (centre[second] + b * over) * (rows > 0),
        q[first, second] - a * a * over, q[second, first] - b * b * over, p[first, second] - a * b * over,
        low[first, second], low[second, first], high[first, second], high[second, first]])


def merged(one: np.ndarray | None, two: np.ndarray) -> np.ndarray:
    """The state of the rows of both."""
    if one is None:
        return two
    n = one[0] + two[0]
    part = np.divide(two[0], n, out=np.zeros(len(n)), where=n > 0)
    da, db = two[1] - one[1], two[2] - one[2]
    weight = one[0] * part
    return np.stack([
        n, one[1] + da * part, one[2] + db * part,
        one[3] + two[3] + da * da * weight, one[4] + two[4] + db * db * weight, one[5] + two[5] + da * db * weight,
        *np.minimum(one[6:8], two[6:8]), *np.maximum(one[8:], two[8:])])


def _packed(share: int, state: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([share], pa.int32()), pa.array([state.ravel().tolist()], pa.list_(pa.float64()))], ["share", "state"])


def co_moments(numbers: DataFrame) -> DataFrame:
    """One row per pair of columns, in order: pair, n, r, vary.

    numbers: columns of doubles; null and NaN are no value. r is Pearson's, null unless both columns
    vary over the rows where both have a value. Without rows there is no result."""
    pairs = len(numbers.columns) * (len(numbers.columns) - 1) // 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            if b.num_rows:
                state = merged(state, batch_state(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1).astype(float)))
        if state is not None:
            yield _packed(TaskContext.get().partitionId() % SHARES, state)

    def all_of(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        state = None
        for b in batches:
            for packed in b.column("state"):
                state = merged(state, packed.values.to_numpy().reshape(len(STATE), pairs))
        return state

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = all_of(batches)
        if state is not None:
            yield _packed(0, state)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = all_of(batches)
        if state is None:
            return
        n, _, _, aa, bb, ab, low_a, low_b, high_a, high_b = state
        vary = (low_a < high_a) & (low_b < high_b)
        size = np.sqrt(np.maximum(aa, 0)) * np.sqrt(np.maximum(bb, 0))
        r = np.divide(ab, size, out=np.zeros(pairs), where=size > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(pairs, dtype=np.int32)), pa.array(n.astype(np.int64)),
             pa.array(r, pa.float64(), mask=~(vary & (size > 0))), pa.array(vary)], ["pair", "n", "r", "vary"])

    kind = "share int, state array<double>"
    shares = numbers.mapInArrow(sums, kind).repartition("share").mapInArrow(merge, kind)
    return shares.repartition(1).mapInArrow(result, "pair int, n bigint, r double, vary boolean")
