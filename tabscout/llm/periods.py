"""Periodic runs of words, by maximal pairs from an LCP-interval tree.

A run with period q is a stretch whose words q apart are alike and that cannot be
extended. Its start and the place q further on are a maximal pair: what follows them is alike for
length - q words and no longer, and the words before them differ. So all maximal
pairs (i, j) whose common words l are at least LEAST_PERIODS - 1 times their distance
are runs from i to j + l as they stand, and all runs are among them; of pairs with the same
stretch the one with the least distance has the run's period.

The pairs come from the intervals of a suffix array, deepest first. Each interval keeps its
places in lists by the word to their left; where two children meet, a place of the smaller one
looks for places that are near enough in the other's lists of other left words.

Only parts of texts where a run can be are sorted: for q from Q up to 2 Q, a run has
over 2 Q places in a row whose next Q words stood less than 2 Q places before. One pass for
each power of two finds these, with hashes of 16 bits that may let more pass but never less.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.llm.common import chunks, text_of
from tabscout.llm.textbytes import U, mixed

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: What the first words of a maximal pair have in common at least: with a distance of 1, LEAST_WORDS words.
LEAST_COMMON = LEAST_WORDS - 1
#: Bytes of text that are taken apart into words at a time.
SPLIT_BYTES = 1 << 20

SPACE = re.compile(rb"[\x20\x09-\x0D]")

Runs = list[tuple[int, int, int]]


def word_numbers(raw: bytes, numbers: dict[bytes, int]) -> np.ndarray:
    """The words of a text as numbers; numbers gets those that are new."""
    parts, at = [], 0
    while at < len(raw):
        cut = SPACE.search(raw, at + SPLIT_BYTES)
        end = cut.start() if cut else len(raw)
        parts.append(np.array(list(map(numbers.__getitem__, raw[at:end].split())), np.int32))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def planted(words: np.ndarray, ident: str) -> np.ndarray:
    """The words of a text, made periodic from some place on if ten divides the id's CRC32."""
    h = zlib.crc32(ident.encode())
    if h % 10 or not len(words):
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = words.copy()
    out[a:] = words[a + np.arange(n - a) % p]
    return out


def regions(words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, stop) of texts end to end that hold every run whole, with a word more on either side; apart from each other.

    words: each text is followed by one number that is nowhere else."""
    stop = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1)
    of = np.arange(len(words))
    left, size, gram = stop - of, np.repeat(sizes, sizes + 1), mixed(words.astype(U) + U(1))
    begin = stop - size
    found: list[np.ndarray] = []
    scale = 1
    while True:
        kept = size >= LEAST_PERIODS * scale
        if not kept.any():
            break
        if not kept.all():
            of, left, size, gram = of[kept], left[kept], size[kept], gram[kept]
        short = (gram >> U(48)).astype(np.uint16)
        order = np.argsort(short, kind="stable")
        near = np.zeros(len(of) + 2, bool)
        near[1:-1][order[1:][(short[order[1:]] == short[order[:-1]]) & (np.diff(order) < 2 * scale)]] = True
        near[1:-1] &= left >= scale
        edge = np.flatnonzero(near[1:] != near[:-1])
        first, last = edge[::2], edge[1::2]
        long = last - first >= max((LEAST_PERIODS - 2) * scale + 1, (LEAST_WORDS - 1) * (scale == 1))
        first, last = of[first[long]], of[last[long] - 1] + 1
        found.append(np.stack([np.maximum(first - 2 * scale, begin[first]), np.minimum(last + scale, stop[first])], 1))
        nxt = np.zeros_like(gram)
        nxt[:-scale or None] = gram[scale:]
        gram = mixed(gram * U(0xFF51AFD7ED558CCD) + nxt)
        scale *= 2
    parts = np.concatenate([np.zeros((0, 2), np.int64), *found])
    out: list[tuple[int, int]] = []
    for a, z in parts[np.argsort(parts[:, 0], kind="stable")].tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def suffixes(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of t, and how many numbers each suffix has in common with the next one, by doubling.

    t ends on a number that is nowhere else."""
    rank = np.unique(t, return_inverse=True)[1].astype(np.int32)
    levels, width = [rank], 1
    while True:
        ahead = np.zeros(len(t), np.int64)
        ahead[:-width or None] = rank[width:].astype(np.int64) + 1
        key = rank.astype(np.int64) * (len(t) + 1) + ahead
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(t), np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if rank[order[-1]] == len(t) - 1:
            break
        levels.append(rank)
        width *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(t) - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (levels[k][a] == levels[k][b]).astype(np.int64) << k
        common += same
        a += same
        b += same
    return order, common


class Interval:
    """Places whose suffixes begin alike, in ascending lists by the word to their left."""

    __slots__ = ("lists", "size")

    def __init__(self, left: int, place: int):
        self.lists = {left: [place]}
        self.size = 1

    def near(self, place: int, left: int, reach: int, tree: "Tree") -> Iterator[int]:
        """Places at most reach away with another word to their left: by lists, or place by place if that is less."""
        if len(self.lists) > 2 * reach:
            for k in range(max(place - reach, 0), min(place + reach + 1, len(tree.owner))):
                if tree.owner[k] is self and tree.before[k] != left:
                    yield k
            return
        for word, places in self.lists.items():
            if word != left:
                k = bisect_left(places, place - reach)
                while k < len(places) and places[k] <= place + reach:
                    yield places[k]
                    k += 1


class Tree:
    """The intervals of a suffix array, deepest first, and the runs that their maximal pairs are."""

    def __init__(self, before: list[int]):
        """before: the word to the left of each place; a number of its own at the start of a text."""
        self.before = before
        self.owner: list[Interval | None] = [None] * len(before)
        #: (start, stop) and period.
        self.runs: dict[tuple[int, int], int] = {}

    def leaf(self, place: int) -> Interval:
        self.owner[place] = out = Interval(self.before[place], place)
        return out

    def joined(self, one: Interval, other: Interval, common: int) -> Interval:
        """Two children in one, after the maximal pairs between them have been looked at."""
        large, small = (one, other) if one.size >= other.size else (other, one)
        reach = common // (LEAST_PERIODS - 1)
        for left, places in small.lists.items():
            for p in places:
                for k in large.near(p, left, reach, self):
                    i, j = (p, k) if p < k else (k, p)
                    at = (i, j + common)
                    if self.runs.get(at, j + 1) > j - i:
                        self.runs[at] = j - i
        for left, places in small.lists.items():
            for p in places:
                self.owner[p] = large
            mine = large.lists.get(left)
            if mine is None:
                large.lists[left] = places
            elif len(places) == 1:
                insort(mine, places[0])
            else:
                mine += places
                mine.sort()  # two sorted lists: merged
        large.size += small.size
        return large

    def walk(self, order: list[int], common: list[int]) -> dict[tuple[int, int], int]:
        """(start, stop) and period of all runs; order and common as suffixes() gives them."""
        stack: list[tuple[int, Interval]] = []
        for k, place in enumerate(order):
            l = common[k] if k < len(common) else 0
            if l < LEAST_COMMON and not stack:
                continue  # alone
            here = self.leaf(place)
            while stack and stack[-1][0] > l:
                depth, above = stack.pop()
                here = self.joined(above, here, depth)
            if l < LEAST_COMMON:
                stack.clear()
            elif stack and stack[-1][0] == l:
                stack[-1] = (l, self.joined(stack[-1][1], here, l))
            else:
                stack.append((l, here))
        return self.runs


def runs_of(texts: list[np.ndarray]) -> list[Runs]:
    """(start, length, period) of all runs of each text, by start, then period; a text is an array of word numbers."""
    out: list[Runs] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(sizes) or sizes.max() < LEAST_WORDS:
        return out
    top = max(int(t.max()) for t in texts if len(t)) + 1
    words = np.empty(int(sizes.sum()) + len(sizes), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    words[ends] = top + np.arange(len(sizes))
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = np.concatenate(texts)
    parts = regions(words, sizes)
    if not parts:
        return out
    top += len(sizes)
    # The regions end to end, each followed by a number of its own.
    t = np.concatenate([x for k, (a, z) in enumerate(parts) for x in (words[a:z], [top + k])])
    came = np.concatenate([np.arange(a, z + 1) for a, z in parts])
    order, common = suffixes(t)
    before = words[came - 1]
    before[came == 0] = -1
    found = Tree(before.tolist()).walk(order.tolist(), common.tolist())
    begin = ends - sizes
    for (start, stop), period in found.items():
        at = int(came[start])
        k = int(np.searchsorted(ends, at))
        out[k].append((at - int(begin[k]), stop - start, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def dropped(n: int, runs: Runs) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:-1] > 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, runs, collapsed.

    Words are what white space (space, tab, line ends) parts. runs: start, length, period
    in words, of all runs of at least LEAST_WORDS words and LEAST_PERIODS periods, by start, then period.
    collapsed: the words joined by one space, without those that a run has after its first period.
    plant makes the texts of some ids periodic before (see planted). Null texts
    have no words, null ids count as empty; repeated rows are each worked on; texts of any length are taken whole, with some hundred bytes
    of memory for each word of their periodic parts. An empty table gives no rows."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{id_col}`").alias("ident"), text_of(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            numbers: dict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__
            texts = [word_numbers(x.as_buffer().to_pybytes(), numbers) for x in b.column("text").cast(pa.binary())]
            if plant:
                texts = [planted(t, i) for t, i in zip(texts, b.column("ident").to_pylist())]
            names = list(numbers)
            found = runs_of(texts)
            kept = [t[~dropped(len(t), runs)] if runs else t for t, runs in zip(texts, found)]
            flat = [r for runs in found for r in runs]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
            columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array([len(t) for t in texts], pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, ["start", "length", "period"])),
                 pa.array([b" ".join(map(names.__getitem__, k.tolist())) for k in kept], pa.binary()).cast(pa.string())],
                ["id", "n_words", "runs", "collapsed"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def longest_run():
    """Of the column `runs` the longest; of equal ones the first by start, then period. Null without runs."""
    return F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
