"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all
pairs of features interact through vectors of low rank, in time linear in the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.llm.common import chunks, text_of
from tabscout.llm.textbytes import alnum_bytes, byte_table, nonspace_bytes, prefix_hash, span_hash, utf8, word_spans

#: Places that words are hashed to; the features of structure and metadata follow them.
WORD_PLACES = 1 << 14
#: Steps that each number about a text is cut into.
STEPS = 12
#: At most so many labelled texts of each class are learned from, those of least hash.
SAMPLE_PER_CLASS = 2500
RANK = 8
EPOCHS = 8
SEED = 7
STRUCTURE = ("bytes", "words", "word_length", "upper", "digits", "marks", "beyond_ascii", "blanks", "lines",
             "distinct_words", "same_as_last", "marked_words", "upper_words", "rare_marks")


def share_steps(x: np.ndarray) -> np.ndarray:
    """Shares of 0 to 1 in steps that are finer near 0."""
    return np.clip(np.ceil(np.sqrt(np.clip(x, 0, 1)) * (STEPS - 1)), 0, STEPS - 1).astype(np.int64)


def size_steps(x: np.ndarray) -> np.ndarray:
    """Sizes in powers of three."""
    return np.clip(np.floor(np.log1p(np.maximum(x, 0)) / np.log(3)), 0, STEPS - 1).astype(np.int64)


def features_of(column: pa.Array, metadata: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, value) of the features of many texts, ordered by text.

    A word's value is its damped count over the length of all of them; each step of
    structure or metadata has value 1. metadata: numbers of each text, NaN where unknown."""
    raw, at = utf8(column)
    n = len(column)
    text_of_byte = np.repeat(np.arange(n), np.diff(at))
    size = np.diff(at)

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.bincount(text_of_byte[mask], minlength=n)

    low = byte_table(np.ones(256, bool))[raw]
    starts, ends, first = word_spans(raw, at, alnum_bytes())
    words = np.diff(first)
    doc = np.repeat(np.arange(n), words)
    sums = prefix_hash(low)
    hashes = span_hash(sums, starts, ends)
    keys, counts = np.unique(doc * WORD_PLACES + (hashes % np.uint64(WORD_PLACES)).astype(np.int64), return_counts=True)
    key_doc, place = keys // WORD_PLACES, keys % WORD_PLACES
    value = np.log1p(counts)
    norm = np.sqrt(np.bincount(key_doc, value ** 2, minlength=n))
    value = value / norm[key_doc]
    s2, e2, first2 = word_spans(raw, at, nonspace_bytes())
    whole = np.diff(first2)
    doc2 = np.repeat(np.arange(n), whole)
    h2 = span_hash(sums, s2, e2)
    # Different words of each text: 40 bits tell the words of one text apart.
    pairs = (np.unique((doc2.astype(np.uint64) << np.uint64(40)) | (h2 >> np.uint64(24))) >> np.uint64(40)).astype(np.int64)
    again = np.zeros(len(h2), bool)
    again[1:] = (h2[1:] == h2[:-1]) & (doc2[1:] == doc2[:-1])
    marks = np.zeros(256, bool)
    marks[33:48] = marks[58:65] = marks[91:97] = marks[123:127] = True
    usual = np.zeros(256, bool)
    usual[[ord(c) for c in ".,;:'\"()-?"]] = True
    upper = np.zeros(256, bool)
    upper[65:91] = True
    is_mark, is_upper = marks[raw], upper[raw]
    mark_sum, upper_sum = np.concatenate([[0], np.cumsum(is_mark & ~usual[raw])]), np.concatenate([[0], np.cumsum(is_upper)])
    bytes_, w = np.maximum(size, 1), np.maximum(whole, 1)
    numbers = [
        size_steps(size), size_steps(whole), size_steps((size / w) ** 2),
        share_steps(per_text(is_upper) / bytes_), share_steps(per_text((raw >= 48) & (raw < 58)) / bytes_),
        share_steps(per_text(is_mark) / bytes_), share_steps(per_text(raw >= 128) / bytes_),
        share_steps(per_text((raw == 32) | (raw == 9)) / bytes_), size_steps(per_text(raw == 10)),
        share_steps(np.bincount(pairs, minlength=n) / w), share_steps(np.bincount(doc2[again], minlength=n) / w),
        share_steps(np.bincount(doc2[mark_sum[e2] > mark_sum[s2]], minlength=n) / w),
        share_steps(np.bincount(doc2[(upper_sum[e2] - upper_sum[s2]) * 2 > e2 - s2], minlength=n) / w),
        share_steps(per_text(is_mark & ~usual[raw]) / bytes_)]
    numbers += [np.where(np.isnan(m), 0, 1 + size_steps(np.nan_to_num(m)).clip(0, STEPS - 2)).astype(np.int64) for m in metadata]
    f = len(numbers)
    side_doc = np.repeat(np.arange(n), f)
    side = (WORD_PLACES + np.arange(f) * STEPS + np.stack(numbers, 1)).ravel() if n else np.zeros(0, np.int64)
    all_doc = np.concatenate([key_doc, side_doc])
    order = np.argsort(all_doc, kind="stable")
    return (all_doc[order], np.concatenate([place, side])[order],
            np.concatenate([value, np.full(len(side), 1 / np.sqrt(f))])[order].astype(np.float32))


@dataclass
class Machine:
    """Weights of a factorisation machine; its size does not depend on the data."""
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, doc: np.ndarray, place: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """One number per text; a text's features stand together."""
        out = np.bincount(doc, self.w[place] * value, minlength=n) + self.bias
        vx = self.v[place] * value[:, None]
        for f in range(vx.shape[1]):
            out += 0.5 * (np.bincount(doc, vx[:, f], minlength=n) ** 2 - np.bincount(doc, vx[:, f] ** 2, minlength=n))
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], places: int, rank: int = RANK, epochs: int = EPOCHS,
        rate: float = 0.1, decay: float = 1e-4) -> Machine:
    """Learn from (places, values, label) of each text by AdaGrad; classes weigh alike. Needs no order of its own."""
    rng = np.random.default_rng(SEED)
    m = Machine(0.0, np.zeros(places, np.float32), rng.normal(0, 0.05, (places, rank)).astype(np.float32))
    ones = sum(s[2] for s in samples)
    if not 0 < ones < len(samples):
        m.bias = 3.0 if ones else (-3.0 if samples else 0.0)
        m.v[:] = 0
        return m
    weigh = {1: len(samples) / (2 * ones), 0: len(samples) / (2 * (len(samples) - ones))}
    g_bias, g_w, g_v = 1.0, np.ones(places, np.float32), np.ones((places, rank), np.float32)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(samples)), max(1, len(samples) // 32)):
            size = [len(samples[i][0]) for i in batch]
            doc = np.repeat(np.arange(len(batch)), size)
            place = np.concatenate([samples[i][0] for i in batch])
            value = np.concatenate([samples[i][1] for i in batch])
            label = np.array([samples[i][2] for i in batch])
            err = (sigmoid(m.logits(doc, place, value, len(batch))) - label) * [weigh[y] for y in label.tolist()]
            vx = m.v[place] * value[:, None]
            total = np.stack([np.bincount(doc, vx[:, f], minlength=len(batch)) for f in range(rank)], 1)
            step = (err[doc] * value)
            used, where = np.unique(place, return_inverse=True)
            d_w = np.bincount(where, step) + decay * m.w[used]
            d_v = np.stack([np.bincount(where, step * (total[doc, f] - vx[:, f])) for f in range(rank)], 1) + decay * m.v[used]
            g_w[used] += d_w ** 2
            g_v[used] += d_v ** 2
            m.w[used] -= rate * 3 * d_w / np.sqrt(g_w[used])
            m.v[used] -= rate * d_v / np.sqrt(g_v[used])
            d = err.sum()
            g_bias += d ** 2
            m.bias -= rate * d / np.sqrt(g_bias)
    return m


def _rows(docs: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), F.xxhash64(text_of(f"`{text_col}`")).alias("text_hash"),
        text_of(f"`{text_col}`").alias("text"),
        F.array(*[F.col(f"`{m}`").cast("double") for m in metadata]).cast("array<double>").alias("metadata"))


def _numbers(b: pa.RecordBatch, k: int) -> list[np.ndarray]:
    flat = np.array(b.column("metadata").to_pylist(), np.float64).reshape(b.num_rows, k)
    return [flat[:, i] for i in range(k)]


def train(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column | None = None, id_col: str = "doc_id",
          text_col: str = "text", metadata: tuple[str, ...] = (), per_class: int = SAMPLE_PER_CLASS) -> Machine:
    """Learn from at most per_class labelled rows of each class, those whose ids have the least hash.

    usable: which rows of labels may be used. Rows without a label, or whose text is
    not in docs, teach nothing; with one class only, the machine always answers it, with
    no labels it answers 0.5. Only the sample's features come to the driver, at most
    WORD_PLACES numbers a text."""
    rows = labels if usable is None else labels.where(usable)
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    rows = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.col("id").cast("string"), F.lit(SEED))
    picked = rows.where("label = 1").orderBy(order, "id").limit(per_class).unionAll(
        rows.where("label = 0").orderBy(order, "id").limit(per_class))
    found = _rows(docs, id_col, text_col, metadata).join(F.broadcast(picked), "id")
    k = len(metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            doc, place, value = features_of(b.column("text"), _numbers(b, k))
            ends = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").cast(pa.string()), b.column("text_hash"), b.column("label"),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(value))],
                ["id", "text_hash", "label", "places", "values"])

    found = found.select("id", "text_hash", "text", "metadata", "label").mapInArrow(
        run, "id string, text_hash long, label int, places array<int>, values array<float>")
    got = found.toArrow().sort_by([("id", "ascending"), ("text_hash", "ascending")])
    samples = [(got["places"][i].values.to_numpy(), got["values"][i].values.to_numpy(), got["label"][i].as_py())
               for i in range(got.num_rows)]
    return fit(samples, WORD_PLACES + STEPS * (len(STRUCTURE) + k))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text",
          metadata: tuple[str, ...] = ()) -> DataFrame:
    """(id, text_hash, score) of every row, from whole texts; null counts as empty, null metadata as unknown."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = _rows(docs, id_col, text_col, metadata)
    k = len(metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            z = shared.value.logits(*features_of(b.column("text"), _numbers(b, k)), b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_hash"), pa.array(sigmoid(z))],
                                             ["id", "text_hash", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_hash long, score double")


def drop_rejected(docs: DataFrame, machine: Machine, threshold: float = 0.5, id_col: str = "doc_id",
                  text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """docs that score at least threshold; all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    k = len(metadata)

    def scores(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        rows = pa.RecordBatch.from_arrays([texts, numbers], ["text", "metadata"])
        for b in chunks(iter([rows]), "text"):
            out.append(sigmoid(shared.value.logits(*features_of(b.column("text"), _numbers(b, k)), b.num_rows)))
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    rows = F.array(*[F.col(f"`{m}`").cast("double") for m in metadata]).cast("array<double>")
    return docs.where(F.arrow_udf(scores, "double")(text_of(f"`{text_col}`"), rows) >= threshold)
