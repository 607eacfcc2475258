"""Groups of spelling variants: words that differ by one edit, found in a reduced alphabet.

Letters are hashed to SYMBOLS symbols. Words one edit apart are one edit apart, or equal, in
the reduced alphabet too. So every word's reduced form gives its full neighbourhood (itself, all
deletions, replacements and insertions of symbols), which is joined with the reduced vocabulary;
what meets there is compared letter by letter. No pair is missed, and hashes that are equal
by chance only cost a comparison.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.llm.common import chunks, filter_bits, landed, text_of
from tabscout.llm.textbytes import BASE, BASE_INVERSE, U, has_bit, mixed, powers

SYMBOLS = 12
#: Least code points and occurrences of a word; a form has at least so many times the occurrences.
LEAST_LETTERS, LEAST_COUNT, FORM_RATIO = 5, 3, 2
#: One in so many (document, run) pairs is written with a letter left out.
SLIP = 97
#: Bits of the filter of reduced words: 8 MB on the executors, whatever the vocabulary.
NEAR_BITS = 1 << 26
#: Counts are given out when so many letters of words have been gathered, and letters compared at a time.
HELD_LETTERS, BATCH_LETTERS = 4 << 20, 1 << 16

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
RUNS = re.compile("[a-zÀ-ÿ]+")
#: A 64-bit number for each symbol.
VALUES = mixed(np.arange(1, 257, dtype=U) * U(BASE))


def words_of(ident: str, text: str, slip: int = SLIP) -> Counter[str]:
    """The words of one text and their counts, slips of the pen included."""
    found = Counter(RUNS.findall(text.encode().translate(LOWER).decode()))
    if not slip:
        return found
    before = zlib.crc32(f"{ident}:".encode())
    out: Counter[str] = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), before)
        if h % slip == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int = SLIP) -> DataFrame:
    """(word, n) of all words with enough letters and occurrences, counted over all texts."""
    rows = docs.select(text_of(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        letters = 0
        for b in chunks(batches, "text"):
            for ident, text in zip(b.column("id"), b.column("text")):
                for word, n in words_of(ident.as_py(), text.as_py(), slip).items():
                    if len(word) >= LEAST_LETTERS:
                        if word not in counts:
                            letters += len(word)
                        counts[word] += n
                if letters > HELD_LETTERS:
                    yield counted(counts)
                    counts, letters = Counter(), 0
        yield counted(counts)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def reduced(words: list[str], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all words end to end, and where each begins (one more than words)."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)]).astype(np.int64)
    return (points % symbols).astype(np.int64), at


def reduced_hash(symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each reduced word."""
    up = powers(int(np.diff(at).max(initial=0)))[0]
    sums = np.concatenate([np.zeros(1, U), np.cumsum(VALUES[symbol] * up[np.arange(len(symbol)) - np.repeat(at[:-1], np.diff(at))], dtype=U)])
    return mixed(sums[at[1:]] - sums[at[:-1]])


def neighbourhood(symbol: np.ndarray, at: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word number, hash) of every reduced word that is at most one edit away, each once a word, in parts."""
    size = np.diff(at)
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(symbol)) - at[word]
    up = powers(int(size.max(initial=0)) + 1)[0]
    sums = np.concatenate([np.zeros(1, U), np.cumsum(VALUES[symbol] * up[place], dtype=U)])
    whole = sums[at[1:]] - sums[at[:-1]]
    head = sums[:-1] - sums[at[word]]  # what stands before each letter, and from it on
    tail = whole[word] - head
    every = np.arange(len(size))
    yield every, mixed(whole)
    # Of equal symbols in a row the first is left out; one more of them is put in behind the last.
    first = np.ones(len(symbol), bool)
    first[1:] = (place[1:] == 0) | (symbol[1:] != symbol[:-1])
    yield word[first], mixed((head + (tail - VALUES[symbol] * up[place]) * U(BASE_INVERSE))[first])
    shifted = head + tail * U(BASE)
    for c in range(symbols):
        other = symbol != c
        yield word[other], mixed((whole[word] + (VALUES[c] - VALUES[symbol]) * up[place])[other])
        yield word[other], mixed((shifted + VALUES[c] * up[place])[other])
        yield every, mixed(whole + VALUES[c] * up[size])


def batches_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most BATCH_LETTERS letters, or one word."""
    yield from chunks(iter([batch]), "word", BATCH_LETTERS)


def keyed_words(words: DataFrame, symbols: int) -> DataFrame:
    """(word, n, key): words with the hash of their reduced form."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole):
                key = reduced_hash(*reduced(b.column("word").to_pylist(), symbols))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key.view(np.int64))], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


def near_keys(words: DataFrame, symbols: int) -> DataFrame:
    """(word, key): of every word's reduced neighbourhood what may be in the reduced vocabulary.

    A filter of fixed size lets all that are in it pass, and few others while it is not full."""
    bits = words.sparkSession.sparkContext.broadcast(filter_bits(words.select(F.col("key").alias("hash")), NEAR_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in batches_of(whole):
                names = b.column("word")
                for word, key in neighbourhood(*reduced(names.to_pylist(), symbols), symbols):
                    kept = has_bit(bits.value, key)
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(word[kept])), pa.array(key[kept].view(np.int64))], ["word", "key"])

    return words.select("word").mapInArrow(run, "word string, key long")


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes a into b; in time linear in their length."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + len(a) + 1 - len(b):] == b[at + 1:]


def one_edits(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(map(one_edit, left.to_pylist(), right.to_pylist()), pa.bool_())


def shuffled(words: DataFrame) -> DataFrame:
    """words, to be joined by sorting both sides.

    Spark goes by the size of files, also for the many keys that are made of each word, and would broadcast tables that take many times as much in memory."""
    return words.hint("merge")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, near, near_n) of all words that differ by one inserted, deleted or replaced letter; both directions.

    words: columns word and n, each word once."""
    known = landed(keyed_words(words, symbols))
    met = near_keys(known, symbols).join(shuffled(known.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")), "key")
    return met.where(F.arrow_udf(one_edits, "boolean")("word", "near")).select("word", "near", "near_n")


def forms(words: DataFrame, pairs: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """(word, n, form, form_n, n_near) of every word; its form is its commonest near word, if common enough.

    A word has at most some hundred near words for each of its letters, so they meet in one place."""
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = pairs.groupBy("word").agg(F.size(F.collect_set("near")).cast("long").alias("n_near"), best.alias("best"))
    much = -F.col("best.less") >= ratio * F.col("n")
    return words.join(shuffled(near), "word", "left").select(
        "word", "n", F.when(much, F.col("best.form")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: where following forms ends.

    Forms are ever commoner words, so no circle is met; each step doubles the way that is gone."""
    ways = landed(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = landed(ways.join(shuffled(ahead), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("gone_on")))
        ways = steps.select("word", "root")
        if steps.where("gone_on").isEmpty():
            return ways


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", symbols: int = SYMBOLS, slip: int = SLIP) -> DataFrame:
    """One row per word of all texts: word, form, root, n, n_near, form_n.

    Words are runs of letters A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, with at least
    LEAST_LETTERS code points and LEAST_COUNT occurrences over all rows. Where slip divides the CRC32 of
    `<id>:<run>`, the run's code point at that number modulo its length is left out first; slip=0 leaves runs
    as they are. Null texts have no words, null ids count as empty, repeated rows count each time.
    Of near words of equal counts the first in code-point order is the form. An
    empty table gives no rows. Words of any length are compared whole."""
    words = landed(vocabulary(docs, id_col, text_col, slip))
    found = landed(forms(words, near_pairs(words, symbols)))
    return found.join(shuffled(roots(found)), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variant_groups(found: DataFrame) -> DataFrame:
    """(root, members, n): how many spellings and occurrences each root has, from variants()."""
    return found.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("n"))
