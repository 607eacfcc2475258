"""Byte-level BPE encoding with an index of pair occurrences, and decoding.

The new words of a piece of a partition are encoded together. An index maps each pair
of neighbouring symbols that has a merge to all its positions. The active merges are
applied in ascending rank, each to its whole list, and the lists of the pairs that
appear are extended. As every symbol is made by an earlier merge than those that use
it, a merge never brings back a pair of lower rank, so one pass is exact.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscout.llm.common import chunks, text_of

#: How byte-level models cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose new words are encoded together.
PIECE_BYTES = 1 << 19
#: Words kept encoded from one piece to the next; when there are more, all are forgotten.
CACHED_WORDS = 50_000
#: What the shift leaves for a symbol's id in a pair's key.
SHIFT = 32


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE model from the JSON text of a tokenizer."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and not any(model.get(k) for k in (
            "dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
            and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
            and spec.get("normalizer") is None)
        added = spec.get("added_tokens", [])
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("only plain byte-level BPE models are read")
        ids: dict[str, int] = model["vocab"]
        of_symbol = {c: b for b, c in enumerate(byte_symbols())}
        self.first = [ids[c] for c in byte_symbols()]
        self.token_bytes: dict[int, bytes] = {i: bytes(of_symbol[c] for c in t) for t, i in ids.items()}
        keys, new_ids = [], []
        made: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, new = ids[a], ids[b], ids[a + b]
            if max(made.get(left, -1), made.get(right, -1)) >= rank or made.setdefault(new, rank) != rank:
                raise ValueError("a merge uses a symbol that a later one makes")
            keys.append(left << SHIFT | right)
            new_ids.append(new)
        #: By rank: the pair and what it becomes.
        self.pairs, self.becomes = keys, new_ids
        #: Pairs in order of their key, with their ranks; the last stands for keys beyond all.
        self.ranks = np.append(np.argsort(np.array(keys, np.int64)), 0)
        self.keys = np.append(np.array(keys, np.int64)[self.ranks[:-1]], -1)
        self.special = {t["content"]: t["id"] for t in added}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        strings = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.cut = regex.compile(f"({'|'.join(strings)})") if strings else None
        self.words = regex.compile(PATTERN)
        tokens = [self.token_bytes.get(i, b"") for i in range(max(self.token_bytes) + 1)]
        self.byte_counts = np.array([len(t) for t in tokens], np.int64)
        self.byte_begins = np.cumsum(self.byte_counts) - self.byte_counts
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        """Drop the words encoded so far; the added tokens are words with one id."""
        self.numbers: defaultdict[str, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids = np.array(list(self.special.values()), np.int32)
        self.sizes = np.ones(len(self.special), np.int64)

    def ranks_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs have merges, and the ranks of those."""
        place = np.searchsorted(self.keys[:-1], keys)
        hit = self.keys[place] == keys
        return hit, self.ranks[place[hit]]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the words end to end, and how many each has."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(w) for w in raw], np.int64)
        n = int(lengths.sum()) + len(raw) + 1
        # A separator before the first word and after each.
        symbols = np.full(n, -1, np.int64)
        inside = np.ones(n, bool)
        inside[0] = False
        inside[np.cumsum(lengths + 1)] = False
        symbols[inside] = np.array(self.first, np.int64)[np.frombuffer(b"".join(raw), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        both = np.flatnonzero(inside[:-1] & inside[1:])
        hit, ranks = self.ranks_of(symbols[both] << SHIFT | symbols[both + 1])
        order = np.argsort(ranks, kind="stable")
        places, ranks = both[hit][order], ranks[order]
        heads = np.flatnonzero(np.diff(ranks, prepend=-1))
        #: The positions of each pair, by its rank.
        at = {int(ranks[h]): p.tolist() for h, p in zip(heads, np.split(places, heads[1:]))} if len(heads) else {}
        active = list(at)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            pair, new = self.pairs[rank], self.becomes[rank]
            left, right = pair >> SHIFT, pair & ((1 << SHIFT) - 1)
            i = np.array(at.pop(rank))
            j = after[i]
            live = (symbols[i] == left) & (symbols[j] == right)
            if left == right:
                i, j = _apart(i[live], after)
            elif not live.all():
                i, j = i[live], j[live]
            if not len(i):
                continue
            symbols[i], symbols[j] = new, -2
            k = after[j]
            after[i], before[k] = k, i
            h = before[i]
            on_right, on_left = symbols[k], symbols[h]
            r, l = on_right >= 0, (on_left >= 0) & (on_left != new)
            keys = np.concatenate([new << SHIFT | on_right[r], on_left[l] << SHIFT | new])
            hit, ranks = self.ranks_of(keys)
            for made, place in zip(ranks.tolist(), np.concatenate([i[r], h[l]])[hit].tolist()):
                if made in at:
                    at[made].append(place)
                else:
                    at[made] = [place]
                    heapq.heappush(active, made)
        kept = symbols >= 0
        counts = np.add.reduceat(kept, np.cumsum(lengths + 1) - lengths, dtype=np.int64) if len(raw) else lengths
        return symbols[kept].astype(np.int32), np.where(lengths > 0, counts, 0)

    def word_numbers(self, text: str) -> np.ndarray:
        """The numbers of the words of a text, in order."""
        pieces = self.cut.split(text) if self.cut else [text]
        number = self.numbers.__getitem__
        words: list[int] = []
        for n, piece in enumerate(pieces):
            words += [number(piece)] if n % 2 else map(number, self.words.findall(piece))
        return np.array(words, np.int64)

    def encode(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the texts end to end, and how many each has."""
        if len(self.numbers) > CACHED_WORDS:
            self.forget()
        if not self.numbers:
            for t in self.special:
                self.numbers[t]
        per_text = [self.word_numbers(t) for t in texts]
        new = list(islice(self.numbers, len(self.sizes), None))
        if new:
            ids, sizes = self.encode_words(new)
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        words = np.concatenate([np.zeros(0, np.int64), *per_text])
        begin, n = (np.cumsum(self.sizes) - self.sizes)[words], self.sizes[words]
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(begin - (ends - n), n) + np.arange(n.sum())]
        edge = np.cumsum([0, *[len(w) for w in per_text]])
        return flat, np.diff(np.concatenate([[0], ends])[edge])

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The texts of ids end to end, of which each text has so many."""
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.byte_counts) or not self.byte_counts[flat].all()):
            raise ValueError("an id that the vocabulary lacks")
        n = self.byte_counts[flat]
        ends = np.cumsum(n)
        total = int(n.sum())
        raw = self.pool[np.repeat(self.byte_begins[flat] - (ends - n), n) + np.arange(total)].tobytes()
        cut = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cut.tolist(), cut[1:].tolist())]


def _apart(i: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of one symbol, from the left, those that share no position with one taken."""
    taken, last = [], -1
    for p in np.sort(i).tolist():
        if p != last:
            taken.append(p)
            last = int(after[p])
    taken = np.array(taken, np.int64)
    return taken, after[taken]


@lru_cache(maxsize=2)
def vocabulary(text: str) -> Vocabulary:
    return Vocabulary(text)


def tokenizer_text(path: str) -> str:
    """A tokenizer's JSON, read on the driver; a vocabulary has a fixed size of a few MB."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "token_ids",
           decoded_col: str | None = None) -> DataFrame:
    """docs with the token ids of each whole text in place of the text column; null counts as empty.

    Strings of added tokens in a text become those tokens; no others are added, nothing
    is cut or padded. An empty text has an empty array. decoded_col names a column for what
    the ids decode to. Other columns, whatever their names, stay."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_text(path))
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    packed = docs.select(F.struct(*rest).alias("rest") if rest else F.lit(None).cast("struct<none:int>").alias("rest"),
                         text_of(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(shared.value)
        for b in chunks(batches, "text", PIECE_BYTES):
            flat, sizes = model.encode(b.column("text").to_pylist())
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            columns = [b.column("rest"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            if decoded_col:
                columns.append(pa.array(model.decode(flat, sizes), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["rest", "ids", "decoded"][:len(columns)])

    kind = packed.schema["rest"].dataType.simpleString()
    found = packed.mapInArrow(run, f"rest {kind}, ids array<int>" + ", decoded string" * bool(decoded_col))
    return found.select(*([F.col("rest.*")] if rest else []), F.col("ids").alias(ids_col),
                        *([F.col("decoded").alias(decoded_col)] if decoded_col else []))


def decode(df: DataFrame, path: str, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """df with the text of each array of ids besides; null has null, broken UTF-8 has U+FFFD, unknown ids fail."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_text(path))

    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = vocabulary(shared.value)
        for arrays in batches:
            out: list[str] = []
            for start in range(0, len(arrays), 256):
                part = arrays.slice(start, 256)
                sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                out += model.decode(part.flatten().to_numpy(zero_copy_only=False), sizes)
            yield pa.array([t if ok else None for t, ok in zip(out, arrays.is_valid().to_pylist())], pa.string())

    return df.withColumn(text_col, F.arrow_udf(texts, "string")(F.col(f"`{ids_col}`")))
