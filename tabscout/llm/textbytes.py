"""Words and hashes of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Powers of both that a worker keeps: 5 MB, enough for a piece of texts and some more.
KEPT_POWERS = 5 << 16


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins (one more than texts)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def byte_table(word: np.ndarray) -> np.ndarray:
    """Each byte with A-Z lower-cased; `word` is unused for bytes outside words."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return np.where(word, table, 32).astype(np.uint8)


def alnum_bytes() -> np.ndarray:
    """Bytes of words made of letters, digits and everything beyond ASCII."""
    word = np.zeros(256, bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    return word


def nonspace_bytes() -> np.ndarray:
    """Bytes of words that only blanks, tabs and line ends part."""
    word = np.ones(256, bool)
    word[[32, 9, 10, 11, 12, 13]] = False
    return word


def word_spans(raw: np.ndarray, at: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of its first word (one more than texts)."""
    inside = word[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return (np.multiply.accumulate(np.full(n, BASE, U)), np.multiply.accumulate(np.full(n, BASE_INVERSE, U)))


@lru_cache(maxsize=1)
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(KEPT_POWERS)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; a table of fixed size is kept, longer ones are not."""
    up, down = _kept_powers() if n <= KEPT_POWERS else _powers(n)
    return up[:n], down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Running sums of the polynomial hash, one more than bytes."""
    out = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * powers(len(raw))[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes from each start to its end, equal for equal bytes."""
    down = powers(len(sums))[1]
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_hash(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every `width` hashes in a row; as many as words, the last ones wrap to nothing."""
    out = words * U(0xFF51AFD7ED558CCD)
    for k in range(1, width):
        out[:-k] += words[k:] * U((0xC4CEB9FE1A85EC53 * (2 * k + 1)) % (1 << 64))
    return mixed(out + U(width))


def has_bit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit that each hash points to is set; bits: a power of two of them, in 64-bit words."""
    place = h & U(len(bits) * 64 - 1)
    return (bits[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) == U(1)
