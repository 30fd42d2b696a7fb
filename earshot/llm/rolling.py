"""Vectorised hashing of UTF-8 byte strings: prefix sums, substrings, white-space words, word shingles.

A substring's hash is a polynomial in an odd base modulo 2**64, read off prefix sums and mixed afterwards, so that
all substrings of a batch cost a few numpy passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GOLDEN = np.uint64(0xBF58476D1CE4E5B9)
_SILVER = np.uint64(0x94D049BB133111EB)

_rng = np.random.default_rng(20240229)
#: A random word per byte value, so that short strings do not collide.
BYTE_WORD = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)

#: Byte classes: lower case of A-Z, and the white space of ``[\x20\x09-\x0D]``.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        for name, base in (("_powers", BASE), ("_inverses", BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= _GOLDEN
    x ^= x >> np.uint64(27)
    x *= _SILVER
    x ^= x >> np.uint64(31)
    return x


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """``P[i]``: sum of byte word times power over ``data[:i]``."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE_WORD[data] * powers(len(data))[0], out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, at_start: np.ndarray | None = None) -> np.ndarray:
    """Mixed hashes of ``data[start:end]``; equal strings have equal hashes wherever they stand.

    ``at_start``: the prefix at ``start``, where it is known.
    """
    out = prefix[end] - (prefix[start] if at_start is None else at_start)
    out *= powers(len(prefix))[1][start]
    out += (end - start).astype(np.uint64) * _SILVER
    return mix(out)


def length_word(size: int) -> np.uint64:
    """What the hash of a substring of ``size`` adds for its length before it is mixed."""
    return np.uint64(size * int(_SILVER) % (1 << 64))


def buffer_of(column: pa.Array, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of rows ``begin:end`` as one array, and where each row starts (null: empty)."""
    part = column.slice(begin, end - begin).cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
    raw = part.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes outside ``gap``) and the number of words of every row."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offsets) - 1, dtype=np.int64)
    inside = ~gap[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inside[firsts]
    ends[firsts[firsts > 0] - 1] = inside[firsts[firsts > 0] - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.diff(np.searchsorted(starts, offsets))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` lower-cased words, and how many each row has.

    A row of fewer words has one run, its whole sequence; a row without words none.
    """
    data = LOWER[data]
    starts, ends, counts = word_bounds(data, offsets)
    words = substring_hashes(prefix_hashes(data), starts, ends)
    row_first = np.concatenate(([0], np.cumsum(counts)))
    n_out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    firsts = np.repeat(row_first[:-1], n_out) + ragged_arange(n_out)
    length = np.repeat(np.minimum(counts, size), n_out)
    out = length.astype(np.uint64)
    for k in range(size):
        on = length > k
        out[on] = mix(out[on] * _GOLDEN + words[firsts[on] + k])
    return out, n_out


def ragged_arange(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every c of ``counts``, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
