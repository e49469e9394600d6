"""Vectorised word and hash helpers over the UTF-8 bytes of Arrow string columns.

All operators that work on words look at bytes: every separator class they use is ASCII, and
no byte of a multi-byte UTF-8 character is an ASCII byte, so byte classes and character
classes agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK = 1 << 18  # bytes (or words) handled by one vectorised step; bounds temporary arrays
CHUNK = 4 << 20  # bytes of text handled together; a longer document makes its own chunk

_P = 0x9E3779B97F4A7C55  # odd multipliers: invertible modulo 2**64
_Q = 0xD1342543DE82EF95


def _class(pattern: set[int]) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(pattern)] = False
    return t


# Words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (the latter after lower-casing).
NON_SPACE = _class({0x20, *range(0x09, 0x0E)})
ALNUM = _class({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U64)
    p[0] = 1
    return np.cumprod(p, dtype=U64)


class _Table:
    """Powers of a multiplier and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.p = self.q = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) < n:
            size = max(n, BLOCK + 1024)
            self.p, self.q = _powers(self.base, size), _powers(self.inv, size)
        return self.p, self.q


_BYTES, _WORDS = _Table(_P), _Table(_Q)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (a bijection)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def string_chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets) of consecutive rows; null reads as empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if len(arr) == 0:
        return
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = int(np.searchsorted(off, off[lo] + most, side="right")) - 1
        hi = min(len(arr), max(hi, lo + 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Byte starts and ends of all words, and the index of each document's first word."""
    w = is_word[data]
    if len(w) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty(len(w), bool)
    before[0], before[1:] = False, w[:-1]
    before[offsets[:-1][offsets[:-1] < len(w)]] = False
    after = np.empty(len(w), bool)
    after[-1], after[:-1] = False, w[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes: a polynomial by prefix sums, then mixed."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        p, q = _BYTES.upto(b - a + 1)
        s = np.empty(b - a + 1, U64)
        s[0] = 0
        np.cumsum((data[a:b].astype(U64) + U64(1)) * p[: b - a], out=s[1:])
        lo, hi = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((s[hi] - s[lo]) * q[lo] + (hi - lo).astype(U64))
        i = j
    return out


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes (one result per start, whole array)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.empty(n, U64)
    for i in range(0, n, BLOCK):
        j = min(n, i + BLOCK)
        p, q = _WORDS.upto(j - i + k)
        s = np.empty(j - i + k, U64)
        s[0] = 0
        np.cumsum(h[i : j + k - 1] * p[: j - i + k - 1], out=s[1:])
        out[i:j] = mix((s[k:] - s[:-k]) * q[: j - i] + U64(k))
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given counts."""
    total = int(counts.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    keep = counts > 0
    s, c = starts[keep].astype(np.int64), counts[keep].astype(np.int64)
    out[0] = s[0]
    at = np.cumsum(c)[:-1]
    out[at] = s[1:] - (s[:-1] + c[:-1] - 1)
    return np.cumsum(out)
