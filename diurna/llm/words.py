"""Word and shingle hashes of whole texts as numpy arrays, for use inside Arrow batches.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. These bytes never occur inside a
multi-byte UTF-8 character, so the byte rule equals the rule on characters. A word's hash mixes in
eight bytes at a time, each step a bijection of the state that is not linear in the bytes, and
starts from the length; it depends on the bytes only.

``spans`` is a polynomial modulo 2^64 over values that are random already (hashes of words) or over
at most a few dozen bytes (pieces). It must not be used for long runs of raw bytes, where patterns
of two letters collide whatever the base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18  # bytes of text hashed at a time (a worker holds some 100 times that); a longer document is one chunk
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK + 1, n + 1)
    if 0 not in _powers or len(_powers[0][0]) < n + 1:
        def run(b: int) -> np.ndarray:
            p = np.full(size, b, np.uint64)
            p[0] = 1
            return np.multiply.accumulate(p)

        _powers[0] = (run(_BASE), run(_INVERSE))
    return _powers[0]


def byte_values() -> np.ndarray:
    """A random value per byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


_FOLDED = np.arange(256, dtype=np.uint8)
_FOLDED[ord("A"):ord("Z") + 1] += 32


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the bytes data[start:end] of each span."""
    length = (ends - starts).astype(np.int64)
    h = mix(length.astype(np.uint64) + np.uint64(seed * _BASE & (1 << 64) - 1))
    blocks = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # the 8 bytes at every place
    active, at = np.flatnonzero(length > 0), 0
    while len(active):
        left = length[active] - at
        x = blocks[starts[active] + at]
        short = left < 8
        x[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        x ^= h[active]
        x *= np.uint64(_BASE)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        h[active] = x ^ (x >> np.uint64(29))
        active, at = active[left > 8], at + 8
    return mix(h)


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each span; equal for equal content wherever it lies."""
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _powers_to(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * inverse[starts] + length)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    at = np.arange(n)
    return spans(words, at, at + k)


@dataclass
class Chunk:
    """Rows lo..hi of a column: ``words[offsets[i]:offsets[i + 1]]`` are the hashes of row lo + i."""

    lo: int
    hi: int
    words: np.ndarray
    offsets: np.ndarray

    def within(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, first word) of each k-gram inside one row."""
        count = np.maximum(np.diff(self.offsets) - k + 1, 0)
        row = np.repeat(np.arange(len(count)), count)
        first = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + self.offsets[:-1][row]
        return row, first


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def row_ranges(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``limit`` bytes together, or one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def word_bounds(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; ``rows`` holds row limits, which end words too."""
    solid = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = rows[(rows > 0) & (rows < len(data))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1


def chunks(column: pa.Array, fold: bool = False, seed: int = 0) -> Iterator[Chunk]:
    """Word hashes of all rows, about CHUNK bytes of text at a time. ``fold`` lower-cases A-Z."""
    data, offsets = buffers(column)
    for lo, hi in row_ranges(offsets):
        rows = offsets[lo: hi + 1] - offsets[lo]
        part = data[offsets[lo]: offsets[hi]]
        starts, ends = word_bounds(part, rows)
        yield Chunk(lo, hi, hashed(_FOLDED[part] if fold else part, starts, ends, seed), np.searchsorted(starts, rows))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
