"""Words of Arrow string columns as NumPy arrays: hashes, grams, windows and their anchors.

All functions work on slices of a batch of about ``SLICE`` bytes of text, so that memory
doesn't follow the batch; a longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE = 2 << 20
PIECE = 1 << 20
_RNG = np.random.default_rng(20240229)
_U = np.uint64
#: A random 64-bit value for each byte, and an odd base with its inverse modulo 2**64.
BYTE_VALUES = _RNG.integers(0, 2**64, 256, dtype=_U)
BASE = int(_RNG.integers(0, 2**63, dtype=_U)) * 2 + 1
INVERSE = pow(BASE, -1, 2**64)
#: Odd multipliers for the places of a gram or a window.
PLACES = _RNG.integers(0, 2**64, 64, dtype=_U) | _U(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up, down = np.full(n, BASE, _U), np.full(n, INVERSE, _U)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(column: pa.Array, limit: int = SLICE, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows."""
    if not len(column):
        return
    data, at = buffers(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(at, at[lo] + limit, "right")) - 1))
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Words of a slice: ``row`` of each, its bytes from ``start`` to ``end``, ``first`` word of each row (n + 1), and ``hash``."""

    __slots__ = ("row", "start", "end", "first", "hash")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        if lower:
            data = LOWERED[data]
        inside = ~IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.start, self.end = start, end
        self.first = np.searchsorted(start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = np.empty(len(start), _U)
        i = 0
        with np.errstate(over="ignore"):
            while i < len(start):  # pieces that end with a word
                base = start[i]
                j = max(i + 1, int(np.searchsorted(end, base + PIECE, "right")))
                n = int(end[j - 1] - base)
                up, down = _powers(PIECE) if n <= PIECE else _powers.__wrapped__(n)
                total = np.zeros(n + 1, _U)
                np.cumsum(BYTE_VALUES[data[base : base + n]] * up[:n], out=total[1:])
                s, e = start[i:j] - base, end[i:j] - base
                self.hash[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U))
                i = j

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each word on, and whether they lie in one row."""
        n = max(0, len(self.hash) - k + 1)
        with np.errstate(over="ignore"):
            out = np.zeros(n, _U)
            for j in range(k):
                out += self.hash[j : j + n] * PLACES[j]
            return mix(out), self.row[:n] == self.row[k - 1 : k - 1 + n]


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the leftmost least value in every window of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at, size = values, np.arange(len(values)), 1
    while size * 2 <= width:
        later = least[size:] < least[:-size]
        at = np.where(later, at[size:], at[:-size])
        least = np.where(later, least[size:], least[:-size])
        size *= 2
    shift = width - size
    later = least[shift : shift + n] < least[:n]
    return np.where(later, at[shift : shift + n], at[:n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
