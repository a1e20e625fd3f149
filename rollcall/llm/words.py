"""Words of Arrow text columns as numpy arrays: places, hashes and shingles, a whole batch at a time.

Texts are handled as UTF-8 bytes in slices of about a megabyte, so temporary arrays stay small whatever
the batch. A longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: For scans whose temporary arrays take up to 80 times a slice: they stay in a core's cache, and a worker stays small.
SMALL_SLICE_BYTES = 1 << 18

_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)
_FACTOR_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE_FACTOR = 0xD1342543DE82EF95


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (shift, multiply, shift)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: One random 64-bit value per byte.
BYTE_VALUES = mixed(np.arange(1, 257, dtype=_U) * _FACTOR)
#: A-Z to a-z, other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)
#: Bytes of words that white space separates.
VISIBLE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: Bytes of words made of letters, digits and everything beyond ASCII (after lower-casing).
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the factor and of its inverse modulo 2**64."""
    steps = np.ones((2, max(n, 1)), dtype=_U)
    steps[0, 1:], steps[1, 1:] = _FACTOR, _FACTOR_INVERSE
    return np.cumprod(steps[0], dtype=_U), np.cumprod(steps[1], dtype=_U)


class Texts(NamedTuple):
    """Rows ``first`` to ``last`` of a batch: their bytes, and where each row begins in them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """A text column in slices of rows; null is empty."""
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, body = column.buffers()
    ends = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, side="right")) - 1)
        yield Texts(first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first])
        first = last


class Words(NamedTuple):
    """Words of a slice: bytes ``begin`` to ``end``; row r has words ``rows[r]`` to ``rows[r + 1]``."""

    begin: np.ndarray
    end: np.ndarray
    rows: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> Words:
    """Maximal runs of bytes that ``letters`` marks; a run never crosses rows."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = letters[data]
    edges = np.zeros(len(data) + 1, dtype=bool)
    edges[offsets] = True
    begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edges[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edges[1:])) + 1
    return Words(begin, end, np.searchsorted(begin, offsets))


def hash_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given disjoint ascending byte runs."""
    out = np.empty(len(begin), dtype=_U)
    i = 0
    while i < len(begin):
        base = int(begin[i])
        j = max(i + 1, int(np.searchsorted(end, base + SLICE_BYTES, side="right")))
        size = int(end[j - 1]) - base
        up, down = powers(size + 1)
        sums = np.zeros(size + 1, dtype=_U)
        np.cumsum(BYTE_VALUES[data[base : base + size]] * up[:size], out=sums[1:])
        b, e = begin[i:j] - base, end[i:j] - base
        out[i:j] = mixed((sums[e] - sums[b]) * down[b] + (e - b).astype(_U))
        i = j
    return out


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive word hashes at every word, and which of them lie within a row."""
    n = len(words)
    if n < size:
        return np.zeros(n, dtype=_U), np.zeros(n, dtype=bool)
    total = np.zeros(n, dtype=_U)
    for i in range(size):
        total[: n - i] += words[i:] * _U(pow(_SHINGLE_FACTOR, i + 1, 1 << 64))
    last = np.repeat(rows[1:], np.diff(rows))
    return mixed(total + _U(size)), np.arange(n) + size <= last
