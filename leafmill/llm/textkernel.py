"""Vectorised byte kernels over Arrow string batches: words, word hashes, shingles.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, so UTF-8 texts need no decoding. All work
goes over blocks of at most `BLOCK` bytes (whole words), so memory does not grow with a text's length
beyond its hash array of 8 bytes a word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 17
_U = np.uint64
WS = np.zeros(256, bool)
WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WORD = ~WS
_CODE = np.arange(1, 257, dtype=np.uint64)
_LOWER_CODE = LOWER.astype(np.uint64) + _U(1)
_P = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_P, -1, 1 << 64)
    out = []
    for base in (_P, inverse):
        a = np.full(n, base, dtype=np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def texts(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and n + 1 offsets; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    n = len(array)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, array.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _block(raw: np.ndarray, cuts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of one block; cuts: positions where a text begins, ascending."""
    n = len(raw)
    word = np.take(_WORD, raw)
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if n and word[0]:
        edge = np.concatenate(([0], edge))
    if n and word[-1]:
        edge = np.concatenate((edge, [n]))
    starts, ends = edge[0::2], edge[1::2]
    inner = cuts[(cuts > 0) & (cuts < n)]
    inner = np.unique(inner[word[inner - 1] & word[inner]])  # one text ends with a word, and the next begins with one
    if len(inner):
        starts, ends = np.insert(starts, np.searchsorted(starts, inner), inner), np.insert(ends, np.searchsorted(ends, inner), inner)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    up, down = _powers(BLOCK) if n <= BLOCK else _powers(1 << (n - 1).bit_length())
    code = np.take(_LOWER_CODE if lower else _CODE, raw)
    code *= up[:n]
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(code, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return starts, ends, mix(h)


def _last_space(raw: np.ndarray, lo: int, hi: int, step: int = 256) -> int:
    """Where the last white space of a range ends; `lo` if it has none."""
    while hi > lo:
        at = max(lo, hi - step)
        ws = np.flatnonzero(WS[raw[at:hi]])
        if len(ws):
            return at + int(ws[-1]) + 1
        hi, step = at, 4 * step
    return lo


def words(raw: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words, and n + 1 word offsets by text."""
    starts, ends, hashes = [], [], []
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(n, lo + BLOCK)
        if hi < n:  # cut after the last white space or at the last text start within the block
            best = max(_last_space(raw, lo, hi), int(off[np.searchsorted(off, hi, "right") - 1]))
            while best <= lo:  # one word longer than a block
                hi = min(n, hi + BLOCK)
                ws = np.flatnonzero(WS[raw[lo:hi]])
                cut = off[np.searchsorted(off, hi, "right") - 1]
                best = hi if hi == n else max(lo + int(ws[0]) + 1 if len(ws) else lo, int(cut))
            hi = best
        a, b = np.searchsorted(off, (lo, hi))
        s, e, h = _block(raw[lo:hi], off[a:b] - lo, lower)
        starts.append(s + lo)
        ends.append(e + lo)
        hashes.append(h)
        lo = hi
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    s = np.concatenate(starts)
    return s, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(s, off)


def parts(raw: np.ndarray, off: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows of one sequence of word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc *= _U(0xD1342543DE82EF95)
        acc += h[j : j + n]
    return mix(acc)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; a shorter text that has words is one shingle."""
    if not len(h):
        return h
    return np.unique(windows(h, min(k, len(h))) + _U(0 if len(h) >= k else len(h)))
