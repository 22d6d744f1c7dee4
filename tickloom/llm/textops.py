"""Words and hashes of whole Arrow text columns in numpy, for use inside tasks.

Texts are taken a few megabytes at a time, so that memory does not follow the batch.
Hashes have 64 bits; equal words have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15
STEP = U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), U(base % 2**64), dtype=np.uint64)
        p[0] = 1
        _powers[base] = have = np.multiply.accumulate(p)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of texts with about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    a = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "").cast(pa.large_binary())
    if len(a) == 0:
        return
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset:a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def byte_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums H, so that (H[e] - H[s]) * inverse_power(s) is the hash of data[s:e]."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U(1)) * powers(BASE, len(data)), out=h[1:])
    return h


INVERSE = pow(BASE, -1, 2**64)


def slice_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (h[end] - h[start]) * powers(INVERSE, len(h))[start]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the number of words before it (one more entry than texts)."""
    on = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True  # words do not cross texts
    edge = np.empty(len(data), bool)
    if len(data):
        edge[0] = True
        edge[1:] = ~on[:-1]
    start = np.flatnonzero(on & (edge | first[:-1]))
    if len(data):
        edge[-1] = True
        edge[:-1] = ~on[1:]
    end = np.flatnonzero(on & (edge | first[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the number of words before each text."""
    if lower:
        data = FOLD[data]
    start, end, at = word_spans(data, off)
    return mix(slice_hashes(byte_hashes(data), start, end)), at


def sequence_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` entries of ``h``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * STEP + h[i:i + n]
    return mix(out)


def shingle_sets(h: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For every text its sorted distinct k-word shingles; a shorter text is one shingle, one without words none."""
    s = sequence_hashes(h, k)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            yield np.unique(s[a:b - k + 1])
        elif b > a:
            yield mix(sequence_hashes(h[a:b], b - a) + U(b - a))
        else:
            yield s[:0]
