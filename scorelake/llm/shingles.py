"""Words and word shingles of whole texts as 64-bit hashes, on the bytes of Arrow columns."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = np.random.default_rng(20240601).integers(0, 1 << 64, 256, dtype=U64)
BASE = 0x9E3779B97F4A7C15
LEFT, RIGHT = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


@lru_cache(maxsize=4)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < 2**bits."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        steps = np.full(1 << bits, U64(base), dtype=U64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column, nulls as empty, and the offsets of its rows in them."""
    values = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int64)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z as a-z) and where each row's words begin in that list (one more entry than rows)."""
    if not len(data):
        return np.zeros(0, dtype=U64), np.zeros(len(offsets), dtype=np.int64)
    black = ~SPACE[data]
    first, last = np.empty(len(data), dtype=bool), np.empty(len(data), dtype=bool)
    first[1:], last[:-1] = ~black[:-1], ~black[1:]
    filled = offsets[1:] > offsets[:-1]
    first[offsets[:-1][filled]] = last[offsets[1:][filled] - 1] = True
    start, end = np.flatnonzero(black & first), np.flatnonzero(black & last) + 1
    up, down = powers(max(18, int(len(data)).bit_length()))
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE[LOWER[data]] * up[:len(data)], out=total[1:])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * RIGHT)
    return h, np.searchsorted(start, offsets)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its word shingles; fewer words than `size` count as one shingle."""
    data, offsets = text_bytes(column)
    h, at = words(data, offsets)
    joined = h * LEFT
    for k in range(1, size):
        joined = mix(joined[:max(len(h) - k, 0)] * LEFT + h[k:] * RIGHT + U64(k))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(joined[a:b - size + 1]))
        elif b > a:
            short = h[a:a + 1] * LEFT
            for k in range(1, b - a):
                short = mix(short * LEFT + h[a + k:a + k + 1] * RIGHT + U64(k))
            out.append(mix(short + U64(b - a)))
        else:
            out.append(h[:0])
    return out
