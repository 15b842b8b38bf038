"""Word shingles of documents or paragraphs as 64-bit hashes, whole Arrow batches at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_STEP = 1 << 18
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M[3]
    h = (h ^ (h >> np.uint64(29))) * _M[1]
    return h ^ (h >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i up to n; kept until the task ends."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        have = np.full(n + 1, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have


def forget_powers() -> None:
    _powers.clear()


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by a polynomial over random byte codes."""
    size = max(len(data), _STEP)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(_BASE, size)[: len(data)], out=prefix[1:])
    inverse = powers(pow(_BASE, -1, 2**64), size)
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * _M[0])


def text_chunks(batch: pa.RecordBatch, column: int, most: int = 1 << 18) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes of text: rows, bytes, and where each row's text starts; null is empty."""
    col = batch.column(column)
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    if len(col) == 0:
        return
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield slice(a, b), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word; words end at white space and at ``bounds``; A-Z count as a-z."""
    data = _LOWER[data]
    inside = ~_WS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    left = inside.copy()
    left[1:] &= ~inside[:-1] | edge[1:-1]
    right = inside.copy()
    right[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
    return start, end, hash_spans(data, start, end)


def shingles(data: np.ndarray, bounds: np.ndarray, n: int, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of ``n`` words of each unit between neighbouring ``bounds``.

    Returns the shingles of all units in a row, where each unit's start, how many it has, and its number of
    words. A unit with fewer words is one shingle; one with fewer than ``least`` words has none.
    """
    start, _, h = words(data, bounds)
    first = np.searchsorted(start, bounds[:-1])
    count = np.diff(np.append(first, len(start)))
    size = np.where(count >= max(least, 1), np.maximum(count - n + 1, 1), 0)
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    full = np.repeat(count >= n, size)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        here = full if k >= 1 else np.ones(len(at), bool)
        out[here] = mix(out[here] * _M[2] + h[at[here] + k])
    for u in np.flatnonzero((size > 0) & (count < n)):
        v = np.uint64(count[u])
        for x in h[first[u] : first[u] + count[u]]:
            v = mix(np.array([v], np.uint64) * _M[2] + x)[0]
        out[(np.cumsum(size) - size)[u]] = v
    return out, np.cumsum(size) - size, size, count


def distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.append(True, h[1:] != h[:-1])] if len(h) else h


def digest(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def signatures(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """MinHash: for each unit, which all must have shingles, ``k`` minima of 32 bits."""
    odd = np.random.default_rng(7).integers(0, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(at), k), np.uint32)
    for i in range(k):
        out[:, i] = np.minimum.reduceat(h * odd[i], at) >> np.uint64(32)
    return out
