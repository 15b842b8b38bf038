"""The first 32 bits of many MD5 digests at once: every key after every prefix."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_WORDS = [(1 * i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: A message of one block has so many bytes at most.
_BLOCK = 55
#: Digests worked on together, so that all state stays in the cache.
_TOGETHER = 32768


def _laid_out(parts: list[bytes], offset: int, end: bytes = b"") -> np.ndarray:
    """Byte strings of one length as the 16 words of a block, from ``offset`` on; a row for each."""
    rows = b"".join(bytes(offset) + p + end + bytes(64 - offset - len(p) - len(end)) for p in parts)
    return np.frombuffer(rows, "<u4").reshape(len(parts), 16)


def _digests(m: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """First word of the digests of blocks whose words are ``m``, arrays that broadcast to ``shape``."""
    a, b, c, d = (np.full(shape, x, np.uint32) for x in _START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(61):  # the last three steps do not touch the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        np.add(f, m[_WORDS[i]] + np.uint32(_SINES[i]), out=f)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=g)
        np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f)
        np.bitwise_or(f, g, out=f)
        np.add(f, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()


def first_words(prefixes: list[bytes], keys: list[bytes]) -> np.ndarray:
    """``uint32[prefix, key]``: the first eight hex digits of the MD5 of prefix and key, as numbers."""
    out = np.empty((len(prefixes), len(keys)), np.uint32)
    by_length: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
    for found, parts in zip(by_length, (prefixes, keys), strict=True):
        for i, p in enumerate(parts):
            found.setdefault(len(p), []).append(i)
    for nk, ks in by_length[1].items():
        for np_, ps in by_length[0].items():
            if np_ + nk > _BLOCK:
                for i in ps:
                    for j in ks:
                        out[i, j] = int(hashlib.md5(prefixes[i] + keys[j]).hexdigest()[:8], 16)
                continue
            length = np.uint32(8 * (np_ + nk))
            for kk in (ks[x : x + 512] for x in range(0, len(ks), 512)):
                right = _laid_out([keys[j] for j in kk], np_, b"\x80")
                step = max(1, _TOGETHER // len(kk))
                for pp in (ps[x : x + step] for x in range(0, len(ps), step)):
                    left = _laid_out([prefixes[i] for i in pp], 0)
                    m = []
                    for w in range(16):
                        if w == 14:
                            m.append(np.full((1, 1), length, np.uint32))
                        elif 4 * w >= np_:
                            m.append(np.ascontiguousarray(right[:, w])[None, :])
                        elif 4 * w + 4 <= np_:
                            m.append(np.ascontiguousarray(left[:, w])[:, None])
                        else:
                            m.append(left[:, w][:, None] | right[:, w][None, :])
                    out[np.ix_(pp, kk)] = _digests(m, (len(pp), len(kk)))
    return out
