"""Word shingles of a batch of texts as 64-bit hashes, with numpy over the batch's bytes.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case. A set holds the distinct
shingles of k words; with fewer words, the whole sequence is one shingle; without words it is empty.
Two different shingles agree with a probability of 2**-64 or so; sets are compared by these hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18

_RNG = np.random.Generator(np.random.PCG64(20))
_OF_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OF_BYTE[65:91] = _OF_BYTE[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_BASE = 0x9E3779B97F4A7C13  # 3 modulo 8
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = np.atleast_1d(x) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return cls.up[:n], cls.down[:n]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash, which does not depend on the place."""
    inside = _IS_WORD[data]
    cut = np.zeros(len(data) + 1, bool)  # a text begins here
    cut[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _Powers.of(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_OF_BYTE[data] * up, out=sums[1:])
    return start, mix((sums[end] - sums[start]) * down[start]) if len(start) else np.empty(0, np.uint64)


def _pieces(data: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cuts one text after separators, into pieces of `most` bytes or, where a word is longer, up to its end."""
    at = 0
    while at < len(data):
        end = at + most
        if end < len(data):
            gaps = np.flatnonzero(~_IS_WORD[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(data) and _IS_WORD[data[end : end + most]].all():
                    end += most
                end += int(np.argmin(_IS_WORD[data[end : end + most]])) if end < len(data) else 0
        yield at, min(end, len(data))
        at = end


def _chunk_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """data: the bytes of the texts, offsets: where each begins, and the end; from 0."""
    n = len(offsets) - 1
    empty = np.empty(0, np.uint64)
    if n == 1 and len(data) > CHUNK:
        parts = [(a, *_words(data[a:b], np.array([0, b - a]))) for a, b in _pieces(data, CHUNK)]
        start, words = np.concatenate([a + s for a, s, _ in parts]), np.concatenate([w for _, _, w in parts])
    else:
        start, words = _words(data, offsets) if len(data) else (empty, empty)
    if not len(start):
        return [empty] * n
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(doc, np.arange(n + 1))
    count = np.diff(first)

    def joined(i: np.ndarray, length: int) -> np.ndarray:
        s = words[i]
        for j in range(1, length):
            s = s * _STEP + words[i + j]
        return mix(s, length)

    sets = [empty] * n
    if len(words) >= k:
        at = np.arange(len(words) - k + 1)
        shingles = joined(at, k)
        for d in np.flatnonzero(count >= k):
            s = np.sort(shingles[first[d] : first[d + 1] - k + 1])
            keep = np.ones(len(s), bool)
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            sets[d] = s[keep]
    for length in range(1, k):
        short = np.flatnonzero(count == length)
        if len(short):
            for d, s in zip(short, joined(first[short], length), strict=True):
                sets[d] = np.array([s], np.uint64)
    return sets


def sets_of(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted set of each text; null counts as empty. Works on CHUNK bytes, or one text, at a time."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        yield from _chunk_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
        i = j


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed 64-bit numbers."""
    a = int(mix(s, 1).sum(dtype=np.uint64)) if len(s) else 0
    b = int(mix(s, 2).sum(dtype=np.uint64)) if len(s) else 0
    return tuple(x - (1 << 64) if x >= 1 << 63 else x for x in (a, b))
