"""Words and shingles of Arrow text columns as 64-bit hashes, without a loop per word.

A block of texts is one byte array. Each byte value has a random 64-bit weight; a prefix
sum of weight times a power of an odd base gives every word's polynomial hash from two
look-ups, and a final mix spreads it. Blocks are small, so memory does not follow the
length of a table; a long text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once, if no single text is longer.
BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WEIGHT = np.random.default_rng(20_240_501).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.random.default_rng(77).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
#: Byte classes: what separates words; A-Z in lower case.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_power: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _power.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, BLOCK + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * BLOCK:
            _power[str(base)] = have
    return have


def blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them); null texts are empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True, spaces: np.ndarray = SPACES, prefixes: tuple = ()) -> tuple:
    """Hashes of all words in order, the index of each row's first word (with an end), and hashes of the words' starts."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64), *[np.zeros(0, np.uint64) for _ in prefixes]
    if lower:
        data = LOWER[data]
    inside = ~spaces[data]
    starts, ends = inside.copy(), inside.copy()
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends[:-1] &= ~inside[1:] | edge[1:n]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_WEIGHT[data] * _powers(_BASE, n)[:n], out=total[1:])
    back, begun = _powers(_INVERSE, n)[first], total[first]
    h = (total[last + 1] - begun) * back
    short = [mix((total[np.minimum(first + k, last + 1)] - begun) * back + np.uint64(k)) for k in prefixes]
    return mix(h + (last - first).astype(np.uint64) * _STEP[0]), np.searchsorted(first, off), *short


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row its distinct shingles of k words, sorted; a shorter row is one shingle."""
    n = len(words)
    if n >= k:
        h = words[: n - k + 1] * _STEP[1]
        for j in range(1, k):
            h = h + words[j : n - k + 1 + j] * _STEP[1 + j]
        h = mix(h)
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= k:
            yield np.unique(h[a : b - k + 1])
        elif b > a:
            short = np.add.reduce(words[a:b] * _STEP[1 : 1 + b - a], keepdims=True)
            yield mix(short + np.uint64(31 * (k - int(b - a))))
        else:
            yield np.zeros(0, np.uint64)
