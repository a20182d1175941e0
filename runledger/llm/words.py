"""Words of many texts at once, on the UTF-8 bytes.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased: ASCII digits and letters, and every character beyond ASCII (all
bytes of those are 0x80 or more, so the rule holds byte by byte).
"""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_VALUE[~IS_WORD] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (splitmix finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def split(data: np.ndarray, offsets: np.ndarray):
    """Words of the rows ``data[offsets[i]:offsets[i + 1]]``.

    Returns the lower-cased bytes, word starts and ends in them, and for each
    row the index of its first word (n + 1 values).
    """
    low = LOWER[data]
    w = IS_WORD[low]
    if not len(w):
        z = np.zeros(0, np.int64)
        return low, z, z, np.zeros(len(offsets), np.int64)
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    inner = offsets[:-1][(offsets[:-1] < len(w)) & (np.diff(offsets) > 0)]
    first[inner] = w[inner]  # words do not join across rows
    cut = inner[inner > 0] - 1
    last[cut] = w[cut]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return low, starts, ends, np.searchsorted(starts, offsets)


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word (equal words, equal hashes)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    begin, stop = starts[0], ends[-1]
    part = low[begin:stop]
    at = np.arange(len(part), dtype=np.int64)
    rel = starts - begin
    at -= np.repeat(rel, np.diff(np.append(rel, len(part))))
    longest = int((ends - starts).max())
    np.minimum(at, longest - 1, out=at)
    h = np.add.reduceat(_VALUE[part] * powers(longest)[at], rel)
    return mix(h + (ends - starts).astype(np.uint64))
