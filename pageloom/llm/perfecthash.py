"""Minimal perfect hashing of int64 keys on arrays.

Level by level, every key left is hashed into twice as many bits as there are
keys; a bit that exactly one key meets is set and settles that key, the others
go on to the next level. A key's number is the count of set bits before its
own, so n keys get the numbers 0 to n - 1. A key that is not in the set may get
a number too: callers verify it against the stored keys.
"""

from __future__ import annotations

import numpy as np

from .words import mix

LEVELS = 96               # 0.4 of the keys go on per level: reached by equal keys only
_SEED = 0x9E3779B97F4A7C15
_LOW = np.uint64(63)
_ONE = np.uint64(1)


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = mix(keys.view(np.uint64) + np.uint64(_SEED * (level + 1) % 2**64))
    return ((h >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


class PerfectHash:
    """The function itself: the bits of all levels, as words, and the set bits before each word."""

    def __init__(self, first: np.ndarray, words: np.ndarray, before: np.ndarray):
        self.first, self.words, self.before = first, words, before

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct keys; equal keys are refused."""
        rest, words, first = keys.astype(np.int64), [], [0]
        for level in range(LEVELS):
            if not rest.size:
                break
            size = -(-2 * rest.size // 64) * 64
            at = _place(rest, level, size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            first.append(first[-1] + size // 64)
            rest = rest[~alone[at]]
        if rest.size:
            raise ValueError("keys of a perfect hash must be distinct")
        flat = np.concatenate(words) if words else np.zeros(0, dtype=np.uint64)
        ones = np.bitwise_count(flat).astype(np.int64)
        return cls(np.array(first, dtype=np.int64), flat, np.cumsum(ones) - ones)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """The number of every key; -1 for some keys outside the set."""
        out = np.full(keys.size, -1, dtype=np.int64)
        rest = np.arange(keys.size)
        for level in range(self.first.size - 1):
            if not rest.size:
                break
            at = _place(keys[rest], level, int(self.first[level + 1] - self.first[level]) * 64)
            word = self.first[level] + (at >> np.uint64(6)).astype(np.int64)
            bits, low = self.words[word], at & _LOW
            hit = (bits >> low) & _ONE == _ONE
            below = np.bitwise_count(bits[hit] & ((_ONE << low[hit]) - _ONE)).astype(np.int64)
            out[rest[hit]] = self.before[word[hit]] + below
            rest = rest[~hit]
        return out

    # One array holds the function and, behind it, the keys in the order of their numbers.

    def packed(self, keys: np.ndarray) -> np.ndarray:
        own = np.empty(keys.size, dtype=np.int64)
        own[self.numbers(keys)] = keys
        head = np.array([self.first.size, self.words.size, keys.size], dtype=np.int64)
        return np.concatenate((head, self.first, self.words.view(np.int64), self.before, own))

    @classmethod
    def unpacked(cls, a: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """(function, keys by number) over the parts of a packed array, which may be mapped."""
        levels, words, n = (int(x) for x in a[:3])
        cut = 3 + np.cumsum([levels, words, words, n])
        return cls(a[3: cut[0]], a[cut[0]: cut[1]].view(np.uint64), a[cut[1]: cut[2]]), a[cut[2]: cut[3]]
