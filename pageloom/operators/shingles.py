"""Shingle sets of texts and their MinHash signatures, computed on arrays.

The functions work on one bounded slice of an Arrow batch: the UTF-8 bytes of some texts, one after the
other, and the offsets of the texts. Words are parted by what Java's ``(?U)\\s`` matches, as in ``functions.text``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

WORDS = 5
BANDS, ROWS = 32, 4       # a pair at 0.8 shares no band with probability 5e-8
SLOTS = BANDS * ROWS
SLICE = 1 << 20           # bytes of text handled at once

_GOLD, _STEP = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
_M1, _M2, _S32 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the input reaches every bit of the result."""
    for m in (_M1, _M2):
        x = (x ^ (x >> _S32)) * m
    return x ^ (x >> _S32)


def _drawn(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * _GOLD % 2**64))


_BYTE = _drawn(256, 1) | np.uint64(1)
_SEEDS = _drawn(SLOTS, 2)
#: White space: line breaks, tabs and the Unicode categories Zs, Zl and Zp; of one, two and three bytes.
_WHITE = [chr(c).encode() for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ONE = np.isin(np.arange(256), [w[0] for w in _WHITE if len(w) == 1])
_LONG = {n: np.array([int.from_bytes(w, "big") for w in _WHITE if len(w) == n], dtype=np.uint32) for n in (2, 3)}
_LEAD = {n: np.isin(np.arange(256), [w[0] for w in _WHITE if len(w) == n]) for n in (2, 3)}


def text_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``SLICE`` bytes; a longer text is one run."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, side="right")) - 1)
        yield i, data[ends[i]: ends[j]], ends[i: j + 1] - ends[i]
        i = j


def _white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = _ONE[data]
    for n, lead in _LEAD.items():
        at = np.flatnonzero(lead[data[: max(0, data.size - n + 1)]])
        if at.size:
            code = np.zeros(at.size, dtype=np.uint32)
            for k in range(n):
                code = code << np.uint32(8) | data[at + k]
            at = at[np.isin(code, _LONG[n])]
            for k in range(n):
                out[at + k] = True
    return out


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text and in all)."""
    space = _white(data)
    begins = ~space
    begins[1:] &= space[:-1]
    heads = offs[offs < data.size]
    begins[heads] = ~space[heads]
    starts = np.flatnonzero(begins)
    if not starts.size:
        return np.zeros(0, dtype=np.uint64), np.zeros(offs.size, dtype=np.int64)
    size = np.diff(np.append(starts, data.size))
    power = np.multiply.accumulate(np.full(size.max(), _STEP, dtype=np.uint64))
    value = _BYTE[data[starts[0]:]] * power[np.arange(starts[0], data.size) - np.repeat(starts, size)]
    value[space[starts[0]:]] = 0
    return _mix(np.add.reduceat(value, starts - starts[0])), np.searchsorted(starts, offs)


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct hashes of ``WORDS`` words in a row, per text; of all its words where there are fewer."""
    word, first = _words(data, offs)
    at, end = np.arange(word.size), np.repeat(first[1:], np.diff(first))
    ahead = np.concatenate((word, np.zeros(WORDS, dtype=np.uint64)))
    grams = np.zeros(word.size, dtype=np.uint64)
    for k in range(WORDS):
        grams = grams * _STEP + np.where(at + k < end, ahead[k: k + word.size], np.uint64(0))
    grams = _mix(grams)
    return [np.unique(grams[s: max(s + 1, e - WORDS + 1)] if s < e else grams[:0])
            for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(set, slot): the smallest hash of each slot; no set is empty."""
    out = np.empty((SLOTS, len(sets)), dtype=np.uint64)
    if sets:
        elems, starts = np.concatenate(sets), np.cumsum([0, *(x.size for x in sets[:-1])])
        h, high = np.empty_like(elems), np.empty_like(elems)
        for slot, seed in enumerate(_SEEDS):
            np.add(elems, seed, out=h)
            h *= _M1
            np.right_shift(h, _S32, out=high)
            h ^= high
            h *= _M2
            np.minimum.reduceat(h, starts, out=out[slot])
    return np.ascontiguousarray(out.T)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(set, band): one hash per band of ``ROWS`` slots."""
    slots = sig.reshape(-1, BANDS, ROWS)
    acc = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), slots.shape[:2])
    for i in range(ROWS):
        acc = _mix(acc * _STEP + slots[:, :, i])
    return acc.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """(set, slot): one byte of every slot, enough to estimate a similarity."""
    return (_mix(sig) >> np.uint64(56)).astype(np.uint8)


def set_id(elems: np.ndarray) -> int:
    """64-bit fingerprint of a set."""
    return int.from_bytes(blake2b(elems.tobytes(), digest_size=8).digest(), "little", signed=True)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    x, y = (x, y) if x.size <= y.size else (y, x)
    at = np.searchsorted(y, x)
    at[at == y.size] = 0
    return int((y[at] == x).sum())
