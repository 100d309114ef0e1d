"""SuperMinHash signatures of word shingles, computed on arrays.

In a SuperMinHash every element walks a random permutation of the M slots and
offers slot ``p(j)`` the value ``j + r`` (r uniform in [0, 1)); a slot keeps
the smallest offer. The ranks j of one element are a permutation, so the slots
of a signature are negatively correlated and the similarity estimate has less
variance than independent minima. The walk of a document stops after round j
as soon as every slot holds an offer, because later offers are all larger.
Here the rounds run for all elements of a slice of documents at once; an offer
is the integer ``j << 32 | r``.
"""

from __future__ import annotations

import numpy as np

from .words import hash_words, mix, word_bounds

SHINGLE = 5
SLOTS = 128
BANDS = 32                 # 32 bands of 4 slots: a pair at 0.75 is missed with probability 5e-6
_ROWS = SLOTS // BANDS
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xA0761D6478BD642F)
_LOW = np.uint64(0xFFFFFFFF)
_B32 = np.uint64(32)


def shingle_sets(buf: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: (hashes, offsets per document).

    Each document's hashes are sorted. A text of one to four words is one
    shingle of its own length; a text without words has none."""
    doc, starts, ends = word_bounds(buf, offs)
    word = hash_words(buf, starts, ends)
    n_docs = offs.size - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    if word.size >= SHINGLE:
        acc = word[: word.size - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            acc = acc * _STEP + word[k: word.size - SHINGLE + 1 + k]
        acc = mix(acc)
    else:
        acc = np.zeros(0, dtype=np.uint64)
    out, sizes = [], np.zeros(n_docs, dtype=np.int64)
    for d in range(n_docs):
        s, e = first[d], first[d + 1]
        if e == s:
            continue
        if e - s < SHINGLE:
            x = np.array([e - s], dtype=np.uint64)
            for w in range(s, e):
                x = x * _STEP + word[w: w + 1]
            h = mix(x ^ _GOLD)
        else:
            h = np.sort(acc[s: e - SHINGLE + 1])
            h = h[np.concatenate(([True], h[1:] != h[:-1]))]
        out.append(h)
        sizes[d] = h.size
    return (np.concatenate(out) if out else np.zeros(0, dtype=np.uint64),
            np.concatenate(([0], np.cumsum(sizes))))


def _draw(elems: np.ndarray, j: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Round j of each element: (32 random bits, position in [j, slots))."""
    x = mix(elems + np.uint64((j + 1) * int(_GOLD) % 2**64))
    return x >> _B32, (((x & _LOW) * np.uint64(slots - j)) >> _B32).astype(np.int64) + j


def signatures(elems: np.ndarray, offs: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """(documents, slots) signature; rows of empty documents stay at the maximum."""
    n_docs = offs.size - 1
    sig = np.full(n_docs * slots, np.iinfo(np.uint64).max, dtype=np.uint64)
    if not elems.size:
        return sig.reshape(n_docs, slots)
    doc = np.repeat(np.arange(n_docs), np.diff(offs))
    r, k = _draw(elems, 0, slots)
    np.minimum.at(sig, doc * slots + k, r)
    open_ = (sig.reshape(n_docs, slots).max(axis=1) == np.iinfo(np.uint64).max) & (np.diff(offs) > 0)
    live = np.flatnonzero(open_[doc])
    elems, doc, k = elems[live], doc[live], k[live]
    for part in range(0, n_docs, 256):  # bounds the permutations held at once
        a, b = np.searchsorted(doc, [part, part + 256])
        _finish(sig, elems[a:b], doc[a:b], k[a:b], slots)
    return sig.reshape(n_docs, slots)


def _finish(sig: np.ndarray, elems: np.ndarray, doc: np.ndarray, k0: np.ndarray, slots: int) -> None:
    """Rounds 1, 2, ... of documents that still have an empty slot."""
    if not elems.size:
        return
    perm = np.broadcast_to(np.arange(slots, dtype=np.int16), (elems.size, slots)).copy()
    at = np.arange(elems.size)
    perm[at, 0], perm[at, k0] = k0, 0
    view = sig.reshape(-1, slots)
    for j in range(1, slots):
        r, k = _draw(elems, j, slots)
        slot = perm[at, k].copy()
        perm[at, k] = perm[at, j]
        perm[at, j] = slot
        np.minimum.at(sig, doc * slots + slot, r | (np.uint64(j) << _B32))
        docs = np.unique(doc)
        full = docs[view[docs].max(axis=1) < np.iinfo(np.uint64).max]
        if full.size:
            stay = ~np.isin(doc, full)
            elems, doc, perm = elems[stay], doc[stay], perm[stay]
            at = np.arange(elems.size)
            if not elems.size:
                return


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(documents, BANDS) signed 64-bit bucket keys."""
    s = sig.reshape(sig.shape[0], BANDS, _ROWS)
    acc = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), s.shape[:2]).copy()
    for i in range(_ROWS):
        acc = mix(acc * _STEP + s[:, :, i])
    return acc.view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """One byte per slot, enough to estimate similarity."""
    return (mix(sig) & np.uint64(0xFF)).astype(np.uint8)


def set_key(elems: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each set (0 for an empty one)."""
    n = np.diff(offs)
    out = np.zeros(n.size, dtype=np.uint64)
    if elems.size:
        has = n > 0
        out[has] = mix(np.add.reduceat(mix(elems ^ _GOLD), offs[:-1][has]) + n[has].astype(np.uint64) * _STEP)
    return out.view(np.int64)
