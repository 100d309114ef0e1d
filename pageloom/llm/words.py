"""Array helpers shared by the operators that read words as bytes.

A word is a maximal run of bytes outside ``\\x20 \\x09-\\x0D``; in UTF-8 these
bytes never occur inside another character, so the byte view and the character
view agree. Everything here works on one bounded slice of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for m in (_M1, _M2):
        x ^= x >> _S33
        x *= m
    x ^= x >> _S33
    return x


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)) | np.uint64(1)


_BYTE = _odd(256, 11)
_STEP = 0xD6E8FEB86659FD93  # odd, so its powers never vanish modulo 2**64


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW = _powers(4096)


def text_slices(col: pa.Array, max_bytes: int = 1 << 20, lower: bool = True) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Cut a string column into runs of whole rows of about ``max_bytes``.

    Yields ``(first_row, utf-8, offsets)``, lower-cased (A-Z) unless ``lower``
    is false; a null is an empty text.
    A single row longer than ``max_bytes`` forms a slice of its own.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset: col.offset + n + 1]
    data = memoryview(col.buffers()[2]) if col.buffers()[2] is not None else memoryview(b"")
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1)
        j = min(j, n)
        buf = bytes(data[offs[i]: offs[j]])
        yield i, buf.translate(LOWER) if lower else buf, offs[i: j + 1] - offs[i]
        i = j


def word_bounds(buf: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, start, end) of every word; words never span documents."""
    a = np.frombuffer(buf, dtype=np.uint8)
    if not a.size:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inside = ~_SPACE[a]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offs[1:-1]
    cuts = cuts[cuts < a.size]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cuts[cuts > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return np.searchsorted(offs, starts, side="right") - 1, starts, ends


def hash_words(buf: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, the same for the same bytes anywhere."""
    global _POW
    if not starts.size:
        return np.zeros(0, dtype=np.uint64)
    a = np.frombuffer(buf, dtype=np.uint8)
    size = ends - starts
    if size.max() > _POW.size:
        _POW = _powers(int(size.max()) * 2)
    head = np.zeros(starts.size, dtype=np.int64)
    np.cumsum(size[:-1], out=head[1:])
    total = int(head[-1] + size[-1])
    flat = np.arange(total, dtype=np.int64)
    value = _BYTE[a if total == a.size else a[flat + np.repeat(starts - head, size)]]
    value *= _POW[flat - np.repeat(head, size)]
    return mix(np.add.reduceat(value, head) + size.astype(np.uint64))


def hash_word(word: str) -> int:
    """The hash of one word (already lower-cased), for models and tests."""
    b = word.encode("utf-8")
    return int(hash_words(b, np.array([0]), np.array([len(b)]))[0])


def read_columns(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]
