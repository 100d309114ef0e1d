"""Alignment of two tokenizers' tokens, with corpus counts by minimal perfect hashing.

Both tokenizers cut the same bytes (a space and the text). Byte offsets at
which tokens of both end cut a document into groups; the two tokens that end
there are linked.

1. First pass: every task aligns its documents and counts its linked id pairs,
   pre-aggregated in bounded pieces.
2. The distinct pairs are dealt to shards by hash; each
   shard gets a minimal perfect hash (``perfecthash``), written with its keys
   to the shared folder.
3. The tasks' counts become dense vectors indexed by that hash, every key
   verified; the vectors are cut into chunks and summed up a tree of FAN
   branches, so that no task meets more than FAN vectors of a chunk.
4. Second pass: documents are aligned again and the links' counts looked up in
   the mapped vectors; a key that is not its number's key is an error.

The shared folder must be a mounted file system (``mapped.local_path``).

Defined cases: null or empty texts, and texts whose pieces do not join to the
space and the text (a literal U+2581, which pieces use for the blank), have no
tokens: zeros, and an empty groups string. Strings of special tokens are plain
text. Repeated rows count each time; null doc_ids stay; texts of any length are
read whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ByteBpe, byte_alphabet, load_tables
from .mapped import local_path, map_array, write_array
from .perfecthash import PerfectHash
from .store import keep, shared_path
from .words import hash_words, mix, read_columns, text_slices

SHARD_KEYS = 1 << 13      # distinct pairs aimed at per shard ...
MOST_SHARDS = 256         # ... up to so many shards (workers map a file of each) ...
LARGE_SHARD = 1 << 22     # ... unless they would grow beyond this
LEAF_ROWS = 1 << 22       # counts that a leaf of the summing tree takes
VECTORS = "shard long, leaf long, chunk int, counts binary"
CHUNK = 1024              # entries of a dense vector that travel in one row
FAN = 8                   # branches of the summing tree
SLICE = 1 << 20           # bytes of text aligned at once
REMEMBERED = 250_000      # pre-tokens and words whose ids a worker remembers
_FLUSH = 1 << 21          # links without a slot that a task holds before it sums them
_SLOT_BITS = 19
_SLOTS = 1 << _SLOT_BITS  # pairs whose counts a task keeps at hand
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def load_pair(a_path: str, b_path: str) -> dict:
    """What workers need of a byte-level BPE file and a piece model; of fixed size."""
    import sentencepiece

    a = load_tables(a_path) | {"special": {}}            # special strings are plain text
    with open(a_path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = byte_alphabet()
    a_bytes = [b""] * a["size"]
    for entry, i in vocab.items():
        a_bytes[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else b""
    with open(b_path, "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    b_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i)
               else sp.id_to_piece(i).replace("▁", " ").encode("utf-8") for i in range(sp.get_piece_size())]
    return {"a": a, "model": model, "a_bytes": a_bytes, "b_bytes": b_bytes}


def _table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length of every entry, its first byte in the flat bytes, the flat bytes)."""
    n = np.array([len(x) for x in entries], dtype=np.int64)
    return n, np.cumsum(n) - n, np.frombuffer(b"".join(entries), dtype=np.uint8)


def _joined(table, ids: np.ndarray) -> np.ndarray:
    """The bytes of all tokens, one after the other."""
    n, first, flat = table
    size = n[ids]
    return flat[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - first[ids], size)]


def _cuts(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(values)))[offs]


class Slice:
    """The aligned tokens of some documents: ids and, for each, its document and
    whether a token of the other side ends with it."""

    def __init__(self, n_docs: int, a, a_doc, a_ends, b, b_doc, b_ends):
        self.n, self.a, self.a_doc, self.a_ends, self.b, self.b_doc, self.b_ends = n_docs, a, a_doc, a_ends, b, b_doc, b_ends

    def keys(self, size_b: int) -> np.ndarray:
        """The linked pairs, in order, as one number each."""
        return self.a[self.a_ends].astype(np.int64) * size_b + self.b[self.b_ends]

    def link_docs(self) -> np.ndarray:
        return self.a_doc[self.a_ends]

    def groups(self) -> list[str]:
        """The groups of every document: ``a1,a2|b1;a3|b2,b3``."""
        if not self.a.size:
            return [""] * self.n
        # every token goes behind the tokens of the groups before its own; a group's A tokens stand first
        a_group = np.cumsum(self.a_ends) - self.a_ends
        b_group = np.cumsum(self.b_ends) - self.b_ends
        a_size, b_size = np.bincount(a_group), np.bincount(b_group)
        a_at = np.arange(self.a.size) + (np.cumsum(b_size) - b_size)[a_group]
        b_at = np.arange(self.b.size) + np.cumsum(a_size)[b_group]
        ids = np.empty(self.a.size + self.b.size, dtype=np.int32)
        mark = np.empty(ids.size, dtype=np.uint8)
        ids[a_at], ids[b_at] = self.a, self.b
        mark[a_at] = np.where(self.a_ends, ord("|"), ord(","))
        mark[b_at] = np.where(self.b_ends, ord(";"), ord(","))
        figures, shown = _figures(int(ids.max()))
        chars = figures[ids]
        chars[:, -1] = mark
        text = chars[shown[ids]].tobytes().decode("ascii")
        stop = np.concatenate(([0], np.cumsum(shown.sum(axis=1)[ids])))
        tokens = np.bincount(self.a_doc, minlength=self.n) + np.bincount(self.b_doc, minlength=self.n)
        cut = stop[np.concatenate(([0], np.cumsum(tokens)))]
        return [text[s: max(s, e - 1)] for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


_FIGURES: list[tuple[np.ndarray, np.ndarray]] = []


def _figures(most: int) -> tuple[np.ndarray, np.ndarray]:
    """For every id up to ``most`` its decimal figures, set to the right before one free place, and which places are in use."""
    if not _FIGURES or _FIGURES[0][0].shape[0] <= most:
        ids = np.arange(max(most + 1, 1 << 16))
        width = len(str(ids.size))
        rest = ids[:, None] // 10 ** np.arange(width - 1, -1, -1)
        used = rest > 0
        used[:, -1] = True
        _FIGURES[:] = [(np.append((48 + rest % 10).astype(np.uint8), np.zeros((ids.size, 1), dtype=np.uint8), axis=1),
                        np.append(used, np.ones((ids.size, 1), dtype=bool), axis=1))]
    return _FIGURES[0]


class _Bytes(ByteBpe):
    """The byte-level side: ids and offsets of the texts of one slice."""

    def slice_ids(self, buf: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self._units(buf, offs)
        if not starts.size:
            return np.zeros(0, dtype=np.int64), np.zeros(offs.size, dtype=np.int64)
        idx = self._lookup(hash_words(buf, starts, ends), lambda pick: self.merge(buf, starts[pick], ends[pick]))
        n, head = self.lens[idx].astype(np.int64), self.heads[idx]
        total = np.concatenate(([0], np.cumsum(n)))
        return self.ids[np.arange(total[-1]) - np.repeat(total[:-1] - head, n)].astype(np.int64), total[np.searchsorted(starts, offs)]

    def _units(self, buf, offs):
        return self.pretokens(buf, offs)[:2]


class _Pieces(_Bytes):
    """The piece side. No piece holds a blank behind another character, so a text is cut before
    every blank that follows one; each unit begins with the blank that the library puts there itself."""

    def __init__(self, model: bytes, remembered: int):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.blank = self.sp.piece_to_id("▁")
        self.remembered = remembered
        self._forget()

    def _units(self, buf, offs):
        raw = np.frombuffer(buf, dtype=np.uint8)
        start = raw == 32
        start[1:] &= raw[:-1] != 32
        start[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(start)
        return starts, np.append(starts[1:], raw.size) if starts.size else starts

    def merge(self, buf, starts, ends):
        parts = self.sp.encode([buf[s + 1: e].decode("utf-8") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], num_threads=1)
        for k in np.flatnonzero(ends - starts == 1).tolist():
            parts[k] = [self.blank]                      # a lone blank at the end of a text
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        return np.fromiter((i for p in parts for i in p), dtype=np.int32, count=int(sizes.sum())), sizes


class Aligner:
    """Both tokenizers and the byte tables of their ids."""

    def __init__(self, pair: dict):
        self.a_side, self.b_side = _Bytes(pair["a"], REMEMBERED), _Pieces(pair["model"], REMEMBERED)
        self.a, self.b = _table(pair["a_bytes"]), _table(pair["b_bytes"])
        self.size_b = self.b[0].size

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, Slice]]:
        """(first row, aligned tokens) of bounded runs of rows."""
        texts = texts.cast(pa.large_string()).fill_null("")
        blank = pa.scalar("", pa.large_string())
        spaced = pc.if_else(pc.equal(texts, blank), blank, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, blank))
        for row, buf, offs in text_slices(spaced, SLICE, lower=False):
            n = offs.size - 1
            a, a_offs = self.a_side.slice_ids(buf, offs)
            b, b_offs = self.b_side.slice_ids(buf, offs)
            a_doc, b_doc = np.repeat(np.arange(n), np.diff(a_offs)), np.repeat(np.arange(n), np.diff(b_offs))
            same = self._same(a, a_offs, buf, offs, self.a) & self._same(b, b_offs, buf, offs, self.b)
            if not same.all():
                a, a_doc, b, b_doc = a[same[a_doc]], a_doc[same[a_doc]], b[same[b_doc]], b_doc[same[b_doc]]
            a_stop, b_stop = np.cumsum(self.a[0][a]), np.cumsum(self.b[0][b])
            ends = np.zeros((2, int(a_stop[-1]) + 1 if a.size else 1), dtype=bool)
            ends[0, a_stop], ends[1, b_stop] = True, True
            yield row, Slice(n, a, a_doc, ends[1, a_stop], b, b_doc, ends[0, b_stop])

    @staticmethod
    def _same(ids: np.ndarray, offs: np.ndarray, buf: bytes, at: np.ndarray, table) -> np.ndarray:
        """Which documents' tokens join to their bytes."""
        length = np.diff(_cuts(table[0][ids], offs))
        ok = length == np.diff(at)
        joined = _joined(table, ids)
        want = np.frombuffer(buf, dtype=np.uint8)
        if ok.all() and np.array_equal(joined, want):
            return ok
        first = np.concatenate(([0], np.cumsum(length)))
        for d in np.flatnonzero(ok).tolist():
            ok[d] = np.array_equal(joined[first[d]: first[d + 1]], want[at[d]: at[d + 1]])
        return ok


_ALIGNERS: dict[int, Aligner] = {}


def aligner(pair: dict) -> Aligner:
    """The worker's aligner for these tables; kept between tasks, of bounded size."""
    mark = zlib.crc32(pair["model"], zlib.crc32(pair["a"]["key"].tobytes()))
    if mark not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[mark] = Aligner(pair)
    return _ALIGNERS[mark]


class Tally:
    """Counts of keys in bounded memory: a key has one slot, the first key that comes keeps it;
    the others are held and summed when there are many."""

    def __init__(self):
        self.keys = np.full(_SLOTS, -1, dtype=np.int64)
        self.n = np.zeros(_SLOTS, dtype=np.int64)
        self.rest: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> bool:
        slot = _slot(keys)
        free = self.keys[slot] < 0
        if free.any():
            self.keys[slot[free]] = keys[free]
        own = self.keys[slot] == keys
        self.n += np.bincount(slot[own], minlength=_SLOTS)
        self.rest.append(keys[~own])
        self.held += self.rest[-1].size
        return self.held >= _FLUSH

    def flush(self, end: bool = False) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.unique(np.concatenate(self.rest), return_counts=True) if self.rest else (np.zeros(0, dtype=np.int64),) * 2
        self.rest, self.held = [], 0
        if end:
            used = np.flatnonzero(self.n)
            keys, n = np.concatenate((keys, self.keys[used])), np.concatenate((n, self.n[used]))
        return keys, n


def _slot(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (((mix(keys.view(np.uint64)) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int32)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def pair_counts(docs: DataFrame, pair: dict) -> DataFrame:
    """First pass: (key, n) of the linked pairs, pre-aggregated by task; key = A id * size of B + B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tally = aligner(pair), Tally()
        for batch in batches:
            for _, s in own.slices(read_columns(batch, "text")[0]):
                if tally.add(s.keys(own.size_b)):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in tally.flush()], names=["key", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in tally.flush(end=True)], names=["key", "n"])

    return _texts(docs).select("text").mapInArrow(run, "key long, n long")


class PairTable:
    """Counts of all linked pairs of a corpus, in mapped shards."""

    def __init__(self, folder: str, shards: int, best: np.ndarray):
        self.folder, self.shards, self.best = folder, shards, best
        self.open: dict[int, tuple] = {}
        self.slots: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"open": {}, "slots": None}

    def _mapped(self, shard: int) -> tuple:
        if shard not in self.open:
            a = map_array(f"{self.folder}/table-{shard}.npy")
            fn, keys = PerfectHash.unpacked(a)
            self.open[shard] = fn, keys, a[a.size - keys.size:]
        return self.open[shard]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The count of every key; a key that was never linked is an error. A key
        has one slot of remembered counts; a newcomer takes it over."""
        if self.slots is None:
            self.slots = np.full(_SLOTS, -1, dtype=np.int64), np.zeros(_SLOTS, dtype=np.int64)
        own, known = self.slots
        slot = _slot(keys)
        out = known[slot]
        miss = np.flatnonzero(own[slot] != keys)
        if miss.size:
            u, where, inv = np.unique(keys[miss], return_index=True, return_inverse=True)
            n, shard = np.zeros(u.size, dtype=np.int64), _shard(u, self.shards)
            for s in np.unique(shard).tolist():
                at = np.flatnonzero(shard == s)
                fn, stored, counts = self._mapped(s)
                n[at] = counts[_verified(fn, stored, u[at])]
            out[miss] = n[inv]
            own[slot[miss[where]]], known[slot[miss[where]]] = u, n
        return out


def _verified(fn: PerfectHash, own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    number = fn.numbers(keys)
    if not np.array_equal(own[number], keys):
        raise RuntimeError("a linked pair is missing from the first pass: the documents have changed since")
    return number


def _by(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of batches sorted by ``name``, each of one value."""
    for batch in batches:
        value = read_columns(batch, name)[0].to_numpy()
        first = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if value.size else np.zeros(0, dtype=np.int64)
        for i, j in zip(first.tolist(), [*first[1:].tolist(), value.size], strict=True):
            yield int(value[i]), batch.slice(i, j - i)


def _shards_for(n: int) -> int:
    """Few keys a shard while there are few; at most MOST_SHARDS until a shard would pass LARGE_SHARD."""
    return max(1, min(MOST_SHARDS, -(-n // SHARD_KEYS)), -(-n // LARGE_SHARD))


def count_pairs(docs: DataFrame, pair: dict) -> PairTable:
    """All steps up to the table that the second pass reads."""
    spark = docs.sparkSession
    folder = local_path(shared_path(spark, "pairs"))
    os.makedirs(folder, exist_ok=True)
    size_b = len(pair["b_bytes"])
    counted = keep(pair_counts(docs, pair), "pair_counts")
    distinct = keep(counted.select("key").distinct(), "pair_keys")
    shards = _shards_for(distinct.count())
    leaves = FAN                                             # leaves of the tree per shard
    while counted.count() > leaves * shards * LEAF_ROWS:
        leaves *= FAN

    def with_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % leaves
        for batch in batches:
            leaf = _shard(read_columns(batch, "key")[0].to_numpy(), shards) * leaves + salt
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=["leaf", *batch.schema.names])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = -1, []

        def write():
            keys = np.concatenate(held)
            write_array(f"{folder}/keys-{at}.npy", PerfectHash.build(keys).packed(keys))
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([keys.size])], names=["shard", "n"])

        for shard, part in _by(batches, "shard"):
            if held and shard != at:
                yield write()
                held = []
            at = shard
            held.append(read_columns(part, "key")[0].to_numpy())
        if held:
            yield write()

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fn, own, vector = -1, None, None, None
        for leaf, part in _by(batches, "leaf"):
            if leaf != at:
                if vector is not None:
                    yield _chunks(at // leaves, at % leaves, vector)
                at, (fn, own) = leaf, PerfectHash.unpacked(map_array(f"{folder}/keys-{leaf // leaves}.npy"))
                vector = np.zeros(own.size, dtype=np.int64)
            keys, n = (x.to_numpy() for x in read_columns(part, "key", "n"))
            np.add.at(vector, _verified(fn, own, keys), n)
        if vector is not None:
            yield _chunks(at // leaves, at % leaves, vector)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, packed, vector = -1, None, None, None

        def write():
            write_array(f"{folder}/table-{at}.npy", np.concatenate((packed, vector)))
            top = np.zeros(size_b, dtype=np.int64)
            np.maximum.at(top, own % size_b, vector)
            b = np.flatnonzero(top)
            return pa.RecordBatch.from_arrays([pa.array(b), pa.array(top[b])], names=["b", "n"])

        for shard, part in _by(batches, "shard"):
            if shard != at:
                if vector is not None:
                    yield write()
                at, packed = shard, map_array(f"{folder}/keys-{shard}.npy")
                own = PerfectHash.unpacked(packed)[1]
                vector = np.zeros(own.size, dtype=np.int64)
            for chunk, raw in zip(*(x.to_pylist() for x in read_columns(part, "chunk", "counts")), strict=True):
                vector[chunk * CHUNK: (chunk + 1) * CHUNK] += np.frombuffer(raw, dtype=np.int64)
        if vector is not None:
            yield write()

    keep(distinct.mapInArrow(with_leaf, "leaf int, key long").select(F.expr(f"leaf div {leaves}").alias("shard"), "key")
         .repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(build, "shard long, n long"), "pair_shards")
    vectors = keep(counted.mapInArrow(with_leaf, "leaf int, key long, n long").repartition(shards * leaves, "leaf")
                   .sortWithinPartitions("leaf").mapInArrow(dense, VECTORS), "pair_vectors")
    while leaves > 1:
        leaves = -(-leaves // FAN)
        vectors = keep(vectors.withColumn("leaf", F.expr(f"leaf div {FAN}"))
                       .repartition(shards * leaves, "shard", "chunk", "leaf").sortWithinPartitions("shard", "chunk", "leaf")
                       .mapInArrow(_sum_chunks, VECTORS), "pair_vectors")
    tops = keep(vectors.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(finish, "b long, n long"), "pair_tops")
    best = np.zeros(size_b, dtype=np.int64)
    for r in tops.groupBy("b").agg(F.max("n").alias("n")).collect():   # at most one row per id of B
        best[r["b"]] = r["n"]
    return PairTable(folder, shards, best)


def _chunks(shard: int, leaf: int, vector: np.ndarray) -> pa.RecordBatch:
    """A dense vector as rows of CHUNK entries; chunks of zeros stay out."""
    parts = [(k, vector[k * CHUNK: (k + 1) * CHUNK]) for k in range(-(-vector.size // CHUNK))]
    parts = [(k, x.tobytes()) for k, x in parts if x.any()]
    n = len(parts)
    return pa.RecordBatch.from_arrays(
        [pa.array([shard] * n, pa.int64()), pa.array([leaf] * n, pa.int64()), pa.array([k for k, _ in parts], pa.int32()),
         pa.array([x for _, x in parts], pa.binary())], names=["shard", "leaf", "chunk", "counts"])


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum rows of the same shard, chunk and leaf, which stand together."""
    at, total = None, None

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([at[2]], pa.int32()),
             pa.array([total.tobytes()], pa.binary())], names=["shard", "leaf", "chunk", "counts"])

    for batch in batches:
        names = ("shard", "leaf", "chunk", "counts")
        for *key, raw in zip(*(x.to_pylist() for x in read_columns(batch, *names)), strict=True):
            x = np.frombuffer(raw, dtype=np.int64)
            if key != at:
                if at is not None:
                    yield row()
                at, total = key, x.copy()
            else:
                total += x
    if at is not None:
        yield row()


def alignments(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of ``docs``."""
    pair = load_pair(a_path, b_path)
    table = count_pairs(docs, pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(pair)
        for batch in batches:
            ident, text = read_columns(batch, "doc_id", "text")
            for row, s in own.slices(text):
                keys, doc = s.keys(own.size_b), s.link_docs()
                counts = table.counts(keys)
                best = counts == table.best[keys % own.size_b]
                at = np.searchsorted(doc, np.arange(s.n + 1))
                links = np.diff(at)
                yield pa.RecordBatch.from_arrays(
                    [ident.slice(row, s.n), pa.array(np.bincount(s.a_doc, minlength=s.n)),
                     pa.array(np.bincount(s.b_doc, minlength=s.n)), pa.array(links), pa.array(links),
                     pa.array(np.diff(np.concatenate(([0], np.cumsum(best)))[at])),
                     pa.array(np.diff(np.concatenate(([0], np.cumsum(counts)))[at])), pa.array(s.groups())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return _texts(docs).mapInArrow(run, RESULT)
