"""Interpolated modified Kneser-Ney model (bigrams over unigrams over uniform),
counted in Spark, stored as sorted hash arrays and memory-mapped by workers.

Build, all sizes growing with the training texts:

1. Words are counted (hash, count); Spark sums them and writes one sorted hash
   array plus aligned counts. A word's id is its place in that array.
2. Every task maps its words to ids through the mapped array, counts its
   bigrams and shuffles them by shard, the leading bits of the bigram's key.
   All bigrams of a context share a shard, except those of very frequent
   contexts, which are spread. A shard is written as a sorted key array with
   counts, and yields partial statistics of its contexts and of the
   continuation counts of its words.
3. The statistics are summed by id and written as arrays aligned with the words.

Workers map the files read-only, so memory holds only touched pages. The shared
folder must be a path that workers can open as files (a mounted file system);
anything else is refused with an error.

Defined cases: a null or empty text is one end token; repeated rows count each
time; a null doc_id counts as the empty string for the split; an empty training
set gives the uniform model; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep, shared_path
from .words import hash_words, mix, read_columns, text_slices, word_bounds

END = -7046029254386353131                  # hash of the end token
SHARD_ROWS = 1_000_000                      # bigram rows aimed at per shard
FREQUENT = 2000                             # a context with over 1/2000 of all tokens is spread ...
SPREAD = 16                                 # ... over so many key prefixes
_LOW = np.uint64((1 << 44) - 1)
_K = np.uint64(0x9E3779B97F4A7C15)
_FLUSH = 1 << 21


def local_path(path: str) -> str:
    """The path under which workers open shared files."""
    p = urlparse(path)
    if p.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need a mounted shared folder, not {p.scheme}://")
    return p.path


def training(doc_id: Column) -> Column:
    """The remainder that decides the split; 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def tokens_of(buf: bytes, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signed hashes of words with an end after each text, first place per text)."""
    doc, starts, ends = word_bounds(buf, offs)
    words = hash_words(buf, starts, ends).view(np.int64)
    n_docs = offs.size - 1
    last = np.searchsorted(doc, np.arange(n_docs), side="right")
    out = np.insert(words, last, END)
    return out, np.concatenate(([0], last + np.arange(1, n_docs + 1)))


class Tally:
    """Counts of int64 keys, kept sorted and merged in bounded pieces."""

    def __init__(self, columns: int = 1):
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> bool:
        self.parts.append(keys)
        self.held += keys.size
        return self.held >= _FLUSH

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate(self.parts) if self.parts else np.zeros(0, dtype=np.int64)
        self.parts, self.held = [], 0
        keys.sort()
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if keys.size else np.zeros(0, dtype=np.int64)
        return keys[first], np.diff(np.append(first, keys.size))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()

    def out():
        h, c = tally.flush()
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], names=["h", "c"])

    for batch in batches:
        for _, buf, offs in text_slices(batch.column(0)):
            if tally.add(tokens_of(buf, offs)[0]):
                yield out()
    yield out()


# --- files -----------------------------------------------------------------------

def _write(path: str, a: np.ndarray) -> None:
    """Write a whole file at once; a repeated task replaces it with the same bytes."""
    part = f"{path}.{os.getpid()}.part"
    a.tofile(part)
    os.replace(part, path)


def _write_slice(path: str, a: np.ndarray, at: int) -> None:
    """Write elements from place ``at`` of a file that already has its full size."""
    with open(path, "r+b") as f:
        f.seek(at * a.itemsize)
        f.write(a.tobytes())


class Model:
    """The mapped arrays. ``meta`` holds a few numbers: sizes and discounts."""

    def __init__(self, folder: str, meta: dict):
        self.folder, self.m = folder, meta
        self.words = self._map("words.hash", np.int64, meta["V"])
        self.count = self._map("words.count", np.int64, meta["V"])
        if "bits" in meta and "D" in meta:
            self.cont = self._map("words.cont", np.int64, meta["V"])
            self.total = self._map("context.total", np.int64, meta["V"] + 1)
            self.kinds = self._map("context.kinds", np.int64, 3 * (meta["V"] + 1)).reshape(-1, 3)
            self.shards: dict[int, tuple] = {}

    def _map(self, name: str, dtype, n: int) -> np.ndarray:
        return np.memmap(f"{self.folder}/{name}", dtype=dtype, mode="r", shape=(n,)) if n else np.zeros(0, dtype=dtype)

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Word ids, -1 for unknown words."""
        if not self.words.size:
            return np.full(h.size, -1, dtype=np.int64)
        u, inv = np.unique(h, return_inverse=True)
        at = np.searchsorted(self.words, u)
        at[at == self.words.size] = 0
        return np.where(self.words[at] == u, at, -1)[inv]

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Signed key of each bigram of ids; the leading 20 bits come from the
        context, so that a context stays in one shard unless it is frequent.
        The id V stands for the beginning of a text."""
        often = (self.count[np.minimum(a, self.m["V"] - 1)] * FREQUENT > self.m["N"]) | (a == self.m["V"])
        mixed = mix(a.astype(np.uint64) * _K + b.astype(np.uint64))
        lead = mix(a.astype(np.uint64) * np.uint64(SPREAD) + np.where(often, mixed % np.uint64(SPREAD), np.uint64(0)))
        return ((lead & ~_LOW) | (mixed & _LOW)).view(np.int64)

    def _shard(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        if s not in self.shards:
            path = f"{self.folder}/bigrams.{s}"
            n = os.path.getsize(path + ".key") // 8 if os.path.exists(path + ".key") else 0
            self.shards[s] = tuple(np.memmap(f"{path}.{k}", dtype=t, mode="r", shape=(n,)) if n else np.zeros(0, dtype=t)
                                   for k, t in (("key", np.int64), ("count", np.int32)))
        return self.shards[s]

    def bigram_counts(self, keys: np.ndarray) -> np.ndarray:
        u, inv = np.unique(keys, return_inverse=True)
        out = np.zeros(u.size, dtype=np.int64)
        shard = u >> (64 - self.m["bits"])
        cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if u.size else []
        for s, e in zip(cut, np.append(cut[1:], u.size) if u.size else [], strict=True):
            key, count = self._shard(int(shard[s]))
            if key.size:
                at = np.searchsorted(key, u[s:e])
                at[at == key.size] = 0
                out[s:e] = np.where(key[at] == u[s:e], count[at], 0)
        return out[inv]

    # --- probabilities ---

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        """Continuation probability, interpolated with the uniform distribution."""
        m = self.m
        uniform = 1.0 / (m["V"] + 1)
        if not m["pairs"]:
            return np.full(ids.size, uniform)
        known = ids >= 0
        c = np.where(known, self.cont[np.where(known, ids, 0)], 0)
        d = np.array([0.0, *m["D1"]])[np.minimum(c, 3)]
        return (c - d) / m["pairs"] + m["gamma1"] * uniform

    def bigram(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """P(b | a); a = V at the beginning of a text, -1 for an unknown word."""
        low = self.unigram(b)
        ok = a >= 0
        total = np.where(ok, self.total[np.where(ok, a, 0)], 0) if self.m["V"] else np.zeros(a.size)
        ok &= total > 0
        if not ok.any():
            return low
        x, y, t = a[ok], b[ok], total[ok].astype(float)
        c = np.zeros(x.size, dtype=np.int64)
        seen = y >= 0
        c[seen] = self.bigram_counts(self.keys(x[seen], y[seen]))
        d = np.array([0.0, *self.m["D"]])
        gamma = (self.kinds[x] * d[1:]).sum(axis=1) / t
        out = low.copy()
        out[ok] = (c - d[np.minimum(c, 3)]) / t + gamma * low[ok]
        return out


def discounts(n: list[int]) -> list[float]:
    """The three discounts from the numbers of items seen once to four times.

    Where a number is zero the usual formula is undefined; each discount is
    kept within (0, its count)."""
    n1, n2, n3, n4 = (max(x, 0) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), raw, strict=True)]


# --- build -----------------------------------------------------------------------

def _bits(rows: int) -> int:
    return min(20, max(2, (max(rows, 1) // SHARD_ROWS).bit_length() + 1))


def _sizes(df: DataFrame, shard: str) -> dict[int, int]:
    """Rows per shard; as many numbers as shards, which are few."""
    return {r[0]: r[1] for r in df.groupBy(shard).count().collect()}


def _kinds(df: DataFrame, col: str) -> list[int]:
    row = df.agg(*[F.sum((F.col(col) == k).cast("long")) for k in (1, 2, 3, 4)]).first()
    return [x or 0 for x in row]


def build(train: DataFrame) -> Model:
    """Count the model over the column ``text`` of ``train`` and write its files."""
    spark = train.sparkSession
    folder = local_path(shared_path(spark, "kneser_ney"))
    os.makedirs(folder)
    counts = keep(train.select("text").mapInArrow(_count_words, "h long, c long")
                  .groupBy("h").agg(F.sum("c").alias("c")), "words")
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = int(n or 0), int(v)
    bits = _bits(v)
    shard = F.shiftright("h", 64 - bits).cast("int")
    sizes = _sizes(counts.select(shard.alias("s")), "s")
    first, at = {}, 0
    for s in sorted(sizes):
        first[s], at = at, at + sizes[s]
    for name, width in (("words.hash", v), ("words.count", v), ("words.cont", v), ("context.total", v + 1),
                        ("context.kinds", 3 * (v + 1))):
        with open(f"{folder}/{name}", "wb") as f:
            f.truncate(8 * width)

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([*batches], schema=pa.schema([("s", pa.int32()), ("h", pa.int64()), ("c", pa.int64())]))
        s, h, c = (t.column(i).to_numpy() for i in range(3))
        done = 0
        for k in np.unique(s):
            mine = np.flatnonzero(s == k)
            mine = mine[np.argsort(h[mine])]
            _write_slice(f"{folder}/words.hash", h[mine], first[int(k)])
            _write_slice(f"{folder}/words.count", c[mine], first[int(k)])
            done += mine.size
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    if v:
        counts.select(shard.alias("s"), "h", "c").repartition(len(sizes), "s") \
            .mapInArrow(write_words, "n long").agg(F.sum("n")).first()
    meta = {"N": n, "V": v, "bits": 0}
    if not v:
        return Model(folder, meta | {"bits": 2, "pairs": 0, "D": [0.5] * 3, "D1": [0.5] * 3, "gamma1": 1.0})
    pair_bits = _bits(n)
    meta["bits"] = pair_bits

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder, meta)
        held: list[np.ndarray] = []
        size = 0

        def out():
            a, b = np.concatenate(held, axis=1)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            a, b, c = a[begin], b[begin], np.diff(np.append(begin, order.size))
            s = (model.keys(a, b) >> (64 - pair_bits)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (s, a, b, c)], names=["s", "a", "b", "c"])

        for batch in batches:
            for _, buf, offs in text_slices(batch.column(0)):
                h, place = tokens_of(buf, offs)
                b = model.ids(h)
                a = np.empty_like(b)
                a[1:] = b[:-1]
                a[place[:-1]] = v
                held.append(np.stack((a, b)))
                size += b.size
                if size >= _FLUSH:
                    yield out()
                    held.clear()
                    size = 0
        if size:
            yield out()

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder, meta)
        t = pa.Table.from_batches([*batches], schema=pa.schema(
            [("s", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())]))
        if not t.num_rows:
            return
        shard_of = t.column(0).to_numpy()
        for k in np.unique(shard_of):
            a, b, c = (t.column(i).to_numpy()[shard_of == k] for i in (1, 2, 3))
            key = model.keys(a, b)
            order = np.argsort(key, kind="stable")
            key = key[order]
            begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            a, b, c = a[order][begin], b[order][begin], np.add.reduceat(c[order], begin)
            _write(f"{folder}/bigrams.{k}.key", key[begin])
            _write(f"{folder}/bigrams.{k}.count", c.astype(np.int32))
            u, inv = np.unique(a, return_inverse=True)
            kind = [np.bincount(inv, weights=w, minlength=u.size).astype(np.int64)
                    for w in (c, c == 1, c == 2, c >= 3)]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(u.size, np.int32)), pa.array(u), *map(pa.array, kind)],
                                             names=list("kiwxyz"))
            u, times = np.unique(b, return_counts=True)
            none = pa.array(np.zeros(u.size, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(u.size, np.int32)), pa.array(u), pa.array(times),
                                              none, none, none], names=list("kiwxyz"))
            # how often bigrams were seen once to four times
            yield pa.RecordBatch.from_arrays(
                [pa.array([2], pa.int32()), pa.array([0], pa.int64()),
                 *[pa.array([int((c == j).sum())], pa.int64()) for j in (1, 2, 3, 4)]], names=list("kiwxyz"))

    pairs = train.select("text").mapInArrow(count_pairs, "s int, a long, b long, c long")
    partial = keep(pairs.repartition(1 << pair_bits, "s").mapInArrow(
        write_pairs, "k int, i long, w long, x long, y long, z long"), "pair_statistics")
    stats = keep(partial.groupBy("k", "i").agg(*[F.sum(c).alias(c) for c in "wxyz"]), "statistics")
    seen = stats.where("k = 2").first()
    cont = stats.where("k = 1")
    n_cont = _kinds(cont, "w")
    distinct, c1, c2, c3 = cont.agg(F.sum("w"), *[F.sum((F.col("w") == j).cast("long")) for j in (1, 2)],
                                    F.sum((F.col("w") >= 3).cast("long"))).first()
    step = max(1, -(-(v + 1) // max(1, len(sizes))))

    def write_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches([*batches], schema=pa.schema(
            [("s", pa.int64()), ("k", pa.int32()), ("i", pa.int64()), *[(x, pa.int64()) for x in "wxyz"]]))
        s, k, i, w, x, y, z = (t.column(j).to_numpy() for j in range(7))
        for part in np.unique(s):
            lo = int(part) * step
            mine = s == part
            for kind, name, width in ((0, "context.total", v + 1), (1, "words.cont", v)):
                at = np.flatnonzero(mine & (k == kind))
                dense = np.zeros(max(0, min(step, width - lo)), dtype=np.int64)
                dense[i[at] - lo] = w[at]
                _write_slice(f"{folder}/{name}", dense, lo)
                if not kind:
                    dense = np.zeros((dense.size, 3), dtype=np.int64)
                    dense[i[at] - lo] = np.stack((x[at], y[at], z[at]), axis=1)
                    _write_slice(f"{folder}/context.kinds", dense, 3 * lo)
        yield pa.RecordBatch.from_arrays([pa.array([len(s)], pa.int64())], names=["n"])

    stats.where("k < 2").select(F.floor(F.col("i") / step).alias("s"), "k", "i", *"wxyz") \
        .repartition(len(sizes), "s").mapInArrow(write_stats, "n long").agg(F.sum("n")).first()
    d1 = discounts(n_cont)
    meta |= {"D": discounts([seen[c] for c in "wxyz"]), "D1": d1, "pairs": int(distinct),
             "gamma1": (d1[0] * c1 + d1[1] * c2 + d1[2] * c3) / distinct}
    return Model(folder, meta)


# --- scoring ---------------------------------------------------------------------

def score(docs: DataFrame, folder: str, meta: dict) -> DataFrame:
    """Score every row of ``docs`` (doc_id, held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(folder, meta)
        n, v = meta["N"], meta["V"]
        for batch in batches:
            ident, held, text = read_columns(batch, "doc_id", "held_out", "text")
            for row, buf, offs in text_slices(text):
                h, place = tokens_of(buf, offs)
                ids = model.ids(h)
                known = ids >= 0
                c = np.where(known, model.count[np.where(known, ids, 0)], 0) if v else np.zeros(ids.size)
                base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
                before = np.empty_like(ids)
                before[1:] = ids[:-1]
                before[place[:-1]] = v if v else -1
                logp = np.log10(model.bigram(before, ids))
                k = offs.size - 1
                yield pa.RecordBatch.from_arrays([
                    ident.slice(row, k), held.slice(row, k), pa.array(np.diff(place)),
                    pa.array(np.add.reduceat(known.astype(np.int64), place[:-1])), pa.array(np.full(k, n)),
                    pa.array(np.add.reduceat(base, place[:-1])), pa.array(np.add.reduceat(logp, place[:-1]))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double")


def lm_scores(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out and score all rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (training(F.col("doc_id")) == 1).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    model = build(rows.where(~F.col("held_out")))
    return score(rows, model.folder, model.m)
