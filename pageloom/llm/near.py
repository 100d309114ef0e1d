"""MinHash near-duplicates: SuperMinHash signatures, banding, verification on
the full shingle sets, and union-find grouping.

Two texts are linked when 100 * |A and B| >= 75 * |A or B| over their distinct
five-word shingles (``superminhash``). Steps:

1. One pass over the texts gives each document its set's size, fingerprint,
   band keys and a one-byte-per-slot sketch. Documents with equal sets form one
   node, so thousands of copies cost one node.
2. Per bucket every node meets the bucket's smallest node. Pairs whose sketch
   cannot come from a linked pair (six standard deviations) are dropped; each
   node verifies its few best partners first, and the links are grouped.
3. Nodes that share a bucket but are not yet grouped meet exhaustively, in
   blocks of bounded size, so a bucket whose smallest node is a stranger loses
   nothing. Every plausible pair is verified on the full sets inside the
   block, which reports a spanning forest of its links only.

Verification reads the texts of the candidate documents again rather than
storing all sets.

Defined cases: a null, empty or blank text has an empty set, is linked with
nothing and is its own component; texts of one to four words are one shingle;
rows that repeat a doc_id or a text are one node; a null doc_id takes part, but
component_id is the smallest id that is not null (null if there is none, and
such a row is kept); extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components, local_roots
from .store import keep
from .superminhash import BANDS, SLOTS, band_keys, set_key, shingle_sets, signatures, sketch
from .words import read_columns, text_slices

PERCENT = 75
#: Fewest equal sketch bytes of a linked pair: the mean at 0.75 less six standard deviations.
LEAST_EQUAL = int(SLOTS * 0.75 - 6 * (SLOTS * 0.75 * 0.25) ** 0.5)
HOT_NODES = 10_000        # nodes whose labels are broadcast
BLOCK = 256               # nodes of a bucket that meet at once
TRIES = 4                 # partners a node verifies in the first step

_SKETCH = "doc_id long, n_shingles long, node long, bands array<long>, sketch binary, packed binary"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, text = read_columns(batch, "doc_id", "text")
        for row, buf, offs in text_slices(text):
            elems, at = shingle_sets(buf, offs)
            sig = signatures(elems, at)
            keys = band_keys(sig)
            n = np.diff(at)
            some = n > 0
            ends = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                ids.slice(row, n.size), pa.array(n), pa.array(set_key(elems, at), mask=~some),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].ravel())),
                pa.array([x.tobytes() for x in sketch(sig)], type=pa.binary()),
                pa.array([x.tobytes() for x in keys], type=pa.binary())],
                names=["doc_id", "n_shingles", "node", "bands", "sketch", "packed"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingle sets of candidate documents, if they still are the wanted node."""
    for batch in batches:
        want, text = read_columns(batch, "node", "text")
        for row, buf, offs in text_slices(text):
            elems, at = shingle_sets(buf, offs)
            node = set_key(elems, at)
            ok = np.flatnonzero(node == want.slice(row, offs.size - 1).to_numpy())
            raw = elems.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[ok]), pa.array([raw[8 * at[i]: 8 * at[i + 1]] for i in ok], type=pa.binary())],
                names=["node", "set"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep the pairs (a, b, set_a, set_b) whose sets are similar enough."""
    for batch in batches:
        a, b, sa, sb = batch.columns
        ok = np.zeros(batch.num_rows, dtype=bool)
        for i in range(batch.num_rows):
            x = np.frombuffer(sa[i].as_buffer(), dtype=np.uint64)
            y = np.frombuffer(sb[i].as_buffer(), dtype=np.uint64)
            if x.size > y.size:
                x, y = y, x
            if 100 * x.size < PERCENT * y.size:
                continue
            at = np.searchsorted(y, x)
            at[at == y.size] = 0
            both = int((y[at] == x).sum())
            ok[i] = 100 * both >= PERCENT * (x.size + y.size - both)
        mask = pa.array(ok)
        yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])


def equal_bytes(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Number of equal sketch bytes, row by row."""
    x = np.frombuffer(b"".join(a.to_pylist()), dtype=np.uint8).reshape(-1, SLOTS)
    y = np.frombuffer(b"".join(b.to_pylist()), dtype=np.uint8).reshape(-1, SLOTS)
    return (x == y).sum(axis=1)


def _plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sketch_a, sketch_b) to (a, b, equal), dropping hopeless ones."""
    for batch in batches:
        if batch.num_rows:
            eq = equal_bytes(batch.column(2), batch.column(3))
            mask = eq >= LEAST_EQUAL
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(mask)), batch.column(1).filter(pa.array(mask)), pa.array(eq[mask])],
                names=["a", "b", "equal"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Cut rows sorted by (bucket, lo, hi) into one table per group. A group
    holds at most two blocks; one that an Arrow batch cuts in two is carried over."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        key = np.stack([t.column(i).to_numpy() for i in range(3)])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        for s, e in zip(cut[:-1], cut[1:], strict=True):
            if e - s > 1:
                yield t.slice(s, e - s)
        rest = t.slice(cut[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest


def _cross(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the plausible pairs of a group whose ends are not yet grouped."""
    lo, hi, blk, comp = (t.column(i).to_numpy() for i in (1, 2, 3, 4))
    sk = np.frombuffer(b"".join(t.column(6).to_pylist()), dtype=np.uint8).reshape(-1, SLOTS)
    i, j = np.triu_indices(t.num_rows, 1)
    far = comp[i] != comp[j]
    if lo[0] != hi[0]:
        far &= blk[i] != blk[j]
    i, j = i[far], j[far]
    ok = np.zeros(i.size, dtype=bool)
    for p in range(0, i.size, 1 << 15):
        x, y = i[p: p + (1 << 15)], j[p: p + (1 << 15)]
        ok[p: p + (1 << 15)] = (sk[x] == sk[y]).sum(axis=1) >= LEAST_EQUAL
    return i[ok], j[ok]


def _hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of a group that have a plausible partner in another component."""
    for t in _groups(batches):
        i, j = _cross(t)
        if i.size:
            node = t.column(5).to_numpy()[np.unique(np.concatenate((i, j)))]
            yield pa.RecordBatch.from_arrays([pa.array(node)], names=["node"])


def _common(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the set pairs (i, j)."""
    who = np.repeat(np.arange(len(sets)), [x.size for x in sets])
    _, col = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(col, kind="stable")
    who, col = who[order], col[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for c in range(0, int(col[-1]) + 1, 8192):  # a bounded slice of the shingles at a time
        s, e = np.searchsorted(col, [c, c + 8192])
        has = np.zeros((len(sets), 8192), dtype=np.float32)
        has[who[s:e], col[s:e] - c] = 1
        out += has @ has.T
    return out[i, j].astype(np.int64)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verify all plausible pairs of each group on the full sets and report a
    spanning forest of the links: fewer rows than the group has nodes.

    A pair that shares several buckets is verified in the first of them."""
    for t in _groups(batches):
        i, j = _cross(t)
        if not i.size:
            continue
        bands = np.frombuffer(b"".join(t.column(7).to_pylist()), dtype=np.int64).reshape(-1, BANDS)
        here = t.column(0)[0].as_py()
        first = (bands[i] == bands[j]).argmax(axis=1)
        mine = bands[i, first] == here
        i, j = i[mine], j[mine]
        if not i.size:
            continue
        used, at = np.unique(np.concatenate((i, j)), return_inverse=True)
        sets = [np.frombuffer(t.column(8)[int(k)].as_buffer(), dtype=np.uint64) for k in used]
        size = np.array([x.size for x in sets])
        x, y = at[: i.size], at[i.size:]
        fit = 100 * np.minimum(size[x], size[y]) >= PERCENT * np.maximum(size[x], size[y])
        x, y = x[fit], y[fit]
        if not x.size:
            continue
        both = _common(sets, x, y)
        linked = 100 * both >= PERCENT * (size[x] + size[y] - both)
        node = t.column(5).to_numpy()[used]
        if linked.any():
            ids, root = local_roots(node[x[linked]], node[y[linked]])
            far = ids != root
            yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(root[far])], names=["a", "b"])


class _Verifier:
    """Confirms pairs of nodes on their full sets, read from the texts."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.nodes = nodes

    def sets(self, ends: DataFrame) -> DataFrame:
        """(node, set) of the nodes in ``ends``."""
        want = self.nodes.select("node", "doc_id").join(ends, "node")
        texts = self.docs.join(want, self.docs["doc_id"].eqNullSafe(want["doc_id"])).select("node", "text")
        return keep(texts.mapInArrow(_sets, "node long, set binary")
                    .groupBy("node").agg(F.first("set").alias("set")), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are similar enough."""
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"))
        return keep(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
                    .select("a", "b", "set_a", "set_b").mapInArrow(_linked, "a long, b long"), "links")


def _buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node) for buckets with at least two nodes."""
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).where("n > 1")
    return rows.join(shared, "bucket")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    each = keep(texts.mapInArrow(_sketches, _SKETCH), "sketches")
    nodes = keep(each.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        F.first("packed").alias("packed"), F.count(F.lit(1)).alias("copies")), "nodes")
    verify = _Verifier(texts, nodes)
    sk = lambda c: nodes.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}"))

    buckets = keep(_buckets(nodes), "buckets")
    stars = buckets.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(sk("a"), "a").join(sk("b"), "b").select("a", "b", "sketch_a", "sketch_b") \
        .mapInArrow(_plausible, "a long, b long, equal long")
    rank = Window.partitionBy("b").orderBy(F.desc("equal"), "a")   # at most one row per band
    best = keep(stars.withColumn("k", F.row_number().over(rank)).where(f"k <= {TRIES}").select("a", "b"), "best")
    first = verify.links(best)
    comp = keep(components(first), "first_groups")

    rows = buckets.select("bucket", "node", "n").join(comp, "node", "left") \
        .select("bucket", "node", "n", F.coalesce("root", "node").alias("comp"))
    # the largest group of a bucket need not meet itself: its nodes go once to every block of the others, which
    # meet each other and all of it
    per = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = per.groupBy("bucket").agg(F.max_by("comp", F.struct("c", "comp")).alias("top"), F.max("c").alias("large"),
                                      F.sum("c").alias("every"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    few = F.col("every") <= BLOCK                            # one block: everybody meets there once
    in_top = (F.col("comp") == F.col("top")) & ~few
    first_rest, rest = F.ceil(F.col("large") / BLOCK).cast("int"), F.ceil((F.col("every") - F.col("large")) / BLOCK).cast("int")
    at = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    rows = rows.join(mixed, "bucket").join(nodes.select("node", "sketch"), "node") \
        .withColumn("blk", F.when(few, 0).when(in_top, at(first_rest)).otherwise(first_rest + at(rest))) \
        .withColumn("other", F.explode(F.sequence(F.when(in_top, first_rest).otherwise(F.lit(0)),
                                                  F.when(few, 0).otherwise(first_rest + rest - 1)))) \
        .select("bucket", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"),
                "blk", "comp", "node", "sketch")
    order = ("bucket", "lo", "hi")
    rows = keep(rows.repartition(*order), "meetings")
    hopeful = keep(rows.sortWithinPartitions(*order).mapInArrow(_hopeful, "node long").distinct(), "hopeful")
    sets = verify.sets(hopeful).join(nodes.select("node", "packed"), "node")
    second = keep(rows.join(sets, "node").select(*rows.columns, "packed", "set").repartition(*order)
                  .sortWithinPartitions(*order).mapInArrow(_settle, "a long, b long"), "second_links")
    groups = keep(components(first.union(second)), "groups")

    named = nodes.select("node", "doc_id").join(groups, "node")
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("lowest"))
    final = groups.join(lowest, "root").select("node", "lowest")
    own = nodes.select("node", "copies", F.col("doc_id").alias("own"))
    labels = keep(own.join(final, "node", "left").select("node", "copies", F.coalesce("lowest", "own").alias("label")), "labels")
    # the nodes with most copies are broadcast, a bounded number of narrow rows; the others have few copies each
    hot = keep(labels.orderBy(F.desc("copies"), "node").limit(HOT_NODES).select("node", F.col("label").alias("hot")), "hot")
    out = each.select("doc_id", "n_shingles", "node").join(F.broadcast(hot), "node", "left")
    known = out.where("hot is not null or node is null").withColumn("label", F.col("hot"))
    others = out.where("hot is null and node is not null").join(labels.select("node", "label"), "node", "left")
    out = known.unionByName(others)
    cid = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("label"))
    return out.select("doc_id", "n_shingles", cid.alias("component_id"),
                      F.coalesce(F.col("doc_id") == cid, cid.isNull()).alias("kept"))
