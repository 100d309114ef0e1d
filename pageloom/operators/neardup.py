"""E10, near part: documents whose word shingles overlap, as connected groups.

1. One pass over the lower-cased texts makes shingle sets and MinHash signatures on arrays (``shingles.py``);
   documents with equal sets are one node. Only the nodes that meet another get their sets from the texts again.
2. Nodes that share a band of their signature meet. Pairs whose sizes or sketches (a byte per slot) rule a link out are
   dropped before any set is fetched. First each node meets the smallest and the largest of its buckets and verifies
   its ``TRIES`` likeliest partners: linear, and enough to group most copies.
3. In buckets that still hold several groups the nodes outside the largest one
   meet everybody else, in blocks: the largest group's nodes go to the blocks of the others, the others to
   all blocks of their bucket, so one stranger in a bucket of a million copies costs a million rows. A block compares its
   sketches first; only nodes with a likely partner fetch their sets, only for the first bucket that both share, and a
   block reports a spanning forest of its links.
4. Every link is verified on the whole shingle sets; groups are the connected components of
   the verified links, by alternating stars.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .dedup import bloom_filter
from .shingles import BANDS, SLOTS, band_keys, common, set_id, shingle_sets, signatures, sketches, text_slices

THRESHOLD = 0.8
BLOCK = 256               # nodes of a bucket that meet in one place,
ELEMENTS = 1 << 20        # and shingles of them
TRIES = 4                 # partners a node verifies before the blocks

_MEETING = ("bucket", "lo", "hi")
_NODE = "id long, n int, bands array<long>, sketch binary"


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, id, n, bands, sketch); a text without words has no id and no bands."""
    for batch in batches:
        for row, data, offs in text_slices(batch.column(1)):
            sets = shingle_sets(data, offs)
            some = np.array([x.size > 0 for x in sets])
            sig = signatures([x for x in sets if x.size])
            ends = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
            sketch = iter(sketches(sig))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(row, len(sets)),
                pa.array([set_id(x) if x.size else None for x in sets], pa.int64()),
                pa.array([x.size for x in sets], pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(band_keys(sig).ravel())),
                pa.array([next(sketch).tobytes() if x.size else None for x in sets], pa.binary())],
                names=["key", "id", "n", "bands", "sketch"])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, id, sh)."""
    for batch in batches:
        for row, data, offs in text_slices(batch.column(1)):
            sets = shingle_sets(data, offs)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(row, len(sets)), pa.array([set_id(x) for x in sets], pa.int64()),
                pa.array([x.tobytes() for x in sets], pa.binary())], names=["key", "id", "sh"])


def _least(threshold: float) -> int:
    """Fewest equal slots of a linked pair: the mean less six standard deviations."""
    return max(0, int(SLOTS * threshold - 6 * (SLOTS * threshold * (1 - threshold)) ** 0.5))


def _rows(column: pa.ChunkedArray | pa.Array, dtype: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def _fits(na: np.ndarray, nb: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(na, nb) >= threshold * np.maximum(na, nb)


def _plausible(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """(a, b, sketch_a, sketch_b) to (a, b, equal), without the pairs that their sketches rule out."""
    for batch in batches:
        if batch.num_rows:
            equal = (_rows(batch.column(2), np.uint8, SLOTS) == _rows(batch.column(3), np.uint8, SLOTS)).sum(axis=1)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(equal.astype(np.int32))], names=["a", "b", "equal"])
            yield out.filter(pa.array(equal >= least))


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    both = common(x, y)
    return both >= threshold * (x.size + y.size - both)


def _set(cell: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype=np.uint64)


def _verified(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b, sh_a, sh_b) to the pairs (a, b) whose sets overlap enough."""
    for batch in batches:
        ok = [_linked(_set(x), _set(y), threshold) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by meeting to one table per meeting of two rows or more, whatever batches they come in."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        key = np.stack([rows.column(c).to_numpy() for c in _MEETING])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end - start > 1:
                yield rows.slice(start, end - start)
        rest = rows.slice(cuts[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest


def _likely(rows: pa.Table, least: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of a meeting that may be linked, likeliest first. Pairs of one group
    have no need to; pairs that share several buckets belong to the first."""
    i, j = np.triu_indices(rows.num_rows, 1)
    blk, comp, n = (rows.column(c).to_numpy() for c in ("blk", "comp", "n"))
    ok = (comp[i] != comp[j]) & _fits(n[i], n[j], threshold)
    if rows.column("lo")[0] != rows.column("hi")[0]:
        ok &= blk[i] != blk[j]
    i, j = i[ok], j[ok]
    sketch = _rows(rows.column("sketch"), np.uint8, SLOTS)
    equal = np.zeros(i.size, dtype=np.int64)
    for at in range(0, i.size, 1 << 14):
        here = slice(at, at + (1 << 14))
        equal[here] = (sketch[i[here]] == sketch[j[here]]).sum(axis=1)
    ok = np.flatnonzero(equal >= least)
    if ok.size:
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        first = np.concatenate([(bands[i[x]] == bands[j[x]]).argmax(axis=1) for x in np.array_split(ok, ok.size // (1 << 14) + 1)])
        ok = ok[bands[i[ok], first] == rows.column("bucket")[0].as_py()]
        ok = ok[np.argsort(-equal[ok], kind="stable")]
    return i[ok], j[ok]


def _hopeful(batches: Iterator[pa.RecordBatch], least: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows of each meeting with a likely partner there."""
    for rows in _blocks(batches):
        i, j = _likely(rows, least, threshold)
        if i.size:
            yield from rows.select([*_MEETING, "id"]).take(pa.array(np.union1d(i, j))).combine_chunks().to_batches()


def _settled(batches: Iterator[pa.RecordBatch], least: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each meeting, verified on the sets; a pair that earlier links already connect is passed over."""
    for rows in _blocks(batches):
        i, j = _likely(rows, least, threshold)
        comp, sets = rows.column("comp").to_numpy(), [_set(x) for x in rows.column("sh")]
        above: dict[int, int] = {}

        def root(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        found = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = root(comp[x]), root(comp[y])
            if a != b and _linked(sets[x], sets[y], threshold):
                above[max(a, b)] = min(a, b)
                found.append((x, y))
        if found:
            node = rows.column("id").to_numpy()
            x, y = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])


def _first_links(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of each node with the likeliest among the ends of its buckets."""
    ends = buckets.select(F.col("id").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b").distinct()
    side = lambda df, c: df.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in df.columns if x != "id"])
    about = nodes.select("id", "n", "sketch")
    near = ends.join(side(about, "a"), "a").join(side(about, "b"), "b") \
        .where(F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b")).select("a", "b", "sketch_a", "sketch_b") \
        .mapInArrow(partial(_plausible, least=_least(threshold)), "a long, b long, equal int")
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("equal"), "b"))   # at most two rows per band
    tried = near.withColumn("rank", rank).where(F.col("rank") <= TRIES).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    both = stored(tried.distinct(), "pairs").join(side(sets, "a"), "a").join(side(sets, "b"), "b")
    return stored(both.select("a", "b", "sh_a", "sh_b").mapInArrow(partial(_verified, threshold=threshold), "a long, b long"), "links")


def _late_links(buckets: DataFrame, nodes: DataFrame, sets: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the groups that share a bucket."""
    rows = _meetings(buckets, nodes, groups)
    sort = lambda df: df.repartition(*_MEETING).sortWithinPartitions(*_MEETING)
    rule = {"least": _least(threshold), "threshold": threshold}
    some = stored(sort(rows).mapInArrow(partial(_hopeful, **rule), "bucket long, lo int, hi int, id long"), "hopeful")
    some = rows.join(some, [*_MEETING, "id"], "left_semi").join(sets, "id")
    return stored(sort(some).mapInArrow(partial(_settled, **rule), "a long, b long"), "late_links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every vertex of ``edges`` (a, b), the root being the smallest of its component.

    Alternating large and small stars: minima per vertex are aggregated before they are joined back, so
    no neighbour list is built. Ends when every edge leads to a root."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() or \
            not e.groupBy("a").count().where("count > 1").isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = stored(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = stored(small.unionByName(low.withColumnRenamed("m", "b")).distinct(), "edges")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _meetings(buckets: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """A row per node and meeting (``_MEETING``) of buckets with several groups. The largest group of a bucket meets the
    others but not itself; the others meet everybody."""
    rows = buckets.select("bucket", "id").join(groups.select(F.col("node").alias("id"), "root"), "id", "left") \
        .select("bucket", "id", F.coalesce("root", "id").alias("comp"))
    mixed = rows.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    rows = stored(rows.join(mixed, "bucket", "left_semi").join(nodes.select("id", "n", "bands", "sketch"), "id"), "mixed")
    per = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    blocks = lambda c, w: F.ceil(F.greatest(c / BLOCK, w / ELEMENTS)).cast("int")
    top = per.groupBy("bucket").agg(F.max(F.struct("c", "comp", "w")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w")) \
        .select("bucket", F.col("top.comp").alias("top"), blocks(F.col("c"), F.col("w")).alias("all"),
                blocks(F.col("top.c"), F.col("top.w")).alias("large"),
                blocks(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("small"))
    one, in_top = F.col("all") == 1, F.col("comp") == F.col("top")
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    return rows.join(top, "bucket") \
        .withColumn("blk", F.when(one, 0).when(in_top, at("large")).otherwise(F.col("large") + at("small"))) \
        .withColumn("other", F.explode(F.sequence(F.when(in_top & ~one, F.col("large")).otherwise(F.lit(0)),
                                                  F.when(one, 0).otherwise(F.col("large") + F.col("small") - 1)))) \
        .select("bucket", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "blk", "comp", "id", "n", "bands", "sketch")


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """(key, rep): every document with the smallest id of its group. Documents are linked when their
    sets of five-word shingles (normalised words) have a Jaccard similarity of at least ``threshold``; a
    text without words is linked with nothing."""
    kind = df.schema[key].dataType.simpleString()
    texts = df.select(F.col(key).alias("key"), F.coalesce(F.lower(F.col(text)), F.lit("")).cast("binary").alias("text"))
    each = stored(texts.mapInArrow(_described, f"key {kind}, {_NODE}"), "shingles")
    nodes = stored(each.where("id is not null and key is not null").groupBy("id").agg(
        F.min("key").alias("node"), *[F.first(c).alias(c) for c in ("n", "bands", "sketch")]), "nodes")
    rows = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    buckets = stored(rows.join(shared, "bucket"), "buckets")
    # one row of each node that meets another; the filter spares the others' sets, the join is exact
    wanted = stored(nodes.join(buckets.select("id").distinct(), "id", "left_semi").select("id", F.col("node").alias("key")), "wanted")
    maybe = bloom_filter(wanted.select(F.xxhash64("key").alias("x")))(F.xxhash64("key"))
    sets = texts.where(maybe).mapInArrow(_with_sets, f"key {kind}, id long, sh binary")
    sets = stored(sets.join(wanted, ["id", "key"], "left_semi").dropDuplicates(["id"]).select("id", "sh"), "sets")

    # rows that repeat a key have one place in the graph, whatever their texts
    same = nodes.groupBy("node").agg(F.min("id").alias("b"), F.max("id").alias("c")).where("b <> c")
    links = _first_links(buckets, nodes, sets, threshold).unionByName(nodes.join(same, "node").select(F.col("id").alias("a"), "b"))
    groups = stored(components(links), "groups")
    late = _late_links(buckets, nodes, sets, groups, threshold)
    if not late.isEmpty():
        groups = stored(components(links.unionByName(late)), "groups")

    groups = groups.withColumnRenamed("node", "id")
    lowest = groups.join(nodes.select("id", "node"), "id").groupBy("root").agg(F.min("node").alias("rep"))
    rep = nodes.select("id", "node").join(groups.join(lowest, "root").select("id", "rep"), "id", "left") \
        .select("id", F.coalesce("rep", "node").alias("rep"))
    return each.select("key", "id").join(rep, "id", "left").select(F.col("key").alias(key), F.coalesce("rep", "key").alias("rep"))
