"""Connected components of a distributed edge table by union and find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import keep


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over the edges of one batch: (vertices, smallest vertex reached)."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent = list(range(ids.size))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: a.size].tolist(), at[a.size:].tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return ids, ids[np.array([find(x) for x in range(ids.size)], dtype=np.int64)]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace each batch of edges by a forest of stars with the same components."""
    for batch in batches:
        if batch.num_rows:
            ids, root = local_roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            far = ids != root
            yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(root[far])], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every vertex of ``edges`` (a long, b long).

    ``root`` is the smallest vertex of the component. Each partition first
    unions its own edges; then every vertex is contracted into its smallest
    neighbour until no edge is left, and the contractions are composed from
    the last to the first. A vertex of huge degree costs one row per
    edge: minima are pre-aggregated and no neighbour list is ever built."""
    left = keep(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
                .where("a <> b").mapInArrow(_shrink, "a long, b long"), "edges")
    steps = []
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.min("b").alias("m"))
                   .select(F.col("a").alias("node"), F.least("a", "m").alias("to")), "contract")
        steps.append(low)
        left = keep(left.join(low.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
                    .join(low.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
                    .where("ta <> tb")
                    .select(F.greatest("ta", "tb").alias("a"), F.least("ta", "tb").alias("b")).distinct()
                    .mapInArrow(_shrink, "a long, b long"), "edges")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[-1]
    for low in reversed(steps[:-1]):
        out = low.join(out.select(F.col("node").alias("to"), F.col("to").alias("end")), "to", "left") \
            .select("node", F.coalesce("end", "to").alias("to"))
    return out.select("node", F.col("to").alias("root"))
