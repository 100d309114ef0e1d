"""Whitening of embeddings on their leading principal components.

Passes over the vectors, each pre-aggregated by task: the number of vectors and
the sum of every dimension (exact integers); the covariance, centred before
multiplying; the whitened values' own moments (which give ``identity_error``);
the result. Only numbers per dimension or pair of dimensions reach the driver,
where ``feast`` finds the components.

A component c becomes the integer x = floor(1024 c) + 100000; beyond the range
of a long it stops at that range's end.

Defined cases: null vectors, and vectors with null or non-finite entries or
another length than the commonest (ties: the shorter), are left out; every
repeated row counts; null vec_ids stay. Components whose eigenvalue is zero up
to rounding do not exist: with fewer than 8 others, fewer rows come out (none
where all vectors are equal). ``deviation`` is null where the exact value does
not fit a long. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .feast import leading
from .store import keep
from .words import read_columns

COMPONENTS = 8
_LONG = 2 ** 63 - 1
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def vectors(table: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as doubles."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")) \
        .where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    size = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (size["d"] if size else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The integers x of a batch, one row per vector."""
    v = read_columns(batch, "v")[0]
    c = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
    x = np.floor(c * 1024.0)
    return np.where(np.abs(x) < 2.0 ** 62, x, np.sign(x) * 2.0 ** 62).astype(np.int64) + 100000


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: (dimension, vectors, high and low half of the sum)."""
    n, high, low = 0, 0, 0
    for batch in batches:
        if batch.num_rows:
            x = _matrix(batch)
            n, high, low = n + x.shape[0], high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)
    if n:
        d = high.size
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)],
                                         names=["i", "n", "high", "low"])


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(n, S): exact, one number per dimension."""
    got = rows.select("v").mapInArrow(_sums, "i int, n long, high long, low long").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("high").cast("decimal(38,0)")).alias("high"),
        F.sum(F.col("low").cast("decimal(38,0)")).alias("low")).orderBy("i").collect()
    return (int(got[0]["n"]) if got else 0), [(int(r["high"]) << 32) + int(r["low"]) for r in got]


def _centred(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """x - S / n without cancellation: the whole part of S / n is taken off in integers."""
    whole = np.array([t // n for t in total], dtype=np.int64)
    return (x - whole).astype(float) - np.array([t % n for t in total], dtype=float) / n


def covariance(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """The covariance of x, divisor n; tasks' sums of centred products are added by Spark, row by row."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = 0.0
        for batch in batches:
            if batch.num_rows:
                x = _centred(_matrix(batch), n, total)
                own = own + x.T @ x
        if isinstance(own, np.ndarray):
            for i, row in enumerate(own):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(row.size, i, dtype=np.int32)),
                                                  pa.array(np.arange(row.size, dtype=np.int32)), pa.array(row)], names=["i", "j", "p"])

    d = len(total)
    out = np.zeros((d, d))
    for r in rows.select("v").mapInArrow(products, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect():
        out[r["i"], r["j"]] = r["p"] / n
    return (out + out.T) / 2


def _identity_error(rows: DataFrame, n: int, whiten, k: int) -> float:
    """Largest absolute entry of the whitened values' covariance minus the identity."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mean, second = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = whiten(_matrix(batch))
                m = w.mean(axis=0)
                step = m - mean                              # two centred parts become one
                second += (w - m).T @ (w - m) + np.outer(step, step) * (held * len(w) / (held + len(w)))
                mean, held = mean + step * (len(w) / (held + len(w))), held + len(w)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([mean.tolist()]), pa.array([second.ravel().tolist()])],
                                             names=["n", "mean", "second"])

    parts = keep(rows.select("v").mapInArrow(moments, "n long, mean array<double>, second array<double>"), "whitened_moments")
    mean = np.zeros(k)
    for r in parts.select("n", F.posexplode("mean")).groupBy("pos").agg(F.sum(F.col("n") * F.col("col")).alias("s")).collect():
        mean[r["pos"]] = r["s"] / n
    apart = F.transform("mean", lambda x, i: x - F.element_at(F.array(*[F.lit(float(m)) for m in mean]), i + 1))
    between = F.flatten(F.transform("apart", lambda a: F.transform("apart", lambda b: a * b * F.col("n"))))
    total = parts.withColumn("apart", apart).select(
        F.posexplode(F.zip_with("second", between, lambda a, b: a + b))).groupBy("pos").agg(F.sum("col").alias("s"))
    out = np.zeros(k * k)
    for r in total.collect():
        out[r["pos"]] = r["s"] / n
    return float(np.abs(out.reshape(k, k) - np.eye(k)).max())


def whitening(table: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)."""
    spark = table.sparkSession
    rows = vectors(table, column)
    n, total = sums(rows)
    if not n:
        return spark.createDataFrame([], RESULT)
    v = covariance(rows, n, total)
    values, basis = leading(v, components)
    k = values.size
    if not k:
        return spark.createDataFrame([], RESULT)
    scaled, explained = basis / np.sqrt(values), values / np.trace(v)

    def whiten(x: np.ndarray) -> np.ndarray:
        return _centred(x, n, total) @ scaled

    error = _identity_error(rows, n, whiten, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                w, m = whiten(x), len(x)
                ident = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [read_columns(batch, "vec_id")[0].take(pa.array(ident)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, n)), deviation(x, n, total).take(pa.array(ident)), pa.array(w.ravel()),
                     pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, RESULT)


def deviation(x: np.ndarray, n: int, total: list[int]) -> pa.Array:
    """Sum over dimensions of (n x - S)^2, exact; null beyond a long."""
    most = max(int(np.abs(x).max(initial=0)) * n + abs(t) for t in total)
    if most * most * len(total) <= _LONG:
        gap = n * x - np.array(total, dtype=np.int64)
        return pa.array((gap * gap).sum(axis=1))
    whole = np.array([t // n for t in total], dtype=np.int64)
    rest = np.array([t % n for t in total], dtype=np.int64)
    gap = x - whole                                          # n x - S = n * gap - rest, usually far smaller than n x
    most = int(np.abs(gap).max(initial=0)) * n + n
    if most * most * len(total) <= _LONG:
        gap = n * gap - rest
        return pa.array((gap * gap).sum(axis=1))
    exact = [sum((n * g - r) ** 2 for g, r in zip(row, rest.tolist(), strict=True)) for row in gap.tolist()]
    return pa.array([e if e <= _LONG else None for e in exact], pa.int64())
