"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Index: equal vectors are collapsed (their smallest ids stay), unit vectors are
assigned to the nearest of some centroids, and the rotated residual of each is
stored as one bit per dimension with correction scalars: its length, its
product with the centroid, and the product of the rotated unit residual with
its code. Search: a query probes the nearest cells; with the query quantised to
bit planes, AND and population counts estimate every inner product, and an
error bound on the estimate decides which vectors are reranked exactly on the
original numbers.

Centroids come from a bounded, hash-chosen sample (at most SAMPLE vectors), and
so does the number of probed cells: the least that covers COVER of the sample's
true neighbours. Every valid row is indexed. Large cells are cut into blocks of
about BLOCK vectors, and the queries of a cell into blocks too, so no task
grows with the hottest cell.

Defined cases: vectors that are null, zero, hold null or non-finite numbers, or
differ in length from the most common length of the sample take no part; a null
id takes no part; rows that repeat an id count once per row; ties go to the
smaller id; with fewer candidates than asked all that are found are returned;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import keep
from .words import read_columns

NEAREST = 5
EVERY = 50                # rows whose id is divisible by this are queries
SAMPLE = 16_384
KNOWN = 2048              # sample vectors that give each query a first bar
PER_CELL = 1024           # vectors per cell aimed at
MOST_CELLS = 4096
COVER = 0.995
BLOCK = 4096
QUERY_BLOCK = 512
PLANES = 4                # bits of a quantised query component
EPS = 2.5                 # error bound in standard deviations


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest component: no square of them vanishes or overflows."""
    with np.errstate(over="ignore"):
        top = np.abs(x).max(axis=1, initial=0.0)[:, None]
    top = np.where(top > 0, top, 1.0)
    # a divisor below the normal range has no full reciprocal: both are brought up first
    up = np.where(top < 1e-280, 2.0 ** 200, 1.0)
    return (x * up) / (top * up)


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centroids of unit vectors (spherical k-means; empty cells keep their place)."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(sample))
    c = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        own = nearest_cells(sample, c, 1)[:, 0]
        for d in range(c.shape[1]):
            s = np.bincount(own, weights=sample[:, d], minlength=cells)
            c[:, d] = np.where(np.bincount(own, minlength=cells) > 0, s, c[:, d])
        c /= np.maximum(np.sqrt((c * c).sum(axis=1)), 1e-12)[:, None]
    return c


def nearest_cells(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each row, nearest first; in blocks."""
    out = np.empty((len(x), n), dtype=np.int32)
    for i in range(0, len(x), 2048):
        s = -(x[i: i + 2048] @ c.T)
        if n == 1:
            out[i: i + 2048, 0] = s.argmin(axis=1)
        else:
            out[i: i + 2048] = np.argsort(s, axis=1, kind="stable")[:, :n]
    return out


def choose_probes(sample: np.ndarray, c: np.ndarray, queries: int = 256, k: int = NEAREST) -> int:
    """Cells to probe so that COVER of the sample's true neighbours are found."""
    q = sample[:queries]
    s = q @ sample.T
    s[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(c)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    place = np.empty((len(q), len(c)), dtype=np.int64)
    order = nearest_cells(q, c, len(c))
    np.put_along_axis(place, order, np.arange(len(c))[None, :], axis=1)
    own = nearest_cells(sample, c, 1)[:, 0]
    rank = place[np.arange(len(q))[:, None], own[near]]
    return int(np.quantile(rank, COVER, method="higher")) + 1


def encode(x: np.ndarray, c: np.ndarray, rot: np.ndarray):
    """(cell, packed code, residual length, residual . centroid, code product) of unit rows."""
    cell = nearest_cells(x, c, 1)[:, 0]
    r = x - c[cell]
    norm = np.sqrt((r * r).sum(axis=1))
    o = (r @ rot) / np.maximum(norm, 1e-300)[:, None]
    prod = np.abs(o).sum(axis=1) / np.sqrt(x.shape[1])
    return cell, np.packbits(o > 0, axis=1), norm, (r * c[cell]).sum(axis=1), np.where(norm > 0, prod, 1.0)


def words64(code: np.ndarray) -> np.ndarray:
    """Packed bytes as rows of 64-bit words."""
    pad = -code.shape[1] % 8
    return np.ascontiguousarray(np.pad(code, ((0, 0), (0, pad)))).view(np.uint64)


def estimate(code: np.ndarray, norm, along, prod, q: np.ndarray, c: np.ndarray, rot: np.ndarray):
    """(estimated inner products, error bounds) of unit queries (rows) with
    the vectors of a cell (columns)."""
    dim = q.shape[1]
    r = q - c
    v = r @ rot
    low = v.min(axis=1)
    step = np.maximum((v.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-300)
    level = np.rint((v - low[:, None]) / step[:, None]).astype(np.int64)
    # sum over bits of 2**b * popcount, highest bit first; small integers
    total = np.zeros((len(q), len(code)), dtype=np.uint16 if dim <= 4096 else np.uint32)
    for b in range(PLANES - 1, -1, -1):
        plane = words64(np.packbits(((level >> b) & 1).astype(bool), axis=1))
        total <<= 1
        for w in range(code.shape[1]):
            total += np.bitwise_count(code[None, :, w] & plane[:, w, None])
    ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
    scale = norm / (np.sqrt(dim) * prod)
    far = np.sqrt((r * r).sum(axis=1))
    spread = norm * np.sqrt(np.maximum(1 - prod * prod, 0)) / prod / np.sqrt(max(dim - 1, 1))
    rounding = norm / prod * np.sqrt(1 / 12.0)
    f32 = np.float32
    est = total.astype(f32)
    est *= (2 * step).astype(f32)[:, None]
    est += (2 * low).astype(f32)[:, None] * ones.astype(f32)
    est -= v.sum(axis=1).astype(f32)[:, None]
    est *= scale.astype(f32)
    est += along.astype(f32)
    est += (q @ c).astype(f32)[:, None]
    err = (EPS * far).astype(f32)[:, None] * spread.astype(f32)
    err += (EPS * step).astype(f32)[:, None] * rounding.astype(f32)
    err += f32(1e-5)                    # single precision
    return est, err


def search_cell(data: pd.DataFrame, queries: pd.DataFrame, c: np.ndarray, rot: np.ndarray, k: int) -> pd.DataFrame:
    """The k best vectors of one block for each query (ties with the last
    place stay: ids decide later): estimate, bound, rerank."""
    x = scaled(np.frombuffer(b"".join(data["vector"]), dtype=np.float64).reshape(len(data), -1))
    every = scaled(np.frombuffer(b"".join(queries["vector"]), dtype=np.float64).reshape(len(queries), -1))
    size = np.sqrt((x * x).sum(axis=1))
    code = words64(np.frombuffer(b"".join(data["code"]), dtype=np.uint8).reshape(len(data), -1))
    norm, along, prod = (data[name].to_numpy() for name in ("norm", "along", "prod"))
    ids, keys, known = data["ids"].to_numpy(), queries["query"].to_numpy(), queries["bar"].to_numpy() - 1e-5
    out = []
    for s in range(0, len(every), 64):
        q = every[s: s + 64]
        length = np.sqrt((q * q).sum(axis=1))
        est, err = estimate(code, norm, along, prod, q / length[:, None], c, rot)
        if len(x) > 4 * k:
            # the k-th best true value among the best estimates is a bar that
            # the answer reaches; whatever may reach it by its bound is reranked
            best = np.argpartition(-est, 2 * k, axis=1)[:, : 2 * k]
            true = np.einsum("qkd,qd->qk", x[best], q) / (size[best] * length[:, None])
            bar = np.maximum(np.partition(true, -k, axis=1)[:, -k], known[s: s + 64])
            err += est
            row, col = np.nonzero(err >= bar[:, None].astype(np.float32))
        else:
            row, col = (i.ravel() for i in np.indices(est.shape))
        score = (x[col] * q[row]).sum(axis=1) / (size[col] * length[row])
        order = np.lexsort((-score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, row)
        last = np.minimum(first + k, np.searchsorted(row, row, side="right")) - 1
        good = score >= score[last]
        out.append(pd.DataFrame({"query": keys[s + row[good]], "score": score[good], "ids": ids[col[good]]}))
    return pd.concat(out, ignore_index=True)


def neighbours(vectors: DataFrame, nearest: int = NEAREST, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    valid = keep(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0"
        " and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"),
        "valid")
    # the smallest ids of equal vectors; the limit is applied before the shuffle too
    by_vector = Window.partitionBy("v").orderBy("vec_id")
    few = valid.withColumn("k", F.row_number().over(by_vector)).where(f"k <= {nearest + 1}")
    distinct = keep(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                    .withColumn("query", F.xxhash64("v")), "vectors")
    queries = valid.where(F.pmod("vec_id", F.lit(every)) == 0).select(
        F.col("vec_id").alias("query_id"), "v", F.xxhash64("v").alias("query"))

    n = distinct.count()
    sample = distinct.orderBy("query").limit(SAMPLE).select("v").collect()  # bounded
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = Counter(len(r["v"]) for r in sample).most_common(1)[0][0]
    sample = unit(np.array([r["v"] for r in sample if len(r["v"]) == dim]))
    cells = min(MOST_CELLS, max(1, n // PER_CELL))
    c, rot = fit_cells(sample, cells), rotation(dim)
    probes = choose_probes(sample, c)
    few_known = sample[:KNOWN]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = read_columns(batch, "v", "ids")
            m = x.flatten().to_numpy().reshape(-1, dim)
            cell, code, norm, along, prod = encode(unit(m), c, rot)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell), pa.array([r.tobytes() for r in m], pa.binary()), ids,
                 pa.array([r.tobytes() for r in code], pa.binary()), pa.array(norm), pa.array(along), pa.array(prod)],
                names=["cell", "vector", "ids", "code", "norm", "along", "prod"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, key = read_columns(batch, "v", "query")
            m = x.flatten().to_numpy().reshape(-1, dim)
            u = unit(m)
            cell = nearest_cells(u, c, probes)
            at = np.repeat(np.arange(len(m)), probes)
            raw = pa.array([r.tobytes() for r in m], pa.binary())
            # the k-th best of a few known vectors: the answer is at least as near
            bar = np.full(len(m), -1.0)
            if len(few_known) >= nearest + 1:
                for i in range(0, len(m), 1024):
                    bar[i: i + 1024] = np.partition(u[i: i + 1024] @ few_known.T, -(nearest + 1), axis=1)[:, -(nearest + 1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.ravel()), key.take(pa.array(at)), raw.take(pa.array(at)), pa.array(bar[at])],
                names=["cell", "query", "vector", "bar"])

    fits = F.size("v") == dim
    table = keep(distinct.where(fits).select("v", "ids").mapInArrow(
        index, "cell int, vector binary, ids array<long>, code binary, norm double, along double, prod double"), "index")
    asked = keep(queries.where(fits).groupBy("query").agg(F.first("v").alias("v")).select("v", "query")
                 .mapInArrow(probe, "cell int, query long, vector binary, bar double"), "probes")
    # blocks per cell: at most MOST_CELLS numbers each
    blocks = {r["cell"]: -(-r["count"] // BLOCK) for r in table.groupBy("cell").count().collect()}
    parts = {r["cell"]: -(-r["count"] // QUERY_BLOCK) for r in asked.groupBy("cell").count().collect()}
    plan = F.broadcast(spark.createDataFrame(
        [(k, blocks[k], parts[k]) for k in sorted(blocks.keys() & parts.keys())], "cell int, blocks int, parts int"))
    data = table.join(plan, "cell").select(
        "*", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    ask = asked.join(plan, "cell").select(
        "cell", "query", "vector", "bar", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int").alias("part"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    k = nearest + 1                     # the query's own vector may be among them

    def search(key: tuple, own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        if own.empty or came.empty:
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64"),
                                 "ids": pd.Series(dtype="object")})
        return search_cell(own, came, c[int(key[0])], rot, k)

    keys = ("cell", "block", "part")
    found = data.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInPandas(search, "query long, score double, ids array<long>")
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.get("ids", F.lit(0)))
    top = keep(found.withColumn("k", F.row_number().over(best)).where(f"k <= {k}").select("query", "score", "ids"), "found")
    pairs = queries.where(fits).select("query_id", "query").join(top, "query") \
        .select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(rank)).where(f"rank <= {nearest}") \
        .select("query_id", "rank", "vec_id", "score")
