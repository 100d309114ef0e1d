"""Best-fit packing with a grouping genetic algorithm on islands.

Documents are tokenised, ended with an end id, and cut only when longer than
the capacity (the first piece takes the remainder). Pieces are dealt evenly,
by row number, to groups of about GROUP pieces; each group is packed by several
islands. An island keeps a small population of packings. Crossover injects
whole well-filled bins of one parent into another, drops the bins that would
repeat a piece, and best-fits the displaced pieces. After every epoch the best
packing of an island migrates to the next island through a shuffle; at the end
the best packing of each group is taken. An island stops as soon as the number
of bins equals the bound total / capacity. Most of what is gained over small groups comes from
best-fit decreasing over many pieces; the crossovers seldom save a bin beyond it.

Defined cases: a null or empty text is one piece that holds the end id only;
repeated rows (and repeated or null ids) are separate documents and packed
separately; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import encoder, load_tables
from .store import keep
from .words import read_columns

CAPACITY = 1024
END_ID = 2
GROUP = 8192              # pieces packed together, about
ISLANDS = 2
EPOCHS = 2
CHILDREN = 8              # crossovers per island and epoch
POPULATION = 4

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# --- pieces --------------------------------------------------------------------

def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; all but the first are full."""
    head = (n - 1) % capacity + 1
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every document, with the crc32 of its ids."""
    tables = load_tables(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(tables)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            doc, text = read_columns(batch, "doc_id", "text")
            for row, ids, offs in bpe.encode(text):
                raw = ids.astype("<u4").tobytes()
                out: list[tuple] = []
                for i in range(offs.size - 1):
                    mine = raw[4 * offs[i]: 4 * offs[i + 1]] + end
                    for k, (s, n) in enumerate(cut(len(mine) // 4, capacity)):
                        out.append((row + i, k, s, n, zlib.crc32(mine[4 * s: 4 * (s + n)])))
                if out:
                    at, k, s, n, crc = (np.array(c, dtype=np.int64) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [doc.take(pa.array(at)), pa.array(k.astype(np.int32)), pa.array(s), pa.array(n), pa.array(crc)],
                        names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(encode, _PIECES)


# --- one island ------------------------------------------------------------------

class Bins:
    """Bins of piece numbers, found by residual space through a bit set."""

    def __init__(self, lens: list[int], capacity: int):
        self.lens, self.capacity = lens, capacity
        self.items: list[list[int]] = []
        self.space: list[int] = []
        self._by: list[list[int]] = [[] for _ in range(capacity + 1)]
        self._bits = 0

    def add(self, items: list[int]) -> None:
        """A new bin with these pieces."""
        left = self.capacity - sum(self.lens[i] for i in items)
        self.items.append(items)
        self.space.append(left)
        self._put(len(self.items) - 1, left)

    def _put(self, b: int, left: int) -> None:
        self._by[left].append(b)
        self._bits |= 1 << left

    def best_fit(self, item: int) -> None:
        """Put a piece where it leaves the least space, or in a new bin."""
        n = self.lens[item]
        fits = self._bits >> n
        if not fits:
            self.add([item])
            return
        left = n + (fits & -fits).bit_length() - 1
        b = self._by[left].pop()
        if not self._by[left]:
            self._bits &= ~(1 << left)
        self.items[b].append(item)
        self.space[b] = left - n
        self._put(b, left - n)

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first, then fuller ones (mean of squared fill)."""
        full = np.array([self.capacity - s for s in self.space], dtype=float) / self.capacity
        return -len(self.items), float((full ** 2).mean()) if full.size else 0.0


def decreasing(lens: list[int], capacity: int, rng: random.Random | None = None) -> Bins:
    """Best-fit decreasing; with ``rng``, over slightly perturbed lengths."""
    noise = (lambda: rng.uniform(0.85, 1.15)) if rng else (lambda: 1.0)
    out = Bins(lens, capacity)
    for i in sorted(range(len(lens)), key=lambda i: -lens[i] * noise()):
        out.best_fit(i)
    return out


def crossover(a: Bins, b: Bins, rng: random.Random) -> Bins:
    """Inject well-filled bins of ``b`` into ``a`` and repair by best fit."""
    order = sorted(range(len(b.items)), key=lambda k: b.space[k])
    cutoff = b.space[order[len(order) // 2]]
    chosen = [k for k in order if b.space[k] <= cutoff and rng.random() < 0.5]
    taken = {i for k in chosen for i in b.items[k]}
    child = Bins(a.lens, a.capacity)
    for k in chosen:
        child.add(list(b.items[k]))
    displaced: list[int] = []
    for items in a.items:
        if taken.isdisjoint(items):
            child.add(list(items))
        else:
            displaced += [i for i in items if i not in taken]
    for i in sorted(displaced, key=lambda i: -a.lens[i]):
        child.best_fit(i)
    return child


def mutate(x: Bins, rng: random.Random) -> Bins:
    """Dissolve the emptiest bins and a few random ones, and best-fit their pieces."""
    n = len(x.items)
    order = sorted(range(n), key=lambda k: -x.space[k])
    gone = {*order[: max(2, n // 50)], *rng.sample(range(n), max(1, n // 50))}
    out = Bins(x.lens, x.capacity)
    loose: list[int] = []
    for k, items in enumerate(x.items):
        if k in gone:
            loose += items
        else:
            out.add(list(items))
    rng.shuffle(loose)
    for i in loose:
        out.best_fit(i)
    return out


def evolve(lens: list[int], capacity: int, seed: int, migrants: list[np.ndarray] = (), children: int = CHILDREN,
           population: int = POPULATION) -> Bins:
    """The best packing one island finds, starting from migrants if there are any."""
    rng = random.Random(seed)
    bound = -(-sum(lens) // capacity)
    best = decreasing(lens, capacity)
    pool = [best]
    for m in migrants:
        pool.append(unpack(m, lens, capacity))
    best = max(pool, key=Bins.fitness)
    if len(best.items) <= max(bound, 1):
        return best
    while len(pool) < population:
        pool.append(decreasing(lens, capacity, rng))
    for _ in range(children):
        if len(best.items) <= bound:
            break
        a, b = sorted(rng.sample(range(len(pool)), 2), key=lambda k: pool[k].fitness())
        child = crossover(pool[a], pool[b], rng)
        if rng.random() < 0.5 and len(child.items) > 2:
            child = mutate(child, rng)
        worst = min(range(len(pool)), key=lambda k: pool[k].fitness())
        if child.fitness() >= pool[worst].fitness():
            pool[worst] = child
        best = max(pool, key=Bins.fitness)
    return best


def pack_array(bins: Bins) -> np.ndarray:
    """The bin number of every piece."""
    out = np.empty(len(bins.lens), dtype=np.int32)
    for b, items in enumerate(bins.items):
        out[items] = b
    return out


def unpack(at: np.ndarray, lens: list[int], capacity: int) -> Bins:
    """The packing that ``pack_array`` wrote down."""
    out = Bins(lens, capacity)
    order = np.argsort(at, kind="stable")
    for items in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        if items.size:
            out.add(items.tolist())
    return out


# --- on Spark ---------------------------------------------------------------------

_ELITE = "grp long, island int, bins int, fill double, place binary"


def _sorted(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values("row", kind="stable")


def pack(rows: DataFrame, capacity: int = CAPACITY, group: int = GROUP, islands: int = ISLANDS,
         epochs: int = EPOCHS) -> DataFrame:
    """Add sequence_id and offset to piece rows (``rows`` must be a stored table)."""
    groups = max(1, -(-rows.count() // group))
    # row numbers of a stored table are dense within each file split, so they deal the rows evenly
    rows = keep(rows.withColumn("row", F.monotonically_increasing_id())
                .withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups))), "packing_rows")
    lens = rows.select("grp", "row", F.col("length").cast("int").alias("length")).withColumn(
        "island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))

    def island(key, own: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        grp, num = (int(k) for k in key)
        own = _sorted(own)
        elites = [np.frombuffer(x, dtype=np.int32) for x in came["place"]]
        found = evolve(own["length"].tolist(), capacity, grp * 1000 + num * 10 + len(elites), elites)
        bins, fill = found.fitness()
        return pd.DataFrame({"grp": [grp], "island": [num], "bins": [-bins], "fill": [fill],
                             "place": [pack_array(found).tobytes()]})

    def first_island(key, own: pd.DataFrame) -> pd.DataFrame:
        return island(key, own, pd.DataFrame({"place": []}))

    state = keep(lens.groupBy("grp", "island").applyInPandas(first_island, _ELITE), "islands")
    for _ in range(epochs - 1):
        # an island sees its own best packing and that of its neighbour
        moved = state.select("grp", F.explode(F.array(
            "island", F.pmod(F.col("island") + 1, F.lit(islands)))).alias("island"), "place")
        state = keep(lens.groupBy("grp", "island").cogroup(moved.groupBy("grp", "island"))
                     .applyInPandas(island, _ELITE), "islands")
    best = state.groupBy("grp").agg(F.min_by("place", F.struct("bins", -F.col("fill"), "island")).alias("place"))

    def settle(key, own: pd.DataFrame, won: pd.DataFrame) -> pd.DataFrame:
        own = _sorted(own).assign(bin=np.frombuffer(won["place"].iloc[0], dtype=np.int32))
        own["offset"] = own.groupby("bin")["length"].cumsum() - own["length"]
        own["sequence_id"] = int(key[0]) * (1 << 32) + own["bin"].astype(np.int64)
        return own[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    return rows.groupBy("grp").cogroup(best.groupBy("grp")).applyInPandas(
        settle, _PIECES + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens."""
    return pack(keep(pieces(docs, path, capacity, end_id), "pieces"), capacity)
