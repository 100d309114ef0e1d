"""Deduplication (2.E): sentences, blocks, sections, items, corpus.

Order-dependent folds inside one page or text (E4, D6, E9) and the similarity
ratio (E5/E8) are Arrow-batched pandas UDFs over arrays of the row, behind
indexes that find the few candidates. Corpus-scale deduplication is relational.
"""

from __future__ import annotations

import bisect
import difflib
import json
import re
from collections import Counter
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WS, norm_block, split_blocks, strip_ws
from ..session import stored

# Thresholds passed by the reference's callers.
SECTION_THRESHOLD = 0.75
ITEM_THRESHOLD = 0.75
BLOCK_CONTAIN = 0.7
SECTION_CONTAIN = 0.5
MIN_BLOCK = 15
MIN_ITEM = 20
MIN_SENTENCE = 20


def seq_ratio_py(a: str | None, b: str | None) -> float:
    """E5: ratio of the lower-cased strings (argument order matters; the
    default autojunk heuristic stays on, as in the reference)."""
    if not a or not b:
        return 0.0
    return difflib.SequenceMatcher(None, a.lower(), b.lower()).ratio()


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Vectorised over Arrow batches; deterministic."""
    return pd.Series([seq_ratio_py(x, y) for x, y in zip(a, b)], dtype="float64")


# --- E3 / E4: blocks inside one text ------------------------------------------

def exact_blocks(c) -> Column:
    """(pos, block, norm) of the blocks (E2) of a text whose normalised form has at least 15
    characters, the first of equal ones. Row-local: places by normalised form are found with a map."""
    blocks = F.transform(split_blocks(c), lambda b, i: F.struct(i.alias("pos"), b.alias("block"), norm_block(b).alias("norm")))
    long = F.filter(blocks, lambda s: F.length(s["norm"]) >= MIN_BLOCK)
    # equal forms stand together in this order, the first one ahead
    ordered = F.sort_array(F.transform(long, lambda s: F.struct(s["norm"].alias("norm"), s["pos"].alias("pos"), s["block"].alias("block"))))
    # the outer transform names the sorted array, so that it is sorted once
    firsts = F.flatten(F.transform(F.array(ordered), lambda a: F.filter(
        a, lambda x, i: (i == 0) | (F.get(a, i - 1)["norm"] != x["norm"]))))
    return F.transform(firsts, lambda x: F.struct(x["pos"].alias("pos"), x["block"].alias("block"), x["norm"].alias("norm")))


def dedup_blocks_exact(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per kept block (key, pos, block, norm); no shuffle."""
    return df.select(key, F.inline(exact_blocks(F.col(text))))


_GRAM = 8                # characters of a fingerprint's window
_MULT, _WRAP = 0x9E3779B97F4A7C15, 1 << 64
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]     # of the odd multiplier, and of its inverse


def _powers(n: int) -> list[np.ndarray]:
    if _POWERS[0].size < n:
        for k, base in enumerate((_MULT, pow(_MULT, -1, _WRAP))):
            p = np.full(2 * n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS


class _Rolling:
    """Hashes of all substrings of one length, from prefix sums."""

    def __init__(self, s: str):
        codes = np.frombuffer(s.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        up, self.down = _powers(codes.size + 1)
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(codes * up[:codes.size], dtype=np.uint64)))

    def of_length(self, n: int) -> np.ndarray:
        h = (self.sums[n:] - self.sums[:-n]) * self.down[:self.sums.size - n]
        return h ^ h >> np.uint64(29)


def _window_minima(h: np.ndarray, width: int) -> list[int]:
    """Distinct minima over all windows of ``width`` hashes."""
    size, m = 1, h
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[:m.size - (width - size)], m[width - size:])
    return np.unique(m).tolist()


class KeptBlocks:
    """Kept blocks, found by containment without a look at each of them.

    *A kept one inside the new block*: kept blocks are filed by length and hash, and the new one's
    rolling hashes of the lengths present in the band are looked up.
    *The new one inside a kept block*: of two blocks of which one holds the other and is not much longer, both
    hold every window of T characters of the shorter one, T being the largest power of two within its
    length, so the longer one has all the smallest gram hashes of those windows. A block is filed under its window
    minima at its own T and at half of it, which covers the band; the shortest of the new block's lists names the few
    candidates. Every hit is verified on the texts."""

    def __init__(self):
        self.raw: dict[str, str] = {}
        self.by_mark: dict[tuple, dict] = {}
        self.by_length: dict[int, dict] = {}
        self.lengths: list[int] = []

    def offer(self, norm: str, raw: str) -> bool:
        """Keep-first with containment; true if a kept block was replaced."""
        if norm in self.raw:
            return False
        n, roll = len(norm), _Rolling(norm)
        grams, top = roll.of_length(_GRAM), 1 << (len(norm).bit_length() - 1)
        marks = [(top, x) for x in _window_minima(grams, top - _GRAM + 1)]
        lists = [self.by_mark.get(m, {}) for m in marks]
        if any(n > len(k) * BLOCK_CONTAIN and norm in k for k in min(lists, key=len)):
            return False
        inside = [k for k in self._held(roll, n) if len(k) > n * BLOCK_CONTAIN and k in norm]
        for k in inside:
            self._remove(k)
        self._add(norm, raw, int(roll.of_length(n)[0]), marks, grams, top)
        return bool(inside)

    def _held(self, roll: _Rolling, n: int) -> list[str]:
        """Kept blocks whose hash one of the new block's substrings has."""
        out = []
        for size in self.lengths[bisect.bisect_left(self.lengths, int(n * BLOCK_CONTAIN)): bisect.bisect_right(self.lengths, n)]:
            filed = self.by_length[size]
            out += [k for h in set(roll.of_length(size).tolist()) & filed.keys() for k in filed[h]]
        return out

    def _add(self, norm, raw, own, marks, grams, top):
        if top // 2 >= _GRAM:
            marks = marks + [(top // 2, x) for x in _window_minima(grams, top // 2 - _GRAM + 1)]
        self.raw[norm] = raw
        for m in marks:
            self.by_mark.setdefault(m, {})[norm] = None
        if len(norm) not in self.by_length:
            bisect.insort(self.lengths, len(norm))
        self.by_length.setdefault(len(norm), {}).setdefault(own, []).append(norm)

    def _remove(self, norm):
        del self.raw[norm]
        roll, top = _Rolling(norm), 1 << (len(norm).bit_length() - 1)
        self.by_length[len(norm)][int(roll.of_length(len(norm))[0])].remove(norm)
        grams = roll.of_length(_GRAM)
        for t in (top, top // 2):
            for x in _window_minima(grams, t - _GRAM + 1) if t >= _GRAM else ():
                self.by_mark.get((t, x), {}).pop(norm, None)


FEW_BLOCKS = 256         # blocks that are compared one by one: substring tests are far cheaper than their hashes


class FewBlocks:
    """``KeptBlocks`` of a short text, by a look at each kept block."""

    def __init__(self):
        self.raw: dict[str, str] = {}

    def offer(self, norm: str, raw: str) -> bool:
        n = len(norm)
        if norm in self.raw or any(n > len(k) * BLOCK_CONTAIN and norm in k for k in self.raw):
            return False
        inside = [k for k in self.raw if len(k) > n * BLOCK_CONTAIN and k in norm]
        for k in inside:
            del self.raw[k]
        self.raw[norm] = raw
        return bool(inside)


_WS = re.compile(r"\s+")


def _norm_py(s: str) -> str:
    return _WS.sub(" ", s.lower().strip())


def _split_blocks_py(text: str) -> list[str]:
    """E2."""
    for mark in ("\n\n", "\n"):
        blocks = [b for b in (x.strip() for x in text.split(mark)) if b]
        if len(blocks) > 1:
            return blocks
    return [b for b in (x.strip() for x in text.split(".")) if len(b) > MIN_SENTENCE]


def dedup_blocks_py(text: str | None, on_supersede: str = "replace") -> str | None:
    """E4 of one text."""
    if not text:
        return text
    blocks, replaced = _split_blocks_py(text), False
    kept = FewBlocks() if len(blocks) <= FEW_BLOCKS else KeptBlocks()
    for raw in blocks:
        norm = _norm_py(raw)
        if len(norm) >= MIN_BLOCK:
            replaced |= kept.offer(norm, raw)
    if replaced and on_supersede == "fallback":
        return None
    return "\n\n".join(kept.raw.values()) if kept.raw else text


def dedup_blocks_of(on_supersede: str = "replace"):
    """E4 on every text of an array column, row-local."""

    return _in_place(_by_slices(lambda a: None if a is None else [dedup_blocks_py(t, on_supersede) for t in a], T.StringType(), pa.string()))


def dedup_blocks(c, on_supersede: str = "replace") -> Column:
    """Split (E2), drop short blocks, then keep-first with
    containment: an exact copy of a kept block goes; a block inside a kept one and longer than 0.7 of it is
    skipped; a kept block inside the new one and longer than 0.7 of it is
    replaced. Joined by blank lines; if nothing is left the input returns.

    ``on_supersede='fallback'`` returns NULL whenever a replacement would
    happen (the reference raises there and falls back to regex text)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.get(dedup_blocks_of(on_supersede)(F.array(c)), F.lit(0))


# --- ordered keep-first inside a page's row (D6, E9) -----------------------------
#
# Keep a text unless it duplicates an earlier *kept* one: an order-dependent fold (a text similar
# only to a dropped one must stay). The groups are the sections or items of one page, arrays of its
# row, so no text is shuffled.

def _section_duplicate(new: str, old: str, threshold: float) -> bool:
    """E6 on normalised texts."""
    if not old:
        return False
    if new == old or (new in old and len(new) > len(old) * SECTION_CONTAIN) or (old in new and len(old) > len(new) * SECTION_CONTAIN):
        return True
    return _above(new, old, threshold)


@lru_cache(maxsize=1024)
def _letters(t: str) -> Counter:
    return Counter(t)


def _above(new: str, old: str, threshold: float) -> bool:
    """E5 over the threshold; cheap upper bounds first: the lengths, then the characters in common (``quick_ratio``),
    counted once per text."""
    both = len(new) + len(old)
    if not 2 * min(len(new), len(old)) > threshold * both:
        return False
    a, b = _letters(new), _letters(old)
    if not 2.0 * sum(min(n, b[c]) for c, n in a.items()) / both > threshold:
        return False
    return difflib.SequenceMatcher(None, new, old).ratio() > threshold


def kept_section_places(norms, threshold: float = SECTION_THRESHOLD) -> list[int]:
    """Places of the sections that stay, in order; a blank one is a duplicate."""
    kept: list[int] = []
    for j, new in enumerate(norms):
        if new and not any(_section_duplicate(new, norms[i], threshold) for i in kept):
            kept.append(j)
    return kept


FEW_ITEMS = 32           # items that are compared one by one, without an index


class SimilarItems:
    """Kept items, found by a prefix filter on character pairs with a length band.

    With a ratio above t, the matched characters are more than t/2 of both texts' L together and the
    unmatched ones fewer than (1 - t) L, so there are at most that many breaks between matched runs
    and more than (1.5 t - 1) L - 1 character pairs in common. Two texts with so many pairs in common, each pair list sorted
    rarest first, share one among the first of both: only those are filed and looked up."""

    def __init__(self, texts, threshold: float):
        self.threshold, texts = threshold, list(texts)
        self.few = len(texts) <= FEW_ITEMS
        self.freq = Counter() if self.few else Counter(p for t in texts for p in self._pairs(t))
        self.by: dict[tuple, list[int]] = {}
        self.texts: list[str] = []
        self.exact: set[str] = set()

    @staticmethod
    def _pairs(t: str) -> list[tuple]:
        seen: Counter = Counter()
        out = []
        for i in range(len(t) - 1):
            p = t[i: i + 2]
            out.append((p, seen[p]))
            seen[p] += 1
        return out

    def _prefix(self, t: str) -> list[tuple]:
        pairs = sorted(self._pairs(t), key=lambda p: (self.freq[p], p))
        both = len(t) * (1 + self.threshold / (2 - self.threshold))       # least L within the length band
        need = int((1.5 * self.threshold - 1) * both)
        return pairs[: len(pairs) - need + 1] if need > 0 else [None]

    def offer(self, t: str) -> bool:
        """Keep ``t`` unless a kept text equals it or is similar."""
        if t in self.exact:
            return False
        prefix = [None] if self.few else self._prefix(t)
        near = dict.fromkeys(i for p in (*prefix, None) for i in self.by.get(p, ()))
        if prefix == [None]:                      # too short for the filter: all kept ones are looked at
            near = dict.fromkeys(range(len(self.texts)))
        if any(_above(t, self.texts[i], self.threshold) for i in near):
            return False
        for p in prefix:
            self.by.setdefault(p, []).append(len(self.texts))
        self.texts.append(t)
        self.exact.add(t)
        return True


def kept_item_places(texts, threshold: float = ITEM_THRESHOLD) -> list[int]:
    """Groups of 0 or 1 item unchanged; otherwise items under 20 characters
    go and the first of equal or similar (E7) ones stays."""
    if len(texts) <= 1:
        return list(range(len(texts)))
    long = [j for j, t in enumerate(texts) if len(t.strip()) >= MIN_ITEM]
    norms = {j: _norm_py(texts[j]) for j in long}
    kept = SimilarItems(norms.values(), threshold)
    return [j for j in long if kept.offer(norms[j])]


def _in_place(udf):
    """Filters inferred from a later explode would be pushed below the projection with the call written
    into them; called non-deterministic, a UDF is evaluated once, where it stands."""
    return udf.asNondeterministic()


ROWS_AT_ONCE = 64        # rows whose texts are Python objects at one time


def _by_slices(of, kind: T.DataType, arrow_kind: pa.DataType):
    """``of`` on each value of an array column, as arrays of ``kind``. A batch stays in Arrow; a few of its rows at a time become Python objects."""
    arrow = pa.list_(arrow_kind)

    def run(values: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array([], arrow), *(
            pa.array([of(a) for a in values.slice(i, ROWS_AT_ONCE).to_pylist()], arrow) for i in range(0, len(values), ROWS_AT_ONCE))])

    return F.arrow_udf(run, T.ArrayType(kind))


kept_sections = _in_place(_by_slices(kept_section_places, T.IntegerType(), pa.int32()))
kept_items = _in_place(_by_slices(kept_item_places, T.IntegerType(), pa.int32()))


# --- corpus scale (E10, E11) -------------------------------------------------

def _norm(c: Column) -> Column:
    return F.regexp_replace(strip_ws(F.lower(c)), WS, " ")


def exact_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """E10 exact part: documents whose normalised text is equal; each maps
    to the smallest id of its group (a groupBy, partial aggregation)."""
    h = df.select(key, F.sha2(_norm(F.col(text)), 256).alias("h"))
    rep = h.groupBy("h").agg(F.min(key).alias("rep"), F.count(F.lit(1)).alias("copies"))
    return h.join(rep, "h").select(key, "rep", "copies")


def duplicate_blocks_corpus(df: DataFrame, key: str, text: str, group: str, min_docs: int = 3) -> DataFrame:
    """Blocks (lines) repeated in at least ``min_docs`` documents of a
    group (host / source): site boilerplate. Pre-aggregated per
    (group, block hash) before any join."""
    lines = df.select(group, key, F.explode(F.split(F.col(text), "\n")).alias("line"))
    lines = lines.withColumn("norm", _norm(F.col("line"))).filter(F.length("norm") >= MIN_BLOCK)
    rep = (lines.groupBy(group, F.md5("norm").alias("h"))
           .agg(F.countDistinct(key).alias("docs"), F.min("norm").alias("block")))
    return rep.filter(F.col("docs") >= min_docs)


BLOOM_WORDS = 1 << 17     # most longs of the filter: one megabyte, whatever the corpus
BLOOM_BITS_EACH = 16      # bits per hash aimed at: with three probes, under 1 % false hits


def drop_boilerplate(df: DataFrame, key: str, text: str, group: str, min_docs: int = 3) -> DataFrame:
    """E11 applied: the documents, all columns, without their group's boilerplate lines.

    A Bloom filter of the boilerplate's hashes is tested on every line inside the row; only possible hits
    leave the row, as (row, hash), for the exact test. No text is taken apart or shuffled to be put together again."""
    bp = stored(duplicate_blocks_corpus(df, key, text, group, min_docs).select(group, "h"), "boilerplate")
    mark = lambda h: F.xxhash64(F.coalesce(F.col(group).cast("string"), F.lit("")), h)
    probe = bloom_filter(bp.select(mark(F.col("h")).alias("x")))
    lines = F.transform(F.split(F.col(text), "\n"), lambda x: F.struct(x.alias("line"), F.md5(_norm(x)).alias("h")))
    # stored: both branches below must see the same row numbers
    tagged = stored(df.select("*", F.monotonically_increasing_id().alias("row id"), lines.alias("row lines")), "lines")
    maybe = F.array_distinct(F.transform(F.filter("row lines", lambda x: probe(mark(x["h"]))), lambda x: x["h"]))
    maybe = tagged.select("row id", group, F.explode(maybe).alias("h"))
    exact = bp.select(F.col(group).alias("g"), F.col("h").alias("hash"))
    hit = maybe.join(exact, maybe[group].eqNullSafe(exact["g"]) & (maybe["h"] == exact["hash"]), "left_semi") \
        .groupBy("row id").agg(F.collect_set("h").alias("row gone"))         # hashes of one document
    kept = F.array_join(F.transform(F.filter("row lines", lambda x: ~F.array_contains("row gone", x["h"])), lambda x: x["line"]), "\n")
    out = tagged.join(hit, "row id", "left")
    return out.withColumn(text, F.when(F.col("row gone").isNull(), F.col(text)).otherwise(kept)).select(*df.columns)


def bloom_filter(hashes: DataFrame):
    """A test ``column -> possibly among the hashes (x)`` as an expression. The bits are set by Spark; the
    driver holds at most ``BLOOM_WORDS`` longs, which become one literal of the plan."""
    n = hashes.count()
    words = 64
    while words < BLOOM_WORDS and words * 64 < n * BLOOM_BITS_EACH:
        words *= 2
    bit = lambda x, k: F.pmod(F.xxhash64(x, F.lit(k)), F.lit(words * 64))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(b, F.lit(64)).cast("int"))
    set_ = hashes.select(F.explode(F.array(*[bit(F.col("x"), k) for k in range(3)])).alias("b")) \
        .groupBy(F.floor(F.col("b") / 64).alias("w")).agg(F.bit_or(one(F.col("b"))).alias("v")).collect()
    table = [0] * words
    for r in set_:
        table[r["w"]] = r["v"]
    literal = F.from_json(F.lit(json.dumps(table)), "array<bigint>")          # folded once, when the plan is made

    def probe(x: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.get(literal, F.floor(bit(x, k) / 64).cast("int")).bitwiseAND(one(bit(x, k))) != 0
                                           for k in range(3)])

    return probe
