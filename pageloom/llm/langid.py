"""Language identification: sparse logistic regression on TF-IDF character n-grams.

Text is lower-cased; a run of characters that are no letters is one blank, and
blanks stand at both ends. Its 1- to 3-grams are hashed into BUCKETS features
with weight (1 + log count) * idf, scaled to unit length.

1. Document frequencies are counted over all training documents.
2. The model is fitted (``ftrl``) on the driver from the features, not the
   texts, of a bounded sample of training documents: at most SAMPLE rows in
   all, dealt evenly to the languages (the SAMPLE commonest, if there are more),
   chosen by hash, whole texts of any length. A fifth of them is kept out to fit the temperature.
3. Every text is scored whole; long ones in pieces that add up to the same
   counts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0,
as is every text where no row can be learned from; rows with a null lang are
not learned from; a null doc_id counts as the empty string for the split;
repeated rows count each (in the sample too); equal scores go to the language
that sorts first; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ftrl
from .store import keep
from .words import mix, read_columns

BITS = 18
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
SAMPLE = 4000             # most rows the model is fitted on
CALIBRATE = 5             # one row of so many fits the temperature
SLICE = 1 << 18           # characters handled at once
_MULT = np.uint64(0x9E3779B97F4A7C15)


def remainder(doc_id: Column) -> Column:
    """The remainder that decides the split; 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


_FOLD: list[np.ndarray] = []


def fold() -> np.ndarray:
    """For every code point its lower-case letter; 32 where it is no letter."""
    if not _FOLD:
        table = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _FOLD.append(table)
    return _FOLD[0]


def _clean(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters with runs of blanks made one, per document."""
    c = fold()[codes]
    again = np.zeros(c.size, dtype=bool)
    again[1:] = (c[1:] == 32) & (c[:-1] == 32) & (doc[1:] == doc[:-1])
    return c[~again], doc[~again]


def _grams(c: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of every n-gram; a lone blank is none."""
    key = np.zeros(c.size, dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = c.size - n + 1
        if m <= 0:
            return
        key = key[:m] * _MULT + c[n - 1:].astype(np.uint64) + np.uint64(1)
        same = doc[:m] == doc[n - 1:]
        if n == 1:
            same &= c != 32
        if n in ORDERS:
            yield doc[:m][same], (mix(key[same] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, document, bucket, count) for runs of texts, sorted by
    document and bucket, one row per distinct pair."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE):
            size += len(texts[j])
            j += 1
        if j == i + 1 and size > SLICE:
            yield i, 1, *_long(texts[i])
        else:
            joined = "".join(f" {t} " for t in texts[i:j])
            codes = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
            doc = np.repeat(np.arange(j - i), [len(t) + 2 for t in texts[i:j]])
            parts = [d << BITS | b for d, b in _grams(*_clean(codes, doc))]
            key = np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64)
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if key.size else key
            yield i, j - i, key[first] >> BITS, key[first] & (BUCKETS - 1), np.diff(np.append(first, key.size))
        i = j


def _long(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of one long text, counted piece by piece."""
    total, tail = np.zeros(BUCKETS, dtype=np.int64), np.zeros(0, dtype=np.uint32)
    most = max(ORDERS)
    text = f" {text} "
    for at in range(0, len(text), SLICE):
        c = fold()[np.frombuffer(text[at: at + SLICE].encode("utf-32-le", "replace"), dtype=np.uint32)]
        c, old = np.concatenate((tail, c)), tail.size
        again = np.zeros(c.size, dtype=bool)
        again[1:] = (c[1:] == 32) & (c[:-1] == 32)
        c = c[~again]
        one = np.zeros(c.size, dtype=np.int64)
        for _, bucket in _grams(c, one):
            total += np.bincount(bucket, minlength=BUCKETS)
        for _, bucket in _grams(tail, one[:old]):            # counted with the piece before
            total -= np.bincount(bucket, minlength=BUCKETS)
        tail = c[-(most - 1):]
    bucket = np.flatnonzero(total)
    return np.zeros(bucket.size, dtype=np.int64), bucket, total[bucket]


def document_frequencies(rows: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, number of them that hold each bucket), over all of ``rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            texts = [t or "" for t in read_columns(batch, "text")[0].to_pylist()]
            n += len(texts)
            for _, _, _, bucket, _ in features(texts):
                df += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), pa.array(np.append(n, df[at]))], names=["bucket", "n"])

    got = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BUCKETS, dtype=np.int64)                 # at most one row per bucket
    n = 0
    for r in got:
        if r["bucket"] < 0:
            n = int(r["n"])
        else:
            df[r["bucket"]] = r["n"]
    return n, df


def _weights(doc, bucket, count, idf, n: int) -> np.ndarray:
    """TF-IDF values, of unit length per document."""
    v = (1.0 + np.log(count)) * idf[bucket]
    norm = np.sqrt(np.bincount(doc, weights=v * v, minlength=n))
    return v / np.where(norm > 0, norm, 1.0)[doc]


class Model:
    """Languages, idf, weights of the buckets that have any, bias and temperature."""

    def __init__(self, langs: list[str], idf: np.ndarray, place: np.ndarray, w: np.ndarray, bias: np.ndarray, heat: float):
        self.langs, self.idf, self.place, self.w, self.bias, self.heat = langs, idf, place, w, bias, heat

    def logits(self, doc, bucket, count, n: int) -> np.ndarray:
        v = _weights(doc, bucket, count, self.idf, n)
        row = self.place[bucket]
        known = row >= 0
        doc, v, row = doc[known], v[known], row[known]
        return np.stack([np.bincount(doc, weights=v * self.w[row, k], minlength=n) for k in range(len(self.langs))], axis=1) + self.bias


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model learned from the rows of ``docs`` that are not held out; None without any."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")) \
        .where((remainder(F.col("doc_id")) != 1) & F.col("lang").isNotNull())
    n, df = document_frequencies(rows)
    if not n:
        return None
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    top = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    langs = sorted(r["lang"] for r in top)
    chosen = _sample(rows, [(r["lang"], r["count"]) for r in top], sample)
    examples, labels, apart = [], [], []
    number = {lang: k for k, lang in enumerate(langs)}
    for r in chosen.collect():                             # at most ``sample`` rows of counted features
        bucket, count = np.array(r["bucket"], dtype=np.int64), np.array(r["n"], dtype=np.float64)
        if bucket.size:
            examples.append((bucket, _weights(np.zeros(bucket.size, dtype=np.int64), bucket, count, idf, 1)))
            labels.append(number[r["lang"]])
            apart.append(r["apart"])
    labels, apart = np.array(labels, dtype=np.int64), np.array(apart, dtype=bool)
    seen = np.unique(np.concatenate([b for b, _ in examples])) if examples else np.zeros(0, dtype=np.int64)
    place = np.full(BUCKETS, -1, dtype=np.int64)
    place[seen] = np.arange(seen.size)
    rowed = [(np.append(place[b], seen.size), np.append(v, 1.0)) for b, v in examples]     # the bias is the last row
    taught = np.flatnonzero(~apart)
    w = ftrl.train([rowed[i] for i in taught], labels[taught], seen.size + 1, len(langs))
    test = np.flatnonzero(apart)
    logits = np.array([rowed[i][1] @ w[rowed[i][0]] for i in test]).reshape(test.size, len(langs))
    heat = ftrl.temperature(logits, labels[test])
    used = np.flatnonzero((w[:-1] != 0).any(axis=1))
    place = np.full(BUCKETS, -1, dtype=np.int32)
    place[seen[used]] = np.arange(used.size)
    return Model(langs, idf, place, w[used], w[-1], heat)


def _sample(rows: DataFrame, counts: list[tuple[str, int]], sample: int) -> DataFrame:
    """(lang, apart, bucket, n): the features of a bounded number of rows of every language."""
    each = max(1, sample // max(1, len(counts)))
    share = rows.sparkSession.createDataFrame([(lang, min(1.0, 2.0 * each / n)) for lang, n in counts], "lang string, share double")
    key = F.xxhash64("doc_id", "text", F.lit("language"))
    few = rows.withColumn("key", key).join(F.broadcast(share), "lang") \
        .where((F.col("key") / F.lit(2.0 ** 64) + 0.5) < F.col("share"))          # about 2 * each rows a language
    picked = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))) \
        .where(F.col("place") <= each)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, apart, text = read_columns(batch, "lang", "apart", "text")
            for row, n, doc, bucket, count in features([t or "" for t in text.to_pylist()]):
                offs = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [lang.slice(row, n), apart.slice(row, n), pa.ListArray.from_arrays(offs, pa.array(bucket.astype(np.int32))),
                     pa.ListArray.from_arrays(offs, pa.array(count.astype(np.int32)))], names=["lang", "apart", "bucket", "n"])

    return keep(picked.select("lang", (F.pmod(F.xxhash64("key"), F.lit(CALIBRATE)) == 0).alias("apart"), "text")
                .mapInArrow(run, "lang string, apart boolean, bucket array<int>, n array<int>"), "language_sample")


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``."""
    model = fit(docs, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ident, held, text = read_columns(batch, "doc_id", "held_out", "text")
            texts = [t or "" for t in text.to_pylist()]
            for row, n, doc, bucket, count in features(texts):
                lang, score = np.full(n, "und", dtype=object), np.zeros(n)
                if model is not None:
                    p = ftrl.softmax(model.logits(doc, bucket, count, n) / model.heat)
                    has = np.bincount(doc, minlength=n) > 0
                    best = p.argmax(axis=1)
                    lang = np.where(has, np.array(model.langs, dtype=object)[best], "und")
                    score = np.where(has, p[np.arange(n), best], 0.0)
                yield pa.RecordBatch.from_arrays([ident.slice(row, n), held.slice(row, n), pa.array(lang.tolist(), pa.string()),
                                                  pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id")) == 1).alias("held_out"),
                       F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
