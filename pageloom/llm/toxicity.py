"""Toxicity of whole texts with the network of ``bigru``.

The network is trained on the driver from a bounded, hash-chosen sample of
labelled rows that are not held out: at most SAMPLE of each class, whole texts of any length; where they would pass
SAMPLE_CHARS characters together, fewer documents are drawn. Scoring runs every overlapping window of every
text, whatever its length; a document's score is that of its highest window.

Defined cases: a null or empty text, or one without words, scores the share of
label 1 among the labelled training rows; a null doc_id counts as the empty string for the split;
repeated label rows count once, the larger label wins, null labels are ignored;
without training rows of both classes the score is a constant; repeated rows
are scored each; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bigru import DECISION, BiGru, Words, score_windows, train, windows
from .words import read_columns, text_slices

SAMPLE = 1500             # most training documents per class
SAMPLE_CHARS = 1_400_000  # ... and characters per class they may have together, at least one document


def remainder(doc_id: Column) -> Column:
    """The remainder that decides the split; 2 is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[BiGru, float]:
    """(network, share of label 1) from labelled rows that are not held out."""
    known = labels.where("doc_id is not null and toxic is not null").where(remainder(F.col("doc_id")) != 2) \
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    text = F.col("text").cast("string")
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("size"),
                        F.xxhash64("doc_id", text).alias("key")).where("size > 0").join(known, "doc_id")
    each = [sizes.where(F.col("toxic") == k).orderBy("key", "doc_id").limit(sample) for k in (0, 1)]    # at most 2 * sample rows
    before = F.sum("size").over(Window.partitionBy("toxic").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    chosen = each[0].unionByName(each[1]).withColumn("before", F.coalesce(before, F.lit(0))) \
        .where((F.col("before") == 0) | (F.col("before") + F.col("size") <= SAMPLE_CHARS)).select("doc_id", "key", "toxic").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64("doc_id", text).alias("key")) \
        .join(F.broadcast(chosen), ["doc_id", "key"]) \
        .orderBy("key", "doc_id").limit(2 * sample).select("text", "toxic").collect()    # at most 2 * sample texts of 2 * SAMPLE_CHARS
    return train([r["text"] for r in rows], np.array([r["toxic"] for r in rows], dtype=np.float32)), share


def score(docs: DataFrame, net: BiGru, empty: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    params = net.p  # fixed size: two embedding tables and a few small matrices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BiGru(params=params)
        for batch in batches:
            ident, held, text = read_columns(batch, "doc_id", "held_out", "text")
            for row, buf, offs in text_slices(text, 1 << 19):
                w = Words(buf, offs)
                doc, start, size = windows(w.first)
                n = offs.size - 1
                top = np.full(n, -np.inf)
                np.maximum.at(top, doc, score_windows(own, w, start, size).astype(float))
                prob = np.where(np.isneginf(top), empty, 1 / (1 + np.exp(-top)))
                yield pa.RecordBatch.from_arrays(
                    [ident.slice(row, n), held.slice(row, n), pa.array(prob),
                     pa.array((prob >= DECISION).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id")) == 2).alias("held_out"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, net: BiGru, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold; a
    text without words stays."""
    params = net.p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = BiGru(params=params)
        for batch in batches:
            for row, buf, offs in text_slices(read_columns(batch, text)[0], 1 << 19):
                w = Words(buf, offs)
                doc, start, size = windows(w.first)
                top = np.full(offs.size - 1, -np.inf)
                np.maximum.at(top, doc, score_windows(own, w, start, size).astype(float))
                yield batch.slice(row, top.size).filter(pa.array(1 / (1 + np.exp(-top)) < DECISION))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` and score all of ``docs``."""
    net, share = fit(docs, labels)
    return score(docs, net, min(share, DECISION / 2))
