"""Language identification: features and gradients against plain Python, accuracy on held-out rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import ftrl, langid

from .conftest import DOCS, odd_documents


def plain_grams(text):
    """Counts of the n-grams of one text, as strings."""
    s = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} ")
    while "  " in s:
        s = s.replace("  ", " ")
    return Counter(s[i:i + n] for n in langid.ORDERS for i in range(len(s) - n + 1) if s[i:i + n] != " ")


TEXTS = ["", "Hello, World", "a", "12 !", "  ÀÉ  été 你好 ", "aaa aaa  aaa", "İi ß x" * 50]


def test_features():
    bucket = {}
    for t in TEXTS:
        (_, _, _, b, n), = langid.features([t])
        assert sorted(n.tolist()) == sorted(plain_grams(t).values())        # no two n-grams of these texts share a bucket
        bucket[t] = dict(zip(b.tolist(), n.tolist(), strict=True))
    together = [(d, b, n) for _, _, doc, bk, count in langid.features(TEXTS)
                for d, b, n in zip(doc.tolist(), bk.tolist(), count.tolist(), strict=True)]
    assert together == [(i, b, n) for i, t in enumerate(TEXTS) for b, n in sorted(bucket[t].items())]


def test_long_texts_count_alike(monkeypatch):
    text = "Wörter and  words -- 12 über all\n\n" * 40
    (_, _, _, b, n), = langid.features([text])
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(langid, "SLICE", size)
        (_, _, _, b2, n2), = langid.features([text])
        assert np.array_equal(b, b2) and np.array_equal(n, n2)


def test_ftrl_against_plain_loop():
    r = np.random.default_rng(1)
    examples = [(np.unique(r.integers(0, 20, 6)), None) for _ in range(60)]
    examples = [(x, r.random(x.size)) for x, _ in examples]
    labels = r.integers(0, 3, 60)
    got = ftrl.train(examples, labels, 20, 3, epochs=2, seed=9)
    z, n = [[0.0] * 3 for _ in range(20)], [[0.0] * 3 for _ in range(20)]

    def weight(i, k):
        if abs(z[i][k]) <= ftrl.L1:
            return 0.0
        return -(z[i][k] - math.copysign(ftrl.L1, z[i][k])) / ((ftrl.BETA + math.sqrt(n[i][k])) / ftrl.ALPHA + ftrl.L2)

    order = np.random.default_rng(9)
    for _ in range(2):
        for e in order.permutation(60).tolist():
            x, v = examples[e]
            logit = [sum(weight(i, k) * u for i, u in zip(x, v, strict=True)) for k in range(3)]
            soft = [math.exp(y) / sum(map(math.exp, logit)) for y in logit]
            new = [(i, k, (soft[k] - (k == labels[e])) * u, weight(i, k)) for i, u in zip(x, v, strict=True) for k in range(3)]
            for i, k, g, w in new:
                z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / ftrl.ALPHA * w
                n[i][k] += g * g
    want = np.array([[weight(i, k) for k in range(3)] for i in range(20)])
    assert np.allclose(got, want)
    assert (want == 0).any()                                                # the L1 part keeps weights at zero


def test_temperature():
    r = np.random.default_rng(2)
    logits = r.standard_normal((4000, 3)) * 2
    labels = np.array([r.choice(3, p=ftrl.softmax(x)) for x in logits])
    assert ftrl.temperature(3 * logits, labels) == pytest.approx(3.0, rel=0.15)
    assert ftrl.temperature(logits[:0], labels[:0]) == 1.0


def test_document_frequencies(documents):
    n, df = langid.document_frequencies(documents)
    want = Counter(b for r in documents.collect() for b in next(langid.features([r["text"] or ""]))[3].tolist())
    assert n == documents.count() and {int(i): int(df[i]) for i in np.flatnonzero(df)} == dict(want)


def test_held_out_accuracy(documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    got = langid.languages(documents).collect()
    assert len(got) == documents.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    again = langid.languages(documents.repartition(5)).collect()            # partitions do not matter
    assert {r["doc_id"]: r["lang_pred"] for r in again} == {r["doc_id"]: r["lang_pred"] for r in got}


def test_odd_rows(spark, table):
    docs = table(odd_documents(), DOCS).withColumn("score", F.lit("clash")).withColumn("key", F.lit(1))
    got = langid.languages(docs).collect()
    assert len(got) == len(odd_documents())
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (0, 1, 2))
    assert all(by[i]["lang_pred"] == "en" and 0 <= by[i]["score"] <= 1 for i in range(3, 12))
    nothing = langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert langid.languages(spark.createDataFrame([], DOCS)).count() == 0


def test_sample_is_bounded(documents):
    rows = documents.where("lang is not null")
    counts = [(r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect()]
    got = langid._sample(rows, counts, 20).groupBy("lang").count().collect()
    assert got and all(r["count"] <= 20 // len(counts) for r in got)
