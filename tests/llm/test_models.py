"""Kneser-Ney scores and the toxicity network against plain Python."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pageloom.llm import bigru, kneser_ney, toxicity
from pageloom.llm.words import text_slices

from .conftest import DOCS, LOWER, odd_documents


def words(t):
    return re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [None]


def brute_scores(rows):
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1 for k, _ in rows]
    toks = [words(t) for _, t in rows]
    train = [t for t, h in zip(toks, held) if not h]
    uni = collections.Counter(w for t in train for w in t)
    pairs = collections.Counter(p for t in train for p in zip(["<s>", *t[:-1]], t))
    total, kinds, cont = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0]), collections.Counter()
    for (a, b), c in pairs.items():
        total[a] += c
        kinds[a][min(c, 3) - 1] += 1
        cont[b] += 1
    d = kneser_ney.discounts([sum(c == j for c in pairs.values()) for j in (1, 2, 3, 4)])
    d1 = kneser_ney.discounts([sum(c == j for c in cont.values()) for j in (1, 2, 3, 4)])
    n, v, every = sum(uni.values()), len(uni), sum(cont.values())

    def low(b):
        if not every:
            return 1 / (v + 1)
        gamma = sum(d1[min(c, 3) - 1] for c in cont.values()) / every
        c = cont.get(b, 0)
        return (c - [0, *d1][min(c, 3)]) / every + gamma / (v + 1)

    def prob(a, b):
        if not total.get(a):
            return low(b)
        c = pairs.get((a, b), 0)
        return (c - [0, *d][min(c, 3)]) / total[a] + sum(x * y for x, y in zip(kinds[a], d)) / total[a] * low(b)

    out = [(h, len(t), sum(w in uni for w in t), n,
            sum(math.log10((uni.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t),
            sum(math.log10(prob(a, w)) for a, w in zip(["<s>", *t[:-1]], t))) for h, t in zip(held, toks)]
    return out, prob, uni


@pytest.mark.parametrize("frequent", [2000, 1])
def test_scores(table, monkeypatch, frequent):
    monkeypatch.setattr(kneser_ney, "FREQUENT", frequent)
    monkeypatch.setattr(kneser_ney, "_FLUSH", 500)
    rng = np.random.default_rng(1)
    rows = [(100 + i, " ".join(rng.choice(["the", "a", "dog", "cat", "Runs", "sits", "far", "there,", "é"], 30))) for i in range(60)]
    rows += [(r[0], r[1]) for r in odd_documents()]
    docs = table(rows, "doc_id long, text string").selectExpr("*", "0 AS held_out")
    want, prob, uni = brute_scores(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in kneser_ney.lm_scores(docs).collect()), key=key)
    want = sorted(((k, *w) for (k, _), w in zip(rows, want)), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert sum(prob("the", w) for w in uni) + prob("the", "unseen") == pytest.approx(1)


def test_scores_without_training(spark, table):
    assert kneser_ney.lm_scores(spark.createDataFrame([], DOCS)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = kneser_ney.lm_scores(table([(held, "a b")], "doc_id long, text string")).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) == (True, 3, 0, 0, 0.0)


def test_remote_folder_is_refused():
    with pytest.raises(ValueError):
        kneser_ney.local_path("hdfs://name/dir")


def test_gradients():
    rng = np.random.default_rng(0)
    net = bigru.BiGru(3)
    net.p = {k: x.astype(float) for k, x in net.p.items()}
    table = rng.standard_normal((20, 2 * bigru.EMBED))
    table[-1] = 0
    size = np.array([24, 10, 3, 1])
    mask = (np.arange(bigru.WINDOW)[:, None] < size).astype(float)
    at = np.where(mask > 0, rng.integers(0, 19, mask.shape), 19)
    y = np.array([1, 0, 1, 0.0])

    def loss():
        return np.mean(np.logaddexp(0, -(2 * y - 1) * net.forward(table, at, mask)[0]))

    logit, held = net.forward(table, at, mask, True)
    g = net.backward(table, at, mask, held, (1 / (1 + np.exp(-logit)) - y) / 4)
    for k in ("Uf", "Ub", "Wf", "Wb", "A", "a", "v", "o", "cf", "bias"):
        i = tuple(rng.integers(0, s) for s in net.p[k].shape)
        old, e = net.p[k][i], 1e-3
        net.p[k][i] = old + e
        up = loss()
        net.p[k][i] = old - e
        down = loss()
        net.p[k][i] = old
        assert (up - down) / (2 * e) == pytest.approx(g[k][i], rel=1e-2, abs=1e-6)


def test_windows_cover_every_word():
    first = np.cumsum([0, 0, 1, 24, 25, 500])
    doc, start, size = bigru.windows(first)
    for d in range(5):
        seen = {i for k in np.flatnonzero(doc == d) for i in range(start[k], start[k] + size[k])}
        assert seen == set(range(first[d], first[d + 1]))


def toxic_rows(n=240):
    rng = np.random.default_rng(2)
    calm = ["sun", "tree", "river", "walk", "house", "quiet", "green", "stone"]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(calm, rng.integers(5, 90)))
        if i % 4 == 0:
            w[rng.integers(len(w))] = str(rng.choice(["vilebad", "vileugly", "grubmean"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_toxicity_held_out(table):
    rows, labels = toxic_rows()
    labels += [labels[0], (5000, 1, 1), (None, 1, 1), (3, 1, None)]
    odd = [(600, None), (601, ""), (602, "  "), (None, "sun tree"), (603, "sun " * 20_000 + "vilebad " + "tree " * 20_000)]
    docs = table(rows + odd, "doc_id long, text string").selectExpr("*", "'x' AS toxic", "1.0 AS score")
    lab = table(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, lab).collect()}
    assert len(got) == len(rows) + len(odd)
    held = [i for i in range(240) if got[i]["held_out"]]
    assert {i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2} == set(held)
    assert np.mean([got[i]["predicted"] == (i % 4 == 0) for i in held]) > 0.95
    assert got[603]["predicted"] == 1 and all(got[i]["predicted"] == 0 for i in (600, 601, 602))
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_drop_toxic_and_constants(spark, table):
    rows, labels = toxic_rows(80)
    docs = table(rows, "doc_id long, text string")
    net, share = toxicity.fit(docs, table(labels, "doc_id long, quality int, toxic int"))
    left = toxicity.drop_toxic(docs, net)
    assert left.columns == docs.columns
    assert np.mean([r["doc_id"] % 4 == 0 for r in left.collect()]) < 0.05
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), none).count() == 0


def test_scores_do_not_depend_on_slices():
    rows, labels = toxic_rows(60)
    net = bigru.train([t for _, t in rows], np.array([x[2] for x in labels]), steps=20)
    texts = [t for _, t in rows]

    def scores(size):
        out = []
        for _, buf, offs in text_slices(pa.array(texts), size):
            w = bigru.Words(buf, offs)
            doc, start, n = bigru.windows(w.first)
            top = np.full(offs.size - 1, -np.inf)
            np.maximum.at(top, doc, bigru.score_windows(net, w, start, n))
            out += top.tolist()
        return out

    assert scores(100) == pytest.approx(scores(1 << 20), abs=1e-4)


def test_decision_point_against_all_cuts():
    r = np.random.default_rng(3)
    for _ in range(20):
        clean, toxic = np.round(r.normal(0, 1, 40), 1), np.round(r.normal(2, 1, 15), 1)
        cost = lambda t: bigru.CLEAN_COST * (clean > t).mean() + (toxic <= t).mean()  # noqa: E731,B023
        got = bigru.decision_point(clean, toxic)
        assert cost(got) <= min(cost(t) for t in np.arange(-5, 6, 0.05)) + 1e-9
    assert bigru.decision_point(np.zeros(0), np.ones(3)) == 0.0


def test_training_takes_long_texts_whole(table, monkeypatch):
    """Whole texts of any length are drawn, the rarer class loses none to its length, and the sample stays bounded."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, label: seen.append((texts, label)))
    rows = [(i, ("word " * (2000 if i % 3 == 0 else 5)).strip(), "en", "h", 0) for i in range(60)] + [(60, None, "en", "h", 0), (61, "", "en", "h", 0)]
    docs = table(rows, DOCS)
    labels = table([(i, 1, i % 2) for i in range(62)], "doc_id long, quality int, toxic int")
    toxicity.fit(docs, labels)
    texts, label = seen.pop()
    known = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(map(len, texts)) == sorted(len(rows[i][1]) for i in known) and label.sum() == sum(i % 2 for i in known)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 25_000)
    toxicity.fit(docs, labels)
    texts, label = seen.pop()
    for k in (0, 1):
        assert 0 < sum(len(t) for t, y in zip(texts, label, strict=True) if y == k) <= 25_000
