"""Near-duplicates against all pairs, on full sets."""

import random
import re

import numpy as np

from pageloom.llm import near, superminhash
from pageloom.llm.components import components

from .conftest import DOCS, LOWER, odd_documents


def shingles(t):
    w = re.findall("[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc_id -> (set size, component, kept) by comparing all pairs."""
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k), find(k) == k) for k in ids}


def chain(n=120, seed=1):
    """Near copies that drift apart, strangers that share a template, exact copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(n):
        base = list(base)
        base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, " ".join(base)))
    template = rng.choices(words, k=90)
    for i in range(80):
        rows.append((1000 + i, " ".join(template + rng.choices(words, k=22))))
    for i in range(20):  # pairs hidden among the template's strangers
        text = template + rng.choices(words, k=22)
        rows += [(2000 + 2 * i, " ".join(text)), (2001 + 2 * i, " ".join(text[:-1] + ["changed"]))]
    return rows + [(3000 + i, rows[0][1].upper()) for i in range(50)]


def test_near_duplicates(spark, table, documents):
    odd = [(r[0], r[1]) for r in odd_documents()[:12]]
    for rows in (chain(), odd, [(r["doc_id"], r["text"]) for r in documents.collect()]):
        got = near.near_duplicates(table(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS bands"))
        assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute(rows)


def test_near_duplicates_odd_rows(spark, table):
    got = near.near_duplicates(table(odd_documents(), DOCS)).collect()
    assert len(got) == len(odd_documents())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert {(r["component_id"], r["kept"]) for r in by[5]} == {(5, True)} and len(by[5]) == 3
    assert by[6][0]["component_id"] == 5 and not by[6][0]["kept"]
    assert sorted(r["n_shingles"] for r in by[None]) == [0, 1] and all(r["kept"] for r in by[None])
    assert near.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_blocks_meet_exhaustively(spark, table, monkeypatch):
    monkeypatch.setattr(near, "TRIES", 1)
    monkeypatch.setattr(near, "BLOCK", 8)
    rows = chain(60, 2)
    got = near.near_duplicates(table(rows, "doc_id long, text string"))
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == brute(rows)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(1, 2**62, 400, dtype=np.uint64)
    a, b = np.sort(pool[:300]), np.sort(pool[100:])
    sig = superminhash.signatures(np.concatenate((a, b)), np.array([0, 300, 600]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.08
    one = superminhash.signatures(a[:1], np.array([0, 1]))
    ranks = one[0] >> np.uint64(32)
    assert sorted(ranks.tolist()) == list(range(superminhash.SLOTS))  # one element offers each rank once


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, x) for x in range(1001, 1400)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    assert got == {x: find(x) for x in list(parent)}
