"""Near-duplicates at scale: what meets, what is fetched, and the arrays behind it."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pageloom.functions import text as X
from pageloom.operators import neardup as ND, shingles as S

from test_mends import plain_groups


def sets_of(*texts):
    return [x for _, data, offs in S.text_slices(pa.array([t.encode() for t in texts])) for x in S.shingle_sets(data, offs)]


@pytest.fixture
def rows_of(monkeypatch):
    """Rows of the tables that the operator stores, by name."""
    counts, stored = {}, ND.stored

    def spy(df, name):
        out = stored(df, name)
        counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ND, "stored", spy)
    return counts


def test_pairs_without_a_chance_fetch_no_sets(spark, rows_of):
    """Half of each text is one template: all share buckets, none are linked."""
    r = random.Random(3)
    template = " ".join(f"t{i}" for i in range(60))
    rows = [(i, template + " " + " ".join(f"w{r.randrange(10**6)}" for _ in range(60))) for i in range(200)]
    got = ND.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    assert got.where("doc_id <> rep").count() == 0
    assert rows_of["mixed"][0] > 200                     # they do meet
    assert rows_of["pairs"] == [0] and rows_of["hopeful"] == [0]


@pytest.mark.parametrize("tries", [0, 4])
def test_small_blocks_lose_no_link(spark, monkeypatch, tries):
    """Families of texts with a few words changed, met by blocks alone, or after a try of the ends."""
    r = random.Random(9)
    texts = []
    for _ in range(6):
        base = [f"w{r.randrange(500)}" for _ in range(r.randint(30, 90))]
        for _ in range(25):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    monkeypatch.setattr(ND, "TRIES", tries)
    monkeypatch.setattr(ND, "BLOCK", 4)
    monkeypatch.setattr(ND, "ELEMENTS", 200)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["rep"] for x in ND.near_duplicates(df, "doc_id", "text").collect()}
    assert got == plain_groups(rows, ND.THRESHOLD)


def test_repeated_and_null_keys(spark):
    """A key that repeats is one place in the graph; rows without a key are named by others' sets only."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [("k1", one), ("k1", two), ("k3", two), ("k2", one + " more"), ("k2", one + " more"), (None, one), (None, three), ("k4", None)]
    got = ND.near_duplicates(spark.createDataFrame(rows, "name string, body string"), "name", "body")
    assert got.columns == ["name", "rep"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [("k1", "k1"), ("k1", "k1"), ("k3", "k1"), ("k2", "k1"), ("k2", "k1"), (None, "k1"), (None, None), ("k4", "k4")], key=str)
    assert ND.near_duplicates(spark.createDataFrame([], "name string, body string"), "name", "body").count() == 0


def test_words_are_parted_as_in_spark(spark):
    texts = ["", " ", "a", "one　two\x85three four five\tsix", "\x1cno​break   x", "é  ü\r\n ß ", "日本 語", "の　は"]
    n = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.size(X.words("t"))).collect()]
    got = []
    for _, data, offs in S.text_slices(pa.array([t.encode() for t in texts])):
        got += np.diff(S._words(data, offs)[1]).tolist()
    assert got == n


def test_shingles_of_a_text_do_not_hang_on_its_neighbours(monkeypatch):
    texts = ["a b c d e f", "", "a b  c d e f a b c d e f", "x", "x y z w", "x y z w v", "  x y z\nw", "f g"]
    alone = [sets_of(t)[0] for t in texts]
    assert [x.size for x in alone] == [2, 0, 6, 1, 1, 1, 1, 1]
    assert (alone[4] == alone[6]).all() and alone[4] != alone[5] and set(alone[0]) < set(alone[2])
    for size in (4, 16, 1 << 20):
        monkeypatch.setattr(S, "SLICE", size)
        assert all(np.array_equal(a, b) for a, b in zip(sets_of(*texts), alone, strict=True))


@pytest.mark.parametrize("n", [5, 50, 2000])
def test_slots_estimate_the_similarity(n):
    r = np.random.default_rng(n)
    found = []
    for _ in range(200):
        x = r.integers(0, 2**63, n).astype(np.uint64)
        a, b = np.sort(x[: n * 4 // 5]), np.sort(x)
        sig = S.signatures([a, b])
        found.append((S.sketches(sig)[0] == S.sketches(sig)[1]).sum())
        assert (S.band_keys(sig)[0] == S.band_keys(sig)[1]).any()
        assert S.common(a, b) == S.common(b, a) == a.size
    assert abs(np.mean(found) - 0.8 * S.SLOTS) < 2 and np.std(found) < 6 and min(found) >= ND._least(0.8)
