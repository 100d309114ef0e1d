"""Contour integration against a dense solver, and whitening against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import feast, whitening

SCHEMA = "vec_id long, embedding array<float>"


def expected(vectors, k=8):
    x = [[int(np.floor(1024.0 * float(c))) + 100000 for c in v] for v in vectors]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, total, strict=True)) for v in x]
    c = np.array(x, dtype=float) - np.array(total) / n
    values, basis = np.linalg.eigh(c.T @ c / n)
    values, basis = values[::-1], basis[:, ::-1]
    return n, deviation, np.abs(c @ basis[:, :k] / np.sqrt(values[:k])), values[:k] / values.sum()


@pytest.mark.parametrize("spectrum", ["spread", "cluster", "rank", "powers", "equal", "pairs"])
@pytest.mark.parametrize("n", [3, 40])
def test_leading(n, spectrum):
    r = np.random.default_rng(7)
    q, _ = np.linalg.qr(r.standard_normal((n, n)))
    e = {"spread": r.random(n) * 1000, "cluster": np.append(500 + 1e-10 * r.random(n - 1), 700), "rank": np.arange(n) % n * (np.arange(n) < 3),
         "powers": 10.0 ** r.uniform(-10, 6, n), "equal": np.full(n, 3.0), "pairs": np.repeat(np.arange(1, n), 2)[:n]}[spectrum]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, basis = feast.leading(a, 8)
    want = np.sort(np.linalg.eigvalsh(a))[::-1]
    want = want[want > 1e-9 * want[0]][:8]
    assert values.size >= want.size and np.allclose(values[:want.size], want, atol=1e-13 * want[0], rtol=0)
    assert np.abs(a @ basis - basis * values).max() <= 1e-12 * want[0]
    assert np.abs(basis.T @ basis - np.eye(values.size)).max() < 1e-13


def test_inertia_counts():
    r = np.random.default_rng(2)
    a = r.standard_normal((30, 30))
    a = a + a.T
    form, values = feast.tridiagonal(a), np.linalg.eigvalsh(a)
    for s in [-100.0, 100.0, *((values[1:] + values[:-1]) / 2)]:
        assert feast.inertia(form, s) == int((values > s).sum())


def test_lost_eigenvalue_is_an_error():
    with pytest.raises(ArithmeticError):
        feast.solve_interval(np.diag([1.0, 0.5, 0.25, 0.1]), 0.9, 1.1, 2)      # the interval holds one, not two


def test_whitening(spark, table):
    r = np.random.default_rng(4)
    good = (r.standard_normal((500, 12)) @ r.standard_normal((12, 12))).astype(np.float32)
    good[100:250] = good[0]                                               # a third of all rows is one vector
    rows = [(i % 400, v.tolist()) for i, v in enumerate(good)] + [(None, good[3].tolist())]
    odd = [(900, None), (901, []), (902, [1.0] * 11), (903, [float("nan")] + [0.0] * 11),
           (904, [float("inf")] + [0.0] * 11), (905, [None] + [0.0] * 11), (906, [1.0] * 13)]
    df = table(rows + odd, SCHEMA).withColumn("n", F.lit("clash")).withColumn("v", F.lit(1))
    n, deviation, white, explained = expected([v for _, v in rows])
    got = whitening.whitening(df).collect()
    assert len(got) == 8 * n == 8 * 501 and {g["n"] for g in got} == {n}
    mine = sorted((str(g["vec_id"]), g["component"], g["deviation"], round(abs(g["whitened"]), 6)) for g in got)
    want = sorted((str(i), k + 1, deviation[j], round(float(white[j, k]), 6)) for j, (i, _) in enumerate(rows) for k in range(8))
    assert [m[:3] for m in mine] == [w[:3] for w in want]
    assert np.allclose([m[3] for m in mine], [w[3] for w in want], atol=3e-6)
    assert max(g["identity_error"] for g in got) < 1e-9
    assert np.allclose([next(g["explained"] for g in got if g["component"] == k + 1) for k in range(8)], explained, rtol=1e-9)


def test_few_components(spark, table):
    assert whitening.whitening(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitening(table([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).count() == 0     # nothing varies
    got = whitening.whitening(table([(i, [float(i % 3), 5.0, 2.0 * (i % 3)]) for i in range(9)], SCHEMA)).collect()
    assert len(got) == 9 and {g["component"] for g in got} == {1} and got[0]["explained"] == pytest.approx(1.0)


def test_deviation_beyond_a_long():
    x = np.array([[2 ** 61, 0], [0, 0], [5, 7]])
    total = [int(c) for c in x.astype(object).sum(axis=0)]
    assert whitening.deviation(x, 3, total).to_pylist() == [None, None, None]
    near = np.array([[10 ** 9 + 1, 4], [10 ** 9, 2]])
    assert whitening.deviation(near, 2, [int(c) for c in near.sum(axis=0)]).to_pylist() == [1 + 4, 1 + 4]


def test_large_components(table):
    got = whitening.whitening(table([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 0.5])], SCHEMA)).collect()
    assert len(got) >= 3 and all(np.isfinite(g["whitened"]) for g in got)
