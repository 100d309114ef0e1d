"""Leading eigenpairs of a symmetric matrix by contour integration (FEAST).

The eigenvalues wanted are first fenced in: the inertia of V - s I (the number
of its positive pivots, taken on a tridiagonal form) counts the eigenvalues
above s, and bisection on it finds intervals that end in the gaps between eigenvalues. For every interval a block of
vectors is projected onto its eigenspace by quadrature over a circle around the
interval: each node of the quadrature is a solve with the complex shifted
matrix. Rayleigh-Ritz on the projected block extracts the pairs, and the
projection is repeated until their residuals vanish. At the end the pairs
found in every interval are counted against its inertia.

Everything here works on one matrix whose side is the dimension of the vectors,
however many vectors there are.
"""

from __future__ import annotations

import numpy as np

NODES = 8                 # quadrature nodes on the upper half of a circle
CLOSE = 1e-8              # of the matrix's norm: eigenvalues this close share an interval
ROUNDS = 40
_EPS, _TINY = np.finfo(float).eps, 1e-290


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, squared off-diagonal) of a tridiagonal matrix congruent to
    every shift of ``a`` alike (Householder reflections)."""
    m = a.astype(float).copy()
    for k in range(m.shape[0] - 2):
        x = m[k + 1:, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = x @ x
        if size > 0:
            y = m[k + 1:, k + 1:] @ x * (2 / size)
            y -= x * (x @ y / size)
            m[k + 1:, k + 1:] -= np.outer(x, y) + np.outer(y, x)
            m[k + 1, k] -= x[0] * (2 * (x @ m[k + 1:, k]) / size)
    return np.diag(m).copy(), np.diag(m, -1) ** 2


def inertia(form: tuple[np.ndarray, np.ndarray], shift: float) -> int:
    """Eigenvalues above ``shift``: positive pivots of the shifted matrix."""
    count, pivot = 0, 1.0
    for d, e in zip(form[0].tolist(), [0.0, *form[1].tolist()], strict=True):
        pivot = d - shift - e / pivot
        count += pivot > 0
        if abs(pivot) < _TINY:
            pivot = -_TINY
    return count


def intervals(form: tuple[np.ndarray, np.ndarray], k: int, low: float, high: float) -> list[tuple[float, float, int]]:
    """(low, high, number of eigenvalues) of intervals, from the top, that hold
    at least the ``k`` largest eigenvalues above ``low``, each in the middle of a gap on both sides.
    Eigenvalues closer than CLOSE share an interval."""
    values: list[float] = []                       # from the top, to about CLOSE / 8, or the gap around them
    total = inertia(form, low)
    while len(values) < min(total, k + 1) or (len(values) < total and values[-2] - values[-1] < CLOSE):
        lo, hi, want = low, values[-1] if values else high, len(values)
        while hi - lo > max(min(CLOSE, lo) / 8, 4 * _EPS * hi):
            middle = (lo + hi) / 2
            lo, hi = (middle, hi) if inertia(form, middle) > want else (lo, middle)
        values.append(lo)
    out, i = [], 0
    while i < len(values) and i < k:
        j = i + 1
        while j < len(values) and values[j - 1] - values[j] < CLOSE:
            j += 1
        below = values[i:j][-1] - (values[j] if j < len(values) else 0.0)
        gap = min(below, (values[i - 1] if i else high) - values[i])
        gap = max(gap, 64 * _EPS)
        lo, hi = values[j - 1] - gap / 2, values[i] + gap / 2
        out.append((lo, hi, inertia(form, lo) - inertia(form, hi)))
        i = j
    return out


def project(a: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """The block's part in the eigenspace of the interval, by Gauss-Legendre
    quadrature of the resolvent over the upper half circle; the lower half is its conjugate."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    centre, radius = (low + high) / 2, (high - low) / 2
    out, eye = np.zeros_like(block), np.eye(a.shape[0])
    for t, weight in zip(np.pi * (x + 1) / 2, w, strict=True):
        turn = np.exp(1j * t)
        solved = np.linalg.solve((centre + radius * turn) * eye - a, block.astype(complex))
        out += (weight / 2) * (radius * turn * solved).real
    return out


def solve_interval(a: np.ndarray, low: float, high: float, count: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs in the interval, values falling."""
    n = a.shape[0]
    norm = max(np.abs(a).sum(axis=1).max(), np.finfo(float).tiny)
    centre, half = (low + high) / 2, max((high - low) / 2, 64 * _EPS * norm)
    block = np.random.default_rng(seed).standard_normal((n, min(n, count + max(4, count // 2))))
    for _ in range(ROUNDS):
        q, _ = np.linalg.qr(project(a, block, centre - half, centre + half))
        values, turn = np.linalg.eigh(q.T @ a @ q)         # Rayleigh-Ritz in the projected block
        block = q @ turn
        inside = np.argsort(np.abs(values - centre))[:count]
        residual = np.linalg.norm(a @ block[:, inside] - block[:, inside] * values[inside], axis=0)
        if (residual <= 16 * n ** 0.5 * _EPS * norm).all():
            break
    else:
        raise ArithmeticError("contour integration did not converge")
    if (np.abs(values[inside] - centre) > half * (1 + 1e-6) + 64 * _EPS * norm).any():
        raise ArithmeticError("fewer eigenvalues found in an interval than its inertia counts")
    inside = inside[np.argsort(-values[inside], kind="stable")]
    return values[inside], block[:, inside]


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues that are positive beyond rounding, falling,
    and their unit eigenvectors as columns; fewer if the rank is less."""
    n = a.shape[0]
    bound = float(np.abs(a).sum(axis=1).max()) if n else 0.0
    if not bound > 0:
        return np.zeros(0), np.zeros((n, 0))
    a = a / bound                                          # all eigenvalues within [-1, 1]
    a = (a + a.T) / 2
    form = tridiagonal(a)
    fences = intervals(form, k, n * 8 * _EPS, 1.0 + 1e-9)
    parts = [solve_interval(a, lo, hi, c) for lo, hi, c in fences if c]
    if not parts:
        return np.zeros(0), np.zeros((n, 0))
    values, vectors = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts], axis=1)
    if inertia(form, min(lo for lo, _, _ in fences)) != values.size:
        raise ArithmeticError("the inertia count and the eigenvalues found differ")
    order = np.argsort(-values, kind="stable")
    # vectors of different intervals are orthogonal up to their residuals; this makes them so to rounding
    vectors, upper = np.linalg.qr(vectors[:, order])
    return values[order][:k] * bound, (vectors * np.sign(np.diag(upper)))[:, :k]
