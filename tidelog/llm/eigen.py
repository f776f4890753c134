"""Leading eigenpairs of a symmetric matrix: Householder tridiagonalisation, bisection on
Sturm counts, inverse iteration with reorthogonalisation inside clusters. The matrix is that of
a covariance, whose size is the length of a vector, never the number of rows."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues nearer than this share of the norm are one cluster.
CLUSTER = 1e-3


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The diagonal and off-diagonal of Q' A Q, and the unit vectors whose reflections, in
    order, make Q."""
    a = np.array(matrix, float)
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        x = a[k + 1 :, k]
        v = x.copy()
        v[0] += np.copysign(np.linalg.norm(x), x[0])
        length = np.linalg.norm(v)
        v = v / length if length > 0 else v
        mirrors.append(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = 2 * (p - (v @ p) * v)
        block -= np.outer(v, w) + np.outer(w, v)
        x -= 2 * v * (v @ x)
        a[k, k + 1 :] = x
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def reflected(mirrors: list[np.ndarray], vectors: np.ndarray) -> np.ndarray:
    """Q times the columns of ``vectors``."""
    out = vectors.copy()
    for k in range(len(mirrors) - 1, -1, -1):
        v = mirrors[k]
        out[k + 1 :] -= 2 * np.outer(v, v @ out[k + 1 :])
    return out


def counts_above(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues exceed each of ``at``: the signs of the Sturm sequence."""
    square = np.concatenate([[0.0], off**2])
    least = max(np.max(square), 1.0) * np.finfo(float).tiny
    count = np.zeros(len(at), int)
    q = np.ones(len(at))
    for d, s in zip(diagonal, square, strict=True):
        q = d - at - s / q
        q = np.where(np.abs(q) <= least, -least, q)
        count += q > 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling: each bisected until its bounds are neighbours
    at the precision of the norm."""
    wide = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    norm = max(np.max(np.abs(diagonal) + wide), np.finfo(float).tiny)
    low = np.full(k, np.min(diagonal - wide) - 4 * EPS * norm)
    high = np.full(k, np.max(diagonal + wide) + 4 * EPS * norm)
    rank = np.arange(1, k + 1)
    while np.max(high - low) > EPS * norm / 4:
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        above = counts_above(diagonal, off, middle) >= rank
        low, high = np.where(above, middle, low), np.where(above, high, middle)
    return (low + high) / 2


def solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float):
    """A function that solves (T - shift) y = b, by elimination with row exchanges; pivots
    smaller than ``least`` become that."""
    n = len(diagonal)
    d, u, w = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    factor, swapped = [0.0] * n, [False] * n
    for i in range(n - 1):
        below, next_d, next_u = float(off[i]), d[i + 1], u[i + 1]
        if abs(d[i]) >= abs(below):
            if abs(d[i]) < least:
                d[i] = least
            factor[i] = below / d[i]
            d[i + 1] = next_d - factor[i] * u[i]
        else:
            factor[i] = d[i] / below
            swapped[i] = True
            d[i + 1] = u[i] - factor[i] * next_d
            w[i], u[i + 1] = next_u, -factor[i] * next_u
            d[i], u[i] = below, next_d
    if abs(d[n - 1]) < least:
        d[n - 1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.tolist()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i] - factor[i] * y[i + 1]
            else:
                y[i + 1] -= factor[i] * y[i]
        for i in range(n - 1, -1, -1):
            later = (u[i] * y[i + 1] if i + 1 < n else 0.0) + (w[i] * y[i + 2] if i + 2 < n else 0.0)
            y[i] = (y[i] - later) / d[i]
        return np.array(y)

    return solve


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns. A vector is made orthogonal to
    the earlier ones of its cluster before each solution and after it."""
    n = len(diagonal)
    norm = max(np.max(np.abs(diagonal)) + (2 * np.max(np.abs(off)) if n > 1 else 0.0), np.finfo(float).tiny)
    random = np.random.default_rng(1)
    vectors = np.zeros((n, len(values)))
    first = 0
    shift = np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        # Equal eigenvalues get shifts a little apart.
        shift = min(value, shift - 4 * EPS * norm) if k > first else value
        solve = solver(diagonal, off, shift, EPS * norm)
        earlier = vectors[:, first:k]
        y = random.standard_normal(n)
        for _ in range(rounds):
            for _ in range(2):
                y -= earlier @ (earlier.T @ y)
            y = solve(y / np.linalg.norm(y))
            y /= np.max(np.abs(y))
        for _ in range(2):
            y -= earlier @ (earlier.T @ y)
            y /= np.linalg.norm(y)
        vectors[:, k] = y
    return vectors


def leading_eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    k = min(k, len(matrix))
    scale = np.max(np.abs(matrix)) if len(matrix) else 0.0
    if not k or scale == 0:
        return np.zeros(k), np.eye(len(matrix))[:, :k]
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    return values * scale, reflected(mirrors, inverse_iteration(diagonal, off, values))
