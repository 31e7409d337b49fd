"""Singular values and right singular vectors of a small triangular matrix.

Householder reflections bring the matrix to upper bidiagonal form B, the
shifted quotient-difference transform (dqds) finds the eigenvalues of B'B to
high relative accuracy, and twisted factorisations of B'B - value give the
vectors. The matrix is as wide as a vector is long; it does not grow with rows.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(np.float64).eps
CLUSTER = 1e-3  # relative gap below which vectors are made orthogonal to each other


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, P) with r = Q B P'."""
    a = np.array(r, dtype=np.float64)
    d = a.shape[0]
    p = np.eye(d)

    def reflector(x):
        v = x.copy()
        norm = np.linalg.norm(x)
        if norm == 0:
            return None
        v[0] += math.copysign(norm, x[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2:
            v = reflector(a[k, k + 1:])
            if v is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ v, v)
                p[:, k + 1:] -= 2 * np.outer(p[:, k + 1:] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _dqds_step(q: list[float], e: list[float], shift: float):
    """One transform; None if the shift is above the least eigenvalue."""
    n = len(q)
    new_q, new_e = [0.0] * n, [0.0] * (n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        if new_q[i] == 0:
            return None
        t = q[i + 1] / new_q[i]
        new_e[i] = e[i] * t
        d = d * t - shift
        least = min(least, d)
    if d < 0 or not math.isfinite(d):
        return None
    new_q[n - 1] = d
    return new_q, new_e, least


def qd_values(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Eigenvalues of L D L' with the given quotients and differences (the
    squares of B's diagonals), falling."""
    top = float(max(q.max(initial=0), e.max(initial=0)))
    if top == 0:
        return np.zeros(len(q))
    tiny = top * EPS ** 3
    work = [([max(float(x), tiny) for x in q], [float(x) for x in e], 0.0)]
    found, left = [], 1000 * (len(q) + 1)
    while work:
        q, e, moved = work.pop()
        least = 0.0
        while q:
            n, left = len(q), left - 1
            if not left:
                raise ArithmeticError("the quotient-difference transforms do not converge")
            if n == 1:
                found.append(q[0] + moved)
                break
            cut = [i for i in range(n - 1) if e[i] <= EPS * EPS * (moved + min(q[i], q[i + 1]))]
            if cut:
                i = cut[-1]  # the part below goes its own way
                work.append((q[i + 1:], e[i + 1:], moved))
                q, e = q[:i + 1], e[:i]
                continue
            if q[0] * 2 < q[-1]:  # the transform finds small values at the end
                q, e = _flip(q, e)
            # Lower bound of the last row's circle, and the last transform's least pivot.
            guess = max(0.0, q[-1] - math.sqrt(q[-1] * e[-1]))
            if least:
                guess = min(guess, least) if guess else least / 4
            step = None
            for shift in (guess, guess * 0.5, guess * 0.0625, 0.0):
                step = _dqds_step(q, e, shift)
                if step is not None:
                    break
            if step is None:  # a zero pivot: nudge it
                q = [max(x, tiny) for x in q]
                step = _dqds_step(q, e, 0.0)
            q, e, least = step
            moved += shift
    return np.sort(np.array(found))[::-1]


def _flip(q: list[float], e: list[float]) -> tuple[list[float], list[float]]:
    """The same eigenvalues with the rows in reverse order: B'B of the
    reversed transpose, which is again bidiagonal."""
    return q[::-1], e[::-1]


def _safe(x: float, floor: float) -> float:
    return x if abs(x) > floor else math.copysign(floor, x)


def _factors(a2: np.ndarray, b: np.ndarray, a: np.ndarray, value: float):
    """Stationary (from the top) and progressive (from the bottom) transforms
    of B'B - value, and the twist elements."""
    n = len(a2)
    ell = b / a[:-1] if n > 1 else b
    floor = EPS * EPS * max(float(a2.max()), float((b * b).max(initial=0)))
    s, plus = np.zeros(n), np.zeros(max(0, n - 1))
    s[0] = -value
    for i in range(n - 1):
        plus[i] = a2[i] * ell[i] / _safe(s[i] + a2[i], floor)
        s[i + 1] = plus[i] * ell[i] * s[i] - value
    minus, gamma = np.zeros(max(0, n - 1)), np.zeros(n)
    p = a2[n - 1] - value
    gamma[n - 1] = s[n - 1] + p + value
    for i in range(n - 2, -1, -1):
        below = _safe(a2[i] * ell[i] ** 2 + p, floor)
        t = a2[i] / below
        minus[i] = ell[i] * t
        gamma[i] = s[i] + t * p
        p = t * p - value
    return plus, minus, gamma


def _twisted(plus: np.ndarray, minus: np.ndarray, gamma: np.ndarray) -> np.ndarray:
    n, r = len(gamma), int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -minus[i] * z[i]
    return z / np.linalg.norm(z)


def qd_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of B'B for its ``values`` (falling, from the first on),
    as columns. Vectors of values that nearly agree are made orthogonal, by
    inverse iteration where the twisted vector lies among those found."""
    top = float(max((a * a).max(), (b * b).max(initial=0)))
    a = np.where(np.abs(a) > EPS * math.sqrt(top), a, EPS * math.sqrt(top))
    a2, out = a * a, np.zeros((len(a), len(values)))
    upper = np.diag(a) + np.diag(b, 1)
    square = upper.T @ upper
    rng = np.random.default_rng(11)
    first = 0  # of the cluster
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * values[k - 1]:
            first = k
        plus, minus, gamma = _factors(a2, b, a, float(value))
        z, near = _twisted(plus, minus, gamma), out[:, first:k]
        for _ in range(2):
            z = z - near @ (near.T @ z)
        size = np.linalg.norm(z)
        if size < 0.5:
            off = np.eye(len(a)) * (value * (1 + 8 * EPS * (k - first)) + top * EPS)
            z = rng.standard_normal(len(a))
            for _ in range(3):
                for _ in range(2):
                    z = z - near @ (near.T @ z)
                z = np.linalg.solve(square - off, z / np.linalg.norm(z))
            for _ in range(2):
                z = z - near @ (near.T @ z)
            size = np.linalg.norm(z)
        out[:, k] = z / size
    return out


def right_singular(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(squares of all singular values, falling; right singular vectors as
    columns). Vectors are given for the first ``count`` values, less those that
    rounding of ``r`` does not tell from zero."""
    a, b, p = bidiagonalise(r)
    values = qd_values(a * a, b * b)
    zero = (8 * len(values) * EPS) ** 2 * values[0] if len(values) else 0.0
    count = int(np.sum(values[:count] > zero))
    if not count:
        return values, np.zeros((len(values), 0))
    return values, p @ qd_vectors(a, b, values[:count])
