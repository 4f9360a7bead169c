"""Singular values and right singular vectors of a small triangular factor: Householder bidiagonal form, dqds,
twisted factorisations. Plain numpy on one d x d matrix; the rows never come here.

``B`` is upper bidiagonal with diagonal ``a`` and superdiagonal ``b``. The qd array ``q = a^2, e = b^2`` gives the
squares of its singular values; ``B'B = L D L'`` with ``D = a^2`` and ``l = b / a``.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(float).eps)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right factor ``W`` of ``r = U B W'`` by Householder reflections."""
    m = np.array(r, float)
    d = len(m)
    w = np.eye(d)
    for k in range(d):
        for rows in (True, False):
            x = m[k:, k] if rows else m[k, k + 1:]
            if len(x) < 2 or not x[1:].any():
                continue
            v = x.copy()
            v[0] += np.copysign(np.linalg.norm(x), x[0])
            v /= np.linalg.norm(v)
            if rows:
                m[k:, k:] -= 2 * np.outer(v, v @ m[k:, k:])
            else:
                m[k:, k + 1:] -= 2 * np.outer(m[k:, k + 1:] @ v, v)
                w[:, k + 1:] -= 2 * np.outer(w[:, k + 1:] @ v, v)
    return np.diagonal(m).copy(), np.diagonal(m, 1).copy(), w


def _dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential qd step with a shift, and its d values; None if the shift was above the smallest value."""
    d = q[0] - shift
    ds, new_q, new_e = [d], [], []
    for i in range(len(e)):
        if d < 0:
            return None
        x = d + e[i]
        t = q[i + 1] / x if x else 1.0
        new_q.append(x)
        new_e.append(e[i] * t)
        d = d * t - shift
        ds.append(d)
    if not d >= 0:
        return None
    new_q.append(d)
    return new_q, new_e, ds


def singular_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squares of the singular values, falling, by dqds with deflation from below.

    A step without a shift gives the diagonal ``1/d`` of the inverse; ``1 / sum(1/d)`` never exceeds the smallest
    value, so it is the safe shift behind the bolder one from the last 2 x 2 block.
    """
    todo = [([float(x) * float(x) for x in a], [float(x) * float(x) for x in b], 0.0)]
    found: list[float] = []
    small = (16 * EPS) ** 2
    while todo:
        q, e, sigma = todo.pop()
        for rounds in range(40 * len(q) + 100):
            while e and e[-1] <= small * (sigma + q[-1]):
                e.pop()
                found.append(sigma + q.pop())
            cut = next((i for i, x in enumerate(e) if x <= small * (sigma + min(q[i], q[i + 1]))), None)
            if cut is not None:
                todo.append((q[:cut + 1], e[:cut], sigma))
                q, e = q[cut + 1:], e[cut + 1:]
            if not e:
                break
            if rounds == 0 and q[0] < q[-1]:  # small values go to the end; B and its mirror image have the same
                q, e = q[::-1], e[::-1]
            q, e, d = _dqds(q, e, 0.0)
            if min(d) <= 0:
                continue
            safe = (1 - 4 * EPS * len(q)) / sum(1 / x for x in d)
            half = (q[-2] + e[-1] + q[-1]) / 2
            low = q[-2] * q[-1] / (half + np.sqrt(max(0.0, half * half - q[-2] * q[-1])))
            bold = low * (1 - 4 * EPS) - (e[-2] if len(e) > 1 else 0.0)
            step = None
            if bold > safe:
                step = _dqds(q, e, bold)
            if step is None:
                bold = max(0.0, safe)
                step = _dqds(q, e, bold)
            if step is not None:
                q, e, _ = step
                sigma += bold
        else:
            raise ArithmeticError("dqds did not converge")
        found += [sigma + x for x in q]
    return np.array(sorted(found, reverse=True))


def _twisted(dd: np.ndarray, ll: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stationary and progressive factors of ``L D L' - lam`` and the twist values."""
    n = len(dd)
    tiny = EPS * EPS * float(max(dd.max(), lam, 1e-300))
    up, down = np.zeros(max(0, n - 1)), np.zeros(max(0, n - 1))
    s, p = np.zeros(n), np.zeros(n)
    s[0] = -lam
    for i in range(n - 1):
        x = s[i] + dd[i]
        up[i] = ll[i] * dd[i] / (x if x else tiny)
        s[i + 1] = up[i] * ll[i] * s[i] - lam
    p[-1] = dd[-1] - lam
    for i in range(n - 2, -1, -1):
        x = dd[i] * ll[i] * ll[i] + p[i + 1]
        t = dd[i] / (x if x else tiny)
        down[i] = ll[i] * t
        p[i] = p[i + 1] * t - lam
    return up, down, s + p + lam


def _vector(up: np.ndarray, down: np.ndarray, r: int) -> np.ndarray:
    z = np.zeros(len(up) + 1)
    z[r] = 1
    for i in range(r - 1, -1, -1):
        z[i] = -up[i] * z[i + 1]
    for i in range(r, len(up)):
        z[i + 1] = -down[i] * z[i]
    big = np.abs(z).max()
    z = z / big
    return z / np.linalg.norm(z)


def directions(a: np.ndarray, b: np.ndarray, squares: np.ndarray, k: int) -> np.ndarray:
    """Right singular vectors of ``B`` for its ``k`` greatest values, as columns.

    Each comes from the twisted factorisation at its value; among values closer together than the rounding of a
    vector allows (relative gap 1e-7), each next vector takes another twist and is made orthogonal to the earlier
    ones, with steps of inverse iteration.
    """
    n = len(a)
    floor = EPS * EPS * max(1e-300, float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)))
    a = np.where(np.abs(a) < floor, floor, a)
    dd, ll = a * a, (b / a[:-1] if n > 1 else np.zeros(0))
    out = np.zeros((n, k))
    group = 0
    rng = np.random.default_rng(n)
    for j in range(k):
        if j and squares[j - 1] - squares[j] > 1e-7 * squares[j - 1]:
            group = j
        up, down, gamma = _twisted(dd, ll, float(squares[j]))
        near = out[:, group:j]
        z = _vector(up, down, int(np.argsort(np.abs(gamma), kind="stable")[min(n - 1, j - group)]))
        for _ in range(3 if j > group else 0):
            z = z - near @ (near.T @ z)
            size = np.linalg.norm(z)
            if size < 1e-3:
                z = rng.standard_normal(n)
                z -= near @ (near.T @ z)
                size = np.linalg.norm(z)
            z = _solve(dd, ll, float(squares[j]), z / size)
            z = z - near @ (near.T @ z)
            z /= np.linalg.norm(z)
        out[:, j] = z
    return out


def _solve(dd: np.ndarray, ll: np.ndarray, lam: float, z: np.ndarray) -> np.ndarray:
    """One step of inverse iteration with ``L D L' - lam = L+ D+ L+'``."""
    n = len(dd)
    tiny = EPS * float(max(dd.max(), lam, 1e-300))
    up, piv = np.zeros(max(0, n - 1)), np.zeros(n)
    s = -lam
    for i in range(n):
        x = s + dd[i]
        piv[i] = x if abs(x) > tiny * 1e-3 else tiny * 1e-3
        if i < n - 1:
            up[i] = ll[i] * dd[i] / piv[i]
            s = up[i] * ll[i] * s - lam
    y = z.copy()
    for i in range(n - 1):
        y[i + 1] -= up[i] * y[i]
    y /= piv
    for i in range(n - 2, -1, -1):
        y[i] -= up[i] * y[i + 1]
    size = np.abs(y).max()
    return y / size / np.linalg.norm(y / size) if np.isfinite(size) and size else z


def principal(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares of all singular values of ``r`` (falling) and the right singular vectors of the first ``k``."""
    scale = float(np.abs(r).max(initial=0))
    if not scale:
        return np.zeros(len(r)), np.eye(len(r))[:, :k]
    a, b, w = bidiagonalise(r / scale)
    squares = singular_squares(a, b)
    return squares * scale * scale, w @ directions(a, b, squares, min(k, len(r)))
