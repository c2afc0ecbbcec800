"""Singular values and right singular vectors of a small square matrix by a bidiagonal qd solver.

Householder reflections make the matrix bidiagonal. dqds (differential qd steps with shifts) gives the squares
of its singular values, small ones as accurately as large ones. Each vector then comes from a twisted factorisation of
B'B - lambda: the factorisations from the top and from the bottom meet where they leave the least residue.
Vectors of values that are equal to three digits are made orthogonal within their group.
"""

from __future__ import annotations

import math

import numpy as np

EPS = float(np.finfo(float).eps)
#: Relative gap below which values form a group.
GAP = 1e-3


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta with (I - beta v v') x along the first axis."""
    norm = np.linalg.norm(x)
    if norm == 0 or not np.any(x[1:]):
        return np.zeros_like(x), 0.0
    v = x / norm
    v[0] += math.copysign(1.0, v[0])
    return v, 2.0 / float(v @ v)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, float]]]:
    """Diagonal, superdiagonal and the reflections that acted from the right."""
    a, n, rights = np.array(r, float), len(r), []
    for k in range(n):
        v, beta = _reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v, beta = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ v, v)
            rights.append((k + 1, v, beta))
    return np.diag(a).copy(), np.diag(a, 1).copy(), rights


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One differential qd step; also the d that show whether the shift was too large."""
    n, d = len(q), q[0] - shift
    nq, ne, ds = [0.0] * n, [0.0] * (n - 1), [d]
    for i in range(n - 1):
        nq[i] = d + e[i]
        if nq[i] == 0.0:
            nq[i] = 1e-300
        t = q[i + 1] / nq[i]
        ne[i] = e[i] * t
        d = d * t - shift
        ds.append(d)
    nq[-1] = d
    return nq, ne, ds


def _shift(q: list[float], e: list[float]) -> float:
    """Less than the least eigenvalue if the trailing two rows tell enough; the caller checks."""
    above = e[-2] if len(q) > 2 else 0.0
    a, b = q[-2] + above, q[-1] + e[-1]
    root = math.hypot((a - b) / 2, math.sqrt(q[-2] * e[-1]))
    least = (q[-2] * q[-1] + above * b) / ((a + b) / 2 + root) if a + b > 0 else 0.0
    return max(0.0, least * (1 - 4 * EPS))


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Eigenvalues of B'B from q, the squares of the diagonal, and e, those of the superdiagonal; greatest first."""
    found, tol = [], (4 * EPS) ** 2
    work = [(list(q), list(e), 0.0, 0.0)]
    budget = 200 * len(q) + 200
    while work:
        q, e, total, lost = work.pop()  # the sum of shifts is kept with its rounding error
        while q:
            if len(q) == 1:
                found.append(total + (lost + q[0]))
                break
            if e[-1] <= tol * (total + q[-1]):
                found.append(total + (lost + q[-1]))
                q, e = q[:-1], e[:-1]
                continue
            cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= tol * (total + min(q[i], q[i + 1]))), None)
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], total, lost))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            shift = _shift(q, e)
            for attempt in range(8):
                budget -= 1
                if budget < 0:
                    raise ArithmeticError("qd steps do not converge")
                nq, ne, ds = _sweep(q, e, shift)
                if min(ds) >= 0 and all(x >= 0 for x in ne):
                    break
                late = min(ds[:-1]) >= 0
                shift = max(0.0, (shift + ds[-1]) * (1 - 4 * EPS)) if late and attempt == 0 else (shift / 4 if attempt < 4 else 0.0)
            q, e = nq, ne
            new = total + shift
            lost += (total - new) + shift if abs(total) >= abs(shift) else (shift - new) + total
            total = new
    return sorted(found, reverse=True)


def _twisted(low: np.ndarray, diag: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    """A unit vector near the eigenvector of L D L' for lam, and the correction of lam it suggests."""
    n, tiny = len(diag), max(1e-290, EPS * EPS * abs(lam))
    down, up = np.empty(max(0, n - 1)), np.empty(max(0, n - 1))
    s, p = np.empty(n), np.empty(n)
    s[0] = -lam
    for i in range(n - 1):
        plus = diag[i] + s[i]
        plus = plus if plus else -tiny
        down[i] = diag[i] * low[i] / plus
        s[i + 1] = down[i] * low[i] * s[i] - lam
    p[-1] = diag[-1] - lam
    for i in range(n - 2, -1, -1):
        minus = diag[i] * low[i] * low[i] + p[i + 1]
        minus = minus if minus else tiny
        t = diag[i] / minus
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - lam
    gamma = s + p + lam
    gamma[~np.isfinite(gamma)] = math.inf
    r = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    norm = np.linalg.norm(z)
    return z / norm, float(gamma[r]) / float(norm * norm)


def _vector(low: np.ndarray, diag: np.ndarray, lam: float) -> tuple[np.ndarray, float]:
    for _ in range(4):
        z, more = _twisted(low, diag, lam)
        if not math.isfinite(more) or abs(more) <= 2 * EPS * abs(lam):
            break
        if abs(more) > 1e-6 * abs(lam):  # no root nearby: the value is better than the correction
            break
        lam += more
    return z, lam


def _jacobi(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a small symmetric matrix by plane rotations."""
    a, v, n = m.copy(), np.eye(len(m)), len(m)
    for _ in range(40):
        if np.abs(a - np.diag(np.diag(a))).max(initial=0) <= EPS * np.abs(a).max(initial=0):
            break
        for i in range(n - 1):
            for j in range(i + 1, n):
                if a[i, j]:
                    t = 0.5 * math.atan2(2 * a[i, j], a[j, j] - a[i, i])
                    g = np.eye(n)
                    g[i, i] = g[j, j] = math.cos(t)
                    g[i, j], g[j, i] = math.sin(t), -math.sin(t)
                    a, v = g.T @ a @ g, v @ g
    return np.diag(a).copy(), v


def _group(tri: np.ndarray, lams: list[float], z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal vectors for values that lie close together."""
    if np.abs(z.T @ z - np.eye(len(lams))).max() <= 8 * EPS:
        return np.array(lams), z
    sizes = np.abs(np.diag(np.linalg.qr(z, mode="r")))
    if sizes.min() > 0.05:
        basis = np.linalg.qr(z)[0]
    else:  # the same vector came twice: inverse steps on a whole subspace
        basis = np.linalg.qr(np.random.default_rng(0).normal(size=z.shape))[0]
        near = float(np.mean(lams)) * (1 + 16 * EPS) + 1e-290
        for _ in range(4):
            basis = np.linalg.qr(np.linalg.solve(tri - near * np.eye(len(tri)), basis))[0]
    values, turn = _jacobi(basis.T @ tri @ basis)
    return values, basis @ turn


def _block(a: np.ndarray, b: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Greatest eigenvalues and vectors of B'B for a bidiagonal block without zeros above its diagonal."""
    lams = dqds([float(x) for x in a * a], [float(x) for x in b * b])
    wanted = lams[:count]
    while len(wanted) < len(lams) and wanted[-1] - lams[len(wanted)] < GAP * wanted[-1]:
        wanted.append(lams[len(wanted)])  # a group is not cut
    low, diag = b / a[:-1], a * a
    tri = np.diag(a * a + np.concatenate([[0.0], b * b])) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    values, vectors, at = [], [], 0
    while at < len(wanted):
        to = at + 1
        while to < len(wanted) and wanted[to - 1] - wanted[to] < GAP * wanted[to - 1]:
            to += 1
        got = [_vector(low, diag, x) for x in wanted[at:to]]
        if to - at == 1:
            lam, z = np.array([got[0][1]]), got[0][0][:, None]
        else:
            lam, z = _group(tri, wanted[at:to], np.stack([g[0] for g in got], axis=1))
        values.append(lam)
        vectors.append(z)
        at = to
    return np.concatenate(values), np.concatenate(vectors, axis=1)


def right_singular(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` greatest singular values, falling, and their right singular vectors as columns.

    Values that rounding cannot tell from zero are left out, so fewer may come back.
    """
    n, scale = len(r), float(np.abs(r).max(initial=0))
    if not scale:
        return np.zeros(0), np.zeros((n, 0))
    a, b, rights = bidiagonalise(r / scale)
    least = EPS * EPS * float(max(np.abs(a).max(), np.abs(b).max(initial=0)))
    a = np.where(np.abs(a) < least, least, a)
    b = np.where(np.abs(b) <= 0.25 * EPS * np.minimum(np.abs(a[:-1]), np.abs(a[1:])), 0.0, b)
    edges = [0, *(np.flatnonzero(b == 0) + 1).tolist(), n]
    values, vectors = [], []
    for lo, hi in zip(edges, edges[1:]):
        lam, z = _block(a[lo:hi], b[lo : hi - 1], count)
        wide = np.zeros((n, len(lam)))
        wide[lo:hi] = z
        values.append(lam)
        vectors.append(wide)
    lam, z = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-lam, kind="stable")[:count]
    sigma, z = np.sqrt(np.maximum(lam[order], 0)), z[:, order]
    for at, v, beta in reversed(rights):
        z[at:] -= beta * np.outer(v, v @ z[at:])
    some = sigma > 16 * n * EPS * sigma.max(initial=0)
    sigma, z = sigma[some] * scale, z[:, some]
    top = np.abs(z).argmax(axis=0)
    return sigma, z * np.where(z[top, np.arange(z.shape[1])] < 0, -1.0, 1.0)
