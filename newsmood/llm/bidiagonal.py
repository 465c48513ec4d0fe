"""Singular values and right singular vectors of a triangular factor, by way of its bidiagonal form.

``bidiagonalise`` reduces a square matrix with Householder reflections; ``dqds`` finds the squared singular values of the
bidiagonal matrix by differential quotient-difference transforms with shifts, each to high relative accuracy; ``twisted``
recovers a vector for each from a twisted factorisation. All work on one matrix of the dimension of the vectors.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, tau, beta): (I - tau v v') x = beta e1, with v[0] = 1."""
    norm = float(np.linalg.norm(x[1:]))
    v = x.copy()
    if norm == 0.0:
        v[:] = 0.0
        v[0] = 1.0
        return v, 0.0, float(x[0])
    beta = -np.copysign(np.hypot(x[0], norm), x[0])
    v[1:] /= x[0] - beta
    v[0] = 1.0
    return v, float((beta - x[0]) / beta), float(beta)


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): r = U B v' with B upper bidiagonal, diagonal a, superdiagonal b, v orthogonal."""
    work, n = np.array(r, np.float64), r.shape[1]
    right = []
    b = np.zeros(max(0, n - 1))
    for k in range(n):
        v, tau, work[k, k] = _reflector(work[k:, k])
        rest = work[k:, k + 1:]
        rest -= np.outer(tau * v, v @ rest)
        if k < n - 1:
            v, tau, b[k] = _reflector(work[k, k + 1:])
            below = work[k + 1:, k + 1:]
            below -= np.outer(below @ v, tau * v)
            right.append((k + 1, v, tau))
    vectors = np.eye(n)
    for at, v, tau in reversed(right):
        vectors[at:, at:] -= np.outer(tau * v, v @ vectors[at:, at:])
    return np.diag(work).copy(), b, vectors


def _transformed(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """One dqds step: (q, e) of the matrix shifted, and the d's on the way. None where it is not positive."""
    n = len(q)
    out_q, out_e, ds = np.empty(n), np.empty(n - 1), np.empty(n)
    d = q[0] - shift
    for i in range(n - 1):
        if not d >= 0.0:
            return None
        ds[i] = d
        out_q[i] = total = d + e[i]
        if total == 0.0:
            return None
        ratio = q[i + 1] / total
        out_e[i] = e[i] * ratio
        d = d * ratio - shift
    if not d >= 0.0:
        return None
    ds[-1] = out_q[-1] = d
    return out_q, out_e, ds


def _unreduced(q: np.ndarray, e: np.ndarray) -> list[float]:
    """The eigenvalues, in any order, of one unreduced piece with positive q and e."""
    found = []
    floor = EPS ** 3 * float(q.max() + e.max(initial=0.0))
    stack = [(q, e, 0.0)]
    while stack:
        q, e, sigma = stack.pop()
        if len(q) == 1:
            found.append(sigma + q[0])
            continue
        cut = np.flatnonzero(e <= 4 * EPS * EPS * (sigma + np.minimum(q[:-1], q[1:])) + floor)
        if len(cut):
            at = int(cut[-1]) + 1
            stack += [(q[:at], e[:at - 1], sigma), (q[at:], e[at:], sigma)]
            continue
        if len(q) == 2:  # in closed form, the smaller one without cancellation
            total, product = q[0] + q[1] + e[0], q[0] * q[1]
            large = (total + np.sqrt(max(0.0, (q[0] - q[1] + e[0]) ** 2 + 4 * q[1] * e[0]))) / 2
            found += [sigma + large, sigma + product / large]
            continue
        if 1.5 * q[0] < q[-1]:  # small values are found at the end
            q, e = q[::-1], e[::-1]
        plain = _transformed(q, e, 0.0)  # q and e are not negative and no e is zero, so this one always exists
        least = float(plain[2].min())
        safe = 1.0 / float((1.0 / plain[2]).sum()) if least > 0.0 else 0.0  # a step of Newton's method from below
        for shift in (0.999 * least, 0.75 * least, 0.999 * safe, 0.0):
            step = _transformed(plain[0], plain[1], shift) if shift else plain
            if step is not None:
                stack.append((step[0], step[1], sigma + shift))
                break
    return found


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squared singular values of the bidiagonal matrix, ascending."""
    return np.sort(np.array(_unreduced(a * a, b * b)))


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """(vector, correction): of B'B = LDL' and a value of it, from the twist where the factorisation of the shifted
    matrix is nearest to singular. ``value + correction`` is the Rayleigh quotient."""
    n, d = len(a), a * a
    low = b / a[:-1]
    tiny = EPS * EPS * max(float(d.max()), 1e-290)
    down, up = np.empty(max(0, n - 1)), np.empty(max(0, n - 1))
    s, p = np.empty(n), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        plus = s[i] + d[i]
        plus = plus if plus else tiny
        down[i] = d[i] * low[i] / plus
        s[i + 1] = down[i] * low[i] * s[i] - value
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        minus = d[i] * low[i] * low[i] + p[i + 1]
        minus = minus if minus else tiny
        ratio = d[i] / minus
        up[i] = low[i] * ratio
        p[i] = p[i + 1] * ratio - value
    gamma = s + p + value
    r = int(np.argmin(np.abs(np.where(np.isfinite(gamma), gamma, np.inf))))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -up[i] * z[i]
    size = float(z @ z)
    return z / np.sqrt(size), float(gamma[r]) / size


def _apart(z: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in before:
            z = z - (other @ z) * other
    return z


def _other_vector(a: np.ndarray, b: np.ndarray, value: float, before: list[np.ndarray], seed: int) -> np.ndarray:
    """A further vector of a value that several share to working accuracy: inverse iteration apart from the others."""
    n = len(a)
    t = np.diag(a * a) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    t[np.arange(1, n), np.arange(1, n)] += b * b
    z = _apart(np.random.default_rng(seed).normal(size=n), before)
    shifted = t - (value + EPS * max(abs(value), 1e-290) * 4) * np.eye(n)
    for _ in range(4):
        try:
            z = np.linalg.solve(shifted, z / np.linalg.norm(z))
        except np.linalg.LinAlgError:
            shifted += np.eye(n) * EPS * np.abs(t).max()
            continue
        z = _apart(z / np.linalg.norm(z), before)
    return z / np.linalg.norm(z)


def right_vectors(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors): up to ``most`` of the largest squared singular values of ``r``, falling, and a right singular
    vector for each, as columns. Values that are zero to working accuracy are left out."""
    n = r.shape[1]
    scale = float(np.abs(r).max()) if n else 0.0
    if scale == 0.0:
        return np.empty(0), np.empty((n, 0))
    a, b, basis = bidiagonalise(r / scale)
    norm = float(max(np.abs(a).max(), np.abs(b).max(initial=0.0)))
    a = np.where(np.abs(a) < EPS * norm, EPS * norm, a)
    b = np.where(np.abs(b) <= EPS * EPS * norm, 0.0, b)
    pieces, at = [], 0
    for end in [*(np.flatnonzero(b == 0.0) + 1).tolist(), n]:
        pieces.append((at, end))
        at = end
    pairs = []
    for at, end in pieces:
        pairs += [(float(v), at, end) for v in dqds(a[at:end], b[at:end - 1])]
    pairs.sort(key=lambda x: (-x[0], x[1]))
    pairs = [x for x in pairs[:most] if x[0] > (n * EPS) ** 2 * pairs[0][0] * n and x[0] > (4 * n * EPS * norm) ** 2]
    values, vectors = [], np.zeros((n, len(pairs)))
    for k, (value, at, end) in enumerate(pairs):
        if end - at == 1:
            z = np.ones(1)
        else:
            piece = a[at:end], b[at:end - 1]
            z, correction = twisted(*piece, value)
            if np.isfinite(correction) and abs(correction) <= 1e-10 * value:  # once more at the Rayleigh quotient
                better, _ = twisted(*piece, value + correction)
                z = better if np.isfinite(better).all() else z
            near = [vectors[at:end, j] for j in range(k)
                    if pairs[j][1] == at and abs(pairs[j][0] - value) <= 1e-3 * value]
            apart = _apart(z, near) if np.isfinite(z).all() else np.zeros(end - at)
            length = float(np.linalg.norm(apart))
            z = apart / length if length > 0.5 else _other_vector(*piece, value, near, k)
        vectors[at:end, k] = z
        values.append(value * scale * scale)
    return np.array(values), basis @ vectors
