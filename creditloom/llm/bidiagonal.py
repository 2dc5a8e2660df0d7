"""Singular values and right singular vectors of a small square matrix.

Householder reflections bring the matrix to bidiagonal form, dqds finds the
singular values of that form to high relative accuracy, and twisted
factorisations give their vectors. The matrix is a QR factor, so its size is
the number of dimensions, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
# Sweeps that one value may take; a few are usual.
SWEEPS = 200
# Closer eigenvalues are a cluster, whose vectors are made orthogonal to each other.
CLUSTER_GAP = 0.05


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vector ``v`` of the reflection ``I - 2 v v'`` that leaves only the first entry of ``x``, and that entry."""
    scale = np.abs(x).max() if len(x) else 0.0
    if scale == 0.0:
        return np.zeros_like(x), 0.0
    v = x / scale
    norm = np.sqrt(v @ v)
    first = -norm if v[0] >= 0 else norm
    v[0] -= first
    length = np.sqrt(v @ v)
    return (v / length if length else v), first * scale


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of ``U' r V``, which is upper bidiagonal, and ``V``."""
    a, size = r.astype(np.float64).copy(), len(r)
    v_all = np.eye(size)
    diagonal, above = np.zeros(size), np.zeros(max(0, size - 1))
    for k in range(size):
        v, diagonal[k] = _reflector(a[k:, k])
        a[k:, k + 1:] -= 2.0 * np.outer(v, v @ a[k:, k + 1:])
        if k < size - 1:
            v, above[k] = _reflector(a[k, k + 1:])
            a[k + 1:, k + 1:] -= 2.0 * np.outer(a[k + 1:, k + 1:] @ v, v)
            v_all[:, k + 1:] -= 2.0 * np.outer(v_all[:, k + 1:] @ v, v)
    return diagonal, above, v_all


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential quotient-difference step with a shift; None when the shift was too large."""
    new_q, new_e = [], []
    d = q[0] - shift
    for k, step in enumerate(e):
        top = d + step
        if not (d >= 0.0 and top > 0.0):
            return None
        ratio = q[k + 1] / top
        new_q.append(top)
        new_e.append(step * ratio)
        d = d * ratio - shift
    if not d >= 0.0:
        return None
    new_q.append(d)
    return new_q, new_e


def _shift(q: list[float], e: list[float]) -> float:
    """Smaller eigenvalue of the last two rows: a near upper estimate of the least one."""
    a, b, c = q[-2] + e[-1], q[-1], e[-1] * q[-1]
    mean, half = 0.5 * (a + b), 0.5 * (a - b)
    root = np.sqrt(half * half + c)
    # The product over the larger root avoids cancellation.
    return max(0.0, float(q[-2] * q[-1] / (mean + root))) if mean + root > 0 else 0.0


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling, by dqds."""
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0.0:
        return np.zeros(len(diagonal))
    blocks = [(list((diagonal / scale) ** 2), list((above / scale) ** 2), 0.0)]
    tiny, found = (8 * EPS) ** 2, []
    while blocks:
        q, e, moved = blocks.pop()
        for _ in range(SWEEPS * (len(q) + 1)):
            if len(q) == 1:
                found.append(moved + q[0])
                break
            if e[-1] <= tiny * (moved + q[-1]):
                found.append(moved + q.pop())
                e.pop()
                continue
            cut = next((k for k, step in enumerate(e) if step <= tiny * moved or step == 0.0), None)
            if cut is not None:
                blocks += [(q[:cut + 1], e[:cut], moved), (q[cut + 1:], e[cut + 1:], moved)]
                break
            if q[-1] == 0.0 or q[0] == 0.0 or 1.5 * q[0] < q[-1]:
                if q[-1] > q[0]:  # small values belong at the end
                    q, e = q[::-1], e[::-1]
            shift, stepped = _shift(q, e), None
            for attempt in (0.999 * shift, 0.75 * shift, 0.25 * shift, 0.0):
                stepped = _sweep(q, e, attempt)
                if stepped:
                    break
            if stepped is None:  # zero pivots: the least value is zero
                stepped, attempt = _sweep([max(x, 1e-300) for x in q], e, 0.0), 0.0
            q, e = stepped
            moved += attempt
        else:
            raise ArithmeticError("dqds did not converge")
    return np.sort(np.maximum(found, 0.0))[::-1] * scale * scale


def _factors(d: np.ndarray, low: np.ndarray, shift: float):
    """Stationary and progressive transforms of ``L D L' - shift``, and the twist values."""
    size, floor = len(d), np.finfo(np.float64).tiny * 1e16
    down, up = np.zeros(size - 1), np.zeros(size - 1)
    d_plus = np.zeros(size)
    s, p = np.zeros(size), np.zeros(size)
    s[0] = -shift
    for k in range(size - 1):
        pivot = s[k] + d[k]
        pivot = pivot if abs(pivot) > floor else floor
        d_plus[k] = pivot
        down[k] = d[k] * low[k] / pivot
        s[k + 1] = down[k] * low[k] * s[k] - shift
    d_plus[-1] = s[-1] + d[-1]
    p[-1] = d[-1] - shift
    for k in range(size - 2, -1, -1):
        pivot = d[k] * low[k] * low[k] + p[k + 1]
        pivot = pivot if abs(pivot) > floor else floor
        ratio = d[k] / pivot
        up[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - shift
    return down, d_plus, up, s + p + shift


def _twisted(down: np.ndarray, up: np.ndarray, at: int) -> np.ndarray:
    z = np.zeros(len(down) + 1)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -down[k] * z[k + 1]
    for k in range(at, len(down)):
        z[k + 1] = -up[k] * z[k]
    return z / np.sqrt(z @ z)


def _solve(down: np.ndarray, d_plus: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``x`` of ``L+ D+ L+' x = b``."""
    x = b.copy()
    for k in range(1, len(x)):
        x[k] -= down[k - 1] * x[k - 1]
    x /= np.where(np.abs(d_plus) > EPS * EPS, d_plus, EPS * EPS)
    for k in range(len(x) - 2, -1, -1):
        x[k] -= down[k] * x[k + 1]
    return x / np.abs(x).max()


def _orthogonal(z: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, float]:
    before = np.sqrt(z @ z)
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    length = np.sqrt(z @ z)
    return (z / length if length else z), length / before


def vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Right singular vectors of a bidiagonal matrix for squared singular ``values`` (falling, positive), as columns."""
    scale = np.abs(diagonal).max(initial=0.0)
    if len(diagonal) == 1:
        return np.ones((1, len(values)))
    scale = max(scale, np.abs(above).max(initial=0.0))
    # A zero on the diagonal is moved by less than the rounding of the matrix.
    alpha = np.where(np.abs(diagonal) < 1e-2 * EPS * scale, 1e-2 * EPS * scale, diagonal) / scale
    low, d = above / scale / alpha[:-1], alpha * alpha
    rng = np.random.default_rng(0)
    found: list[np.ndarray] = []
    start = 0
    for k, value in enumerate(values / (scale * scale)):
        if k and values[k - 1] - values[k] > CLUSTER_GAP * values[k - 1]:
            start = k
        down, d_plus, up, twist = _factors(d, low, value)
        z, kept = np.zeros(len(d)), 0.0
        if np.isfinite(twist).all():
            z, kept = _orthogonal(_twisted(down, up, int(np.argmin(np.abs(twist)))), found[start:])
        if not kept > 0.1:  # an equal value found this vector already: iterate from another start
            down, d_plus, *_ = _factors(d, low, value * (1 + 4 * EPS * (k - start + 1)))
            z, _ = _orthogonal(rng.standard_normal(len(d)), found[start:])
            for _ in range(4):
                z, _ = _orthogonal(_solve(down, d_plus, z), found[start:])
        found.append(z)
    return np.array(found).T if found else np.zeros((len(d), 0))


def principal(r: np.ndarray, count: int, least: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Squared singular values of ``r``, falling, and their right singular vectors as columns.

    At most ``count``, and none below ``least`` times the largest singular
    value, whose direction rounding decides. Each vector's largest entry is positive.
    """
    diagonal, above, v = bidiagonalise(r)
    values = squared_singular_values(diagonal, above)
    kept = values[: int(np.sum(values > max(values[:1], default=0.0) * least * least))][:count]
    if not len(kept):
        return kept, np.zeros((len(r), 0))
    directions = v @ vectors(diagonal, above, kept)
    return kept, directions * np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(len(kept))])
