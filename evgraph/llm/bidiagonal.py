"""Right singular vectors of a small square matrix: Householder bidiagonal form, dqds for the values, twisted factorisations for the vectors.

Everything here is of the size of one vector's dimension squared, whatever the number of rows was.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
CLOSE, DEEP = 1e-3, 8


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(d, e, reflectors): r is turned into an upper bidiagonal matrix by reflections from both sides; the right ones are returned, the k-th acts on columns k + 1 and up."""
    a, n, right = np.array(r, float), len(r), []

    def reflector(x: np.ndarray) -> np.ndarray:
        v, size = x.copy(), np.linalg.norm(x)
        v[0] += size if x[0] >= 0 else -size
        length = np.linalg.norm(v)
        return v / length if length else v

    for k in range(n):
        v = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 2:
            v = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _pass(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """One differential qd step with a shift, or None where the shift was beyond the least value."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for k in range(n - 1):
        if d < 0:
            return None
        top = d + e[k]
        ratio = q[k + 1] / top if top else 1.0
        new_q[k], new_e[k] = top, e[k] * ratio
        d = d * ratio - shift
    new_q[n - 1] = d
    return (new_q, new_e) if d >= 0 else None


def dqds(q: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the bidiagonal matrix whose squared entries are q (diagonal) and e."""
    found: list[float] = []
    work = [(np.array(q, float), np.array(e, float), 0.0)]
    while work:
        q, e, base = work.pop()
        while len(q):
            n = len(q)
            if n == 1:
                found.append(base + q[0])
                break
            if e[-1] <= EPS**2 * (base + q[-1]):
                found.append(base + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            small = np.flatnonzero(e <= EPS**2 * (base + np.minimum(q[:-1], q[1:])))
            if len(small):
                k = int(small[-1]) + 1
                work.append((q[:k], e[: k - 1], base))
                q, e = q[k:], e[k:]
                continue
            if q[0] < q[-1]:
                q, e = q[::-1].copy(), e[::-1].copy()
            total, product = q[-2] + e[-1] + q[-1], q[-2] * q[-1]  # least value of the last two rows
            guess = 2 * product / (total + np.sqrt(max(0.0, total * total - 4 * product))) if total else 0.0
            step = None
            for shift in (guess * (1 - 1e-10), guess * 0.75, guess * 0.25):
                if shift > 0 and (step := _pass(q, e, shift)):
                    base += shift
                    break
            q, e = step or _pass(q, e, 0.0)
    return np.sort(np.array(found))[::-1]


def _stationary(d: np.ndarray, l: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L D L' - shift = L+ D+ L+': (D+, L+, the sums s)."""
    n, tiny = len(d), EPS * np.abs(d).max() * EPS
    plus, low, s = np.empty(n), np.empty(n - 1), np.empty(n)
    s[0] = -shift
    for k in range(n - 1):
        plus[k] = s[k] + d[k] or tiny
        low[k] = l[k] * d[k] / plus[k]
        s[k + 1] = low[k] * l[k] * s[k] - shift
    plus[n - 1] = s[n - 1] + d[n - 1] or tiny
    return plus, low, s


def _progressive(d: np.ndarray, l: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray]:
    """L D L' - shift = U- D- U-': (U-, the sums p)."""
    n, tiny = len(d), EPS * np.abs(d).max() * EPS
    up, p = np.empty(n - 1), np.empty(n)
    p[n - 1] = d[n - 1] - shift
    for k in range(n - 2, -1, -1):
        below = d[k] * l[k] * l[k] + p[k + 1] or tiny
        ratio = d[k] / below
        up[k] = l[k] * ratio
        p[k] = p[k + 1] * ratio - shift
    return up, p


def twisted(d: np.ndarray, l: np.ndarray, value: float) -> np.ndarray:
    """The unit eigenvector of L D L' for an eigenvalue: both factorisations meet at the row that leaves the least remainder."""
    n = len(d)
    if n == 1:
        return np.ones(1)
    _, low, s = _stationary(d, l, value)
    up, p = _progressive(d, l, value)
    r = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[r] = 1
    for k in range(r - 1, -1, -1):
        z[k] = -low[k] * z[k + 1]
    for k in range(r, n - 1):
        z[k + 1] = -up[k] * z[k]
    return z / np.linalg.norm(z)


def _refined(d: np.ndarray, l: np.ndarray, near: np.ndarray, first: int) -> np.ndarray:
    """Eigenvalues first, first + 1, ... (from the least) of L D L' by bisection around `near`, to full relative accuracy."""
    below = lambda x: int((_stationary(d, l, x)[0] < 0).sum())
    out = []
    for k, x in enumerate(near):
        wide = max(abs(x), EPS * np.abs(near).max(), np.finfo(float).tiny) * 1e-6
        low, high = x - wide, x + wide
        while below(low) > first + k:
            wide *= 8
            low = x - wide
        while below(high) <= first + k:
            wide *= 8
            high = x + wide
        for _ in range(200):
            middle = (low + high) / 2
            if middle in (low, high) or high - low <= 2 * EPS * max(abs(low), abs(high)):
                break
            low, high = (low, middle) if below(middle) > first + k else (middle, high)
        out.append((low + high) / 2)
    return np.array(out)


def _vectors(d: np.ndarray, l: np.ndarray, values: np.ndarray, first: int, deep: int = 0) -> np.ndarray:
    """Eigenvectors (columns) of L D L' for rising values, the first of which is the first-th from the least.

    Values that lie relatively close get a shifted factorisation of their own, in which they lie apart.
    """
    out, at = np.zeros((len(d), len(values))), 0
    while at < len(values):
        end = at + 1
        while end < len(values) and values[end] - values[end - 1] <= CLOSE * max(abs(values[end]), abs(values[end - 1])):
            end += 1
        group = values[at:end]
        if len(group) == 1 or deep == DEEP:
            for k, x in enumerate(group):
                out[:, at + k] = twisted(d, l, x)
        else:
            shift = group[0] - max(100 * EPS * abs(group[0]), (group[-1] - group[0]) / len(group) * 0.1)
            plus, low, _ = _stationary(d, l, shift)
            out[:, at:end] = _vectors(plus, low, _refined(plus, low, group - shift, first + at), first + at, deep + 1)
        if len(group) > 1:  # what is still parallel after the last shift
            for _ in range(2):
                for k in range(at + 1, end):
                    out[:, k] -= out[:, at:k] @ (out[:, at:k].T @ out[:, k])
                    out[:, k] /= np.linalg.norm(out[:, k]) or 1
        at = end
    return out


def right_singular(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns) of a square matrix, falling; values that are zero at its size are left out."""
    n = len(r)
    scale = np.abs(r).max(initial=0)
    if not scale:
        return np.zeros(0), np.zeros((n, 0))
    d, e, right = bidiagonal(r / scale)
    least = EPS * n
    d[np.abs(d) < least * EPS] = least * EPS  # else a zero would stand in a denominator
    values, vectors, begin = [], [], 0
    for end in [*(np.flatnonzero(np.abs(e) <= EPS * np.minimum(np.abs(d[:-1]), np.abs(d[1:]))) + 1).tolist(), n]:
        q, l = d[begin:end] ** 2, e[begin : end - 1] / d[begin : end - 1]
        found = dqds(q, e[begin : end - 1] ** 2)[::-1]
        kept = found > (least * np.abs(d).max()) ** 2
        block = np.zeros((n, int(kept.sum())))
        block[begin:end] = _vectors(q, l, found[kept], int((~kept).sum()))
        values.append(found[kept])
        vectors.append(block)
        begin = end
    values, vectors = np.concatenate(values), np.concatenate(vectors, axis=1)
    for k in reversed(range(len(right))):
        vectors[k + 1 :] -= 2 * np.outer(right[k], right[k] @ vectors[k + 1 :])
    order = np.argsort(-values, kind="stable")
    return values[order] * scale**2, vectors[:, order]
