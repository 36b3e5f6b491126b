"""Small dense linear algebra for the driver, by rows and columns in one thread.

The threaded LAPACK and BLAS of numpy stood still in a driver that had trained the language
network before (a 251 x 251 inverse took over half a minute instead of milliseconds). Nothing
here calls them; sizes are bounded by the callers (256 classes, some 72 dimensions).
"""

from __future__ import annotations

import numpy as np


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b without BLAS; b may be a vector."""
    return np.einsum("ij,jk->ik" if b.ndim == 2 else "ij,j->i", a, b, optimize=False)


def inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row pivots; ZeroDivisionError if a is singular."""
    n = len(a)
    both = np.concatenate((a.astype(float), np.eye(n)), 1)
    for j in range(n):
        p = j + int(np.abs(both[j:, j]).argmax())
        if both[p, j] == 0:
            raise ZeroDivisionError("a singular matrix has no inverse")
        both[[j, p]] = both[[p, j]]
        both[j] /= both[j, j]
        rest = both[:, j].copy()
        rest[j] = 0
        both -= rest[:, None] * both[j]
    return both[:, n:]


def orthonormal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """q, r with a = q r by modified Gram-Schmidt, twice; columns of no length stay zero."""
    q, n = a.astype(float).T.copy(), a.shape[1]
    r = np.eye(n)
    for _ in range(2):
        step = np.zeros((n, n))
        for j in range(n):
            step[j, j] = length = np.sqrt((q[j] * q[j]).sum())
            if length > 0:
                q[j] /= length
                step[j, j + 1 :] = (q[j + 1 :] * q[j]).sum(1)
                q[j + 1 :] -= step[j, j + 1 :, None] * q[j]
        r = times(step, r)
    return q.T, r


def left_singular(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Left singular vectors and values of a, largest first: Gram-Schmidt, then one-sided Jacobi rotations of the small factor."""
    q, r = orthonormal(a)
    w, n = np.ascontiguousarray(r.T), r.shape[1]  # columns as rows
    for _ in range(sweeps):
        off = 0.0
        for i in range(n - 1):
            for j in range(i + 1, n):
                x, y, c = (w[i] * w[i]).sum(), (w[j] * w[j]).sum(), (w[i] * w[j]).sum()
                if abs(c) <= max(1e-15 * np.sqrt(x) * np.sqrt(y), 1e-280):
                    continue
                off = max(off, abs(c) / np.sqrt(x) / np.sqrt(y))
                z = (y - x) / (2 * c)
                t = (1 if z >= 0 else -1) / (abs(z) + np.hypot(1, z))
                k = 1 / np.sqrt(1 + t * t)  # the rotation's cosine
                w[i], w[j] = k * w[i] - k * t * w[j], k * t * w[i] + k * w[j]
        if off < 1e-12:
            break
    s = np.sqrt((w * w).sum(1))
    order = np.argsort(-s, kind="stable")
    u = w[order] / np.where(s[order] > 0, s[order], 1)[:, None]
    return times(q, u.T), s[order]
