"""Covariance estimators on a stack of matrices (k, samples, channels), all trials of a batch at once."""

from __future__ import annotations

import numpy as np


def pack(c: np.ndarray) -> np.ndarray:
    """Lower triangles, row by row."""
    rows, cols = np.tril_indices(c.shape[-1])
    return c[..., rows, cols]


def unpack(packed) -> np.ndarray:
    """Symmetric matrices of packed lower triangles."""
    packed = np.asarray(packed, float)
    n = int((np.sqrt(8 * packed.shape[-1] + 1) - 1) / 2)
    rows, cols = np.tril_indices(n)
    c = np.zeros((*packed.shape[:-1], n, n))
    c[..., rows, cols] = packed
    c[..., cols, rows] = packed
    return c


def _turned(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


def _trace(c: np.ndarray) -> np.ndarray:
    return np.trace(c, axis1=-2, axis2=-1)[..., None, None]


def scm(x: np.ndarray) -> np.ndarray:
    """Centred sample covariance, divided by n."""
    x = x - x.mean(axis=-2, keepdims=True)
    return _turned(x) @ x / x.shape[-2]


def ledoit_wolf(x: np.ndarray) -> np.ndarray:
    """Optimal shrinkage toward the constant-correlation target (Ledoit and Wolf 2004)."""
    c, constant = _shrunk(x)
    if constant.any():
        raise ValueError("a constant channel has no correlation")
    return c


def ledoit_wolf_each(x: np.ndarray) -> np.ndarray:
    """As ``ledoit_wolf``; a matrix with a constant channel keeps its variances, its other entries are NaN, as it has no correlation to shrink to."""
    c, constant = _shrunk(x)
    return np.where(constant[..., None, None] & ~np.eye(x.shape[-1], dtype=bool), np.nan, c)


def _shrunk(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(covariances shrunk toward a constant correlation, which of them have a constant channel)."""
    n, p = x.shape[-2:]
    x = x - x.mean(axis=-2, keepdims=True)
    s = _turned(x) @ x / n
    var = np.diagonal(s, axis1=-2, axis2=-1)
    constant = (var <= 0).any(axis=-1)
    if p == 1:
        return s, constant
    var = np.where(constant[..., None], 1.0, var)
    eye = np.eye(p, dtype=bool)
    root = np.sqrt(var[..., :, None] * var[..., None, :])
    mean_r = ((s / root).sum(axis=(-2, -1)) - p)[..., None, None] / (p * (p - 1))
    target = np.where(eye, s, mean_r * root)
    square = x * x
    spread = _turned(square) @ square / n - s * s
    theta = _turned(square * x) @ x / n - var[..., :, None] * s  # of s_ii with s_ij
    cross = np.where(eye, 0, np.sqrt(var[..., None, :] / var[..., :, None]) * theta)
    rho = _trace(spread) + mean_r * cross.sum(axis=(-2, -1))[..., None, None]
    gamma = ((target - s) ** 2).sum(axis=(-2, -1))[..., None, None]
    raw = (spread.sum(axis=(-2, -1))[..., None, None] - rho) / np.where(gamma > 0, gamma, 1) / n
    delta = np.where(gamma > 0, np.clip(raw, 0, 1), 0)
    return delta * target + (1 - delta) * s, constant


def definite(c: np.ndarray, least: float = 1e-12) -> np.ndarray:
    """Which matrices of a stack are finite and positive definite: no eigenvalue is below ``least`` of the largest."""
    known = np.isfinite(c).all(axis=(-2, -1))
    value = np.linalg.eigvalsh(np.where(known[..., None, None], c, np.eye(c.shape[-1])))
    return known & (value[..., 0] > least * value[..., -1])


def oas(x: np.ndarray) -> np.ndarray:
    """Oracle-approximating shrinkage toward a common variance (Chen, Wiesel, Eldar and Hero 2010)."""
    s, (n, p) = scm(x), x.shape[-2:]
    trace, square = _trace(s), (s * s).sum(axis=(-2, -1))[..., None, None]
    low = (n + 1 - 2 / p) * (square - trace**2 / p)
    rho = np.where(low > 0, np.minimum(1, ((1 - 2 / p) * square + trace**2) / np.where(low > 0, low, 1)), 1)
    return (1 - rho) * s + rho * trace / p * np.eye(p)


def unit_determinant(c: np.ndarray) -> np.ndarray:
    """Positive definite matrices over the p-th root of their determinants."""
    sign, log = np.linalg.slogdet(c)
    if (sign <= 0).any():
        raise ValueError("a matrix is not positive definite")
    return c / np.exp(log / c.shape[-1])[..., None, None]


def _fixed_point(start: np.ndarray, step, tol: float, rounds: int) -> np.ndarray:
    """Repeat ``step`` on the matrices that still change; each has trace 1."""
    r, open_ = start.copy(), np.arange(len(start))
    for _ in range(rounds):
        new = step(r[open_], open_)
        new /= _trace(new)
        moved = np.linalg.norm(new - r[open_], axis=(-2, -1)) > tol * np.linalg.norm(r[open_], axis=(-2, -1))
        r[open_] = new
        open_ = open_[moved]
        if not len(open_):
            break
    return r


def _power(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x' r^-1 x of every sample; samples of length zero get no say."""
    power = np.einsum("kni,kni->kn", x, _turned(np.linalg.solve(r, _turned(x))))
    return np.where((x * x).sum(axis=-1) > 0, power, np.inf)


def tyler(x: np.ndarray, tol: float = 1e-6, rounds: int = 200) -> np.ndarray:
    """Tyler's M-estimators of shape, trace 1."""
    k, _, p = x.shape

    def step(r: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _turned(x[at] / _power(x[at], r)[..., None]) @ x[at]

    return _fixed_point(np.broadcast_to(np.eye(p) / p, (k, p, p)), step, tol, rounds)


def regularised_tyler(x: np.ndarray, tol: float = 1e-6, rounds: int = 500) -> np.ndarray:
    """Tyler's estimators shrunk to the identity at a level from random matrix theory, trace 1."""
    k, n, p = x.shape
    length = np.linalg.norm(x, axis=-1, keepdims=True)
    unit = x / np.where(length > 0, length, 1)
    shape = p * _turned(unit) @ unit / n
    zeta = (shape * shape).sum(axis=(-2, -1)) / p - p / n  # sphericity of normalised samples, freed of its bias
    safe = np.maximum(zeta, 1)
    alpha = np.clip((safe - 1 + 2 / n) / (safe * (1 + (p - 1) / n)), 0, 0.999)[:, None, None]
    alpha = np.where(zeta[:, None, None] > 1, alpha, 0)

    def step(r: np.ndarray, at: np.ndarray) -> np.ndarray:
        raw = _turned(x[at] / _power(x[at], r)[..., None]) @ x[at]
        return alpha[at] * raw * p / _trace(raw) + (1 - alpha[at]) * np.eye(p)

    return _fixed_point(np.broadcast_to(np.eye(p) / p, (k, p, p)), step, tol, rounds)
