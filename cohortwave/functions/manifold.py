"""Positive definite matrices: functions of eigenvalues, Fisher mean, tangent vectors."""

from __future__ import annotations

import numpy as np


def spectral(c: np.ndarray, function) -> np.ndarray:
    """``function`` of the eigenvalues of symmetric matrices, one or a stack."""
    value, vector = np.linalg.eigh(c)
    return (vector * function(value)[..., None, :]) @ np.swapaxes(vector, -1, -2)


def fisher_mean(c: np.ndarray, weights: np.ndarray | None = None, tol: float = 1e-8, rounds: int = 100) -> np.ndarray:
    """Geometric mean of a stack (k, n, n) under the affine-invariant metric."""
    w = np.full(len(c), 1 / len(c)) if weights is None else weights / weights.sum()
    g = np.tensordot(w, c, 1)
    for _ in range(rounds):
        root, back = spectral(g, np.sqrt), spectral(g, lambda v: 1 / np.sqrt(v))
        step = np.tensordot(w, spectral(back @ c @ back, np.log), 1)
        g = root @ spectral(step, np.exp) @ root
        g = (g + g.T) / 2
        if np.linalg.norm(step) <= tol * np.sqrt(len(g)):
            break
    return g


def fisher_maps(c: np.ndarray, start: np.ndarray, weights: np.ndarray | None = None, tol: float = 1e-8, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(means, logs): the Fisher mean of each run of a stack, and log(g^-1/2 C g^-1/2) of every matrix at its run's mean g.

    Runs begin at ``start`` and are solved side by side, from their log-Euclidean
    means on. The logs are those that a run's last step was taken from.
    """
    size = np.diff(np.append(start, len(c)))
    w = np.ones(len(c)) if weights is None else np.asarray(weights, float)
    w = w / np.repeat(np.add.reduceat(w, start), size)
    w = w[:, None, None]
    logs = spectral(c, np.log)
    g = spectral(np.add.reduceat(w * logs, start), np.exp)
    owner, open_ = np.repeat(np.arange(len(start)), size), np.arange(len(start))
    for _ in range(rounds):
        own = slice(None) if len(open_) == len(start) else np.isin(owner, open_)
        root, back = spectral(g[open_], np.sqrt), spectral(g[open_], lambda v: 1 / np.sqrt(v))
        each = np.repeat(back, size[open_], axis=0)
        logs[own] = spectral(each @ c[own] @ each, np.log)
        step = np.add.reduceat(w[own] * logs[own], np.append(0, np.cumsum(size[open_])[:-1]))
        far = np.linalg.norm(step, axis=(-2, -1)) > tol * np.sqrt(c.shape[-1])
        new = (root @ spectral(step, np.exp) @ root)[far]
        open_ = open_[far]
        if not len(open_):
            break
        g[open_] = (new + np.swapaxes(new, -1, -2)) / 2
    return g, logs


def fisher_means(c: np.ndarray, start: np.ndarray, tol: float = 1e-8, rounds: int = 100) -> np.ndarray:
    """``fisher_mean`` of each run of a stack; runs begin at ``start`` and are solved side by side."""
    return fisher_maps(c, start, None, tol, rounds)[0]


def vectorised(s: np.ndarray, columns: int | None = None) -> np.ndarray:
    """(k, features): lower triangles of symmetric matrices, off-diagonals times sqrt 2, column by column; the first ``columns`` alone."""
    n = s.shape[-1]
    at = [(i, j) for j in range(n if columns is None else columns) for i in range(j, n)]
    rows, cols = np.array(at).T
    return s[:, rows, cols] * np.where(rows == cols, 1.0, np.sqrt(2))


def tangent_vectors(c: np.ndarray, base: np.ndarray, columns: int | None = None) -> np.ndarray:
    """(k, features): lower triangles of log(base^-1/2 C base^-1/2), off-diagonals times sqrt 2.

    Column by column; ``columns`` keeps the first ones only. ``base`` is one matrix, or one for each.
    """
    back = spectral(base, lambda v: 1 / np.sqrt(v))
    return vectorised(spectral(back @ c @ back, np.log), columns)
