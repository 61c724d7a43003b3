"""Source separation by approximate joint diagonalisation of symmetric matrices."""

from __future__ import annotations

import numpy as np


def joint_diagonaliser(c: np.ndarray, tol: float = 1e-9, rounds: int = 100) -> np.ndarray:
    """Orthogonal v whose v' c_k v are as diagonal as can be, by plane rotations (Cardoso and Souloumiac 1996)."""
    c, n = np.array(c, float), c.shape[-1]
    v = np.eye(n)
    for _ in range(rounds):
        turned = 0.0
        for p in range(n - 1):
            for q in range(p + 1, n):
                apart, off = c[:, p, p] - c[:, q, q], 2 * c[:, p, q]
                on, cross = (apart**2 - off**2).sum(), 2 * (apart * off).sum()
                angle = 0.5 * np.arctan2(cross, on + np.hypot(on, cross))
                if abs(angle) <= tol:
                    continue
                turned = max(turned, abs(angle))
                turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
                c[:, :, [p, q]] = c[:, :, [p, q]] @ turn
                c[:, [p, q], :] = turn.T @ c[:, [p, q], :]
                v[:, [p, q]] = v[:, [p, q]] @ turn
        if turned <= tol:
            break
    return v


def _unit_trace(c: np.ndarray) -> np.ndarray:
    trace = np.trace(c, axis1=-2, axis2=-1)[..., None, None]
    return c / np.where(trace > 0, trace, 1)


def separate(spectra: np.ndarray, evoked: np.ndarray, share: float = 0.9, keep: float = 1e-10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filters, patterns, ratios) from cospectra and covariances of class means, a component a column.

    All matrices have unit trace. They are whitened by ``share`` of the mean
    cospectrum and the rest of the mean evoked covariance, directions of less
    than ``keep`` of the greatest eigenvalue left out, and jointly diagonalised.
    Components have unit mean spectral power, go by evoked over spectral power,
    the greatest first, and each pattern's greatest entry is positive.
    """
    spectra, evoked = _unit_trace(spectra), _unit_trace(evoked)
    noise, signal = spectra.mean(axis=0), evoked.mean(axis=0)
    value, vector = np.linalg.eigh(share * noise + (1 - share) * signal)
    good = value > keep * value[-1]
    white = vector[:, good] / np.sqrt(value[good])
    filters = white @ joint_diagonaliser(white.T @ np.concatenate((spectra, evoked)) @ white)
    power = np.einsum("ia,ij,ja->a", filters, noise, filters)
    filters = filters / np.sqrt(np.where(power > 0, power, 1))
    ratios = np.einsum("ia,ij,ja->a", filters, signal, filters)
    order = np.argsort(-ratios, kind="stable")
    filters, ratios = filters[:, order], ratios[order]
    patterns = np.linalg.pinv(filters).T
    greatest = patterns[np.abs(patterns).argmax(axis=0), np.arange(patterns.shape[1])]
    sign = np.where(greatest < 0, -1.0, 1.0)
    return filters * sign, patterns * sign, ratios
