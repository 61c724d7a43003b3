"""Whitening and joint alignment of several domains' feature matrices.

A domain's matrix has one row per feature and one column per bootstrap; column k
stands for the same bootstrap in every domain.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Cells of cross-covariances of the groups that are aligned side by side.
CELLS = 2_000_000


def whiten(w: list[np.ndarray], kind: str = "svd", size: int = 16, subspace: int = 16) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(T, H): whitened matrices T = H' W and the filters H.

    svd: each domain by its own singular vectors, so that T T' = I. pca: scores,
    not scaled to one. smart: scores turned to the subspace that a domain shares
    with all others. none: as they are.
    """
    if kind == "none":
        return list(w), [np.eye(len(x)) for x in w]
    if kind not in ("svd", "pca", "smart"):
        raise ValueError(f"unknown whitening {kind!r}")
    parts = [np.linalg.svd(x, full_matrices=False) for x in w]
    rank = min(size, *(int((s > 1e-10 * s[0]).sum()) for _, s, _ in parts))
    if kind == "svd":
        filters = [u[:, :rank] / s[:rank] for u, s, _ in parts]
    elif kind == "pca":
        filters = [u[:, :rank] for u, _, _ in parts]
    else:
        scaled = [u[:, :rank] * s[:rank] for u, s, _ in parts]
        scores = [f.T @ x for f, x in zip(scaled, w, strict=True)]
        total = sum(scores)
        turn = [np.linalg.svd(t @ (total - t).T)[0][:, : min(subspace, rank)] for t in scores]
        filters = [f @ q for f, q in zip(scaled, turn, strict=True)]
    return [h.T @ x for h, x in zip(filters, w, strict=True)], filters


def start_at(t: list[np.ndarray], kind: str = "none") -> np.ndarray:
    """First filters (domains, D, D): identity, or the singular vectors of what a domain shares with the others."""
    if kind not in ("none", "smart"):
        raise ValueError(f"unknown start {kind!r}")
    if kind == "none":
        return np.stack([np.eye(len(x)) for x in t])
    total = sum(t)
    return np.stack([np.linalg.svd(x @ (total - x).T)[0] for x in t])


@dataclass(frozen=True)
class Aligned:
    """Filters ``u`` (domains, D, D), sweeps done, the last change, and whether it grew near the end."""

    u: np.ndarray
    rounds: int
    change: float
    diverging: bool


def joint_alignment(t: list[np.ndarray], start: np.ndarray | None = None, tol: float = 1e-8, rounds: int = 2500) -> Aligned:
    """Filters that make all cross-covariances u_i' T_i T_j' u_j diagonal at once.

    Domains are visited in turn, twice a round, each with the newest filters of
    the others: component d has R = sum over j of (C_ij u_jd)(C_ij u_jd)', and
    u_d becomes (sum of all R)^-1 R u_d, scaled to u' R u = 1.
    """
    return joint_alignments([t], None if start is None else [start], tol, rounds)[0]


def joint_alignments(groups: list[list[np.ndarray]], start: list[np.ndarray] | None = None, tol: float = 1e-8, rounds: int = 2500) -> list[Aligned]:
    """``joint_alignment`` of several groups, those of one shape side by side; each rests when it has come to its own end.

    No R is made: with V_j = C_ij u_j, R_d u_d is the sum over j of V_jd (V_jd' u_d),
    and the sum of all R is that of V_j V_j'.
    """
    out: list[Aligned | None] = [None] * len(groups)
    shapes: dict[tuple[int, int], list[int]] = {}
    for n, t in enumerate(groups):
        if len(t) < 2:
            raise ValueError("alignment needs two domains or more")
        shapes.setdefault((len(t), len(t[0])), []).append(n)
    for (m, d), every in shapes.items():
        step = max(1, CELLS // (m * m * d * d))
        for lo in range(0, len(every), step):
            at = every[lo : lo + step]
            c = np.stack([_crossed(groups[n]) for n in at])
            u = np.stack([start_at(groups[n]) if start is None else start[n] for n in at])
            for n, found in zip(at, _together(c, u, tol, rounds), strict=True):
                out[n] = found
    return out


def _crossed(t: list[np.ndarray]) -> np.ndarray:
    x = np.stack(t)
    m, d, k = x.shape
    flat = x.reshape(m * d, k)
    return (flat @ flat.T).reshape(m, d, m, d).transpose(0, 2, 1, 3)


def _together(c: np.ndarray, u: np.ndarray, tol: float, rounds: int) -> list[Aligned]:
    """The alignments of groups of one shape: ``c`` (groups, domains, domains, D, D), ``u`` (groups, domains, D, D)."""
    many, m, d = u.shape[:3]
    others = [np.array([j for j in range(m) if j != i]) for i in range(m)]
    rows = [np.ascontiguousarray(c[:, i, others[i]]) for i in range(m)]
    u, out, open_, eye = u.copy(), [None] * many, np.arange(many), np.eye(d)
    last, before, diverging = np.full(many, np.nan), np.ones(many), np.zeros(many, bool)
    for done in range(1, rounds + 1):
        for i in 2 * list(range(m)):
            v = rows[i] @ u[:, others[i]]
            total = v.swapaxes(1, 2).reshape(len(v), d, -1)
            total = total @ total.swapaxes(1, 2)
            ru = np.einsum("gjad,gjd->gad", v, np.einsum("gjad,gad->gjd", v, u[:, i]))
            total += (1e-12 * np.einsum("gaa->g", total))[:, None, None] * eye
            y = np.linalg.solve(total, ru)
            # y' R y of a component is the sum of squares of V_j' y
            met = np.einsum("gjad,gad->gjd", v, y)
            u[:, i] = y / np.sqrt(np.maximum(np.einsum("gjd,gjd->gd", met, met), 1e-300))[:, None]
        level = (u**2).sum(axis=(1, 2, 3)) / (2 * d * d * m)
        change = np.ones(len(level)) if done == 1 else np.abs((level - last) / last)
        diverging |= (before < 1e-5) & (change > before)
        last, before = level, change
        end = (change <= tol) | (done == rounds)
        for k in np.flatnonzero(end):
            out[open_[k]] = Aligned(u[k].copy(), done, float(change[k]), bool(diverging[k]))
        if end.any():
            go = ~end
            if not go.any():
                break
            u, open_, last, before, diverging = u[go], open_[go], last[go], before[go], diverging[go]
            rows = [r[go] for r in rows]
    return out


def orthogonal_alignment(t: list[np.ndarray], components: int, tol: float = 1e-8, rounds: int = 2500) -> Aligned:
    """Filters with orthonormal columns that make the sum of shared covariances largest, any number of domains.

    Domains are visited in turn: with M the sum over the others j of
    C_ij u_j diag(u_i' C_ij u_j), u_i becomes the orthogonal polar factor of M (as
    in joint diagonalisation by orthogonal matrices). For two domains these are singular vectors.
    """
    m = len(t)
    if m < 2:
        raise ValueError("alignment needs two domains or more")
    rank = min(components, *(min(x.shape) for x in t))
    c = [[x @ y.T / x.shape[1] for y in t] for x in t]
    u = []
    for i in range(m):
        shared = np.concatenate([c[i][j] for j in range(m) if j != i], axis=1)
        u.append(np.linalg.svd(shared, full_matrices=False)[0][:, :rank])
    # signs that agree with the first domain, or terms of the sum would cancel
    for i in range(1, m):
        sign = np.sign(np.einsum("ak,ab,bk->k", u[0], c[0][i], u[i]))
        u[i] = u[i] * np.where(sign == 0, 1, sign)
    shared_of = lambda i, j: np.einsum("ak,ab,bk->k", u[i], c[i][j], u[j])
    last, change, done = None, 1.0, 0
    for done in range(1, rounds + 1):
        for i in range(m):
            left, _, right = np.linalg.svd(sum(c[i][j] @ u[j] * shared_of(i, j) for j in range(m) if j != i), full_matrices=False)
            u[i] = left @ right
        level = float(sum((shared_of(i, j) ** 2).sum() for i in range(m) for j in range(m) if i != j))
        change = 1.0 if last is None else abs(level - last) / max(abs(last), 1e-300)
        last = level
        if change <= tol:
            break
    total = sum(shared_of(i, j) for i in range(m) for j in range(m) if i != j)
    order = np.argsort(-total, kind="stable")
    first = u[0][:, order]
    sign = np.sign(first[np.abs(first).argmax(axis=0), np.arange(rank)])
    return Aligned(np.stack([x[:, order] * sign for x in u]), done, change, False)


def fast_alignment(t: list[np.ndarray], u: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The filter of a new domain for a group whose filters stay as they are."""
    v = np.stack([new @ x.T @ f for x, f in zip(t, u, strict=True)]).transpose(2, 1, 0)
    r = v @ v.transpose(0, 2, 1)
    value, vector = np.linalg.eigh(r.sum(axis=0))
    h = (vector / np.sqrt(np.maximum(value, 1e-12 * value[-1]))) @ vector.T
    return np.stack([h @ np.linalg.eigh(h @ rd @ h)[1][:, -1] for rd in r], axis=1)


def normalised(u: np.ndarray, t: list[np.ndarray] | None = None) -> np.ndarray:
    """Columns of length one; with ``t``, of unit variance u' T T' u instead."""
    if t is None:
        return u / np.linalg.norm(u, axis=1, keepdims=True)
    return np.stack([f / np.linalg.norm(x.T @ f, axis=0) for f, x in zip(u, t, strict=True)])


def ordered(u: np.ndarray, t: list[np.ndarray]) -> np.ndarray:
    """Components by falling shared energy, signs such that they agree with the first domain.

    The first domain's largest entry of each component is positive.
    """
    y = np.stack([f.T @ x for f, x in zip(u, t, strict=True)])
    total = y.sum(axis=0)
    energy = (total**2).sum(axis=1) - (y**2).sum(axis=(0, 2))
    order = np.argsort(-energy, kind="stable")
    u, y = u[:, :, order].copy(), y[:, order]
    first = np.sign(np.take_along_axis(u[0], np.abs(u[0]).argmax(axis=0)[None], axis=0))[0]
    sign = np.sign(np.einsum("dk,idk->id", y[0], y)) * np.where(first == 0, 1, first)
    return u * np.where(sign == 0, 1, sign)[:, None, :]


def non_diagonality(u: np.ndarray, t: list[np.ndarray]) -> np.ndarray:
    """(domains, domains): off-diagonal over diagonal energy of each pair's u_i' T_i T_j' u_j, 0 for i = j."""
    y = np.stack([f.T @ x for f, x in zip(u, t, strict=True)])
    a = np.einsum("iak,jbk->ijab", y, y)
    square, n = a**2, a.shape[-1]
    own = np.einsum("ijaa->ij", square)
    out = (square.sum(axis=(2, 3)) - own) / np.maximum((n - 1) * own, 1e-300)
    np.fill_diagonal(out, 0)
    return out


def canonical(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Canonical correlations of two matrices with corresponding columns."""
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    a, b = (np.linalg.svd(z, full_matrices=False) for z in (x, y))
    keep = lambda p: p[2][p[1] > 1e-10 * max(p[1][0], 1e-300)]
    return np.clip(np.linalg.svd(keep(a) @ keep(b).T, compute_uv=False), 0, 1)


def maximum_covariance(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filters of x, filters of y, covariances) by the singular vectors of X Y' / n."""
    u, s, v = np.linalg.svd(x @ y.T / x.shape[1])
    return u, v.T, s
