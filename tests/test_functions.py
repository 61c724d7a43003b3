"""Numeric functions against plain loops and known results."""

import numpy as np
import pytest

from cohortwave.functions import alignment as al
from cohortwave.functions import covariances as cov
from cohortwave.functions import filters, linear, manifold, separation

RNG = np.random.default_rng(0)


def _plain_ledoit_wolf(x):
    n, p = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    r = np.mean([s[i, j] / np.sqrt(s[i, i] * s[j, j]) for i in range(p) for j in range(i)])
    f = np.array([[s[i, i] if i == j else r * np.sqrt(s[i, i] * s[j, j]) for j in range(p)] for i in range(p)])
    pi = np.array([[np.mean((x[:, i] * x[:, j] - s[i, j]) ** 2) for j in range(p)] for i in range(p)])
    theta = lambda k, i, j: np.mean((x[:, k] ** 2 - s[k, k]) * (x[:, i] * x[:, j] - s[i, j]))
    rho = np.trace(pi) + sum(r / 2 * (np.sqrt(s[j, j] / s[i, i]) * theta(i, i, j) + np.sqrt(s[i, i] / s[j, j]) * theta(j, i, j)) for i in range(p) for j in range(p) if i != j)
    delta = np.clip((pi.sum() - rho) / np.sum((f - s) ** 2) / n, 0, 1)
    return delta * f + (1 - delta) * s


def test_ledoit_wolf_equals_its_formula():
    x = RNG.normal(size=(5, 12, 4)) @ RNG.normal(size=(4, 4))
    assert np.allclose(cov.ledoit_wolf(x), [_plain_ledoit_wolf(v) for v in x])
    with pytest.raises(ValueError):
        cov.ledoit_wolf(np.ones((1, 5, 3)))


def test_oas_equals_its_formula():
    x = RNG.normal(size=(3, 9, 4))
    for v, got in zip(x, cov.oas(x), strict=True):
        s, n, p = np.cov(v.T, bias=True), 9, 4
        rho = min(1, ((1 - 2 / p) * np.trace(s @ s) + np.trace(s) ** 2) / ((n + 1 - 2 / p) * (np.trace(s @ s) - np.trace(s) ** 2 / p)))
        assert np.allclose(got, (1 - rho) * s + rho * np.trace(s) / p * np.eye(p))


def test_pack_and_determinant():
    c = cov.scm(RNG.normal(size=(4, 20, 3)))
    assert np.allclose(cov.unpack(cov.pack(c)), c)
    assert np.allclose(np.linalg.det(cov.unit_determinant(c)), 1)
    with pytest.raises(ValueError):
        cov.unit_determinant(-np.eye(3)[None])


def test_tyler_fixed_point_and_scale():
    x = RNG.standard_t(3, size=(3, 200, 4)) @ np.diag([1, 2, 3, 4.0])
    r = cov.tyler(x)
    assert np.allclose(np.trace(r, axis1=1, axis2=2), 1)
    again = np.stack([sum(np.outer(v, v) / (v @ np.linalg.inv(m) @ v) for v in k) for k, m in zip(x, r, strict=True)])
    again /= np.trace(again, axis1=1, axis2=2)[:, None, None]
    assert np.abs(again - r).max() < 1e-5
    assert np.allclose(cov.tyler(x * 7), r)
    shrunk = cov.regularised_tyler(x[:, :10])
    assert np.linalg.eigvalsh(shrunk).min() > 0 and np.allclose(np.trace(shrunk, axis1=1, axis2=2), 1)


def test_fisher_mean_of_commuting_matrices_and_base_point():
    d = RNG.uniform(0.5, 3, (6, 4))
    q = np.linalg.qr(RNG.normal(size=(4, 4)))[0]
    c = q @ (d[:, :, None] * np.eye(4)) @ q.T
    g = manifold.fisher_mean(c)
    assert np.allclose(g, q @ np.diag(np.exp(np.log(d).mean(axis=0))) @ q.T)
    assert np.allclose(manifold.tangent_vectors(g[None], g), 0)
    v = manifold.tangent_vectors(c, g)
    assert v.shape == (6, 10) and np.allclose(v.mean(axis=0), 0, atol=1e-7)
    assert manifold.tangent_vectors(c, g, 2).shape == (6, 7)


def _planted(m=5, d=6, k=300, noise=0.05):
    s = RNG.normal(size=(d, k)) * np.linspace(1, 2, d)[:, None]
    return [np.linalg.qr(RNG.normal(size=(d, d)))[0] @ (s + noise * RNG.normal(size=(d, k))) for _ in range(m)]


def test_whitening_gives_orthonormal_rows():
    t, h = al.whiten(_planted(), "svd", 6)
    assert all(np.allclose(x @ x.T, np.eye(6)) for x in t)
    with pytest.raises(ValueError):
        al.whiten(_planted(), "other")
    smart, _ = al.whiten(_planted(), "smart", 6, 4)
    assert all(x.shape[0] == 4 for x in smart)


@pytest.mark.parametrize("start", ["none", "smart"])
def test_joint_alignment_undoes_planted_rotations(start):
    w = _planted()
    found = al.joint_alignment(w, al.start_at(w, start))
    u = al.ordered(al.normalised(found.u), w)
    before = al.non_diagonality(al.start_at(w), w)
    after = al.non_diagonality(u, w)
    off = ~np.eye(5, dtype=bool)
    assert after[off].mean() < 0.02 < before[off].mean()
    y = [f.T @ x for f, x in zip(u, w, strict=True)]
    assert all(np.corrcoef(y[0][k], y[j][k])[0, 1] > 0.95 for j in range(5) for k in range(6))
    assert np.allclose(np.linalg.norm(u, axis=1), 1)
    white = al.normalised(found.u, w)
    assert all(np.allclose(np.diag(f.T @ x @ x.T @ f), 1) for f, x in zip(white, w, strict=True))


def test_fast_alignment_fits_a_new_domain():
    w = _planted()
    found = al.joint_alignment(w[:-1])
    u = np.concatenate((found.u, al.fast_alignment(w[:-1], found.u, w[-1])[None]))
    assert al.non_diagonality(al.normalised(u), w)[-1, :-1].mean() < 0.05


def test_canonical_correlations():
    x = RNG.normal(size=(3, 200))
    assert np.allclose(al.canonical(x, np.linalg.qr(RNG.normal(size=(3, 3)))[0] @ x), 1)
    u, v, s = al.maximum_covariance(x, x)
    assert np.allclose(s, np.linalg.eigvalsh(x @ x.T / 200)[::-1])


@pytest.mark.parametrize("kind", ["svc", "enlr"])
def test_classifiers_separate(kind):
    x = RNG.normal(size=(300, 4))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0.4, 2, 1)
    assert linear.balanced_accuracy(y, linear.predict(linear.train(x, y, kind), x)) > 0.95
    three = np.digitize(x[:, 0], [-0.5, 0.5])
    assert linear.balanced_accuracy(three, linear.predict(linear.train(x, three, kind), x)) > 0.6
    assert (linear.predict(linear.train(x, np.ones(300), kind), x) == 1).all()
    with pytest.raises(ValueError):
        linear.train(x, y, "other")


def test_squared_hinge_is_at_its_minimum():
    x, y = RNG.normal(size=(80, 3)), np.where(RNG.normal(size=80) > 0, 1.0, -1.0)
    a, weight, w = np.column_stack((x, np.ones(80))), linear.balanced(y), linear.squared_hinge(x, y)
    cost = lambda v: 0.5 * v @ v + weight @ np.maximum(0, 1 - y * (a @ v)) ** 2
    assert all(cost(w) <= cost(w + 1e-3 * RNG.normal(size=4)) for _ in range(50))


def test_band_pass_keeps_the_band_and_the_phase():
    rate, t = 128.0, np.arange(1024) / 128
    inside, outside = np.sin(2 * np.pi * 8 * t), np.sin(2 * np.pi * 40 * t) + 3
    y = filters.zero_phase((inside + outside)[:, None], filters.butterworth_band(4, 16, rate))[:, 0]
    assert np.abs(y - inside)[100:-100].max() < 0.05


def test_inverse_solutions():
    k = RNG.normal(size=(12, 60))
    k -= k.mean(axis=0)
    h = np.eye(12) - 1 / 12
    assert np.allclose(k @ filters.minimum_norm(k), h)
    for inverse in (filters.standardised_low_resolution(k), filters.exact_low_resolution(k)):
        power = ((inverse @ k).reshape(20, 3, 60) ** 2).sum(axis=1).reshape(20, 20, 3).sum(axis=2)
        assert (power.argmax(axis=0) == np.arange(20)).all()


def test_mean_normalised():
    x, rounds = filters.mean_normalised(RNG.uniform(1, 2, (6, 5)))
    assert rounds < 100 and np.allclose(x.mean(axis=0), 1, atol=1e-6) and np.allclose(x.mean(axis=1), 1)


@pytest.mark.parametrize("n", [1, 5, 128, 300])
def test_filter_blocks_equal_a_plain_recursion(n):
    x = np.random.default_rng(n).normal(size=(n, 2))
    for b, a in filters.butterworth_band(1, 20, 128.0):
        plain, before, after = np.empty_like(x), [x[0], x[0]], [b.sum() / a.sum() * x[0]] * 2
        for t in range(n):
            plain[t] = b[0] * x[t] + b[1] * before[0] + b[2] * before[1] - a[1] * after[0] - a[2] * after[1]
            before, after = [x[t], before[0]], [plain[t], after[0]]
        one = filters.Cascade([(b, a)])
        assert np.allclose(one.run(x, one.rest(x[0]))[0], plain, atol=1e-10)


def test_rotations_diagonalise_what_can_be():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(5, 5)))[0]
    c = np.stack([q @ np.diag(rng.normal(size=5)) @ q.T for _ in range(6)])
    v = separation.joint_diagonaliser(c)
    found = v.T @ c @ v
    assert np.abs(found - found * np.eye(5)).max() < 1e-8 and np.allclose(v.T @ v, np.eye(5))
