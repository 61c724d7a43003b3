"""Penalised classifiers: the conditions that their minima meet."""

import numpy as np

from cohortwave.functions import linear
from cohortwave.operators import alignment

RNG = np.random.default_rng(17)


def _rows(n=120, p=6):
    x = RNG.normal(size=(n, p))
    y = np.where(x[:, 0] - 0.7 * x[:, 1] + 0.6 * RNG.normal(size=n) > 0.4, 1.0, -1.0)
    return x, y


def test_path_meets_the_conditions_of_a_minimum():
    x, y = _rows()
    weight = linear.balanced(y) / len(y)
    for mix in (1.0, 0.5, 0.1):
        top = linear.largest_penalty(x, y, weight, mix)
        strengths = top * np.geomspace(1.001, 1e-3, 12)
        path = linear.penalised_path(x, y, strengths, mix)
        assert not path[0, :-1].any() and path[1, :-1].any()
        for s, w in zip(strengths, path, strict=True):
            f = x @ w[:-1] + w[-1]
            slope = -(weight * y / (1 + np.exp(y * f)))
            g, b = x.T @ slope + s * (1 - mix) * w[:-1], slope.sum()
            on = w[:-1] != 0
            assert abs(b) < 1e-7
            assert np.abs(g[on] + s * mix * np.sign(w[:-1][on])).max(initial=0) < 1e-7
            assert (np.abs(g[~on]) <= s * mix + 1e-7).all()


def test_path_agrees_with_one_strength_alone():
    x, y = _rows()
    alone = linear.elastic_net_logistic(x, y, 0.03, 0.5, 20_000, 1e-12)
    assert np.allclose(linear.penalised_path(x, y, np.array([0.5, 0.1, 0.03]))[-1], alone, atol=1e-5)


def test_folds_choose_a_strength_that_predicts():
    x, y = _rows(200)
    strengths, lost, w = linear.chosen_penalty(x, y)
    assert len(strengths) == len(lost) == 20 and 0 < lost.argmin() and lost.min() < 0.9 * lost[0]
    more, truth = _rows(500)
    assert linear.balanced_accuracy(truth, np.where(np.column_stack((more, np.ones(500))) @ w > 0, 1.0, -1.0)) > 0.75
    assert linear.predict(linear.train(x, y, "enlr_path"), x).shape == y.shape


def test_paths_of_domains_and_splits_of_one_class(spark):
    x, y = _rows(60)
    rows = [(1, d, t, "train" if t % 2 else "test", (2 if y[t] > 0 else 1) if d == 1 else 1, x[t].tolist()) for d in (1, 2) for t in range(60)]
    frame = spark.createDataFrame(rows, "split int, domain int, trial_no int, role string, label int, v array<double>")
    got = alignment.penalty_paths(frame, ("split",)).collect()
    assert {r.domain for r in got} == {1} and len(got) == 20 and sum(r.chosen for r in got) == 1
    assert [r.acc for r in alignment.trained_at_scale(frame.where("domain = 2")).collect()] == [None]
    assert alignment.trained_at_scale(frame.where("false")).count() == 0
    assert alignment.trained_at_scale(frame.where("domain = 1")).first().acc > 0.6
