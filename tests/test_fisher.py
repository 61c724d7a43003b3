"""Fisher means by rounds over the rows, and in bins, against the plain mean."""

import numpy as np
import pytest

from cohortwave.functions import covariances as cov
from cohortwave.functions import manifold
from cohortwave.operators import fisher

RNG = np.random.default_rng(8)


def _groups(spark, sizes, n=4):
    c, rows = {}, []
    for g, size in enumerate(sizes):
        x = RNG.normal(size=(size, 12, n)) * RNG.uniform(0.3, 3, size=(size, 1, n))
        c[g] = cov.scm(x)
        rows += [(g, i, 1 + (i % 3 == 0), cov.pack(m).tolist()) for i, m in enumerate(c[g])]
    return c, spark.createDataFrame(rows, "g int, i int, label int, c array<double>").repartition(4)


@pytest.mark.parametrize("most", [0, 30, 10_000])
def test_vectors_at_weighted_means(spark, most):
    c, rows = _groups(spark, (1, 5, 25, 60))
    weighted = fisher.class_weights(rows, ("g",))
    got = fisher.tangent_vectors(weighted, rows.groupBy("g").count(), ("g",), ("i", "label"), 3, most=most).toPandas()
    assert len(got) == 91
    for g, own in c.items():
        label = np.array([1 + (i % 3 == 0) for i in range(len(own))])
        w = 1 / np.array([(label == v).sum() for v in label])
        want = manifold.tangent_vectors(own, manifold.fisher_mean(own, w, tol=1e-12), 3)
        mine = got[got.g == g].sort_values("i")
        assert mine["label"].tolist() == label.tolist() and np.allclose(np.stack(mine["v"]), want, atol=1e-6)


def test_a_mean_of_many_rows_is_found_without_gathering_them(spark):
    # commuting matrices: the mean is that of the logarithms
    logs = RNG.normal(size=(20_000, 3))
    turn = np.linalg.qr(RNG.normal(size=(3, 3)))[0]
    rows = [(1, cov.pack(turn @ np.diag(np.exp(v)) @ turn.T).tolist(), 1.0) for v in logs]
    frame = spark.createDataFrame(rows, "g int, c array<double>, weight double").repartition(8).cache()
    (base,) = fisher.base_points(frame, ("g",), 3).collect()
    root = cov.unpack(np.array(base.root))
    assert np.allclose(root @ root, turn @ np.diag(np.exp(logs.mean(axis=0))) @ turn.T, atol=1e-8)
    assert np.allclose(cov.unpack(np.array(base.back)) @ root, np.eye(3), atol=1e-8)


def test_runs_side_by_side_equal_one_at_a_time():
    c = cov.scm(RNG.normal(size=(30, 20, 5)))
    w = RNG.uniform(0.2, 2, 30)
    start = np.array([0, 3, 4, 17])
    means, logs = manifold.fisher_maps(c, start, w)
    for mean, a, b in zip(means, start, [*start[1:], 30], strict=True):
        assert np.allclose(mean, manifold.fisher_mean(c[a:b], w[a:b]), atol=1e-7)
        assert np.allclose(manifold.vectorised(logs[a:b], 2), manifold.tangent_vectors(c[a:b], mean, 2), atol=1e-6)


def test_nearest_mean_equals_a_plain_loop(spark):
    c, rows = _groups(spark, (24, 40))
    train, test = rows.where("i % 2 = 0"), rows.where("i % 2 = 1").withColumnRenamed("label", "truth")
    got = {(r.g, r.i): (r.predicted, r.distance) for r in fisher.nearest_mean(train, test, ("g",), ("i", "truth"), 4).collect()}
    assert len(got) == 32
    for g, own in c.items():
        label = np.array([1 + (i % 3 == 0) for i in range(len(own))])
        learned = np.arange(len(own)) % 2 == 0
        means = {v: manifold.fisher_mean(own[learned & (label == v)]) for v in (1, 2)}
        for i in range(1, len(own), 2):
            far = {v: np.sqrt((np.log(np.linalg.eigvals(np.linalg.solve(m, own[i])).real) ** 2).sum()) for v, m in means.items()}
            best = min(far, key=lambda v: (far[v], v))
            assert got[g, i][0] == best and abs(got[g, i][1] - far[best]) < 1e-6
