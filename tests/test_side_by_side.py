"""Alignments and penalty paths that are solved side by side against each alone."""

import numpy as np

from cohortwave.functions import alignment as al
from cohortwave.functions import linear
from cohortwave.operators import alignment

RNG = np.random.default_rng(21)


def _plain_alignment(t, tol, rounds=2500):
    """Domain by domain, each R made."""
    m, d = len(t), len(t[0])
    u, last = [np.eye(d) for _ in t], None
    for done in range(1, rounds + 1):
        for i in 2 * list(range(m)):
            v = [t[i] @ t[j].T @ u[j] for j in range(m) if j != i]
            r = [sum(np.outer(x[:, k], x[:, k]) for x in v) for k in range(d)]
            total = sum(r)
            y = np.linalg.solve(total + 1e-12 * np.trace(total) * np.eye(d), np.stack([r[k] @ u[i][:, k] for k in range(d)], axis=1))
            u[i] = y / np.sqrt([y[:, k] @ r[k] @ y[:, k] for k in range(d)])
        level = sum((f**2).sum() for f in u) / (2 * d * d * m)
        change, last = 1.0 if last is None else abs((level - last) / last), level
        if change <= tol:
            break
    return np.stack(u), done


def test_alignments_side_by_side():
    groups = []
    for m in (3, 4, 3, 3):  # domains that share four sources
        shared = RNG.normal(size=(4, 60)) * np.array([4, 3, 2, 1])[:, None]
        groups.append(al.whiten([RNG.normal(size=(6, 4)) @ shared + 0.3 * RNG.normal(size=(6, 60)) for _ in range(m)], "svd", 4)[0])
    found = al.joint_alignments(groups, tol=1e-7)
    for t, one in zip(groups, found, strict=True):
        u, rounds = _plain_alignment(t, 1e-7)
        assert one.rounds == rounds and np.allclose(one.u, u, atol=1e-8)
    assert len({f.rounds for f in found}) > 1
    assert [f.rounds for f in al.joint_alignments(groups, tol=0.0, rounds=3)] == [3] * 4


def test_leave_one_out_by_parts(spark, monkeypatch):
    """The same filters whether a task holds out one domain, two, or all."""
    rows = [(g, d, RNG.normal(size=(20, 6)).tolist()) for g in (1, 2) for d in range(5)]
    packed = spark.createDataFrame(rows, "study int, domain int, w array<array<double>>")
    key = lambda f: {(r.study, r.held_out, r.domain): (r.rounds, np.array(r.b)) for r in f.collect()}
    found = []
    for held in (1, 2, 8):
        monkeypatch.setattr(alignment, "HELD", held)
        found.append(key(alignment.leave_one_out(packed, ("study",), 4)))
    assert all(len(f) == 2 * 5 * 5 for f in found)
    for other in found[1:]:
        assert all(other[k][0] == n and np.allclose(other[k][1], b, atol=1e-8) for k, (n, b) in found[0].items())


def test_penalty_paths_side_by_side():
    problems = []
    for n in (30, 44, 38):
        x = RNG.normal(size=(n, 5))
        problems.append((x, np.where(x[:, 0] + RNG.normal(size=n) > 0, 1.0, -1.0)))
    strengths = np.stack([top * np.geomspace(1, 1e-3, 8) for top in (0.3, 0.2, 0.4)])
    found = linear.penalised_paths(problems, strengths)
    for (x, y), s, w in zip(problems, strengths, found, strict=True):
        assert np.allclose(w, linear.penalised_path(x, y, s), atol=1e-7)


def test_penalties_of_all_domains_of_a_group(spark):
    rows, sets = [], {}
    for d in range(4):
        x = RNG.normal(size=(24, 3))
        label = np.where(x[:, 0] + RNG.normal(size=24) > 0, 2, 1) if d else np.ones(24, int)
        sets[d] = (x, np.where(label == 2, 1.0, -1.0))
        rows += [(1, d, i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, label, strict=True))]
    frame = spark.createDataFrame(rows, "study int, domain int, trial_no int, label int, v array<double>")
    for by in (("study",), ()):
        got = alignment.penalty_paths(frame, by).toPandas()
        assert sorted(got["domain"].unique()) == [1, 2, 3] and len(got) == 60
        for d in (1, 2, 3):
            strengths, lost, _ = linear.chosen_penalty(*sets[d])
            own = got[got["domain"] == d].sort_values("step")
            assert np.allclose(own["strength"], strengths) and np.allclose(own["deviance"], lost) and own["chosen"].tolist() == [i == lost.argmin() for i in range(20)]
