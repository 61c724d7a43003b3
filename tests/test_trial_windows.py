"""Windows cut from blocks against windows joined to their samples."""

import numpy as np
import pytest

from cohortwave.operators import markers, trials


@pytest.mark.parametrize(("wl", "offset", "width"), [(4, 0, 4096), (4, 0, 4), (5, 3, 7), (5, -2, 6), (9, 0, 8), (1, 0, 3)])
def test_windows_equal_those_of_the_join(spark, wl, offset, width):
    rng = np.random.default_rng(3)
    rows = []
    for rec, n in ((1, 40), (2, 3), (3, 64), (4, 25)):
        for t in range(1, n + 1):
            if rec != 4 or t % 6:  # the last one has gaps
                rows.append((rec, t, int(rng.integers(0, 3)), rng.normal(size=2).tolist()))
    rng.shuffle(rows)
    samples = spark.createDataFrame([(int(r), int(t), int(s), list(map(float, x))) for r, t, s, x in rows], "recording_id long, t long, stim int, x array<double>")
    marks = trials.numbered(markers.stim_to_marks(samples, wl, offset))
    want = {tuple(r[:5]): r.x for r in trials.extract(samples, marks, wl).collect()}
    packed = trials.packed_windows(samples, wl, offset, width)
    got = trials.unpacked(packed).select("recording_id", "trial_no", "class", "onset", "dt", "x").collect()
    whole = [r for r in got if r.recording_id != 4]
    assert len(whole) > 20 and {tuple(r[:5]): r.x for r in whole} == {k: v for k, v in want.items() if k[0] != 4}
    cells = lambda rows: sorted((r[1], r[2], r[3], x) for r, x in rows)
    assert cells((r, r.x) for r in got if r.recording_id == 4) == cells((k, v) for k, v in want.items() if k[0] == 4)


def test_windows_are_cut_without_a_join(spark, small):
    from cohortwave.jobs.signal_queries import packed_line_trials

    plan = packed_line_trials(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_weights_of_packed_trials(spark):
    x = np.random.default_rng(4).normal(size=(5, 3, 2))
    x[2] = 0
    packed = spark.createDataFrame([(1, i, 1, v.tolist()) for i, v in enumerate(x)], "recording_id long, trial_no long, class int, x array<array<double>>")
    key = lambda rows: {(r.trial_no, r.dt): (r.weight, r.x) for r in rows.select("trial_no", "dt", "weight", "x").collect()}
    got, want = key(trials.unpacked(trials.powered(packed))), key(trials.powered(trials.unpacked(packed)))
    assert got.keys() == want.keys() and got[2, 0][0] is None
    assert all(got[k][1] == want[k][1] and (got[k][0] == want[k][0] or abs(got[k][0] / want[k][0] - 1) < 1e-12) for k in want)
