"""A stream that is replayed, and stopped on the way, fits what the table fits."""

import numpy as np

from cohortwave.operators import alignment
from cohortwave.streaming import fitting

RNG = np.random.default_rng(44)
SCHEMA = "domain int, trial_no long, label int, v array<double>"


def _rows(domains, trials=160, size=6):
    turn = {d: np.linalg.qr(RNG.normal(size=(size, size)))[0] for d in domains}
    rows = []
    for d in domains:
        for t in range(trials):
            v = RNG.normal(size=size) * 0.3 + np.eye(size)[t % 2] * 2
            rows.append((d, t, 1 + t % 2, (turn[d] @ v).tolist()))
    return rows


def test_replayed_stream_equals_the_batch_fit(spark, tmp_path):
    rows, bins = _rows((1, 2, 3, 8, 9)), 5
    group = fitting.complete(fitting.running_means(spark.createDataFrame([r for r in rows if r[0] < 4], SCHEMA), 6, bins), 2, bins)
    new = [r for r in rows if r[0] > 4]
    source, out, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    frame = lambda part: spark.createDataFrame(part, SCHEMA)
    want = {}
    for step in range(3):  # each step is a stop and a restart
        frame(new[step::3]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        fitting.fit_stream(stream, group, out, mark, 6, 2, bins, 1, 4).awaitTermination()
        so_far = fitting.complete(fitting.running_means(frame([r for k in range(step + 1) for r in new[k::3]]), 6, bins), 2, bins)
        want = {r.domain: np.array(r.b) for r in alignment.fitted(so_far, group, 4).collect()}
        got = {r.domain: np.array(r.b) for r in fitting.models(spark, out).collect()}
        assert sorted(got) == sorted(want) == [8, 9]
        assert all(np.allclose(got[d], want[d], atol=1e-6) for d in got)
    held = alignment.leave_one_out(group.unionByName(so_far.where("domain = 8")).selectExpr("0 AS g", "domain", "w"), ("g",), 4)
    (same,) = held.where("held_out = 8 AND domain = 8").collect()
    assert np.allclose(want[8], np.array(same.b), atol=1e-6)


def test_a_domain_waits_until_enough_has_come(spark):
    means = spark.createDataFrame([(1, lab, b, 3 if (lab, b) != (2, 1) else 1, [1.0]) for lab in (1, 2) for b in (0, 1)], "domain int, label int, bin int, n long, v array<double>")
    assert fitting.complete(means, 2, 2, 1).count() == 1 and fitting.complete(means, 2, 2, 2).count() == 0
