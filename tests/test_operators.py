"""Operators on small recordings, where plain Python can say what must come out."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwave.functions import alignment as al
from cohortwave.functions import covariances as cov
from cohortwave.functions import manifold
from cohortwave.jobs import alignment_queries as queries
from cohortwave.jobs import pipeline
from cohortwave.operators import alignment, covariance, features, markers, overlap, rejection, scans, selection, spectra, splits, trials
from cohortwave.sources import ascii as text
from cohortwave.sources import recordings

RNG = np.random.default_rng(2)
SAMPLES = "recording_id long, t long, stim int, x array<double>"


def _recording(spark, stim, x, rec=1):
    return spark.createDataFrame([(rec, i + 1, int(s), [float(c) for c in np.atleast_1d(v)]) for i, (s, v) in enumerate(zip(stim, x, strict=True))], SAMPLES)


def test_overlap_correction_recovers_planted_responses(spark):
    wl, n = 6, 400
    shape = {1: RNG.normal(size=wl), 2: RNG.normal(size=wl)}
    stim, x = np.zeros(n, int), np.zeros(n)
    for at in sorted(RNG.choice(n - wl, 90, replace=False)):
        stim[at] = RNG.integers(1, 3)
        x[at : at + wl] += shape[stim[at]]
    samples = _recording(spark, stim, x)
    marks = markers.stim_to_marks(samples, wl)
    cut = trials.extract(samples, trials.numbered(marks), wl)
    got = overlap.corrected_means(trials.lag_histogram(marks, wl), trials.toeplitz_rhs(cut, 1), wl).collect()
    assert len(got) == 2 * wl
    assert all(abs(r["mean"] - shape[r["class"]][r["dt"]]) < 1e-5 for r in got)


def _plain_reject(stim, x, wl, upper):
    value = np.log1p(np.abs(x))
    n, ranked = len(x), np.sort(value)
    m = ranked[n // 2 - wl - 1 : n // 2 + wl].mean()
    low = value[value > m / 100].min()
    high = m + (m - low) * upper
    clean = stim.copy()
    for bad in (lambda w: w.min() < low, lambda w: w.max() > high):
        s = 0
        while s + wl <= n:
            if clean[s] > 0 and bad(value[s : s + wl]):
                clean[s : s + wl] = 0
                s += wl
            else:
                s += 1
    return clean


def test_rejection_scan_equals_plain_loop(spark):
    for seed in range(3):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=300) ** 3
        x[rng.choice(300, 6)] = 0
        stim = rng.integers(0, 6, 300) * (rng.random(300) < 0.4)
        stim[stim > 2] = 0
        got = rejection.reject(_recording(spark, stim, x), 5, 1.5).orderBy("t").toPandas()
        assert got["clean"].tolist() == _plain_reject(stim, x, 5, 1.5).tolist()


def test_splits_are_stratified_and_disjoint(spark):
    rows = spark.createDataFrame([(1, i, 1 + (i % 3 == 0)) for i in range(1, 61)], "recording_id long, trial_no long, class int")
    for ratio in (10, 40, 50, 60, 90, None):
        got = splits.stratified(rows, 4, ratio).toPandas()
        assert got.groupby(["split", "trial_no"]).size().eq(1).all() and len(got) == 240
        share = 0.25 if ratio is None else min(ratio, 100 - ratio) / 100
        role = "train" if ratio is not None and ratio <= 50 else "test"
        for (_, c), own in got.groupby(["split", "class"]):
            assert (own.role == role).sum() == int((20 if c == 2 else 40) * share + 1e-9)
    for wrong in (0, 100):
        with pytest.raises(ValueError):
            splits.stratified(rows, 4, wrong)


def test_round_trips(spark, tmp_path):
    stim = [0, 1, 0, 2, 0, 0, 1, 0, 0, 0]
    samples = _recording(spark, stim, range(10))
    marks = markers.stim_to_marks(samples, 3)
    assert [r.stim for r in markers.marks_to_stim(samples, marks).orderBy("t").collect()] == stim
    assert markers.stim_to_marks(samples, 5).count() == 2
    shifted = markers.stim_to_marks(samples, 2, offset=1)
    assert [r.stim for r in markers.marks_to_stim(samples, shifted, offset=1).orderBy("t").collect()] == stim
    text.write_matrix(samples, str(tmp_path / "m"))
    assert sorted(r.x for r in text.read_matrix(spark, str(tmp_path / "m")).collect()) == [[float(i)] for i in range(10)]
    with pytest.raises(Exception, match="already exists"):
        text.write_matrix(samples, str(tmp_path / "m"))


def test_decimal_commas(spark):
    lines = spark.createDataFrame([(" 1,5\t-2  3.25 ",)], "line string")
    assert lines.select(text.numbers(F.col("line"))).first()[0] == [1.5, -2.0, 3.25]


def test_extraction_plans_one_equality_join(spark, small):
    from cohortwave.jobs.signal_queries import extract_trials

    plan = extract_trials(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_unknown_names_are_refused(spark):
    rows = spark.createDataFrame([], "recording_id long, trial_no long, class int, x array<array<double>>")
    with pytest.raises(ValueError):
        covariance.estimate(rows, "other")
    with pytest.raises(ValueError):
        selection.beyond(rows, 1.5)
    with pytest.raises(ValueError):
        spectra.sources(rows, np.eye(3), "other")
    with pytest.raises(ValueError):
        alignment.trained_alone(rows, (), "other")


def test_estimates_equal_expressions(spark, small):
    from cohortwave.jobs.signal_queries import line_trials

    cut = line_trials(spark, small)
    plain = {(r.recording_id, r.trial_no): r.c for r in covariance.moments(cut, 4).collect()}
    packed = covariance.packed_trials(cut)
    for r in covariance.estimate(packed, "scm").collect():
        assert np.allclose(r.c, plain[r.recording_id, r.trial_no])


def test_centred_features(spark):
    rows = spark.createDataFrame([(d, i, 1, [float(v) for v in RNG.normal(3, 1, 4)]) for d in (1, 2) for i in range(20)], "domain int, trial_no long, label int, v array<double>")
    got = features.centred(rows).toPandas()
    for _, own in got.groupby("domain"):
        v = np.stack(own["v"])
        assert np.allclose(v.mean(axis=0), 0) and np.isclose(np.linalg.norm(v, axis=1).mean(), 1)


def test_draws_correspond_across_equal_domains(spark):
    rows = spark.createDataFrame([(d, 100 * d + i, 1, [float(i)]) for d in (1, 2) for i in range(30)], "domain int, trial_no long, label int, v array<double>")
    got = features.draws(rows, 5, 7).toPandas()
    assert len(got) == 2 * 5 * 7
    again = features.draws(rows.repartition(3), 5, 7).toPandas()
    assert sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, again.to_numpy()))


def _planted_features(spark, domains=4, n=80):
    """Two classes in a shared space, each domain turned its own way."""
    rows = []
    for d in range(1, domains + 1):
        q = np.linalg.qr(RNG.normal(size=(6, 6)))[0]
        for i in range(n):
            label = i % 2 + 1
            v = RNG.normal(size=6) * np.array([1, 0.8, 0.6, 0.5, 0.4, 0.3]) + (label - 1.5) * np.array([2.0, -1, 1, 0, 0.5, 0])
            rows.append((1, d, 1, "train" if i < n // 2 else "test", i, label, [float(x) for x in q @ v]))
    return spark.createDataFrame(rows, "study int, domain long, split int, role string, trial_no long, label int, v array<double>")


def test_training_modes_on_planted_domains(spark):
    rows = _planted_features(spark)
    alone = alignment.trained_alone(rows, queries.GROUP).toPandas()
    assert alone.acc.mean() > 0.85
    packed = queries.study_means(rows)
    model = alignment.aligned(packed, queries.GROUP, 6)
    first = model.drop("b").toPandas()
    assert (first.after < first.before).all()
    applied = features.apply_model(rows, model, (*queries.GROUP, "domain"))
    assert {len(r.v) for r in applied.collect()} == {6}
    together = alignment.trained_together(applied, queries.GROUP).toPandas()
    assert len(together) == 4 and together.acc.between(0, 1).all()
    held = alignment.leave_one_out(packed, queries.GROUP, 6)
    assert held.count() == 16
    fast = alignment.trained_without(features.apply_models(rows, held.select(*queries.GROUP, "held_out", "domain", "b"), (*queries.GROUP, "domain")), queries.GROUP).toPandas()
    assert sorted(fast.domain) == [1, 2, 3, 4] and fast.acc.between(0, 1).all()
    assert alignment.trained_at_scale(rows).count() == 4


def test_tangent_features_have_the_columns_of_the_channels(spark, small):
    rows = queries.study_features(spark, small)
    assert {len(r.v) for r in rows.limit(50).collect()} == {8 * 4 - 6}
    assert rows.where("v is null").count() == 0


def test_summary_of_one_split_has_no_deviation(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.75)], "domain int, acc double")
    assert [(r.domain, r.deviation, r.place) for r in selection.accuracy_summary(rows).orderBy("place").collect()] == [(2, None, 1), (1, None, 2)]


def test_band_pass_and_sources(spark):
    t = np.arange(256)
    samples = _recording(spark, np.zeros(256), np.stack([np.sin(t / 3), np.ones(256)], axis=1))
    got = np.stack(scans.band_pass(samples, 2, 20, 128.0).orderBy("t").toPandas()["x"])
    assert np.abs(got[:, 1]).max() < 1e-6 and got[:, 0].std() > 0.3
    field = RNG.normal(size=(5, 24))
    planted = [field[:, 3 * v : 3 * v + 3] @ RNG.normal(size=3) for v in range(8)]
    found = spectra.sources(_recording(spark, np.zeros(8), planted), field, "sloreta", 1e-9).orderBy("t").collect()
    assert len(found) == 8 and all(1 <= r.voxel <= 8 for r in found)


def test_recordings_from_files(spark, tmp_path):
    import yaml

    for stem, subject in (("subject_01_session_01", 1), ("subject_02_session_01", 2), ("alone", None)):
        np.savez(tmp_path / f"{stem}.npz", data=np.arange(12.0).reshape(6, 2) + (subject or 0), stim=[0, 1, 0, 2, 0, 0])
        if subject:
            meta = {"id": {"subject": subject, "session": 1, "run": 1, "database": "db"}, "acquisition": {"samplingrate": 512, "sensors": ["Fz", "Cz"]}, "stim": {"labels": {"NonTarget": 1, "Target": 2}, "windowlength": 512, "offset": 0}}
            (tmp_path / f"{stem}.yml").write_text(yaml.safe_dump(meta))
    (tmp_path / "note.TXT").write_text("x")
    assert {r.stem for r in recordings.list_recordings(spark, str(tmp_path)).collect()} == {"subject_01_session_01", "subject_02_session_01"}
    assert [r.name for r in recordings.list_files(spark, str(tmp_path), ".txt").collect()] == ["note.TXT"]
    rows = recordings.read_samples(spark, str(tmp_path), block=4)
    assert rows.count() == 12 and sorted(r.t for r in rows.where("stim > 0").collect()) == [2, 2, 4, 4]
    assert rows.where("stem = 'subject_02_session_01' and t = 6").first().x == [12.0, 13.0]
    meta = recordings.read_metadata(spark, str(tmp_path)).orderBy("subject").collect()
    assert [(m.subject, m.sensors, m.labels["Target"], m.window_length) for m in meta] == [(1, ["Fz", "Cz"], 2, 512), (2, ["Fz", "Cz"], 2, 512)]


def test_pipelines_leave_their_context_alone(spark, small):
    from cohortwave.sources.tables import line_samples

    samples = line_samples(spark, small).where("recording_id < 3")
    config = pipeline.Config(window=8, channels=4, n_splits=2, n_boot=20, boot_size=10, white_dim=8, study=4)
    context = {"samples": samples}
    done = pipeline.run(pipeline.GROUP_PIPELINE, config, context)
    assert set(context) == {"samples"}
    summary = done["summary"].toPandas()
    assert sorted(summary["mode"].unique()) == ["alone", "together"] and summary["mean"].between(0, 1).all()
    held = pipeline.run(pipeline.HELD_OUT_PIPELINE, config, context)["summary"].toPandas()
    assert sorted(held.domain) == [0, 1, 2]
    folds = alignment.cross_validated(done["vectors"].where("role = 'train'"), queries.GROUP, 4).toPandas()
    assert len(folds) == 6 and folds.acc.between(0, 1).all()


def test_canonical_ranking_takes_whole_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3, 300, 12))
    x[1, :, 10] = x[0, :, 11] + 0.1 * rng.normal(size=300)  # the tie lies beyond the eighth coordinate
    frame = spark.createDataFrame([(1, d + 1, w.tolist()) for d, w in enumerate(x)], "seed int, domain int, w array<array<double>>")
    got = {(r.target, r.source): (r.correlation, r.place) for r in alignment.canonical_ranking(frame, ("seed",)).collect()}
    for (t, s), (value, _) in got.items():
        a, b = (x[k - 1] - x[k - 1].mean(axis=0) for k in (t, s))
        squares = np.linalg.eigvals(np.linalg.solve(a.T @ a, a.T @ b) @ np.linalg.solve(b.T @ b, b.T @ a)).real
        assert np.isclose(value, np.sqrt(squares.max()))
    assert got[1, 2][0] > 0.9 and got[1, 2][1] == got[2, 1][1] == 1


def test_source_ranking_has_columns_for_whole_vectors(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no generated tables here")
    groups = {(r.seed, r.domain): np.stack(r.w) for r in queries.embedding_groups(spark, folder, 320).collect()}
    assert all(w.shape == (640, 64) for w in groups.values())
    for r in queries.cca_rank_sources(spark, folder).collect():
        a, b = (np.linalg.qr(w - w.mean(axis=0))[0] for w in (groups[r.seed, r.target], groups[r.seed, r.source]))
        assert np.isclose(r.correlation, np.linalg.svd(a.T @ b, compute_uv=False)[0]) and r.correlation < 0.999


def test_short_recordings_are_not_rejected(spark):
    from cohortwave.operators import rejection

    rows = [(1, t, int(t in (2, 5)), [float(t)]) for t in range(1, 9)]
    frame = spark.createDataFrame(rows, "recording_id long, t long, stim int, x array<double>")
    assert [r.clean for r in rejection.reject(frame, 8).orderBy("t").collect()] == [r[2] for r in rows]


def test_downsampling_takes_block_means(spark):
    from cohortwave.operators import markers

    frame = spark.createDataFrame([(1, t, 2 if t == 6 else 0, [float(t), 1.0]) for t in range(1, 11)], "recording_id long, t long, stim int, x array<double>")
    got = [(r.t, r.stim, r.x) for r in markers.downsample(frame, 4, 2).orderBy("t").collect()]
    assert got == [(1, 0, [2.5, 1.0]), (2, 2, [6.5, 1.0])]


def test_no_accuracy_without_rows_to_train_on(spark):
    from cohortwave.operators import alignment

    rows = [(1, 1, "test", i, 1 + i % 2, [float(i)]) for i in range(4)] + [(1, 2, role, i, 1 + i % 2, [float(i % 2)]) for i in range(4) for role in ("train", "test")]
    frame = spark.createDataFrame(rows, "study int, domain int, role string, trial_no int, label int, v array<double>")
    assert {r.domain: r.acc for r in alignment.trained_alone(frame, ("study",)).collect()} == {1: None, 2: 1.0}


def _trial_frames(spark, seed=5, channels=3, wl=6, n=14):
    rng = np.random.default_rng(seed)
    x = {(r, k): rng.normal(size=(wl, channels)) for r in (1, 2) for k in range(1, n + 1)}
    label = lambda k: 1 + k % 2
    rows = [(r, k, label(k), d, [float(c) for c in v]) for (r, k), w in x.items() for d, v in enumerate(w)]
    cut = spark.createDataFrame(rows, "recording_id long, trial_no long, class int, dt int, x array<double>")
    sets = [(r, k, label(k), s, "train" if (k + s) % 3 else "test") for r, k in x for s in (1, 2)]
    return x, label, cut, sets, spark.createDataFrame(sets, "recording_id long, trial_no long, class int, split int, role string")


def test_tangent_features_equal_a_plain_loop(spark):
    x, label, cut, sets, frame = _trial_frames(spark)
    packed = covariance.packed_trials(cut)
    for with_prototype in (True, False):
        made = alignment.prototypes(cut, frame, 2, 3) if with_prototype else None
        for name, make, det in (("lw", cov.ledoit_wolf, False), ("scm", cov.scm, False), ("oas", cov.oas, True), ("nrtme", cov.regularised_tyler, False)):
            if with_prototype and name == "scm":
                continue  # six samples of six channels: singular
            got = {(r.recording_id, r.split, r.role, r.trial_no): r.v for r in alignment.tangent_features(packed, made, frame, 3, name, det).collect()}
            assert len(got) == len(sets)
            for rec in (1, 2):
                for split in (1, 2):
                    p = np.mean([x[rec, k] for r, k, c, s, role in sets if (r, s, role, c) == (rec, split, "train", 2)], axis=0)
                    for role in ("train", "test"):
                        own = [k for r, k, c, s, o in sets if (r, s, o) == (rec, split, role)]
                        c = make(np.stack([np.hstack((x[rec, k], p)) if with_prototype else x[rec, k] for k in own]))
                        c = cov.unit_determinant(c) if det else c
                        want = manifold.tangent_vectors(c, manifold.fisher_mean(c), 3)
                        assert np.allclose([got[rec, split, role, k] for k in own], want, atol=1e-7)


def test_covariances_need_a_prototype_of_their_split(spark):
    _, _, cut, sets, frame = _trial_frames(spark)
    made = alignment.prototypes(cut, frame.where("split = 1"), 2, 3)
    got = alignment.super_covariances(covariance.packed_trials(cut), made, frame).collect()
    assert {r.split for r in got} == {1} and len(got) == len(sets) / 2
    with pytest.raises(ValueError):
        alignment.super_covariances(cut, made, frame, "other")


def test_prototype_options(spark):
    wl, n = 4, 300
    rng = np.random.default_rng(8)
    shape = {1: rng.normal(size=(wl, 2)), 2: rng.normal(size=(wl, 2))}
    stim, x = np.zeros(n, int), np.zeros((n, 2))
    for at in sorted(rng.choice(n - wl, 70, replace=False)):
        stim[at] = rng.integers(1, 3)
        x[at : at + wl] += shape[stim[at]]
    samples = _recording(spark, stim, x)
    numbered = trials.numbered(markers.stim_to_marks(samples, wl))
    cut = trials.extract(samples, numbered, wl)
    whole = numbered.select("recording_id", "trial_no", "class", F.lit(1).alias("split"), F.lit("train").alias("role"))
    freed = np.array(alignment.prototypes(cut, whole, 2, 2, wl=wl).first().p)
    assert np.abs(freed - shape[2]).max() < 1e-5
    plain = np.array(alignment.prototypes(cut, whole, 2, 2).first().p)
    assert np.abs(plain - shape[2]).max() > 0.1  # windows overlap
    own = [x[t : t + wl] for t in np.flatnonzero(stim == 2) if t + wl <= n]
    w = np.array([1 / (v**2).sum() for v in own])
    weighted = np.array(alignment.prototypes(cut, whole, 2, 2, adaptive=True).first().p)
    assert np.allclose(weighted, np.tensordot(w / w.sum(), own, 1))
    one = np.array(alignment.prototypes(cut, whole, 2, 2, components=1).first().p)
    vector = np.linalg.eigh(cov.scm(plain))[1][:, -1:]
    assert np.allclose(np.abs(one), np.abs(plain @ vector))
    with pytest.raises(ValueError):
        alignment.prototypes(cut, whole, 2, 2, components=3)


def test_adaptive_mean_equals_weights_joined(spark, small):
    from cohortwave.jobs import signal_queries

    rows = signal_queries.line_trials(spark, small)
    key = lambda r: (r.recording_id, r["class"], r.dt, r.channel)
    want = {key(r): r.mean for r in trials.class_mean(rows, trials.adaptive_weights(rows)).collect()}
    for channels in (None, 4):
        got = {key(r): r.mean for r in trials.adaptive_mean(rows, channels=channels).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_trial_of_zeros_has_no_weight(spark):
    rows = [(1, 1, 1, 0, [0.0]), (1, 1, 1, 1, [0.0]), (1, 2, 1, 0, [2.0]), (1, 2, 1, 1, [4.0])]
    cut = spark.createDataFrame(rows, "recording_id long, trial_no long, class int, dt int, x array<double>")
    assert sorted((r.dt, r.mean) for r in trials.adaptive_mean(cut, channels=1).collect()) == [(0, 2.0), (1, 4.0)]
    assert {r.trial_no: r.weight for r in trials.adaptive_weights(cut).collect()} == {1: None, 2: 1.0}


def test_orthogonal_alignment_finds_shared_components():
    rng = np.random.default_rng(4)
    hidden = rng.normal(size=(3, 400)) * np.array([[3.0], [2.0], [1.0]])
    turns = [np.linalg.qr(rng.normal(size=(6, 6)))[0][:, :3] for _ in range(4)]
    t = [q @ hidden + 0.01 * rng.normal(size=(6, 400)) for q in turns]
    found = al.orthogonal_alignment(t, 3)
    for u, x in zip(found.u, t, strict=True):
        assert np.allclose(u.T @ u, np.eye(3), atol=1e-9)
        assert np.corrcoef(u[:, 0] @ x, hidden[0])[0, 1] ** 2 > 0.98
    first = found.u[0].T @ t[0]
    assert all((np.einsum("ka,ka->k", first, u.T @ x) > 0).all() for u, x in zip(found.u, t, strict=True))
    # two domains: the singular vectors of their cross-covariance
    pair = al.orthogonal_alignment(t[:2], 3, tol=1e-14)
    left = np.linalg.svd(t[0] @ t[1].T)[0][:, :3]
    assert np.allclose(np.abs(left.T @ pair.u[0]), np.eye(3), atol=1e-2)


def test_domain_pairs_are_all_pairs_once(spark):
    frame = spark.createDataFrame([(g, d, [[float(d)]]) for g in (1, 2) for d in (3, 4, 5)], "seed int, domain int, w array<array<double>>")
    got = sorted((r.seed, r.domain_a, r.domain_b, r.a[0][0], r.b[0][0]) for r in features.domain_pairs(frame, ("seed",)).collect())
    assert got == [(g, a, b, float(a), float(b)) for g in (1, 2) for a in (3, 4, 5) for b in (3, 4, 5) if b < a]
    assert features.domain_pairs(frame, ("seed",), ordered=True).count() == 12


def test_cached_stage_runs_once_for_each_configuration(spark, tmp_path):
    runs = []

    def stage(config, context):
        runs.append(config.seed)
        return {"out": context["samples"].withColumn("seed", F.lit(config.seed))}

    context = {"samples": spark.range(3).toDF("t")}
    kept = pipeline.cached(stage, f"file://{tmp_path}/kept", "out")
    for seed in (1, 1, 2, 1):
        got = pipeline.run([kept], pipeline.Config(seed=seed), context)["out"]
        assert sorted((r.t, r.seed) for r in got.collect()) == [(0, seed), (1, seed), (2, seed)]
    assert runs == [1, 2]
    for mark in tmp_path.glob("kept/*/out/_SUCCESS"):
        mark.unlink()
    pipeline.run([kept], pipeline.Config(seed=2), context)
    assert runs == [1, 2, 2]


def test_text_files_by_line_row_range_and_ordinal(spark, tmp_path):
    samples = _recording(spark, [0] * 6, range(6))
    paths = [str(tmp_path / name) for name in "abc"]
    for path, ends in zip(paths, ((1, 2), (3, 4), (5, 9)), strict=True):
        text.write_matrix(samples, path, between=ends)
    got = text.read_matrices(spark, paths, skip=(2,)).collect()
    assert sorted((r.file, r.x) for r in got) == [(1, [0.0]), (1, [1.0]), (3, [4.0]), (3, [5.0])]
    assert text.read_matrices(spark, paths, skip=(1, 2, 3)).collect() == []
    text.write_lines(spark.createDataFrame([("Fz",), (None,)], "value string").coalesce(1), str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["Fz", ""]
    text.write_vector(spark.createDataFrame([(" 1 2 ",)], "value string"), str(tmp_path / "vector"))
    assert [r.value for r in spark.read.text(str(tmp_path / "vector")).collect()] == ["12"]
    with pytest.raises(Exception, match="already exists"):
        text.write_lines(spark.createDataFrame([("x",)], "value string"), str(tmp_path / "lines"))


def test_folders_xml_and_first_files(spark, tmp_path):
    for name in ("db_a", "db_b", "other"):
        (tmp_path / name).mkdir()
    (tmp_path / "db_file").write_text("x")
    assert [r.name for r in recordings.list_folders(spark, str(tmp_path), "db").collect()] == ["db_a", "db_b"]
    (tmp_path / "montage.xml").write_text("<all><channel><name>Fz</name><place>1</place></channel><channel><name>Cz</name></channel></all>")
    found = recordings.read_xml(spark, str(tmp_path / "montage.xml"), "channel", "name string, place int").collect()
    assert sorted((r.name, r.place) for r in found) == [("Cz", None), ("Fz", 1)]
    files = spark.createDataFrame([("b", 2, 1, 1), ("a", 1, 1, 1), ("c", 3, 1, 1)], "stem string, subject int, session int, run int")
    assert [r.stem for r in recordings.info(files, 2).collect()] == ["a", "b"]
    assert recordings.info(files, 0).count() == 3


def test_amplitude_of_a_tone_and_shape_of_trials(spark):
    wl, rate = 32, 32.0
    tone = np.stack([3 * np.sin(2 * np.pi * 8 * np.arange(wl) / rate + 0.7), np.zeros(wl)], axis=1)
    packed = spark.createDataFrame([(1, 1, k, [[float(c) for c in row] for row in tone]) for k in range(3)], "recording_id long, class int, trial_no long, x array<array<double>>")
    got = spectra.time_frequency(packed, wl, 2, rate, 4.0, 12.0, smoothing=False).collect()
    assert len(got) == 3 * wl * 2 and {(r.band, r.frequency) for r in got} == {(1, 4.0), (2, 8.0), (3, 12.0)}
    assert all(abs(r.amplitude - (3.0 if r.frequency == 8.0 and r.channel == 1 else 0.0)) < 1e-9 for r in got)
    with pytest.raises(Exception, match="a trial of 32 samples"):
        spectra.time_frequency(packed, 16, 2, rate, 4.0).collect()


def test_separation_finds_planted_sources(spark):
    rng, channels, wl = np.random.default_rng(8), 3, 64
    mixing = rng.normal(size=(channels, channels))
    t = np.arange(wl)
    rows = []
    for k in range(60):
        source = np.stack([np.sin(2 * np.pi * f * t / wl + rng.uniform(0, 6.3)) for f in (5, 11, 19)], axis=1) + 0.05 * rng.normal(size=(wl, channels))
        source[:, 1] += np.exp(-((t - 20) ** 2) / 20)
        rows += [(1, k, 1, int(d), v.tolist()) for d, v in enumerate(source @ mixing.T)]
    cut = spark.createDataFrame(rows, "recording_id long, trial_no long, class int, dt int, x array<double>")
    means = trials.wide_mean(trials.class_mean(cut, channels=channels))
    got = spectra.separated(spectra.mean_cospectra(covariance.packed_trials(cut), wl, channels), means, channels).orderBy("component").collect()
    found = np.array([r["pattern"] for r in got])
    like = np.abs(found / np.linalg.norm(found, axis=1, keepdims=True) @ (mixing / np.linalg.norm(mixing, axis=0)))
    assert sorted(like.argmax(axis=1)) == [0, 1, 2] and like.max(axis=1).min() > 0.99
    assert like[0].argmax() == 1 and got[0]["ratio"] > got[1]["ratio"] >= got[2]["ratio"]
    empty = spectra.separated(spectra.mean_cospectra(covariance.packed_trials(cut), wl, channels), means.where("false"), channels)
    assert empty.collect() == []
