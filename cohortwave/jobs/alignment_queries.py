"""Queries on features, bootstraps, alignment and training, each beside its SQL where SQL can say it."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import alignment, covariance, features, fisher, markers, spectra, splits, trials
from ..operators.selection import balanced_accuracy
from ..sources import recordings
from ..sources.stored import shared_path
from ..sources.tables import EMBEDDING_FEATURES, LINE_SAMPLES, embedding_features, line_samples
from ..functions import filters
from . import pipeline
from .signal_queries import _trials, packed_line_trials

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WL, CHANNELS, N_BOOT, BOOT_SIZE = 8, 4, 12, 25
#: Recordings of one study: the group that is aligned together.
STUDY = 8
GROUP = ("study", "split")


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def study_features(spark, sf_dir: str) -> DataFrame:
    """(study, domain, split, role, trial_no, label, v): tangent features of the line-item recordings, null where a trial has none."""
    samples = line_samples(spark, sf_dir)
    numbered = trials.numbered(markers.stim_to_marks(samples, WL))
    cut = trials.packed_windows(samples, WL)
    sets = splits.stratified(numbered, 2, 50, seed=1)
    found = alignment.tangent_features(cut, alignment.prototypes(cut, sets, 2, CHANNELS), sets, CHANNELS)
    study = F.floor(F.col("recording_id") / STUDY).cast("int")
    return found.select(study.alias("study"), F.col("recording_id").alias("domain"), "split", "role", "trial_no", "label", "v")


def study_means(rows: DataFrame) -> DataFrame:
    """Packed bootstrap means of the training features of every (study, split, domain)."""
    train, own = rows.where("role = 'train' and v is not null"), (*GROUP, "domain")
    drawn = features.draws(train, 40, 10, seed=1, by=own)
    return alignment.packed_means(features.bootstrap_vectors(train, drawn, own), GROUP)


def embedding_means(spark, sf_dir: str) -> DataFrame:
    rows = embedding_features(spark, sf_dir)
    return features.bootstrap_vectors(rows, features.draws(rows, N_BOOT, BOOT_SIZE, seed=7), size=64)


def embedding_groups(spark, sf_dir: str, n_boot: int = 60) -> DataFrame:
    """Packed means of three bootstrap seeds: each seed is one group of domains."""
    rows = embedding_features(spark, sf_dir)
    parts = [features.bootstrap_vectors(rows, features.draws(rows, n_boot, BOOT_SIZE, seed=s), size=64).withColumn("seed", F.lit(s)) for s in (1, 2, 3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return alignment.packed_means(whole, ("seed",))


DRAWS = f"""{EMBEDDING_FEATURES}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY ('0x' || substr(md5(trial_no::VARCHAR), 1, 12))::BIGINT % {features.PARTS}, trial_no) AS place,
    count(*) OVER (PARTITION BY domain, label) AS n FROM features
), wanted AS (
  SELECT c.domain, c.label, b.boot, d.draw, ('0x' || substr(md5('7|' || b.boot || '|' || d.draw), 1, 12))::BIGINT % c.n + 1 AS place
  FROM (SELECT DISTINCT domain, label, n FROM placed) c CROSS JOIN (SELECT unnest(range(1, {N_BOOT + 1}))::INT AS boot) b CROSS JOIN (SELECT unnest(range(1, {BOOT_SIZE + 1}))::INT AS draw) d
), drawn AS (
  SELECT w.domain, w.label, w.boot, w.draw, p.trial_no, p.v FROM wanted w JOIN placed p USING (domain, label, place)
), means AS (
  SELECT domain, label, boot, c.coord::INT AS coord, avg(v[c.coord]) AS mean FROM drawn CROSS JOIN (SELECT unnest(range(1, 65)) AS coord) c GROUP BY domain, label, boot, c.coord
)"""


@query(f"WITH {DRAWS} SELECT domain, label, boot, draw, trial_no FROM drawn")
def bootstrap_draws(spark, sf_dir):
    return features.draws(embedding_features(spark, sf_dir), N_BOOT, BOOT_SIZE, seed=7)


@query(f"WITH {DRAWS} SELECT domain, label, boot, coord, round(mean, 8) AS mean FROM means")
def bootstrap_means(spark, sf_dir):
    rows = embedding_means(spark, sf_dir).select("domain", "label", "boot", F.posexplode("v").alias("coord", "mean"))
    return rows.withColumns({"coord": F.col("coord") + 1, "mean": F.round("mean", 8)})


@query(f"""WITH {DRAWS}
SELECT a.domain AS domain_a, b.domain AS domain_b, a.coord AS coord_a, b.coord AS coord_b, round(sum(a.mean * b.mean), 8) AS c
FROM means a JOIN means b ON a.label = b.label AND a.boot = b.boot AND a.domain > b.domain GROUP BY ALL""")
def cross_domain_cov(spark, sf_dir):
    return features.cross_covariances(alignment.packed_means(embedding_means(spark, sf_dir))).withColumn("c", F.round("c", 8))


def _long(rows: DataFrame) -> DataFrame:
    return rows.select("domain", "trial_no", "label", F.posexplode("v").alias("_i", "_v")).select("domain", "trial_no", "label", (F.col("_i") + 1).alias("coord"), F.round("_v", 8).alias("value"))


@query(f"""WITH {EMBEDDING_FEATURES}, l AS (SELECT domain, trial_no, label, c.coord::INT AS coord, v[c.coord] AS x FROM features CROSS JOIN (SELECT unnest(range(1, 65)) AS coord) c),
z AS (SELECT *, x - avg(x) OVER (PARTITION BY domain, coord) AS y FROM l),
n AS (SELECT domain, avg(norm) AS scale FROM (SELECT domain, trial_no, sqrt(sum(y * y)) AS norm FROM z GROUP BY domain, trial_no) GROUP BY domain)
SELECT z.domain, z.trial_no, z.label, z.coord, round(z.y / n.scale, 8) AS value FROM z JOIN n USING (domain)""")
def center_features(spark, sf_dir):
    return _long(features.centred(embedding_features(spark, sf_dir), 64))


@query(f"""WITH {EMBEDDING_FEATURES}, s AS (SELECT domain, trial_no, label, list_transform(v, lambda x: x * (1 + label)) AS v FROM features),
n AS (SELECT *, avg(sqrt(list_sum(list_transform(v, lambda x: x * x)))) OVER (PARTITION BY domain) AS scale FROM s)
SELECT domain, trial_no, label, c.coord::INT AS coord, round(v[c.coord] / scale, 8) AS value FROM n CROSS JOIN (SELECT unnest(range(1, 65)) AS coord) c""")
def norm_scale_features(spark, sf_dir):
    rows = embedding_features(spark, sf_dir).withColumn("v", F.transform("v", lambda x: x * (1 + F.col("label"))))
    return _long(features.norm_scaled(rows))


@query(f"""WITH {EMBEDDING_FEATURES}
SELECT domain, trial_no, label, k.coord::INT AS coord,
  round(list_sum(list_transform(range(1, 65), lambda i: v[i] * cos((domain * k.coord * i)::DOUBLE))), 8) AS value
FROM features CROSS JOIN (SELECT unnest(range(1, 9)) AS coord) k""")
def apply_fixed_projection(spark, sf_dir):
    rows = embedding_features(spark, sf_dir)
    entry = lambda k: F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.cos((F.col("domain") * k * i).cast("double")))
    model = spark.range(1, 5).select(F.col("id").cast("int").alias("domain")).select("domain", F.transform(F.sequence(F.lit(1), F.lit(8)), entry).alias("b"))
    return _long(features.apply_model(rows, model))


@query(f"""WITH {LINE_SAMPLES}, s AS (SELECT recording_id, sum(x[1]) AS s1, sum(x[2]) AS s2, sum(x[3]) AS s3, sum(x[4]) AS s4 FROM samples GROUP BY recording_id)
SELECT recording_id, t, round(x[1] / s1, 10) AS x1, round(x[2] / s2, 10) AS x2, round(x[3] / s3, 10) AS x3, round(x[4] / s4, 10) AS x4 FROM samples JOIN s USING (recording_id)""")
def col_sum_normalise(spark, sf_dir):
    rows = features.column_normalised(line_samples(spark, sf_dir), 4)
    return rows.select("recording_id", "t", *[F.round(F.col("x")[i], 10).alias(f"x{i + 1}") for i in range(4)])


@query(f"WITH {EMBEDDING_FEATURES} SELECT DISTINCT domain, label FROM features")
def label_distinct(spark, sf_dir):
    return embedding_features(spark, sf_dir).select("domain", "label").distinct()


@query()
def tangent_vectors(spark, sf_dir):
    return study_features(spark, sf_dir)


@query()
def whiten_svd(spark, sf_dir):
    return alignment.whitened(embedding_groups(spark, sf_dir), ("seed",), "svd", 16)


@query()
def whiten_smart(spark, sf_dir):
    return alignment.whitened(embedding_groups(spark, sf_dir), ("seed",), "smart", 16)


@query()
def joint_alignment(spark, sf_dir):
    return alignment.aligned(study_means(study_features(spark, sf_dir)), GROUP, 12)


@query()
def joint_alignment_vectors(spark, sf_dir):
    return alignment.aligned(embedding_groups(spark, sf_dir), ("seed",), 8, start="smart")


@query()
def fast_alignment(spark, sf_dir):
    return alignment.leave_one_out(study_means(study_features(spark, sf_dir)), GROUP, 12)


@query()
def train_subject(spark, sf_dir):
    return alignment.trained_alone(study_features(spark, sf_dir), GROUP)


@query()
def train_group(spark, sf_dir):
    rows = study_features(spark, sf_dir).persist()
    model = alignment.aligned(study_means(rows), GROUP, 12)
    return alignment.trained_together(features.apply_model(rows, model, (*GROUP, "domain")), GROUP)


@query()
def train_fast(spark, sf_dir):
    rows = study_features(spark, sf_dir).persist()
    model = alignment.leave_one_out(study_means(rows), GROUP, 12).select(*GROUP, "held_out", "domain", "b")
    return alignment.trained_without(features.apply_models(rows, model, (*GROUP, "domain")), GROUP)


@query()
def train_elastic_net(spark, sf_dir):
    return alignment.trained_alone(study_features(spark, sf_dir), GROUP, "enlr")


def _whole_vectors(spark, sf_dir: str) -> DataFrame:
    study = F.floor(F.col("recording_id") / STUDY).cast("int")
    return tangent_vectors_whole(spark, sf_dir).select(study.alias("study"), "split", F.col("recording_id").alias("domain"), "trial_no", "label", "v")


@query()
def cross_validation(spark, sf_dir):
    """Over all trials of a recording, mapped at one mean."""
    return alignment.cross_validated(_whole_vectors(spark, sf_dir).withColumn("role", F.lit("train")), GROUP, 5)


@query()
def penalised_path(spark, sf_dir):
    """Logistic classifiers of each recording along a path of penalties, and the one that folds choose."""
    return alignment.penalty_paths(_whole_vectors(spark, sf_dir), GROUP)


@query()
def group_pipeline(spark, sf_dir):
    config = pipeline.Config(window=WL, channels=CHANNELS, n_splits=2, n_boot=40, boot_size=10, white_dim=12, study=STUDY)
    return pipeline.run(pipeline.GROUP_PIPELINE, config, {"samples": line_samples(spark, sf_dir)})["summary"]


@query()
def group_pipeline_corrected(spark, sf_dir):
    """Prototypes freed of overlap, of weighted trials, two components; covariances of unit determinant."""
    config = pipeline.Config(window=WL, channels=CHANNELS, n_splits=2, n_boot=40, boot_size=10, white_dim=12, study=STUDY, overlapping=True, adaptive=True, components=2, det=True)
    return pipeline.run(pipeline.GROUP_PIPELINE, config, {"samples": line_samples(spark, sf_dir)})["summary"]


@query()
def group_pipeline_mi(spark, sf_dir):
    config = pipeline.Config(window=WL, channels=CHANNELS, n_splits=2, n_boot=40, boot_size=10, white_dim=8, study=STUDY, paradigm="mi")
    return pipeline.run(pipeline.GROUP_PIPELINE, config, {"samples": line_samples(spark, sf_dir)})["summary"]


def _cut_and_sets(spark, sf_dir):
    samples = line_samples(spark, sf_dir)
    numbered = trials.numbered(markers.stim_to_marks(samples, WL))
    return trials.packed_windows(samples, WL), splits.stratified(numbered, 2, 50, seed=1)


@query()
def prototype_corrected(spark, sf_dir):
    return alignment.prototypes(*_cut_and_sets(spark, sf_dir), 2, CHANNELS, wl=WL, adaptive=True)


@query()
def prototype_components(spark, sf_dir):
    return alignment.prototypes(*_cut_and_sets(spark, sf_dir), 2, CHANNELS, components=2)


@query()
def tangent_vectors_whole(spark, sf_dir):
    """Vectors of whole recordings: one prototype of all target trials, all trials mapped at one mean."""
    samples = line_samples(spark, sf_dir)
    numbered = trials.numbered(markers.stim_to_marks(samples, WL))
    cut = trials.packed_windows(samples, WL)
    whole = numbered.select("recording_id", "trial_no", "class", F.lit(0).alias("split"), F.lit("train").alias("role"))
    return alignment.tangent_features(cut, alignment.prototypes(cut, whole, 2, CHANNELS), whole, CHANNELS)


@query()
def tangent_vectors_mi(spark, sf_dir):
    cut, sets = _cut_and_sets(spark, sf_dir)
    return alignment.tangent_features(cut, None, sets, CHANNELS)


#: Rows of a mixing matrix, and the filters (one a row) that undo it, of four channels.
MIXING = np.array([[1.0, 0.5, 0.0, 0.0], [0.0, 1.0, 0.5, 0.0], [0.0, 0.0, 1.0, 0.5], [0.5, 0.0, 0.0, 1.0]])
FILTERS = np.linalg.inv(MIXING).T


def _variance_sql() -> str:
    quadratic = lambda b: " + ".join(f"({b[j] * b[k]!r})::DOUBLE * c{min(j, k)}{max(j, k)}" for j in range(4) for k in range(4))
    plain = [f"({float((MIXING[i] ** 2).sum())!r})::DOUBLE * ({quadratic([float(v) for v in FILTERS[i]])})" for i in range(4)]
    unit = [f"({quadratic([float(v) for v in FILTERS[i] / np.linalg.norm(FILTERS[i])])})" for i in range(4)]
    sums = ", ".join(f"covar_pop(x[{j + 1}], x[{k + 1}]) AS c{j}{k}" for j in range(4) for k in range(j, 4))
    rows = " UNION ALL ".join(f"SELECT recording_id, {i + 1} AS source, round({plain[i]}, 8) AS variance, round({unit[i]}, 8) AS unit_variance FROM c" for i in range(4))
    return f"WITH {LINE_SAMPLES}, c AS (SELECT recording_id, {sums} FROM samples GROUP BY recording_id) {rows}"


@query(_variance_sql())
def explained_variance(spark, sf_dir):
    covs = covariance.moments(line_samples(spark, sf_dir), CHANNELS, ("recording_id",))
    rows = covariance.explained_variance(covs, MIXING, FILTERS)
    return rows.withColumns({"variance": F.round("variance", 8), "unit_variance": F.round("unit_variance", 8)})


@query()
def covariance_sets(spark, sf_dir):
    return alignment.covariance_sets(embedding_groups(spark, sf_dir), ("seed",))


@query()
def covariance_sets_applied(spark, sf_dir):
    """Vectors of all domains in the common components of the first bootstrap seed."""
    model = alignment.covariance_sets(embedding_groups(spark, sf_dir), ("seed",)).where("seed = 1")
    return _long(features.apply_model(embedding_features(spark, sf_dir), model))


@query()
def train_at_scale(spark, sf_dir):
    rows = embedding_features(spark, sf_dir).withColumnRenamed("domain", "recording_id").withColumnRenamed("label", "class")
    sets = splits.stratified(rows, 2, 50, seed=3).select(F.col("recording_id").alias("domain"), "split", "trial_no", "role")
    return alignment.trained_at_scale(embedding_features(spark, sf_dir).join(sets, ["domain", "trial_no"]))


@query()
def cca_rank_sources(spark, sf_dir):
    # two classes of 320 means: five times the 64 + 64 dimensions of a pair
    return alignment.canonical_ranking(embedding_groups(spark, sf_dir, 320), ("seed",))


@query()
def mca_pairs(spark, sf_dir):
    return alignment.covariance_pairs(embedding_groups(spark, sf_dir), ("seed",))


@query(f"""WITH {_trials(LINE_SAMPLES, 16)}, centred AS (
  SELECT recording_id, trial_no, class, dt, pow(sin(pi() * (dt + 0.5) / 16), 2) AS w, {", ".join(f"x[{i}] - avg(x[{i}]) OVER (PARTITION BY recording_id, trial_no) AS y{i}" for i in range(1, 5))} FROM trials
), waves AS (
  SELECT recording_id, trial_no, class, bin, sum(w * w) AS energy, {", ".join(f"sum(w * y{i} * cos(2 * pi() * bin * dt / 16)) AS a{i}, sum(w * y{i} * sin(2 * pi() * bin * dt / 16)) AS b{i}" for i in range(1, 5))}
  FROM (SELECT *, unnest(range(0, 9))::INT AS bin FROM centred) GROUP BY recording_id, trial_no, class, bin
)
SELECT recording_id, class, bin, {", ".join(f"round(avg((a{i} * a{j} + b{i} * b{j}) / energy), 7) + 0.0 AS c{i}{j}" for i in range(1, 5) for j in range(1, 5))} FROM waves GROUP BY recording_id, class, bin""")
def mean_cospectra(spark, sf_dir):
    rows = spectra.mean_cospectra(packed_line_trials(spark, sf_dir, 16), 16, CHANNELS)
    return rows.select("recording_id", "class", "bin", *[(F.round(F.col("c")[4 * i + j], 7) + 0.0).alias(f"c{i + 1}{j + 1}") for i in range(4) for j in range(4)])


@query(f"""WITH {_trials(LINE_SAMPLES)}, bins(band, k, w) AS (VALUES (1, 1, 2.0), (1, 2, 2.0), (1, 3, 2.0), (2, 3, 2.0), (2, 4, 1.0)), d AS (SELECT unnest(range(0, {WL}))::INT AS dt), raw AS (
  SELECT band, d.dt, s.dt AS s, sum(w / {WL} * cos(2 * pi() * k * (d.dt - s.dt) / {WL})) AS re, sum(w / {WL} * sin(2 * pi() * k * (d.dt - s.dt) / {WL})) AS im
  FROM bins CROSS JOIN d CROSS JOIN d s GROUP BY band, d.dt, s.dt
), kernel AS (
  SELECT band, d.dt, s, sum((2 - abs(raw.dt - d.dt)) * re) / sum(2 - abs(raw.dt - d.dt)) AS re, sum((2 - abs(raw.dt - d.dt)) * im) / sum(2 - abs(raw.dt - d.dt)) AS im
  FROM raw JOIN d ON abs(raw.dt - d.dt) < 2 GROUP BY band, d.dt, s
), cells AS (SELECT *, unnest(x) AS v, unnest([1, 2, 3, 4]) AS channel FROM trials), waves AS (
  SELECT recording_id, trial_no, class, band, k.dt, channel, sqrt(pow(sum(re * v), 2) + pow(sum(im * v), 2)) AS a FROM cells JOIN kernel k ON k.s = cells.dt GROUP BY recording_id, trial_no, class, band, k.dt, channel
)
SELECT recording_id, class, band, band * 2.0::DOUBLE AS frequency, dt, channel, round(avg(a), 7) AS amplitude FROM waves GROUP BY recording_id, class, band, dt, channel""")
def time_frequency(spark, sf_dir):
    """Eight samples a second, bands of 2 Hz around 2 and 4."""
    rows = spectra.time_frequency(packed_line_trials(spark, sf_dir, WL), WL, CHANNELS, 8.0, 2.0)
    return rows.withColumn("amplitude", F.round("amplitude", 7))


@query()
def source_separation(spark, sf_dir):
    cut = packed_line_trials(spark, sf_dir, 16)
    means = trials.wide_mean(trials.class_mean(trials.unpacked(cut), channels=CHANNELS))
    return spectra.separated(spectra.mean_cospectra(cut, 16, CHANNELS), means, CHANNELS)


def _leadfield(channels: int = 64, voxels: int = 12) -> np.ndarray:
    return np.random.default_rng(5).normal(size=(channels, 3 * voxels))


def _inverse_sql(maker) -> str:
    """The strongest voxel of each vector, taken as a sample of 64 channels, the inverse of the fixed lead field as literals."""
    k = _leadfield()
    inverse = maker(k - k.mean(axis=0), 1.0)
    dot = lambda r: f"pow(list_inner_product(y, {inverse[r].tolist()}::DOUBLE[]), 2)"
    powers = ", ".join(" + ".join(dot(3 * v + a) for a in range(3)) for v in range(len(inverse) // 3))
    return f"""WITH {EMBEDDING_FEATURES}, m AS (SELECT domain AS recording_id, trial_no AS t, v, list_avg(v) AS m FROM features),
c AS (SELECT recording_id, t, list_transform(v, lambda a: a - m) AS y FROM m), p AS (SELECT recording_id, t, [{powers}] AS p FROM c)
SELECT recording_id, t, list_position(p, list_max(p))::INT AS voxel, round(list_max(p), 8) AS power FROM p"""


def _strongest(spark, sf_dir, method: str) -> DataFrame:
    samples = embedding_features(spark, sf_dir).select(F.col("domain").alias("recording_id"), F.col("trial_no").alias("t"), F.col("v").alias("x"))
    return spectra.sources(samples, _leadfield(), method).withColumn("power", F.round("power", 8))


@query(_inverse_sql(filters.standardised_low_resolution))
def inverse_sloreta(spark, sf_dir):
    return _strongest(spark, sf_dir, "sloreta")


@query(_inverse_sql(filters.exact_low_resolution))
def inverse_eloreta(spark, sf_dir):
    return _strongest(spark, sf_dir, "eloreta")


@query(_inverse_sql(filters.minimum_norm))
def inverse_minimum_norm(spark, sf_dir):
    return _strongest(spark, sf_dir, "minimum_norm")


RAW = pipeline.Config(window=WL, channels=CHANNELS, n_splits=2, n_boot=40, boot_size=10, white_dim=12, study=STUDY, band=(1.0, 16.0, 128.0), reject=1.0)


@query()
def group_pipeline_raw(spark, sf_dir):
    return pipeline.run([pipeline.prepare, *pipeline.GROUP_PIPELINE], RAW, {"samples": line_samples(spark, sf_dir)})["summary"]


@query()
def files_to_accuracy(spark, sf_dir):
    """Recordings written as files, and from the files to accuracies: selection, reading, preparing, the group pipeline on eight coordinates, balanced means."""
    samples, folder = line_samples(spark, sf_dir), shared_path(spark, "recordings")
    stem = F.concat(F.lit("subject_"), F.lpad(F.col("recording_id").cast("string"), 8, "0"))
    about = samples.select("recording_id").distinct().select(
        stem.alias("stem"), F.col("recording_id").cast("int").alias("subject"), *[F.lit(1).alias(c) for c in ("session", "run")], F.lit(128).alias("sampling_rate"), F.lit(WL).alias("window_length"),
        F.lit(0).alias("offset"), F.array(*[F.lit(f"C{i}") for i in range(CHANNELS)]).alias("sensors"), F.create_map(F.lit("NonTarget"), F.lit(1), F.lit("Target"), F.lit(2)).alias("labels"), F.lit("line items").alias("database"),
    )
    recordings.write_recordings(samples.withColumn("stem", stem), about, folder).write.format("noop").mode("overwrite").save()
    config, context = pipeline.from_files(spark, folder, replace(RAW, sub_dim=8, balanced=True))
    return pipeline.run([pipeline.prepare, *pipeline.GROUP_PIPELINE], config, context)["summary"]


@query()
def nearest_mean_sets(spark, sf_dir):
    """Trials' covariances told apart by the nearest class mean, trained on all recordings of a study but the last."""
    rows = covariance.estimate(packed_line_trials(spark, sf_dir), "lw")
    study = F.floor(F.col("recording_id") / STUDY).cast("int")
    rows = splits.last_against_rest(rows.select(study.alias("study"), "recording_id", "trial_no", F.col("class").alias("label"), "c"), "study", "recording_id")
    keep = ("recording_id", "trial_no", "truth")
    test = rows.where("role = 'test'").withColumnRenamed("label", "truth")
    found = fisher.nearest_mean(rows.where("role = 'train'"), test, ("study",), keep, CHANNELS)
    return balanced_accuracy(found, ("study",))
