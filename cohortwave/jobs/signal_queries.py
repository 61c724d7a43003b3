"""Queries on markers, trials, weights, means, rejection, splits and covariances, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import covariance, markers, overlap, rejection, selection, splits, trials
from ..sources import ascii, recordings
from ..sources.ascii import numbers
from ..sources.tables import EMBEDDING_FEATURES, EVENT_SAMPLES, LABEL_PREDICTIONS, LINE_SAMPLES, embedding_features, event_samples, label_predictions, line_samples
from ..streaming.scoring import shared_path

WL = 8
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _marks(of: str, wl: int = WL) -> str:
    return f"""{of}, marks AS (
  SELECT recording_id, class, row_number() OVER (PARTITION BY recording_id, class ORDER BY t) AS ord, t FROM (
    SELECT recording_id, stim AS class, t, max(t) OVER (PARTITION BY recording_id) AS n FROM samples
  ) WHERE class > 0 AND t + {wl - 1} <= n
)"""


def _trials(of: str, wl: int = WL) -> str:
    return f"""{_marks(of, wl)}, numbered AS (
  SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY class, t) AS trial_no, class, t AS onset FROM marks
), windows AS (
  SELECT *, onset + dt AS t FROM (SELECT *, unnest(range(0, {wl}))::INT AS dt FROM numbered)
), trials AS (
  SELECT w.recording_id, w.trial_no, w.class, w.onset, w.dt, s.x FROM windows w JOIN samples s ON s.recording_id = w.recording_id AND s.t = w.t
)"""


EVENT_MARKS, EVENT_TRIALS = _marks(EVENT_SAMPLES), _trials(EVENT_SAMPLES)
LINE_TRIALS = _trials(LINE_SAMPLES)
LINE_WEIGHTS = f"""{LINE_TRIALS}, power AS (
  SELECT recording_id, trial_no, class, 1 / sum(list_sum(list_transform(x, lambda v: v * v))) AS w FROM trials GROUP BY ALL
), weights AS (
  SELECT recording_id, trial_no, class, w / avg(w) OVER (PARTITION BY recording_id, class) AS weight FROM power
)"""


def _event_marks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    samples = event_samples(spark, sf_dir)
    return samples, markers.stim_to_marks(samples, WL)


def event_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials.unpacked(trials.packed_windows(event_samples(spark, sf_dir), WL))


def packed_line_trials(spark: SparkSession, sf_dir: str, wl: int = WL) -> DataFrame:
    return trials.packed_windows(line_samples(spark, sf_dir), wl)


def line_trials(spark: SparkSession, sf_dir: str, wl: int = WL) -> DataFrame:
    return trials.unpacked(packed_line_trials(spark, sf_dir, wl))


@query(f"WITH {EVENT_MARKS} SELECT recording_id, class, ord, t FROM marks")
def stim_to_marks(spark, sf_dir):
    return _event_marks(spark, sf_dir)[1]


@query(f"""WITH {EVENT_MARKS}
SELECT s.recording_id, s.t, coalesce(m.class, 0)::INT AS stim FROM samples s LEFT JOIN marks m ON m.recording_id = s.recording_id AND m.t = s.t""")
def marks_to_stim(spark, sf_dir):
    return markers.marks_to_stim(*_event_marks(spark, sf_dir))


@query(f"""WITH {EVENT_MARKS}
SELECT recording_id, 1 AS class, row_number() OVER (PARTITION BY recording_id ORDER BY t) AS ord, t FROM marks""")
def merge_marks(spark, sf_dir):
    return markers.merge_marks(_event_marks(spark, sf_dir)[1], {1: 1, 2: 1})


@query(f"""WITH {EVENT_SAMPLES}
SELECT recording_id, t, (t - 1) / 512.0::DOUBLE AS seconds, CASE stim WHEN 1 THEN 'NonTarget' ELSE 'Target' END AS label FROM samples WHERE stim <> 0""")
def stimulus_export(spark, sf_dir):
    return markers.stimulus_list(event_samples(spark, sf_dir), {1: "NonTarget", 2: "Target"}, 512)


@query("""SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t,
  CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS stim, value AS value
FROM events WHERE event_type <> 'error'""")
def remove_samples(spark, sf_dir):
    samples = event_samples(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.row_number().over(trials.Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    gone = e.select(F.col("user_id").alias("recording_id"), t.alias("t"), "event_type").where("event_type = 'error'").drop("event_type")
    return markers.remove_samples(samples, gone).select("recording_id", "t", "stim", F.col("x")[0].alias("value"))


@query(f"WITH {LINE_SAMPLES} SELECT recording_id, t, x[1] AS x1, x[4] AS x2 FROM samples")
def remove_channels(spark, sf_dir):
    rest = markers.remove_channels(line_samples(spark, sf_dir), [2, 3])
    return rest.select("recording_id", "t", F.col("x")[0].alias("x1"), F.col("x")[1].alias("x2"))


@query(f"""WITH {EVENT_SAMPLES}, b AS (
  SELECT recording_id, (t - 1) // 4 AS b, count(*) AS n, count(*) FILTER (stim > 0) AS k, arg_min(stim, t) FILTER (stim > 0) AS s FROM samples GROUP BY ALL
)
SELECT recording_id, b + 1 AS t, coalesce(s, 0)::INT AS stim, greatest(k - 1, 0) AS clashes FROM b WHERE n = 4""")
def resample_stim(spark, sf_dir):
    return markers.downsample_stim(event_samples(spark, sf_dir), 4)


@query(f"""WITH {LINE_SAMPLES}, b AS (
  SELECT recording_id, (t - 1) // 4 AS b, count(*) AS n, count(*) FILTER (stim > 0) AS k, arg_min(stim, t) FILTER (stim > 0) AS s,
    {", ".join(f"avg(x[{i}]) AS m{i}" for i in range(1, 5))} FROM samples GROUP BY ALL
)
SELECT recording_id, b + 1 AS t, coalesce(s, 0)::INT AS stim, {", ".join(f"round(m{i}, 8) AS x{i}" for i in range(1, 5))} FROM b WHERE n = 4""")
def resample_signal(spark, sf_dir):
    rows = markers.downsample(line_samples(spark, sf_dir), 4, 4)
    return rows.select("recording_id", "t", "stim", *[F.round(F.col("x")[i], 8).alias(f"x{i + 1}") for i in range(4)])


@query(f"""WITH {LINE_SAMPLES}
SELECT recording_id, t, round(x[1] - list_avg(x), 8) AS x1, round(x[2] - list_avg(x), 8) AS x2, round(x[3] - list_avg(x), 8) AS x3, round(x[4] - list_avg(x), 8) AS x4 FROM samples""")
def rereference_car(spark, sf_dir):
    rows = markers.average_reference(line_samples(spark, sf_dir))
    return rows.select("recording_id", "t", *[F.round(F.col("x")[i], 8).alias(f"x{i + 1}") for i in range(4)])


@query(f"""WITH {LINE_SAMPLES}
SELECT recording_id, count(*) AS samples, 4::BIGINT AS channels, count(DISTINCT CASE WHEN stim > 0 THEN stim END) AS classes,
  count(*) FILTER (stim > 0) AS stimuli, max(t) = count(*) AS gapless FROM samples GROUP BY recording_id""")
def recording_summary(spark, sf_dir):
    return markers.recording_summary(line_samples(spark, sf_dir))


@query(f"WITH {EVENT_TRIALS} SELECT recording_id, trial_no, class, onset, dt, x AS value FROM trials")
def extract_trials(spark, sf_dir):
    return event_trials(spark, sf_dir).select("recording_id", "trial_no", "class", "onset", "dt", F.col("x")[0].alias("value"))


@query(f"""WITH {LINE_TRIALS}
SELECT recording_id, trial_no, class, {", ".join(f"round(sum(0.5 * x[1] + 0.25 * x[2] - x[3] + 2.0 * x[4]) FILTER (dt = {k}), 8) AS v{k}" for k in range(WL))} FROM trials GROUP BY recording_id, trial_no, class""")
def trial_channel_projection(spark, sf_dir):
    """One row a trial."""
    rows = trials.project(line_trials(spark, sf_dir), [0.5, 0.25, -1.0, 2.0])
    return rows.groupBy("recording_id", "trial_no", "class").agg(*[F.round(F.sum(F.when(F.col("dt") == k, F.col("value"))), 8).alias(f"v{k}") for k in range(WL)])


@query(f"""WITH {EVENT_TRIALS}
SELECT recording_id, class, dt, 1 AS channel, round(avg(x), 8) AS mean FROM trials GROUP BY recording_id, class, dt""")
def class_mean(spark, sf_dir):
    return trials.class_mean(event_trials(spark, sf_dir), channels=1).withColumn("mean", F.round("mean", 8))


@query(f"""WITH {LINE_WEIGHTS}
SELECT t.recording_id, t.class, t.dt, c.channel::INT AS channel, round(sum(w.weight * t.x[c.channel]) / sum(w.weight), 8) AS mean
FROM trials t JOIN weights w USING (recording_id, trial_no) CROSS JOIN (SELECT unnest(range(1, 5)) AS channel) c
GROUP BY t.recording_id, t.class, t.dt, c.channel""")
def class_mean_weighted(spark, sf_dir):
    return trials.adaptive_mean(packed_line_trials(spark, sf_dir), channels=4).withColumn("mean", F.round("mean", 8))


@query(f"WITH {LINE_WEIGHTS} SELECT recording_id, trial_no, class, round(weight, 8) AS weight FROM weights")
def adaptive_weights(spark, sf_dir):
    return trials.adaptive_weights(line_trials(spark, sf_dir)).withColumn("weight", F.round("weight", 8))


@query(f"""WITH {LINE_TRIALS}, power AS (
  SELECT recording_id, trial_no, class, 1 / sqrt(sum(list_sum(list_transform(x, lambda v: v * v)))) AS w FROM trials GROUP BY ALL
)
SELECT recording_id, trial_no, class, round(w / avg(w) OVER (PARTITION BY recording_id, class), 8) AS weight FROM power""")
def norm_weights(spark, sf_dir):
    return trials.norm_weights(line_trials(spark, sf_dir)).withColumn("weight", F.round("weight", 8))


@query(f"""WITH {EVENT_MARKS}
SELECT a.recording_id, a.class AS class_i, b.class AS class_j, (b.t - a.t)::INT AS lag, count(*)::DOUBLE AS w
FROM marks a JOIN marks b ON a.recording_id = b.recording_id AND b.t BETWEEN a.t AND a.t + {WL - 1} GROUP BY ALL""")
def lag_histogram(spark, sf_dir):
    return trials.lag_histogram(_event_marks(spark, sf_dir)[1], WL)


@query(f"""WITH {EVENT_TRIALS}
SELECT recording_id, class, dt, 1 AS channel, round(sum(x), 8) AS total FROM trials GROUP BY recording_id, class, dt""")
def toeplitz_rhs(spark, sf_dir):
    return trials.toeplitz_rhs(event_trials(spark, sf_dir), 1).withColumn("total", F.round("total", 8))


@query()
def overlap_corrected_mean(spark, sf_dir):
    marks = _event_marks(spark, sf_dir)[1]
    totals = trials.toeplitz_rhs(event_trials(spark, sf_dir), 1)
    return overlap.corrected_means(trials.lag_histogram(marks, WL), totals, WL)


RANKED = f"""{EVENT_SAMPLES}, ranked AS (
  SELECT recording_id, t, stim, %s AS frms, row_number() OVER (PARTITION BY recording_id ORDER BY %s, t) AS r, count(*) OVER (PARTITION BY recording_id) AS n FROM samples
), middles AS (
  SELECT *, avg(CASE WHEN r BETWEEN n // 2 - {WL} AND n // 2 + {WL} THEN frms END) OVER (PARTITION BY recording_id) AS middle FROM ranked
)"""


@query(f"""WITH {RANKED % (("ln(1 + sqrt(x * x))",) * 2)}, low AS (
  SELECT recording_id, any_value(middle) AS middle, min(frms) FILTER (frms > middle / 100) AS low FROM middles WHERE n // 2 > {WL} GROUP BY recording_id
)
SELECT recording_id, round(middle, 8) AS middle, round(low, 8) AS low, round(middle + (middle - low) * 1.5, 8) AS high FROM low""")
def frms_thresholds(spark, sf_dir):
    rows = rejection.thresholds(event_samples(spark, sf_dir), WL, 1.5)
    return rows.select("recording_id", *[F.round(c, 8).alias(c) for c in ("middle", "low", "high")])


@query(f"""WITH {RANKED % (("abs(x)",) * 2)}, peaks AS (
  SELECT *, middle + (middle - min(frms) OVER (PARTITION BY recording_id)) * 1.2 AS high,
    max(frms) OVER (PARTITION BY recording_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {WL - 1} FOLLOWING) AS peak FROM middles
)
SELECT recording_id, t, stim, peak <= high AS kept FROM peaks WHERE stim > 0 AND t + {WL - 1} <= n""")
def reject_peak(spark, sf_dir):
    return rejection.reject_peaks(event_samples(spark, sf_dir), WL, 1.2)


def _hits(name: str, bad: str) -> str:
    """The windows that a scan rejects among the bad ones: the first, then the first behind it, and so on."""
    return f"""{name}(recording_id, t) AS (
  SELECT recording_id, min(t) FROM {bad} GROUP BY recording_id
  UNION ALL
  SELECT h.recording_id, min(b.t) FROM {name} h JOIN {bad} b ON b.recording_id = h.recording_id AND b.t >= h.t + {WL} GROUP BY h.recording_id, h.t
)"""


_SCAN = f"""WITH RECURSIVE {RANKED % (("ln(1 + sqrt(x * x))",) * 2)}, lows AS (
  SELECT recording_id, any_value(middle) AS middle, min(frms) FILTER (frms > middle / 100) AS low FROM middles WHERE n // 2 > {WL} GROUP BY recording_id
), limits AS (SELECT recording_id, low, middle + (middle - low) * 1.0 AS high FROM lows), scanned AS (
  SELECT recording_id, t, stim, n, min(frms) OVER w AS least, max(frms) OVER w AS most FROM ranked
  WINDOW w AS (PARTITION BY recording_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {WL - 1} FOLLOWING)
), bad_low AS (
  SELECT recording_id, t FROM scanned JOIN limits USING (recording_id) WHERE stim > 0 AND t + {WL - 1} <= n AND least < low
), {_hits("hit_low", "bad_low")}, once AS (
  SELECT s.*, EXISTS (SELECT 1 FROM hit_low h WHERE h.recording_id = s.recording_id AND h.t BETWEEN s.t - {WL - 1} AND s.t) AS gone FROM scanned s
), bad_high AS (
  SELECT recording_id, t FROM once JOIN limits USING (recording_id) WHERE stim > 0 AND NOT gone AND t + {WL - 1} <= n AND most > high
), {_hits("hit_high", "bad_high")}
SELECT recording_id, t, stim,
  CASE WHEN gone OR EXISTS (SELECT 1 FROM hit_high h WHERE h.recording_id = o.recording_id AND h.t BETWEEN o.t - {WL - 1} AND o.t) THEN 0 ELSE stim END AS clean FROM once o"""


@query(_SCAN)
def reject_scan(spark, sf_dir):
    return rejection.reject(event_samples(spark, sf_dir), WL, 1.0)


@query(_SCAN)
def reject_scan_blocks(spark, sf_dir):
    """The same scan over blocks of a few windows, so that it passes from one to the next."""
    return rejection.reject(event_samples(spark, sf_dir), WL, 1.0, width=4 * WL)


@query(f"""WITH {LINE_SAMPLES}, cells AS (SELECT recording_id, unnest(x) AS v FROM samples), ranked AS (
  SELECT recording_id, v, row_number() OVER (PARTITION BY recording_id ORDER BY v) AS r, count(*) OVER (PARTITION BY recording_id) AS n FROM cells
), ends AS (
  SELECT recording_id, n, min(v) FILTER (r > floor(n * 0.25) AND r <= n - floor(n * 0.25)) AS low, max(v) FILTER (r > floor(n * 0.25) AND r <= n - floor(n * 0.25)) AS high,
    stddev_samp(v) FILTER (r > floor(n * 0.25) AND r <= n - floor(n * 0.25)) AS spread FROM ranked GROUP BY recording_id, n
), centre AS (
  SELECT recording_id, avg(greatest(low, least(high, v))) AS middle, any_value(spread) AS spread FROM cells JOIN ends USING (recording_id) GROUP BY recording_id
)
SELECT recording_id, t, stim, {", ".join(f"round((x[{i}] - middle) / spread, 8) + 0.0 AS x{i}" for i in range(1, 5))} FROM samples JOIN centre USING (recording_id)""")
def standardise(spark, sf_dir):
    rows = rejection.standardise(line_samples(spark, sf_dir))
    return rows.select("recording_id", "t", "stim", *[(F.round(F.col("x")[i], 8) + 0.0).alias(f"x{i + 1}") for i in range(4)])


SPLITS = f"""{EVENT_MARKS}, numbered AS (
  SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY class, t) AS trial_no, class FROM marks
), placed AS (
  SELECT recording_id, s.split, trial_no, class,
    row_number() OVER (PARTITION BY recording_id, s.split, class ORDER BY md5('10|' || s.split || '|' || recording_id || '|' || trial_no), trial_no) AS place,
    floor(count(*) OVER (PARTITION BY recording_id, s.split, class) * %s + 1e-9) AS taken
  FROM numbered CROSS JOIN (SELECT unnest(range(1, 6))::INT AS split) s
), splits AS (
  SELECT recording_id, split, trial_no, class, CASE WHEN place <= taken THEN '%s' ELSE '%s' END AS role FROM placed
)"""


def _splits(spark, sf_dir, ratio):
    return splits.stratified(trials.numbered(_event_marks(spark, sf_dir)[1]), 5, ratio, seed=10)


@query(f"WITH {SPLITS % (0.4, 'train', 'test')} SELECT * FROM splits")
def split_stratified(spark, sf_dir):
    return _splits(spark, sf_dir, 40)


@query(f"WITH {SPLITS % (0.2, 'test', 'train')} SELECT * FROM splits")
def split_folds(spark, sf_dir):
    return _splits(spark, sf_dir, None)


@query(f"""WITH {SPLITS % (0.2, 'test', 'train')}
SELECT a.recording_id, a.split AS split_a, b.split AS split_b, count(*) AS shared
FROM splits a JOIN splits b ON a.recording_id = b.recording_id AND a.trial_no = b.trial_no AND a.split < b.split
WHERE a.role = 'test' AND b.role = 'test' GROUP BY ALL""")
def split_overlaps(spark, sf_dir):
    return splits.overlaps(_splits(spark, sf_dir, None))


@query("""SELECT o_custkey AS subject, o_orderkey AS session,
  CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1 THEN 'train' ELSE 'test' END AS role FROM orders""")
def split_first_vs_rest(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("session"), "o_orderdate")
    return splits.first_against_rest(rows, "subject", ["o_orderdate", "session"]).drop("o_orderdate")


@query(f"""WITH {EMBEDDING_FEATURES}, c AS (SELECT domain, label, count(*) AS n FROM features GROUP BY ALL), m AS (SELECT label, min(n) AS least FROM c GROUP BY label)
SELECT domain, trial_no, label FROM (SELECT *, row_number() OVER (PARTITION BY domain, label ORDER BY trial_no) AS r FROM features) f JOIN m USING (label) WHERE r <= least""")
def balance_classes(spark, sf_dir):
    return splits.balance(embedding_features(spark, sf_dir)).select("domain", "trial_no", "label")


@query(f"""WITH {EMBEDDING_FEATURES}, c AS (SELECT domain, label, count(*) AS rows FROM features GROUP BY ALL)
SELECT domain, label, rows, sum(rows) OVER (PARTITION BY domain) / (count(*) OVER (PARTITION BY domain) * rows)::DOUBLE AS weight FROM c""")
def class_weights(spark, sf_dir):
    return splits.class_weights(embedding_features(spark, sf_dir))


def _cov_sql(size: int) -> list[str]:
    return [f"covar_pop(x[{i + 1}], x[{j + 1}])" for i in range(size) for j in range(i + 1)]


def _spread(rows: DataFrame, size: int, digits: int = 8) -> DataFrame:
    """Packed covariances in one column an entry, for comparison with SQL."""
    many = size * (size + 1) // 2
    return rows.select(*[c for c in rows.columns if c != "c"], *[(F.round(F.col("c")[k], digits) + 0.0).alias(f"c{k + 1}") for k in range(many)])


LINE_COVS = f"""{LINE_TRIALS}, covs AS (
  SELECT recording_id, trial_no, class, count(*) AS n, {", ".join(f"{e} AS c{k + 1}" for k, e in enumerate(_cov_sql(4)))} FROM trials GROUP BY recording_id, trial_no, class
)"""
_DIAGONAL = (1, 3, 6, 10)
_TRACE = "(c1 + c3 + c6 + c10)"
_SQUARE = "(" + " + ".join(f"{1 if k in _DIAGONAL else 2} * c{k} * c{k}" for k in range(1, 11)) + ")"


@query(f"WITH {LINE_COVS} SELECT recording_id, trial_no, class, n, {', '.join(f'round(c{k}, 8) + 0.0 AS c{k}' for k in range(1, 11))} FROM covs")
def cov_scm_trial(spark, sf_dir):
    return _spread(covariance.moments(line_trials(spark, sf_dir), 4), 4)


@query(f"""WITH {LINE_SAMPLES}
SELECT recording_id, count(*) AS n, {", ".join(f"round({e}, 8) + 0.0 AS c{k + 1}" for k, e in enumerate(_cov_sql(4)))} FROM samples GROUP BY recording_id""")
def cov_scm_recording(spark, sf_dir):
    return _spread(covariance.moments(line_samples(spark, sf_dir), 4, ("recording_id",)), 4)


@query(f"""WITH {LINE_COVS}, s AS (SELECT *, {_TRACE} AS tr, {_SQUARE} AS sq FROM covs), r AS (
  SELECT *, CASE WHEN (n + 1 - 0.5) * (sq - tr * tr / 4) > 0 THEN least(1.0, ((1 - 0.5) * sq + tr * tr) / ((n + 1 - 0.5) * (sq - tr * tr / 4))) ELSE 1.0 END AS rho FROM s
)
SELECT recording_id, trial_no, class, n, round(rho, 8) AS rho, {", ".join(f"round((1 - rho) * c{k}" + (" + rho * tr / 4" if k in _DIAGONAL else "") + f", 8) + 0.0 AS c{k}" for k in range(1, 11))} FROM r""")
def cov_oas_trial(spark, sf_dir):
    return _spread(covariance.shrunk(covariance.moments(line_trials(spark, sf_dir), 4), 4).withColumn("rho", F.round("rho", 8)).select("recording_id", "trial_no", "class", "n", "rho", "c"), 4)


@query(f"WITH {LINE_COVS} SELECT recording_id, trial_no, class, n, {', '.join(f'round(c{k} / {_TRACE}, 8) + 0.0 AS c{k}' for k in range(1, 11))} FROM covs")
def trace_normalise(spark, sf_dir):
    return _spread(covariance.trace_normalised(covariance.moments(line_trials(spark, sf_dir), 4), 4), 4)


def _estimated(spark, sf_dir, estimator, det=False):
    return covariance.estimate(packed_line_trials(spark, sf_dir), estimator, det)


def _shrunk_sql(size: int) -> str:
    """Covariances of LINE_TRIALS shrunk toward a constant correlation, entries as in ``_spread``."""
    every = range(1, size + 1)
    s = lambda i, j: f"s{max(i, j)}{min(i, j)}"
    root = lambda i, j: f"sqrt({s(i, i)} * {s(j, j)})"
    off = [(i, j) for i in every for j in every if i != j]
    low = [(i, j) for i in every for j in every if j <= i]
    spread = lambda i, j: f"(q{max(i, j)}{min(i, j)} - {s(i, j)} * {s(i, j)})"
    rho = " + ".join(spread(i, i) for i in every) + " + r * (" + " + ".join(f"sqrt({s(j, j)} / {s(i, i)}) * (u{i}{j} - {s(i, i)} * {s(i, j)})" for i, j in off) + ")"
    gamma = " + ".join(f"pow(r * {root(i, j)} - {s(i, j)}, 2)" for i, j in off)
    entry = lambda i, j: s(i, i) if i == j else f"delta * r * {root(i, j)} + (1 - delta) * {s(i, j)}"
    return f"""WITH {LINE_TRIALS}, centred AS (
  SELECT recording_id, trial_no, class, {", ".join(f"x[{i}] - avg(x[{i}]) OVER (PARTITION BY recording_id, trial_no) AS d{i}" for i in every)} FROM trials
), sums AS (
  SELECT recording_id, trial_no, class, count(*) AS n, {", ".join(f"avg(d{i} * d{j}) AS s{i}{j}, avg(d{i} * d{i} * d{j} * d{j}) AS q{i}{j}" for i, j in low)},
    {", ".join(f"avg(d{i} * d{i} * d{i} * d{j}) AS u{i}{j}" for i, j in off)} FROM centred GROUP BY ALL
), r AS (SELECT *, ({" + ".join(f"{s(i, j)} / {root(i, j)}" for i, j in off)}) / {size * (size - 1)} AS r FROM sums), g AS (
  SELECT *, {gamma} AS gamma, {" + ".join(spread(i, j) for i in every for j in every)} - ({rho}) AS gain FROM r
), d AS (SELECT *, CASE WHEN gamma > 0 THEN least(1.0, greatest(0.0, gain / gamma / n)) ELSE 0.0 END AS delta FROM g)
SELECT recording_id, trial_no, class, n, {", ".join(f"round({entry(i, j)}, 8) + 0.0 AS c{k + 1}" for k, (i, j) in enumerate(low))} FROM d"""


@query(_shrunk_sql(4))
def cov_ledoit_wolf(spark, sf_dir):
    return _spread(_estimated(spark, sf_dir, "lw"), 4)


@query()
def cov_tyler(spark, sf_dir):
    return covariance.estimate(packed_line_trials(spark, sf_dir, 16), "tme")


@query()
def cov_regularised_tyler(spark, sf_dir):
    return _estimated(spark, sf_dir, "nrtme")


def _determinant() -> str:
    """The determinant of the packed 4 by 4 triangle c1 .. c10, by the first column of every minor."""
    name = lambda i, j: f"c{max(i, j) * (max(i, j) + 1) // 2 + min(i, j) + 1}"

    def minor(rows: list[int], cols: list[int]) -> str:
        if len(rows) == 1:
            return name(rows[0], cols[0])
        terms = [f"{'-' if k % 2 else '+'} {name(r, cols[0])} * ({minor([q for q in rows if q != r], cols[1:])})" for k, r in enumerate(rows)]
        return " ".join(terms)

    return minor([0, 1, 2, 3], [0, 1, 2, 3])


@query(f"""WITH {LINE_COVS}, s AS (SELECT *, {_TRACE} AS tr, {_SQUARE} AS sq FROM covs), r AS (
  SELECT *, CASE WHEN (n + 1 - 0.5) * (sq - tr * tr / 4) > 0 THEN least(1.0, ((1 - 0.5) * sq + tr * tr) / ((n + 1 - 0.5) * (sq - tr * tr / 4))) ELSE 1.0 END AS rho FROM s
), o AS (
  SELECT recording_id, trial_no, class, n, {", ".join(f"(1 - rho) * c{k}" + (" + rho * tr / 4" if k in _DIAGONAL else "") + f" AS c{k}" for k in range(1, 11))} FROM r
), d AS (SELECT *, sqrt(sqrt({_determinant()})) AS root FROM o)
SELECT recording_id, trial_no, class, n, {", ".join(f"round(c{k} / root, 6) + 0.0 AS c{k}" for k in range(1, 11))} FROM d""")
def det_normalise(spark, sf_dir):
    return _spread(_estimated(spark, sf_dir, "oas", det=True), 4, 6)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def paired_recordings(spark, sf_dir):
    data = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_name", "s_acctbal")
    meta = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return selection.paired(data, meta, "s_suppkey")


@query("SELECT c_custkey AS file, c_acctbal AS score FROM customer ORDER BY score DESC, file LIMIT 12")
def select_top_n(spark, sf_dir):
    scores = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("file"), F.col("c_acctbal").alias("score"))
    return selection.best_files(scores, 12)


@query("SELECT c_custkey AS file, c_acctbal AS score FROM customer ORDER BY score, file LIMIT 12")
def select_bottom_n(spark, sf_dir):
    scores = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("file"), F.col("c_acctbal").alias("score"))
    return selection.best_files(scores, 12, descending=False)


@query("SELECT o_orderkey AS file, o_totalprice / 500000 AS score FROM orders WHERE o_totalprice / 500000 < 0.3")
def select_below(spark, sf_dir):
    scores = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("file"), (F.col("o_totalprice") / 500000).alias("score"))
    return selection.beyond(scores, 0.3, above=False)


@query("""SELECT o_orderkey AS stem, o_custkey AS subject, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS session, 1 AS run
FROM orders ORDER BY stem LIMIT 50""")
def recording_info(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    session = F.row_number().over(trials.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    files = orders.select(F.col("o_orderkey").alias("stem"), F.col("o_custkey").alias("subject"), session.alias("session"), F.lit(1).alias("run"))
    return recordings.info(files, 50)


@query("SELECT o_orderkey AS file, o_totalprice / 500000 AS score FROM orders WHERE o_totalprice / 500000 > 0.7")
def select_threshold(spark, sf_dir):
    scores = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("file"), (F.col("o_totalprice") / 500000).alias("score"))
    return selection.beyond(scores, 0.7)


@query("SELECT o_custkey AS subject, o_orderkey AS session FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 4)")
def select_first_subjects(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("session"))
    return selection.first_subjects(files, 4)


@query("""SELECT o_custkey AS subject, o_orderkey AS session FROM orders
WHERE o_custkey IN (SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders) ORDER BY md5('3|' || o_custkey), o_custkey LIMIT 4)""")
def select_random_subjects(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("subject"), F.col("o_orderkey").alias("session"))
    return selection.random_subjects(files, 4, seed=3)


@query(f"""WITH {LABEL_PREDICTIONS}, r AS (
  SELECT split, domain, truth, avg((truth = predicted)::INT) AS recall, sum((truth = predicted)::INT) AS h, count(*) AS n FROM predictions GROUP BY ALL
)
SELECT split, domain, round(avg(recall), 8) AS balanced_accuracy, round(sum(h) / sum(n), 8) AS accuracy FROM r GROUP BY split, domain""")
def accuracy_balanced(spark, sf_dir):
    rows = selection.balanced_accuracy(label_predictions(spark, sf_dir), ("split", "domain"))
    return rows.select("split", "domain", *[F.round(c, 8).alias(c) for c in ("balanced_accuracy", "accuracy")])


@query(f"""WITH {LABEL_PREDICTIONS}, a AS (SELECT split, domain, avg((truth = predicted)::INT) AS acc FROM predictions GROUP BY ALL),
m AS (SELECT domain, round(avg(acc), 8) AS mean, round(stddev_samp(acc), 8) AS deviation FROM a GROUP BY domain)
SELECT domain, mean, deviation, row_number() OVER (ORDER BY mean DESC, domain) AS place FROM m""")
def accuracy_summary(spark, sf_dir):
    rows = label_predictions(spark, sf_dir).groupBy("split", "domain").agg(F.avg((F.col("truth") == F.col("predicted")).cast("double")).alias("acc"))
    found = selection.accuracy_summary(rows)
    return found.select("domain", F.round("mean", 8).alias("mean"), F.round("deviation", 8).alias("deviation"), "place")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity, 6) AS x1, round(l_extendedprice, 6) AS x2, round(l_discount, 6) AS x3 FROM lineitem")
def read_ascii(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    line = F.concat_ws("   ", *[F.regexp_replace(F.col(c).cast("decimal(18,2)").cast("string"), r"\.", ",") for c in ("l_quantity", "l_extendedprice", "l_discount")])
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", numbers(F.concat(F.lit(" "), line, F.lit(" "))).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(F.col("x")[i], 6).alias(f"x{i + 1}") for i in range(3)])


@query("""SELECT CASE l_returnflag WHEN 'A' THEN 1 ELSE 3 END AS file, l_orderkey::DOUBLE AS x1, round(l_extendedprice, 2) AS x2, round(l_discount, 2) AS x3
FROM lineitem WHERE l_returnflag IN ('A', 'R')""")
def read_many_ascii(spark, sf_dir):
    """Three matrices written as text and read again, the second of them skipped."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("x", F.array(F.col("l_orderkey").cast("double"), "l_extendedprice", "l_discount"))
    folder = shared_path(spark, "ascii")
    paths = [f"{folder}/{flag}" for flag in "ANR"]
    for flag, path in zip("ANR", paths, strict=True):
        ascii.write_matrix(li.where(F.col("l_returnflag") == flag), path)
    rows = ascii.read_matrices(spark, paths, skip=(2,))
    return rows.select("file", *[F.round(F.col("x")[i], 2 if i else 0).alias(f"x{i + 1}") for i in range(3)])


@query("SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier")
def read_xml(spark, sf_dir):
    """Suppliers written as XML and read again."""
    path = shared_path(spark, "xml")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    rows.write.format("xml").option("rowTag", "supplier").save(path)
    return recordings.read_xml(spark, path, "supplier", rows.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
