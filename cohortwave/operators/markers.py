"""Stimulus channels and markers. Samples and classes count from 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stim_to_marks(samples: DataFrame, wl: int, offset: int = 0) -> DataFrame:
    """(recording_id, class, ord, t): onsets whose whole window lies in the recording."""
    length = F.max("t").over(Window.partitionBy("recording_id"))
    rows = samples.select("recording_id", F.col("stim").cast("int").alias("class"), (F.col("t") + offset).alias("t"), length.alias("_n"))
    rows = rows.where((F.col("class") > 0) & (F.col("t") >= 1) & (F.col("t") + wl - 1 <= F.col("_n")))
    return _numbered(rows.select("recording_id", "class", "t"))


def marks_to_stim(samples: DataFrame, marks: DataFrame, offset: int = 0) -> DataFrame:
    """(recording_id, t, stim): the stimulus channel that has ``marks``, shifted by ``offset``."""
    at = marks.select("recording_id", (F.col("t") - offset).alias("t"), F.col("class").alias("_c"))
    return samples.select("recording_id", "t").join(at, ["recording_id", "t"], "left").select("recording_id", "t", F.coalesce("_c", F.lit(0)).alias("stim"))


def merge_marks(marks: DataFrame, groups: dict[int, int]) -> DataFrame:
    """Marks with classes regrouped; classes that ``groups`` does not name go."""
    new = F.create_map(*[F.lit(v) for pair in sorted(groups.items()) for v in pair])[F.col("class")]
    return _numbered(marks.withColumn("class", new).where("class is not null").select("recording_id", "class", "t"))


def _numbered(marks: DataFrame) -> DataFrame:
    ord_ = F.row_number().over(Window.partitionBy("recording_id", "class").orderBy("t")).cast("long")
    return marks.select("recording_id", "class", ord_.alias("ord"), "t")


def stimulus_list(samples: DataFrame, names: dict[int, str], sampling_rate: int) -> DataFrame:
    """(recording_id, t, seconds, label) of every stimulus: what a viewer's event list holds."""
    label = F.create_map(*[F.lit(v) for pair in sorted(names.items()) for v in pair])[F.col("stim")]
    return samples.where("stim <> 0").select("recording_id", "t", ((F.col("t") - 1) / sampling_rate).alias("seconds"), label.alias("label"))


def remove_samples(samples: DataFrame, gone: DataFrame) -> DataFrame:
    """Samples without those of ``gone(recording_id, t)``, numbered anew."""
    rest = samples.join(gone, ["recording_id", "t"], "left_anti")
    t = F.row_number().over(Window.partitionBy("recording_id").orderBy("t")).cast("long")
    return rest.withColumn("t", t)


def remove_channels(samples: DataFrame, gone: list[int]) -> DataFrame:
    """Samples without the channels at these places, counted from 1."""
    return samples.withColumn("x", F.filter("x", lambda _, i: ~(i + 1).isin(gone)))


def downsample_stim(samples: DataFrame, step: int) -> DataFrame:
    """(recording_id, t, stim, clashes): blocks of ``step`` samples; a block's one stimulus moves to its start.

    Where a block has several, the first counts and ``clashes`` says how many more there were.
    A last block that is not whole is dropped.
    """
    block = F.floor((F.col("t") - 1) / step).cast("long")
    own = F.when(F.col("stim") > 0, F.struct("t", "stim"))
    rows = samples.groupBy("recording_id", block.alias("b")).agg(F.count("*").alias("n"), F.min(own)["stim"].alias("s"), F.count(own).alias("k"))
    return rows.where(F.col("n") == step).select("recording_id", (F.col("b") + 1).alias("t"), F.coalesce("s", F.lit(0)).alias("stim"), F.greatest(F.col("k") - 1, F.lit(0)).alias("clashes"))


def downsample(samples: DataFrame, step: int, channels: int) -> DataFrame:
    """(recording_id, t, stim, x): one sample for every ``step``, the mean of its block, which keeps faster waves out.

    The stimulus channel goes as in ``downsample_stim``. Sums are made where the
    samples lie; a last block that is not whole is dropped.
    """
    block = F.floor((F.col("t") - 1) / step).cast("long")
    own = F.when(F.col("stim") > 0, F.struct("t", "stim"))
    means = [F.avg(F.col("x")[i]).alias(f"_{i}") for i in range(channels)]
    rows = samples.groupBy("recording_id", block.alias("b")).agg(F.count("*").alias("n"), F.min(own)["stim"].alias("s"), *means)
    x = F.array(*[F.col(f"_{i}") for i in range(channels)])
    return rows.where(F.col("n") == step).select("recording_id", (F.col("b") + 1).alias("t"), F.coalesce("s", F.lit(0)).alias("stim"), x.alias("x"))


def average_reference(samples: DataFrame) -> DataFrame:
    """Each sample minus the mean of its channels."""
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    return samples.withColumn("_m", mean).withColumn("x", F.transform("x", lambda v: v - F.col("_m"))).drop("_m")


def recording_summary(samples: DataFrame) -> DataFrame:
    """One row per recording: samples, channels, classes, stimuli, and whether t runs without a gap."""
    return samples.groupBy("recording_id").agg(
        F.count("*").alias("samples"),
        F.max(F.size("x")).cast("long").alias("channels"),
        F.countDistinct(F.when(F.col("stim") > 0, F.col("stim"))).alias("classes"),
        F.sum((F.col("stim") > 0).cast("long")).alias("stimuli"),
        (F.max("t") == F.count("*")).alias("gapless"),
    )
