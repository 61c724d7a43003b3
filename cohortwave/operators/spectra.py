"""Filters, spectra and inverse solutions over recordings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters, separation
from . import tomography
from .arrays import mean


def _whole(trial: np.ndarray, wl: int, channels: int) -> np.ndarray:
    """A packed trial as a matrix; another shape is an error."""
    v = np.stack(trial)
    if v.shape != (wl, channels):
        raise ValueError(f"a trial of {v.shape[0]} samples and {v.shape[1]} channels, not {wl} and {channels}")
    return v


def mean_cospectra(trials: DataFrame, wl: int, channels: int) -> DataFrame:
    """(recording_id, class, bin, c): mean real cross-spectrum of packed trials, entries row by row.

    Spectra are made batch by batch where the trials lie and leave as one array
    a trial; only running sums are shuffled. Trials of other lengths than
    ``wl`` are an error.
    """

    @F.pandas_udf("array<double>")
    def spectra(x: pd.Series) -> pd.Series:
        return pd.Series([filters.cospectra(_whole(v, wl, channels)).ravel() for v in x], dtype=object)

    cells, bins = channels**2, wl // 2 + 1
    means = trials.select("recording_id", "class", spectra("x").alias("_c")).groupBy("recording_id", "class").agg(mean("_c", cells * bins).alias("_c"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.slice("_c", k * cells + 1, F.lit(cells)))
    return means.select("recording_id", "class", F.posexplode(rows).alias("bin", "c"))


def time_frequency(trials: DataFrame, wl: int, channels: int, rate: float, bandwidth: float, fmax: float | None = None, smoothing: bool = True) -> DataFrame:
    """(recording_id, class, band, frequency, dt, channel, amplitude): mean amplitude of the analytic signals of packed trials.

    Kernels depend on the window alone and are made once; a batch of trials
    takes one product where it lies and only means are shuffled. Trials of
    other lengths than ``wl`` are an error.
    """
    centres, kernels = filters.analytic_kernels(wl, rate, bandwidth, fmax, smoothing)

    @F.pandas_udf("array<double>")
    def amplitudes(x: pd.Series) -> pd.Series:
        return pd.Series([np.abs(kernels @ _whole(v, wl, channels)).ravel() for v in x], dtype=object)

    size = kernels.shape[0] * wl * channels
    means = trials.select("recording_id", "class", amplitudes("x").alias("_a")).groupBy("recording_id", "class").agg(mean("_a", size).alias("_a"))
    rows = means.select("recording_id", "class", F.posexplode("_a").alias("_k", "amplitude"))
    band = F.floor(F.col("_k") / (wl * channels)).cast("int")
    dt, channel = F.floor(F.col("_k") / channels).cast("int") % wl, F.col("_k") % channels + 1
    frequency = F.array(*[F.lit(float(c)) for c in centres])[band]
    return rows.select("recording_id", "class", (band + 1).alias("band"), frequency.alias("frequency"), dt.alias("dt"), channel.alias("channel"), "amplitude")


def separated(cospectra: DataFrame, means: DataFrame, channels: int, share: float = 0.9) -> DataFrame:
    """(recording_id, component, ratio, filter, pattern): sources of each recording, see ``separation.separate``.

    ``cospectra`` are mean cospectra, ``means`` class means (recording_id,
    class, dt, m). Only matrices of channels by channels are shuffled, one a
    class and bin. The bin of frequency 0 takes no part.
    """
    m = F.col("m")
    evoked = means.groupBy("recording_id", "class").agg(F.array(*[F.sum(m[i] * m[j]) for i in range(channels) for j in range(channels)]).alias("c"))
    rows = cospectra.where("bin > 0").select("recording_id", F.lit(0).alias("_e"), "class", "bin", "c")
    rows = rows.unionByName(evoked.select("recording_id", F.lit(1).alias("_e"), "class", F.lit(0).alias("bin"), "c"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_e", "class", "bin"])
        c, which = np.stack(group["c"].to_list()).reshape(-1, channels, channels), group["_e"].to_numpy() == 1
        if which.all() or not which.any():
            return pd.DataFrame(columns=["recording_id", "component", "ratio", "filter", "pattern"])
        b, a, ratio = separation.separate(c[~which], c[which], share)
        return pd.DataFrame({"recording_id": group["recording_id"].iloc[0], "component": np.arange(1, len(ratio) + 1, dtype=np.int32), "ratio": ratio, "filter": list(b.T), "pattern": list(a.T)})

    return rows.groupBy("recording_id").applyInPandas(one, "recording_id long, component int, ratio double, filter array<double>, pattern array<double>")


def sources(samples: DataFrame, leadfield: np.ndarray, method: str = "sloreta", alpha: float = 1.0, weights: np.ndarray | None = None) -> DataFrame:
    """(recording_id, t, voxel, power): the strongest voxel of every sample and its power.

    The inverse is computed once, from the lead field; applying it is one product a batch.
    ``weights`` (one for each column) are for the minimum norm alone.
    """
    makers = {"minimum_norm": filters.minimum_norm, "sloreta": filters.standardised_low_resolution, "eloreta": filters.exact_low_resolution}
    if method not in makers:
        raise ValueError(f"unknown method {method!r}")
    centred = leadfield - leadfield.mean(axis=0)
    if weights is not None and method != "minimum_norm":
        raise ValueError(f"{method} takes no weights")
    inverse = makers[method](centred, alpha) if weights is None else tomography.weighted_minimum_norm(centred, weights, alpha)

    @F.pandas_udf("voxel int, power double")
    def strongest(x: pd.Series) -> pd.DataFrame:
        v = np.stack(x.to_numpy())
        power = ((v - v.mean(axis=1, keepdims=True)) @ inverse.T).reshape(len(v), -1, 3)
        power = (power**2).sum(axis=2)
        best = power.argmax(axis=1)
        return pd.DataFrame({"voxel": best.astype(np.int32) + 1, "power": power[np.arange(len(v)), best]})

    return samples.select("recording_id", "t", strongest("x").alias("s")).select("recording_id", "t", "s.voxel", "s.power")
