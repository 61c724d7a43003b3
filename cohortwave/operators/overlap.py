"""Class means freed of the overlap of neighbouring windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corrected_means(histogram: DataFrame, totals: DataFrame, wl: int, ridge: float = 1e-9, by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """(..., class, dt, channel, mean): the class responses that explain the recording best.

    ``histogram`` is ``trials.lag_histogram`` and ``totals`` is ``trials.toeplitz_rhs``,
    both summed by Spark; what is solved here is (classes * wl) equations for
    each recording, many recordings a batch. Where windows do not overlap, these are the plain means.
    """

    @F.pandas_udf("array<double>")
    def solve(ci: pd.Series, cj: pd.Series, lag: pd.Series, w: pd.Series, c: pd.Series, dt: pd.Series, channel: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([_solved(*row, wl, ridge) for row in zip(ci, cj, lag, w, c, dt, channel, total, strict=True)], dtype=object)

    pairs, sums = ("class_i", "class_j", "lag", "w"), ("class", "dt", "channel", "total")
    left = histogram.groupBy(*by).agg(*[F.collect_list(n).alias(f"_{n}") for n in pairs])
    right = totals.groupBy(*by).agg(*[F.collect_list(n).alias(f"_{n}") for n in sums])
    rows = left.join(right, list(by)).select(*by, F.array_sort(F.array_distinct("_class_i")).alias("_known"), F.array_max("_channel").alias("_width"), solve(*[f"_{n}" for n in (*pairs, *sums)]).alias("_m"))
    at = F.col("_at")
    rows = rows.select(*by, "_known", "_width", F.posexplode("_m").alias("_at", "mean"))
    block = F.floor(at / F.col("_width"))
    return rows.select(*by, F.element_at("_known", (F.floor(block / wl) + 1).cast("int")).cast("int").alias("class"), (block % wl).cast("int").alias("dt"), (at % F.col("_width") + 1).cast("int").alias("channel"), "mean")


def _solved(ci: np.ndarray, cj: np.ndarray, lag: np.ndarray, w: np.ndarray, c: np.ndarray, dt: np.ndarray, channel: np.ndarray, total: np.ndarray, wl: int, ridge: float) -> np.ndarray:
    """Responses (classes, wl, channels), flat, of one recording."""
    classes = np.unique(ci)
    step = np.arange(wl)
    inside = step[None, :] < wl - lag[:, None]  # each lag fills one diagonal of its block
    rows = (np.searchsorted(classes, ci) * wl + lag)[:, None] + step
    cols = (np.searchsorted(classes, cj) * wl)[:, None] + step
    rows, cols, value = rows[inside], cols[inside], np.broadcast_to(w[:, None], inside.shape)[inside]
    normal = np.zeros((len(classes) * wl, len(classes) * wl))
    normal[rows, cols] = value
    normal[cols, rows] = value
    right = np.zeros((len(normal), int(channel.max())))
    right[np.searchsorted(classes, c) * wl + dt, channel - 1] = total
    return np.linalg.solve(normal + ridge * np.trace(normal) / len(normal) * np.eye(len(normal)), right).ravel()
