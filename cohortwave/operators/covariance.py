"""Covariances of trials: closed forms in expressions, the others in numpy by group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import covariances as cov

_TRIAL = ("recording_id", "trial_no")
ESTIMATORS = ("scm", "oas", "lw", "tme", "nrtme")


def _pairs(size: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(size) for j in range(i + 1)]


def moments(trials: DataFrame, channels: int, by: tuple[str, ...] = (*_TRIAL, "class")) -> DataFrame:
    """(..., n, c): sample covariance of each group, divided by n, as a packed lower triangle.

    ``channels`` is the length of ``x``. All sums are plain aggregates, so a group
    of any size is summed where it lies and only its sums are shuffled.
    """
    sums = [F.covar_pop(F.col("x")[i], F.col("x")[j]).alias(f"_{i}_{j}") for i, j in _pairs(channels)]
    packed = F.array(*[F.col(f"_{i}_{j}") for i, j in _pairs(channels)])
    return trials.groupBy(*by).agg(F.count("*").alias("n"), *sums).select(*by, "n", packed.alias("c"))


def shrunk(covs: DataFrame, channels: int) -> DataFrame:
    """OAS: packed covariances with their shrinkage ``rho`` toward a common variance."""
    diagonal = [i for i, (a, b) in enumerate(_pairs(channels)) if a == b]
    trace = sum((F.col("c")[i] for i in diagonal), F.lit(0.0))
    square = sum((F.col("c")[i] * F.col("c")[i] * (1 if a == b else 2) for i, (a, b) in enumerate(_pairs(channels))), F.lit(0.0))
    p = float(channels)
    rows = covs.withColumns({"_tr": trace, "_sq": square})
    top = (1 - 2 / p) * F.col("_sq") + F.col("_tr") * F.col("_tr")
    low = (F.col("n") + 1 - 2 / p) * (F.col("_sq") - F.col("_tr") * F.col("_tr") / p)
    rows = rows.withColumn("rho", F.when(low > 0, F.least(F.lit(1.0), top / low)).otherwise(1.0))
    kept = F.array(*[(1 - F.col("rho")) * F.col("c")[i] + (F.col("rho") * F.col("_tr") / p if a == b else F.lit(0.0)) for i, (a, b) in enumerate(_pairs(channels))])
    return rows.withColumn("c", kept).drop("_tr", "_sq")


def trace_normalised(covs: DataFrame, channels: int) -> DataFrame:
    """Packed covariances divided by their trace."""
    diagonal = [i for i, (a, b) in enumerate(_pairs(channels)) if a == b]
    trace = sum((F.col("c")[i] for i in diagonal), F.lit(0.0))
    return covs.withColumn("_tr", trace).withColumn("c", F.transform("c", lambda v: v / F.col("_tr"))).drop("_tr")


def explained_variance(covs: DataFrame, mixing: np.ndarray, filters: np.ndarray) -> DataFrame:
    """(..., source, variance, unit_variance): the variance that each source explains of packed covariances.

    Source i has row i of ``mixing`` as its pattern a and row i of ``filters`` as its
    filter b: ``variance`` is |a|^2 b'Cb, ``unit_variance`` the same with a and b of length one.
    """
    keys = [n for n in covs.columns if n not in ("n", "c")]
    pairs = _pairs(filters.shape[1])

    def quadratic(b: np.ndarray) -> Column:
        return sum((F.col("c")[at] * float(b[i] * b[j] * (1 if i == j else 2)) for at, (i, j) in enumerate(pairs)), F.lit(0.0))

    found = [
        F.struct(F.lit(i + 1).alias("source"), (quadratic(b) * float(a @ a)).alias("variance"), quadratic(b / np.linalg.norm(b)).alias("unit_variance"))
        for i, (a, b) in enumerate(zip(mixing, filters, strict=True))
    ]
    return covs.select(*keys, F.explode(F.array(*found)).alias("_s")).select(*keys, "_s.*")


def packed_trials(trials: DataFrame, by: tuple[str, ...] = _TRIAL) -> DataFrame:
    """(..., class, x): each trial as one row, its samples in order of ``dt``."""
    rows = trials.groupBy(*by, "class").agg(F.sort_array(F.collect_list(F.struct("dt", "x"))).alias("_a"))
    return rows.select(*by, "class", F.transform("_a", lambda s: s["x"]).alias("x"))


def estimate(trials: DataFrame, estimator: str = "lw", det: bool = False) -> DataFrame:
    """(recording_id, trial_no, class, n, c): the covariance of each packed trial by a named estimator.

    ``det`` divides by det^(1/p). One call takes a batch of trials as they lie,
    those of a length together; nothing is shuffled. By ``lw`` a trial with a constant
    channel has variances alone, as no correlation is known; the other entries are NaN.
    """
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator!r}; known: {', '.join(ESTIMATORS)}")
    make = {"scm": cov.scm, "oas": cov.oas, "lw": cov.ledoit_wolf_each, "tme": cov.tyler, "nrtme": cov.regularised_tyler}[estimator]

    @F.pandas_udf("array<double>")
    def packed(x: pd.Series) -> pd.Series:
        whole = x.map(np.stack)
        out = pd.Series([None] * len(x), index=x.index, dtype=object)
        for _, same in whole.groupby(whole.map(len)):
            c = make(np.stack(same.to_list()))
            if det:
                known = np.isfinite(c).all(axis=(-2, -1))
                c[known], c[~known] = cov.unit_determinant(c[known]), np.nan
            rows = cov.pack(c)
            out.loc[same.index] = pd.Series(list(rows), index=same.index)
        return out

    return trials.select(*_TRIAL, "class", F.size("x").cast("long").alias("n"), F.transform(packed("x"), lambda v: F.coalesce(v, F.lit(float("nan")))).alias("c"))  # Arrow makes NaN null


@F.pandas_udf(BooleanType())
def definite(c: pd.Series) -> pd.Series:
    """Whether packed covariances, all of one size, are positive definite."""
    return pd.Series(cov.definite(cov.unpack(np.stack(c))))


def rounded(c: Column, digits: int) -> Column:
    return F.transform(c, lambda v: F.round(v, digits))
