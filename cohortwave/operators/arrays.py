"""Means of array columns as one aggregate: no row for each entry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arrays of up to this length get one aggregate an entry, longer ones a vector summary.
WIDE = 64


def mean(column: str, size: int | None = None, weight: str | None = None) -> Column:
    """Mean of arrays of ``size`` entries (None: not known), entry by entry, weighted by a column if one is named.

    Summed where the rows lie; only sums are shuffled. A row of null or zero weight has no say.
    """
    if size is None or size > WIDE:
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        return vector_to_array(Summarizer.mean(array_to_vector(F.col(column)), F.lit(1.0) if weight is None else F.coalesce(F.col(weight), F.lit(0.0))))
    x = F.col(column)
    if weight is None:
        return F.array(*[F.avg(x[i]) for i in range(size)])
    w = F.col(weight)
    return F.array(*[F.try_divide(F.sum(w * x[i]), F.sum(w)) for i in range(size)])


def total(column: str, size: int, weight: str | None = None) -> Column:
    """Sum of arrays of ``size`` entries, as ``mean``."""
    x = F.col(column)
    return F.array(*[F.sum(x[i] if weight is None else F.col(weight) * x[i]) for i in range(size)])
