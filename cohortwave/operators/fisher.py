"""Fisher means and tangent vectors of covariances that lie anywhere, one row each.

A group is what shares the columns ``by``. Groups of bounded size are packed into
bins and solved side by side, a bin a task. A larger group never meets in a task:
in every round its base point goes to its rows, the logarithms there are summed
where the rows lie, and the weighted mean of them moves the base point. Both
ways take the same steps from the same start, the log-Euclidean mean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import covariances as cov
from ..functions import manifold
from ..sources.stored import discard, stored
from . import arrays
from .covariance import definite

#: Rows of a group that may meet in a task, and of a bin of groups, about: bins are many, so that tasks share them evenly.
MOST, BIN = 20_000, 2_000
#: Matrix cells that one call holds at a time.
CELLS = 1_000_000


def class_weights(rows: DataFrame, by: tuple[str, ...], label: str = "label", name: str = "weight") -> DataFrame:
    """``rows(by, label, c)`` with a weight inverse to the size of its class, of the c that are known, within its group: all classes of a group weigh alike."""
    counts = rows.groupBy(*by, label).agg(F.try_divide(F.lit(1.0), F.count("c")).alias(name))
    return rows.join(counts, [*by, label])


def _logs(rows: DataFrame, by: tuple[str, ...], base: DataFrame | None, keep: tuple[str, ...]) -> DataFrame:
    """``rows`` (``by``, ``keep``, c) with ``s``, the packed logarithm of c, at the base point of its group if there is one."""

    @F.pandas_udf("array<double>")
    def plain(c: pd.Series) -> pd.Series:
        return pd.Series(list(cov.pack(manifold.spectral(cov.unpack(np.stack(c)), np.log))))

    @F.pandas_udf("array<double>")
    def based(c: pd.Series, back: pd.Series) -> pd.Series:
        each = cov.unpack(np.stack(back))
        return pd.Series(list(cov.pack(manifold.spectral(each @ cov.unpack(np.stack(c)) @ each, np.log))))

    if base is None:
        return rows.select(*by, *keep, plain("c").alias("s"))
    return rows.join(base.select(*by, "back"), list(by)).select(*by, *keep, based("c", "back").alias("s"))


def _moved(groups: DataFrame, by: tuple[str, ...], tol: float) -> DataFrame:
    """Base points ``root`` and ``back`` (g^1/2 and g^-1/2, packed) after a step ``s``, and whether they still move."""

    @F.pandas_udf("root array<double>, back array<double>, moves boolean")
    def stepped(root: pd.Series, s: pd.Series) -> pd.DataFrame:
        root, s = cov.unpack(np.stack(root)), cov.unpack(np.stack(s))
        g = root @ manifold.spectral(s, np.exp) @ root
        g = (g + np.swapaxes(g, -1, -2)) / 2
        moves = np.linalg.norm(s, axis=(-2, -1)) > tol * np.sqrt(s.shape[-1])
        new = np.where(moves[:, None, None], manifold.spectral(g, np.sqrt), root)
        return pd.DataFrame({"root": list(cov.pack(new)), "back": list(cov.pack(np.linalg.inv(new))), "moves": moves})

    return groups.select(*by, stepped("root", "s").alias("_b")).select(*by, "_b.*")


def base_points(rows: DataFrame, by: tuple[str, ...], channels: int, tol: float = 1e-8, rounds: int = 100) -> DataFrame:
    """(by, root, back): square roots of the Fisher mean of each group of stored ``rows(by, weight, c)``, and their inverses.

    A round is one pass over the rows of the groups that still move: logarithms
    where the rows lie, sums by aggregation. No group is held by a task.
    """
    size = channels * (channels + 1) // 2
    mean = lambda logs: logs.groupBy(*by).agg(arrays.mean("s", size, "weight").alias("s"))
    eye = F.array(*[F.lit(float(v)) for v in cov.pack(np.eye(channels))])
    now = stored(_moved(mean(_logs(rows, by, None, ("weight",))).withColumn("root", eye), by, -1.0), "fisher-base")
    still, ended = now, []
    for _ in range(rounds):
        steps = mean(_logs(rows, by, still, ("weight",)))
        now = stored(_moved(steps.join(still.select(*by, "root"), list(by)), by, tol), "fisher-base")
        discard(still)
        ended.append(now.where("not moves"))
        still = now.where("moves")
        if still.isEmpty():
            break
    else:
        ended.append(still)
    whole = ended[0]
    for part in ended[1:]:
        whole = whole.unionByName(part)
    return whole.drop("moves")


def tangent_vectors(rows: DataFrame, counts: DataFrame, by: tuple[str, ...], keep: tuple[str, ...], channels: int | None = None, tol: float = 1e-8, most: int = MOST) -> DataFrame:
    """(by, keep, v): vectors of ``rows(by, keep, weight, c)`` at the weighted Fisher mean of their group.

    ``c`` are packed matrices, all of one size; of their triangle the first
    ``channels`` columns stay. Weights count relative to their group; a group
    whose weights are all zero is an error. ``counts(by, count)`` says how many rows
    a group has at most; groups of more than ``most`` take the way of rounds. Where
    c is null, v is.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in (*by, *keep)) + ", v array<double>"
    counts = counts.select(*by, F.col("count").alias("_size"))
    total, widest = counts.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    bins = max(1, -(-total // BIN))

    def solved(group: pd.DataFrame) -> pd.DataFrame:
        lost = group[group["c"].isna()]
        group = group[group["c"].notna()]
        if not len(group):
            return lost[[*by, *keep]].assign(v=None)
        group = group.sort_values([*by], kind="stable").reset_index(drop=True)
        new = (group[list(by)] != group[list(by)].shift()).any(axis=1).to_numpy()
        new[:1] = True
        start, vectors = np.flatnonzero(new), []
        sizes = np.diff(np.append(start, len(group)))
        cells = 2 * len(group["c"].iloc[0])
        # as many groups at a time as keep the cells within bounds, one at least
        for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(np.cumsum(sizes * cells) // CELLS)) + 1):
            a, b = start[part[0]], start[part[-1]] + sizes[part[-1]]
            c = cov.unpack(np.stack(group["c"].iloc[a:b].to_numpy()))
            vectors += list(manifold.vectorised(manifold.fisher_maps(c, start[part] - a, group["weight"].to_numpy()[a:b], tol)[1], channels))
        found = group[[*by, *keep]].assign(v=vectors)
        return pd.concat((found, lost[[*by, *keep]].assign(v=None)), ignore_index=True) if len(lost) else found

    def along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch[[*by, *keep]].assign(v=list(manifold.vectorised(cov.unpack(np.stack(batch["s"].to_numpy())), channels)))

    binned = rows if widest <= most else rows.join(counts.where(F.col("_size") <= most).drop("_size"), list(by))
    found = binned.withColumn("_bin", F.pmod(F.xxhash64(*by), F.lit(bins))).groupBy("_bin").applyInPandas(solved, schema)
    if widest <= most:
        return found
    large = stored(rows.join(counts.where(F.col("_size") > most).drop("_size"), list(by)).select(*by, *keep, F.col("weight").cast("double"), "c"), "fisher-rows")
    found = found.unionByName(large.where("c is null").select(*by, *keep, F.lit(None).cast("array<double>").alias("v")))
    large = large.where("c is not null")
    wide = large.select(F.size("c").alias("n")).first()
    if wide is None:
        return found
    base = base_points(large, by, int((np.sqrt(8 * wide["n"] + 1) - 1) / 2), tol)
    return found.unionByName(_logs(large, by, base, keep).mapInPandas(along, schema))


def distances(rows: DataFrame, means: DataFrame, by: tuple[str, ...], keep: tuple[str, ...]) -> DataFrame:
    """(by, keep, candidate, distance): how far each of ``rows(by, keep, c)`` is from each mean of its group.

    ``means(by, candidate, back)`` have the inverse square roots of the means. The
    distance is affine-invariant: the norm of the logarithms of the eigenvalues
    of the one relative to the other.
    """

    @F.pandas_udf("double")
    def far(c: pd.Series, back: pd.Series) -> pd.Series:
        each = cov.unpack(np.stack(back))
        return pd.Series(np.sqrt((np.log(np.linalg.eigvalsh(each @ cov.unpack(np.stack(c)) @ each)) ** 2).sum(axis=-1)))

    return rows.join(means.select(*by, "candidate", "back"), list(by)).select(*by, *keep, "candidate", far("c", "back").alias("distance"))


def nearest_mean(train: DataFrame, test: DataFrame, by: tuple[str, ...], keep: tuple[str, ...], channels: int, tol: float = 1e-8) -> DataFrame:
    """(by, keep, predicted, distance): the class whose Fisher mean is nearest, a classifier that needs no tangent map.

    ``train(by, label, c)`` makes one mean a group and class, ``test(by, keep, c)``
    is told apart by them; of equal distances the smaller label counts. Test rows of a
    group without training rows have no answer and are left out, as are rows
    whose covariance is not positive definite: no distance to them is finite.
    """
    own = (*by, "label")
    train, test = (rows.where(definite("c")) for rows in (train, test))
    known = stored(train.select(*own, F.lit(1.0).alias("weight"), "c"), "fisher-rows")
    means = base_points(known, own, channels, tol).withColumnRenamed("label", "candidate")
    met = distances(test, means, by, keep)
    best = met.groupBy(*by, *keep).agg(F.min(F.struct("distance", "candidate")).alias("_b"))
    return best.select(*by, *keep, F.col("_b.candidate").alias("predicted"), F.col("_b.distance").alias("distance"))
