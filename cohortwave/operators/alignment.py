"""Tangent features, whitening, joint and fast alignment, and training, on groups of bounded size.

Sums over data are Spark's; what a group function gets is a recording's trials, or the
bootstrap means of a group of domains.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alignment as al
from ..functions import covariances as cov
from ..functions import linear, manifold
from . import arrays, fisher, overlap
from . import trials as trial_ops
from .features import domain_pairs
from .selection import balanced_accuracy

_ESTIMATE = {"scm": cov.scm, "oas": cov.oas, "lw": cov.ledoit_wolf_each, "tme": cov.tyler, "nrtme": cov.regularised_tyler}
#: Cells of super-trials and of covariances that one call holds at a time.
CELLS = 4_000_000
#: Domains of a group that one task holds out in turn.
HELD = 8


def super_covariances(trials: DataFrame, prototypes: DataFrame | None, splits: DataFrame, estimator: str = "lw", det: bool = False) -> DataFrame:
    """(recording_id, split, role, trial_no, label, c): packed covariances of each split's trials.

    With ``prototypes`` (recording_id, split, p) a super-trial has the split's
    prototype beside its channels; without, the trials stand alone. Covariances
    are made where a trial lies, once for each of its splits, so that trials are
    not repeated by split and only covariances move on. ``det`` divides by det^(1/n).
    Where no positive definite matrix comes out, as with a channel that is constant
    over a trial, ``c`` is null.
    """
    if estimator not in _ESTIMATE:
        raise ValueError(f"unknown estimator {estimator!r}")
    make = _ESTIMATE[estimator]
    length = F.size("x").alias("_n")
    sets = splits.groupBy("recording_id", "trial_no").agg(F.sort_array(F.collect_list(F.struct("split", "role"))).alias("_sets"))
    rows = trials.select("recording_id", "trial_no", F.col("class").alias("label"), length, F.flatten("x").alias("_x")).join(sets, ["recording_id", "trial_no"])
    if prototypes is None:
        rows = rows.withColumn("_p", F.array(F.array().cast("array<double>")))  # no channels beside
    else:
        own = prototypes.groupBy("recording_id").agg(F.map_from_entries(F.collect_list(F.struct("split", F.flatten("p").alias("p")))).alias("_by"))
        rows = rows.join(own, "recording_id").withColumn("_sets", F.filter("_sets", lambda s: F.map_contains_key("_by", s["split"]))).where(F.size("_sets") > 0)
        rows = rows.withColumn("_p", F.transform("_sets", lambda s: F.element_at("_by", s["split"])))

    @F.pandas_udf("array<double>")
    def packed(n: pd.Series, x: pd.Series, made: pd.Series, p: pd.Series) -> pd.Series:
        n, x, made, p = n.to_numpy(), x.to_numpy(), made.to_numpy(), p.to_numpy()
        out = np.empty(len(n), object)
        shapes = pd.DataFrame({"n": n, "x": [len(v) for v in x], "k": made, "p": [len(v) for v in p]})
        for (length, cells, k, more), at in shapes.groupby(["n", "x", "k", "p"]).indices.items():
            step = max(1, CELLS // (k * cells + more))
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                whole = np.repeat(np.concatenate(x[part]).reshape(len(part), 1, length, -1), k, axis=1)
                if more:
                    whole = np.concatenate((whole, np.concatenate(p[part]).reshape(len(part), k, length, -1)), axis=3)
                c = make(whole.reshape(len(part) * k, length, -1))
                known = cov.definite(c)
                if det:
                    c[known] = cov.unit_determinant(c[known])
                c[~known] = np.nan
                for i, row in zip(part, cov.pack(c).reshape(len(part), -1), strict=True):
                    out[i] = row
        return pd.Series(out)

    made = F.lit(1) if prototypes is None else F.size("_sets")
    rows = rows.select("recording_id", "trial_no", "label", "_sets", packed("_n", "_x", made, F.flatten("_p")).alias("_c"))
    if prototypes is None:  # a trial's covariance is the same in all of its splits
        rows = rows.withColumn("_c", F.array("_c"))
        paired = F.transform("_sets", lambda s: F.struct(s["split"].alias("split"), s["role"].alias("role"), F.col("_c")[0].alias("c")))
    else:
        paired = F.zip_with("_sets", _cut("_c", F.size("_sets")), lambda s, c: F.struct(s["split"].alias("split"), s["role"].alias("role"), c.alias("c")))
    rows = rows.select("recording_id", "trial_no", "label", F.explode(paired).alias("_s"))
    return rows.select("recording_id", "_s.split", "_s.role", "trial_no", "label", F.when(~F.isnan(F.coalesce(F.col("_s.c")[0], F.lit(float("nan")))), F.col("_s.c")).alias("c"))  # Arrow makes NaN null


def _cut(flat: str, parts: Column) -> Column:
    """An array as equally long parts."""
    width = (F.size(flat) / parts).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.slice(flat, i * width + 1, width))


def tangent_features(trials: DataFrame, prototypes: DataFrame | None, splits: DataFrame, channels: int, estimator: str = "lw", det: bool = False, balanced: bool = False, most: int = fisher.MOST) -> DataFrame:
    """(recording_id, split, role, trial_no, label, v): tangent vectors of ``super_covariances``.

    Training and test trials are mapped each at their own Fisher mean; of the
    triangle, the columns of the channels stay, those of the prototype alone go
    (without prototypes: the whole triangle). ``trials`` are packed (one row
    each), ``prototypes`` have (recording_id, split, p), p as samples by channels.
    With ``balanced`` all classes weigh alike in a mean. Sets of more than ``most``
    trials never meet in a task (``fisher``). A trial without a positive definite
    covariance has no vector: ``v`` is null, and no mean knows of it.
    """
    keys = ("recording_id", "split", "role")
    found = super_covariances(trials, prototypes, splits, estimator, det)
    found = fisher.class_weights(found, keys) if balanced else found.withColumn("weight", F.lit(1.0))
    return fisher.tangent_vectors(found, splits.groupBy(*keys).count(), keys, ("trial_no", "label"), channels, most=most)


def prototypes(trials: DataFrame, splits: DataFrame, target: int, channels: int, *, wl: int | None = None, adaptive: bool = False, components: int | None = None) -> DataFrame:
    """(recording_id, split, p): the target class's mean over each split's training trials, samples by channels.

    ``wl`` (the window's length) frees the mean of overlapping windows of all
    classes; ``adaptive`` weights trials by their inverse power; ``components``
    keeps the prototype's own leading principal components, the largest last.
    A split without training trials of the target has no prototype. ``trials`` are
    packed or not; packed ones meet their splits as they are and fall into samples after that.
    """
    if components is not None and not 1 <= components <= channels:
        raise ValueError(f"{components} components of {channels} channels")
    by = ("recording_id", "split")
    train = splits.where(F.col("role") == "train").select("recording_id", "trial_no", "split")
    if wl is None:
        train = splits.where((F.col("role") == "train") & (F.col("class") == target)).select("recording_id", "trial_no", "split")
    rows = (trial_ops.powered(trials) if adaptive else trials).join(train, ["recording_id", "trial_no"])
    if "dt" not in rows.columns:
        rows = trial_ops.unpacked(rows)
    if wl is None:
        rows = rows.groupBy(*by, "dt").agg(arrays.mean("x", channels, "weight" if adaptive else None).alias("_p"))
    else:
        if adaptive:  # relative to the mean of the class in its split, as the equations couple classes
            rows = rows.withColumn("weight", F.col("weight") / F.avg("weight").over(Window.partitionBy(*by, "class")))
        marks = rows.where("dt = 0")
        histogram = trial_ops.lag_histogram(marks.withColumnRenamed("onset", "t"), wl, marks if adaptive else None, by)
        found = overlap.corrected_means(histogram, trial_ops.toeplitz_rhs(rows, channels, by=by), wl, by=by)
        rows = trial_ops.wide_mean(found.where(F.col("class") == target), by).select(*by, "dt", F.col("m").alias("_p"))
    packed = F.sort_array(F.collect_list(F.struct("dt", "_p")))
    rows = rows.groupBy(*by).agg(packed.alias("_a")).select(*by, F.transform("_a", lambda s: s["_p"]).alias("p"))
    if components is None:
        return rows

    @F.pandas_udf("array<array<double>>")
    def reduced(p: pd.Series) -> pd.Series:
        def one(v) -> list:
            x = np.stack(v)
            turn = np.linalg.eigh(cov.scm(x))[1][:, -components:]
            first = np.take_along_axis(turn, np.abs(turn).argmax(axis=0)[None], axis=0)
            return list(x @ (turn * np.sign(first)))  # a component's largest weight is positive

        return p.map(one)

    return rows.withColumn("p", reduced("p"))


def packed_means(vectors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(..., domain, w): ``features.bootstrap_vectors`` of a domain, bootstraps by coordinates, ordered by (label, boot)."""
    packed = F.sort_array(F.collect_list(F.struct("label", "boot", "v")))
    return vectors.groupBy(*by, "domain").agg(packed.alias("_a")).select(*by, "domain", F.transform("_a", lambda s: s["v"]).alias("w"))


def _matrices(group: pd.DataFrame) -> tuple[list, list[np.ndarray]]:
    """(domains, matrices features by bootstraps), centred and scaled to mean column norm 1."""
    group = group.sort_values("domain")
    out = []
    for w in group["w"]:
        m = np.stack(w).T
        m = m - m.mean(axis=1, keepdims=True)
        out.append(m / max(np.linalg.norm(m, axis=0).mean(), 1e-300))
    return group["domain"].to_list(), out


def whitened(packed: DataFrame, by: tuple[str, ...], kind: str = "svd", size: int = 16) -> DataFrame:
    """(..., domain, rank, error): the rank of each whitened domain and how far T T' is from identity."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        domains, w = _matrices(group)
        t, _ = al.whiten(w, kind, size)
        keys = [[group[c].iloc[0] for c in by]] * len(domains)
        return pd.DataFrame([[*k, d, len(x), float(np.abs(x @ x.T - np.eye(len(x))).max())] for k, d, x in zip(keys, domains, t, strict=True)], columns=[*by, "domain", "rank", "error"])

    return packed.groupBy(*by).applyInPandas(one, _schema(packed, by) + "domain " + _kind(packed, "domain") + ", rank int, error double")


def aligned(packed: DataFrame, by: tuple[str, ...], size: int = 16, whitening: str = "svd", start: str = "none", tol: float = 1e-8) -> DataFrame:
    """(..., domain, rounds, change, before, after, b): the alignment matrix of each domain of a group.

    ``before`` and ``after`` are the mean non-diagonality of whitened and of
    aligned domains; ``b`` has one array for each output coordinate.
    """

    def several(groups: list[tuple[list, pd.DataFrame]]) -> pd.DataFrame:
        read = [_matrices(group) for _, group in groups]
        white = [al.whiten(w, whitening, size) for _, w in read]
        lines = []
        for (keys, _), (domains, _), (t, h), found in zip(groups, read, white, al.joint_alignments([t for t, _ in white], [al.start_at(t, start) for t, _ in white], tol), strict=True):
            u = al.ordered(al.normalised(found.u), t)
            eye = np.stack([np.eye(len(x)) for x in t])
            before, after = (_mean_off(al.non_diagonality(f, t)) for f in (eye, u))
            b = [(f @ g).T.tolist() for f, g in zip(h, u, strict=True)]
            lines += [[*keys, d, found.rounds, found.change, before, after, m] for d, m in zip(domains, b, strict=True)]
        return pd.DataFrame(lines, columns=[*by, "domain", "rounds", "change", "before", "after", "b"])

    return _side_by_side(packed, by, several, _schema(packed, by) + f"domain {_kind(packed, 'domain')}, rounds int, change double, before double, after double, b array<array<double>>")


def leave_one_out(packed: DataFrame, by: tuple[str, ...], size: int = 16, whitening: str = "svd", tol: float = 1e-6) -> DataFrame:
    """(..., held_out, domain, rounds, after, b): each domain in turn fitted to a group aligned without it.

    A task has a group and some of its domains to hold out, which are fitted side by
    side. Whitening, too, knows nothing of the held-out domain.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy("domain")) if by else F.row_number().over(Window.orderBy("domain"))
    held = packed.select(*by, "domain").withColumn("_part", F.floor((place - 1) / HELD).cast("int"))
    held = held.groupBy(*by, "_part").agg(F.collect_list("domain").alias("_held"))
    rows = held.join(packed, list(by)) if by else held.crossJoin(packed)
    return _held_out(rows, by, ("_part",), size, whitening, tol)


def fitted(new: DataFrame, group: DataFrame, size: int = 16, whitening: str = "svd", tol: float = 1e-6) -> DataFrame:
    """(domain, after, b): each domain of ``new`` fitted to a group that stays as it is.

    Both have (domain, w), columns of ``w`` in one order; the group, of bounded
    size, goes to every new domain, and comes out of each fit the same.
    """
    one = F.lit(0).alias("_all")
    rows = new.select(one, F.col("domain").alias("held_out")).join(F.broadcast(group.select(one, "domain", "w")), "_all").select("held_out", "domain", "w")
    rows = rows.unionByName(new.select(F.col("domain").alias("held_out"), "domain", "w")).withColumn("_held", F.array("held_out"))
    return _held_out(rows, (), ("held_out",), size, whitening, tol).where("domain = held_out").select("domain", "after", "b")


def _held_out(rows: DataFrame, by: tuple[str, ...], part: tuple[str, ...], size: int, whitening: str, tol: float) -> DataFrame:
    """Of each group (by, part), for every domain of its ``_held``: all domains but that one aligned, and that one fitted to them."""

    def several(groups: list[tuple[list, pd.DataFrame]]) -> pd.DataFrame:
        cases = []
        for keys, group in groups:
            domains, w = _matrices(group)
            for out in sorted(group["_held"].iloc[0]):
                rest = [i for i in range(len(w)) if domains[i] != out]
                cases.append((keys[: len(by)], domains, w, out, rest, *al.whiten([w[i] for i in rest], whitening, size)))
        lines = []
        for (keys, domains, w, out, rest, t, h), found in zip(cases, al.joint_alignments([c[5] for c in cases], tol=tol), strict=True):
            at = domains.index(out)
            if whitening == "none":
                new_t, new_h = w[at], np.eye(len(w[at]))
            else:
                (new_t,), (new_h,) = al.whiten([w[at]], "pca" if whitening == "pca" else "svd", len(t[0]))
            u = al.normalised(np.concatenate((found.u, al.fast_alignment(t, found.u, new_t)[None])))
            whole, names, filters = [*t, new_t], [*[domains[i] for i in rest], out], [*h, new_h]
            u = al.ordered(u, whole)
            after = float(al.non_diagonality(u, whole)[-1, :-1].mean())
            lines += [[*keys, out, d, found.rounds, after, (f @ g).T.tolist()] for d, f, g in zip(names, filters, u, strict=True)]
        return pd.DataFrame(lines, columns=[*by, "held_out", "domain", "rounds", "after", "b"])

    kind = _kind(rows, "domain")
    return _side_by_side(rows, (*by, *part), several, _schema(rows, by) + f"held_out {kind}, domain {kind}, rounds int, after double, b array<array<double>>")


def _side_by_side(rows: DataFrame, by: tuple[str, ...], several: Callable[[list[tuple[list, pd.DataFrame]]], pd.DataFrame], schema: str) -> DataFrame:
    """``several`` of lists of (keys, group): groups of bounded size, as many at a time as Arrow puts into a batch."""
    names = [c for c in rows.columns if c not in by]
    packed = rows.groupBy(*by).agg(F.collect_list(F.struct(*names)).alias("_g")).select(*by, *[F.col(f"_g.{c}").alias(c) for c in names])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(list(r[: len(by)]), pd.DataFrame({c: list(v) for c, v in zip(names, r[len(by) :], strict=True)})) for r in frame[[*by, *names]].itertuples(index=False)]
            found = [(keys, group) for keys, group in found if len(group)]
            if found:
                yield several(found)

    return packed.mapInPandas(batches, schema)


def _mean_off(a: np.ndarray) -> float:
    return float(a[~np.eye(len(a), dtype=bool)].mean())


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _schema(df: DataFrame, by: tuple[str, ...]) -> str:
    return "".join(f"{c} {_kind(df, c)}, " for c in by)


def trained_alone(features: DataFrame, by: tuple[str, ...], classifier: str = "svc") -> DataFrame:
    """(..., domain, acc): a classifier for each domain, balanced accuracy on its own test rows.

    Null, here and below, where a domain has no rows to train on or none to test;
    rows without a vector are neither.
    """
    return _trained(features, (*by, "domain"), by, classifier)


def trained_together(features: DataFrame, by: tuple[str, ...], classifier: str = "svc") -> DataFrame:
    """(..., domain, acc): one classifier for all domains of a group, tested in each."""
    return _trained(features, by, by, classifier)


def trained_without(features: DataFrame, by: tuple[str, ...], classifier: str = "svc") -> DataFrame:
    """(..., domain, acc): features of leave-one-out models; training on the rest, test in the held-out domain."""
    rows = features.where(((F.col("role") == "train") & (F.col("domain") != F.col("held_out"))) | ((F.col("role") == "test") & (F.col("domain") == F.col("held_out"))))
    return _trained(rows, (*by, "held_out"), by, classifier)


def _trained(features: DataFrame, group: tuple[str, ...], by: tuple[str, ...], classifier: str) -> DataFrame:
    if classifier not in linear.CLASSIFIERS:
        raise ValueError(f"unknown classifier {classifier!r}")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        columns = [*by, "domain", "acc"]
        known = rows["v"].notna()
        train, test = rows[known & (rows["role"] == "train")], rows[known & (rows["role"] == "test")]
        if not len(train) or not len(test):  # nothing to learn from, or to test: no accuracy
            return pd.DataFrame([[*[rows[c].iloc[0] for c in by], d, None] for d in sorted(set((test if len(test) else rows)["domain"]))], columns=columns)
        train = train.sort_values(["domain", "trial_no"])
        model = linear.train(np.stack(train["v"].to_numpy()), train["label"].to_numpy(), classifier)
        keys = [rows[c].iloc[0] for c in by]
        return pd.DataFrame([[*keys, d, linear.balanced_accuracy(own["label"].to_numpy(), linear.predict(model, np.stack(own["v"].to_numpy())))] for d, own in test.groupby("domain")], columns=columns)

    return features.groupBy(*group).applyInPandas(one, _schema(features, by) + f"domain {_kind(features, 'domain')}, acc double")


def cross_validated(features: DataFrame, by: tuple[str, ...], folds: int = 10, classifier: str = "enlr") -> DataFrame:
    """(..., domain, acc, place): mean balanced accuracy over folds of each domain's rows, best domain first.

    A row's fold is its place within its class, modulo ``folds``. Folds run side by side.
    """
    place = F.row_number().over(Window.partitionBy(*by, "domain", "label").orderBy("trial_no")) - 1
    rows = features.drop("role").withColumn("_own", place % folds).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rows = rows.withColumn("role", F.when(F.col("_own") == F.col("fold"), "test").otherwise("train")).drop("_own")
    found = _trained(rows, (*by, "fold", "domain"), by, classifier).groupBy(*by, "domain").agg(F.avg("acc").alias("acc"))
    order = Window.partitionBy(*by).orderBy(F.desc("acc"), "domain")
    return found.withColumn("place", F.row_number().over(order)) if by else found


def penalty_paths(features: DataFrame, by: tuple[str, ...], target: int = 2, mix: float = 0.5, many: int = 20) -> DataFrame:
    """(..., domain, step, strength, deviance, chosen): the penalties of each domain's logistic classifier, and which one folds choose.

    ``target`` against the other classes. A domain of one class has no path. The
    folds of all domains of a group, which is of bounded size, are solved side by side.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        columns, keys, sets = [*by, "domain", "step", "strength", "deviance", "chosen"], [], []
        for domain, own in rows[rows["v"].notna()].sort_values("trial_no").groupby("domain"):
            y = np.where(own["label"] == target, 1.0, -1.0)
            if len(set(y)) == 2:
                keys.append([*[own[c].iloc[0] for c in by], domain])
                sets.append((np.stack(own["v"].to_numpy()), y))
        found = linear.chosen_penalties(sets, mix, many)
        return pd.DataFrame([[*k, i + 1, s, d, i == lost.argmin()] for k, (strengths, lost) in zip(keys, found, strict=True) for i, (s, d) in enumerate(zip(strengths, lost, strict=True))], columns=columns)

    schema = _schema(features, (*by, "domain")) + "step int, strength double, deviance double, chosen boolean"
    return features.groupBy(*(by or ("domain",))).applyInPandas(one, schema)


def trained_at_scale(features: DataFrame, rounds: int = 50, target: int = 2) -> DataFrame:
    """(split, domain, acc): one classifier a split for features of any number, ``target`` against the rest, balanced accuracy by domain.

    The splits are few; each fit runs on the whole cluster. A split without two
    classes to learn from has no accuracy (null); an empty table gives no rows.
    """
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    rows = features.select("split", "domain", "role", "label", array_to_vector("v").alias("features"), (F.col("label") == target).cast("double").alias("target"))
    found = []
    for split in [r["split"] for r in rows.select("split").distinct().orderBy("split").collect()]:
        own = rows.where(F.col("split") == split)
        train = own.where("role = 'train'")
        counts = {r["target"]: r["count"] for r in train.groupBy("target").count().collect()}
        if len(counts) < 2:
            found.append(own.where("role = 'test'").select("split", "domain", F.lit(None).cast("double").alias("acc")).distinct())
            continue
        weight = F.when(F.col("target") == 1, sum(counts.values()) / (2 * counts[1.0])).otherwise(sum(counts.values()) / (2 * counts[0.0]))
        model = LinearSVC(labelCol="target", weightCol="weight", maxIter=rounds, regParam=1e-4).fit(train.withColumn("weight", weight))
        scored = model.transform(own.where("role = 'test'")).select("split", "domain", F.col("target").alias("truth"), F.col("prediction").alias("predicted"))
        found.append(balanced_accuracy(scored, ("split", "domain")).select("split", "domain", F.col("balanced_accuracy").alias("acc")))
    whole = rows.select("split", "domain", F.lit(None).cast("double").alias("acc")).limit(0)
    for one in found:
        whole = whole.unionByName(one)
    return whole


def canonical_ranking(packed: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(..., target, source, correlation, place): sources of each target by first canonical correlation.

    Of whole vectors. Two domains need more columns, and more trials behind
    them, than the dimensions of both together; with fewer, two vectors always
    agree on some direction and the correlation is 1.
    """
    @F.pandas_udf("double")
    def first(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float(al.canonical(np.stack(p).T, np.stack(q).T)[0]) for p, q in zip(x, y, strict=True)])

    rows = domain_pairs(packed, by, ordered=True).select(*by, F.col("domain_a").alias("target"), F.col("domain_b").alias("source"), first("a", "b").alias("correlation"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by, "target").orderBy(F.desc("correlation"), "source")))


def covariance_pairs(packed: DataFrame, by: tuple[str, ...], components: int = 8) -> DataFrame:
    """(..., domain_a, domain_b, component, value): maximum covariance analysis of every pair of domains."""
    @F.pandas_udf("array<double>")
    def values(x: pd.Series, y: pd.Series) -> pd.Series:
        def pair(p, q) -> list[float]:
            p, q = np.stack(p).T, np.stack(q).T
            p, q = p - p.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True)
            return al.maximum_covariance(p, q)[2][:components].tolist()

        return pd.Series([pair(p, q) for p, q in zip(x, y, strict=True)])

    rows = domain_pairs(packed, by).select(*by, F.col("domain_b").alias("domain_a"), F.col("domain_a").alias("domain_b"), F.posexplode(values("b", "a")).alias("component", "value"))
    return rows.withColumn("component", F.col("component") + 1)


def covariance_sets(packed: DataFrame, by: tuple[str, ...], components: int = 8, tol: float = 1e-8) -> DataFrame:
    """(..., domain, rounds, b): maximum covariance analysis of all domains of a group, two or more.

    ``b`` has one array for each component; ``features.apply_model`` applies it to
    training and test vectors alike. Filters are orthonormal; components fall by shared covariance.
    """

    def one(group: pd.DataFrame) -> pd.DataFrame:
        domains, w = _matrices(group)
        found = al.orthogonal_alignment(w, components, tol)
        keys = [group[c].iloc[0] for c in by]
        return pd.DataFrame([[*keys, d, found.rounds, u.T.tolist()] for d, u in zip(domains, found.u, strict=True)], columns=[*by, "domain", "rounds", "b"])

    return packed.groupBy(*by).applyInPandas(one, _schema(packed, by) + f"domain {_kind(packed, 'domain')}, rounds int, b array<array<double>>")
