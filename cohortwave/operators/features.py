"""Feature tables: bootstraps, centring, scaling, cross-covariances, projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays


#: Parts in which the rows of a class are numbered.
PARTS = 64


def _hash(*parts: Column) -> Column:
    """48 bits of md5, as LONG: alike in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("long")


def draws(features: DataFrame, n_boot: int, boot_size: int, seed: int = 1, by: tuple[str, ...] = ("domain",)) -> DataFrame:
    """(..., label, boot, draw, trial_no): rows drawn with replacement for each bootstrap.

    The position drawn depends on the seed, the bootstrap and the draw alone, so
    bootstraps of equally large classes correspond across domains. Rows get
    their positions in parts, by a hash of the trial, so that a class of any size
    is numbered by many tasks.
    """
    own = [*by, "label"]
    rows = features.select(*own, "trial_no", (_hash(F.col("trial_no").cast("string")) % PARTS).cast("int").alias("_part"))
    sizes = rows.groupBy(*own, "_part").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*own, "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"), F.sum("_n").over(Window.partitionBy(*own)).alias("n"))
    wanted = sizes.groupBy(*own).agg(F.max("n").alias("n"))
    wanted = wanted.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_boot))).alias("boot")).select("*", F.explode(F.sequence(F.lit(1), F.lit(boot_size))).alias("draw"))
    key = _hash(F.lit(str(seed)), F.col("boot").cast("string"), F.col("draw").cast("string"))
    wanted = wanted.select(*own, "boot", "draw", (key % F.col("n") + 1).alias("_at"))
    at = F.row_number().over(Window.partitionBy(*own, "_part").orderBy("trial_no"))
    placed = rows.withColumn("_in", at).join(sizes.drop("n"), [*own, "_part"])
    placed = placed.select(*own, "trial_no", (F.col("_in") + F.col("_ahead")).alias("_at"))
    return placed.join(wanted, [*own, "_at"]).select(*own, "boot", "draw", "trial_no")


def bootstrap_vectors(features: DataFrame, drawn: DataFrame, by: tuple[str, ...] = ("domain",), size: int | None = None) -> DataFrame:
    """(..., label, boot, v): the mean vector of every bootstrap; ``size`` is the length of ``v``, if known."""
    own = [*by, "label"]
    rows = drawn.join(features.select(*own, "trial_no", "v"), [*own, "trial_no"])
    return rows.groupBy(*own, "boot").agg(arrays.mean("v", size).alias("v"))


def bootstrap_means(features: DataFrame, drawn: DataFrame, by: tuple[str, ...] = ("domain",), size: int | None = None) -> DataFrame:
    """(..., label, boot, coord, mean): ``bootstrap_vectors``, one row a coordinate."""
    rows = bootstrap_vectors(features, drawn, by, size).select(*by, "label", "boot", F.posexplode("v").alias("coord", "mean"))
    return rows.withColumn("coord", F.col("coord") + 1)


def centred(features: DataFrame, size: int | None = None) -> DataFrame:
    """Vectors minus their domain's mean vector, then over the mean norm of what is left.

    Means are aggregates by coordinate; they come back as one short row per domain.
    """
    means = features.groupBy("domain").agg(arrays.mean("v", size).alias("_m"))
    rows = features.join(means, "domain")
    rows = rows.withColumn("v", F.zip_with("v", "_m", lambda a, b: a - b)).drop("_m")
    return norm_scaled(rows, ("domain",))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def norm_scaled(features: DataFrame, by: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Vectors over the mean norm of their group: each set by its own."""
    scale = features.groupBy(*by).agg(F.avg(norm(F.col("v"))).alias("_s"))
    rows = features.join(scale, list(by))
    return rows.withColumn("v", F.transform("v", lambda x: x / F.col("_s"))).drop("_s")


def domain_pairs(packed: DataFrame, by: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """(..., domain_a, domain_b, a, b): the packed matrices of every two domains of a group, b the smaller id unless ``ordered``.

    A group's ids, not its matrices, are gathered and dealt to each domain; the
    other matrix then comes by an equality join on the whole key.
    """
    keys = [*by, "_all"]
    rows = packed.withColumn("_all", F.lit(0))
    known = rows.groupBy(*keys).agg(F.collect_set("domain").alias("_ids"))
    other = F.col("domain_b") != F.col("domain_a") if ordered else F.col("domain_b") < F.col("domain_a")
    a = rows.join(known, keys).select(*keys, F.col("domain").alias("domain_a"), F.col("w").alias("a"), F.explode("_ids").alias("domain_b")).where(other)
    b = rows.select(*keys, F.col("domain").alias("domain_b"), F.col("w").alias("b"))
    return a.join(b, [*keys, "domain_b"]).select(*by, "domain_a", "domain_b", "a", "b")


def cross_covariances(packed: DataFrame) -> DataFrame:
    """(domain_a, domain_b, coord_a, coord_b, c), a > b: sums over bootstraps of products of coordinates.

    ``packed`` has (domain, w), w as bootstraps by coordinates in one order for all
    domains (``alignment.packed_means``): one matrix product for each pair of domains.
    """

    @F.pandas_udf("array<double>")
    def product(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(np.stack(p).T @ np.stack(q)).ravel() for p, q in zip(a, b, strict=True)], dtype=object)

    width = F.size(F.col("b")[0])
    rows = domain_pairs(packed).select("domain_a", "domain_b", width.alias("_n"), F.posexplode(product("a", "b")).alias("_i", "c"))
    return rows.select("domain_a", "domain_b", (F.floor(F.col("_i") / F.col("_n")) + 1).cast("int").alias("coord_a"), (F.col("_i") % F.col("_n") + 1).alias("coord_b"), "c")


def apply_model(features: DataFrame, model: DataFrame, on: tuple[str, ...] = ("domain",)) -> DataFrame:
    """Vectors multiplied by their domain's matrix: ``model`` has ``b``, one array per output coordinate. A null vector stays null."""
    dot = lambda col: F.aggregate(F.zip_with("v", col, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    rows = features.join(model.select(*on, "b"), list(on))
    return rows.withColumn("v", F.when(F.col("v").isNotNull(), F.transform("b", dot))).drop("b")


def apply_models(features: DataFrame, models: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """As ``apply_model``, for models with columns of their own (a held-out domain): a row for each model that fits."""
    dot = lambda col: F.aggregate(F.zip_with("v", col, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return features.join(models, list(on)).withColumn("v", F.when(F.col("v").isNotNull(), F.transform("b", dot))).drop("b")


def column_normalised(samples: DataFrame, channels: int) -> DataFrame:
    """Samples whose channels are divided by their sum over the recording."""
    sums = samples.groupBy("recording_id").agg(arrays.total("x", channels).alias("_s"))
    return samples.join(sums, "recording_id").withColumn("x", F.zip_with("x", "_s", lambda a, b: a / b)).drop("_s")
