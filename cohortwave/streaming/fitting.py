"""New domains fitted to a frozen group while their trials arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.alignment import fitted


def running_means(features: DataFrame, size: int, bins: int) -> DataFrame:
    """(domain, label, bin, n, v): means of the trials that a hash deals to each of ``bins`` bins of a class.

    The bins take the place of bootstraps: a stream's state is one sum a bin, however
    many trials have come, and columns correspond across domains. The same over a
    table and over a stream.
    """
    bin_ = F.pmod(F.xxhash64("trial_no"), F.lit(bins)).cast("int")
    return features.groupBy("domain", "label", bin_.alias("bin")).agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("v")[i]) for i in range(size)]).alias("v"))


def complete(means: DataFrame, labels: int, bins: int, enough: int = 1) -> DataFrame:
    """(domain, w): packed means, by label and bin, of the domains of which every bin of every class has ``enough`` trials."""
    packed = F.sort_array(F.collect_list(F.struct("label", "bin", "v")))
    rows = means.where(F.col("n") >= enough).groupBy("domain").agg(packed.alias("_a")).where(F.size("_a") == labels * bins)
    return rows.select("domain", F.transform("_a", lambda s: s["v"]).alias("w"))


def latest(means: DataFrame) -> DataFrame:
    """Of means that were written batch by batch, the last of each bin."""
    place = F.row_number().over(Window.partitionBy("domain", "label", "bin").orderBy(F.desc("batch")))
    return means.withColumn("_r", place).where("_r = 1").drop("_r", "batch")


def fit_stream(stream: DataFrame, group: DataFrame, out: str, checkpoint: str, size: int, labels: int, bins: int, enough: int = 1, white_dim: int = 16):
    """Start fitting what streams in to ``group(domain, w)``; what is there is taken once, then the query ends.

    State is the running means; Spark keeps it and, after a stop, takes it up from
    ``checkpoint``. A batch writes the means that it changed under ``out/means`` and
    the filters of the domains that are complete and changed by it under ``out/models``,
    both by its number: a batch that runs twice writes the same again.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{out}/means/batch={number}")
        means = spark.read.parquet(f"{out}/means")
        changed = means.where(F.col("batch") == number).select("domain").distinct()
        ready = complete(latest(means), labels, bins, enough).join(changed, "domain", "left_semi")
        fitted(ready, group, white_dim).write.mode("overwrite").parquet(f"{out}/models/batch={number}")

    means = running_means(stream, size, bins)
    return means.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def models(spark, out: str) -> DataFrame:
    """(domain, after, b): the last filters of every domain that ``fit_stream`` has fitted."""
    rows = spark.read.parquet(f"{out}/models")
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("batch")))
    return rows.withColumn("_r", place).where("_r = 1").drop("_r", "batch")
