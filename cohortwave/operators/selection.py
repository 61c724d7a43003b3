"""Choice of subjects and files, and summaries of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_subjects(files: DataFrame, n: int) -> DataFrame:
    """All files of the first ``n`` subjects in id order; 0 takes all."""
    if n <= 0:
        return files
    subjects = files.select("subject").distinct().orderBy("subject").limit(n)
    return files.join(subjects, "subject", "left_semi")


def random_subjects(files: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """All files of ``n`` subjects chosen by a hash of the seed and the subject, each once."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("subject").cast("string")).cast("binary"))
    subjects = files.select("subject").distinct().orderBy(key, "subject").limit(n).select("subject")
    return files.join(subjects, "subject", "left_semi")


def best_files(scores: DataFrame, n: int, descending: bool = True) -> DataFrame:
    """The ``n`` files with the largest (or smallest) score; ties by file."""
    order = F.desc("score") if descending else F.asc("score")
    return scores.orderBy(order, "file").limit(n)


def beyond(scores: DataFrame, threshold: float, above: bool = True) -> DataFrame:
    """Files whose score is strictly above (or below) ``threshold``, between 0 and 1."""
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    return scores.where(F.col("score") > threshold if above else F.col("score") < threshold)


def paired(data: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Data that has its metadata; data without any is left out."""
    return data.join(meta, key, "left_semi")


def balanced_accuracy(predictions: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(..., balanced_accuracy, accuracy): the mean recall of the classes, and the plain share."""
    hit = (F.col("truth") == F.col("predicted")).cast("double")
    recall = predictions.groupBy(*by, "truth").agg(F.sum(hit).alias("_h"), F.count("*").alias("_n"))
    return recall.groupBy(*by).agg(F.avg(F.col("_h") / F.col("_n")).alias("balanced_accuracy"), (F.sum("_h") / F.sum("_n")).alias("accuracy"))


def accuracy_summary(accuracies: DataFrame) -> DataFrame:
    """(domain, mean, deviation, place) over splits; the deviation of one split is null, places go down by mean."""
    rows = accuracies.groupBy("domain").agg(F.avg("acc").alias("mean"), F.when(F.count("*") > 1, F.stddev_samp("acc")).alias("deviation"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("mean"), "domain")).cast("long"))
