"""Train and test splits, and class balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shuffle_key(seed: int, split: Column, *parts: Column) -> Column:
    """A hash that orders rows at random, the same in every engine with md5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), split.cast("string"), *[p.cast("string") for p in parts]).cast("binary"))


def held_share(n_splits: int, ratio: float | None) -> tuple[float, bool]:
    """(share of a class that the shuffled head takes, whether that head is the training set)."""
    if n_splits < 1 or (ratio is not None and not 0 < ratio < 100):
        raise ValueError("n_splits must be positive and the ratio between 0 and 100")
    if ratio is None:
        return 1 / n_splits, n_splits == 1
    return (ratio / 100, True) if ratio <= 50 else ((100 - ratio) / 100, False)


def stratified(trials: DataFrame, n_splits: int = 5, ratio: float | None = None, seed: int = 1) -> DataFrame:
    """(recording_id, split, trial_no, class, role): independent shuffles of each class.

    A split's head takes floor(n * share) trials of each class; it trains if
    ``ratio`` is 50 or less (or for a single split), else it tests. One table
    serves prototypes and covariances alike.
    """
    share, head_trains = held_share(n_splits, ratio)
    head, rest = ("train", "test") if head_trains else ("test", "train")
    rows = trials.select("recording_id", "trial_no", "class", F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("split"))
    own = Window.partitionBy("recording_id", "split", "class")
    place = F.row_number().over(own.orderBy(shuffle_key(seed, F.col("split"), F.col("recording_id"), F.col("trial_no")), "trial_no"))
    taken = F.floor(F.count("*").over(own) * F.lit(share) + 1e-9)
    return rows.select("recording_id", "split", "trial_no", "class", F.when(place <= taken, head).otherwise(rest).alias("role"))


def first_against_rest(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with role: the first of each group trains, the others test."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("role", F.when(place == 1, "train").otherwise("test"))


def last_against_rest(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``rows`` with role: those of the last ``order`` of each group test, the others train."""
    last = rows.groupBy(group).agg(F.max(order).alias("_last"))
    return rows.join(last, group).withColumn("role", F.when(F.col(order) == F.col("_last"), "test").otherwise("train")).drop("_last")


def overlaps(splits: DataFrame) -> DataFrame:
    """(recording_id, split_a, split_b, shared): test trials that two splits share, a < b."""
    test = splits.where("role = 'test'").select("recording_id", "trial_no", "split")
    a, b = test.withColumnRenamed("split", "split_a"), test.withColumnRenamed("split", "split_b")
    pairs = a.join(b, ["recording_id", "trial_no"]).where("split_a < split_b")
    return pairs.groupBy("recording_id", "split_a", "split_b").agg(F.count("*").alias("shared"))


def balance(features: DataFrame) -> DataFrame:
    """Of every domain and label the first rows, as many as the smallest (domain, label) has.

    The smallest count is one number per label, so the comparison needs no
    second pass in a single task.
    """
    counts = features.groupBy("domain", "label").count().groupBy("label").agg(F.min("count").alias("_least"))
    place = F.row_number().over(Window.partitionBy("domain", "label").orderBy("trial_no"))
    rows = features.withColumn("_r", place).join(counts, "label").where("_r <= _least")
    return rows.drop("_r", "_least")


def class_weights(features: DataFrame) -> DataFrame:
    """(domain, label, rows, weight): n / (classes * rows of the class)."""
    rows = features.groupBy("domain", "label").agg(F.count("*").alias("rows"))
    own = Window.partitionBy("domain")
    return rows.select("domain", "label", "rows", (F.sum("rows").over(own) / (F.count("*").over(own) * F.col("rows"))).alias("weight"))
