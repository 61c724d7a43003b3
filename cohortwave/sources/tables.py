"""Adapters that give the input tables the shapes of the signal operators.

samples: recording_id, t (from 1), stim (0 or a class), x ARRAY<DOUBLE>.
features: domain, trial_no, label, v ARRAY<DOUBLE>.

Recordings get their name before they are dealt out, and their arrays after that: what
works by recording then finds them where they lie, and only plain columns are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Order of a line item within its supplier; unique at every scale of the tables.
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel: a user's events in time; clicks are class 1, purchases class 2."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("user_id", "recording_id")
    e = e.withColumn("t", F.row_number().over(Window.partitionBy("recording_id").orderBy("ts", "event_id")).cast("long"))
    stim = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(0)
    return e.select("recording_id", "t", stim.alias("stim"), F.array("value").alias("x"))


EVENT_SAMPLES = """samples AS (
  SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t,
    CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS stim, value AS x
  FROM events
)"""


def line_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four channels: a supplier's line items in order; line 1 is class 1, line 4 class 2."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_suppkey", "recording_id")
    order = ["recording_id" if c == "l_suppkey" else c for c in LINE_ORDER]
    li = li.withColumn("t", F.row_number().over(Window.partitionBy("recording_id").orderBy(*order)).cast("long"))
    stim = F.when(F.col("l_linenumber") == 1, 1).when(F.col("l_linenumber") == 4, 2).otherwise(0)
    x = F.array(F.col("l_quantity") / 10, F.col("l_extendedprice") * 3.1830988618e-05, F.col("l_discount") * 40, F.col("l_tax") * 40)
    return li.select("recording_id", "t", stim.alias("stim"), x.alias("x"))


LINE_SAMPLES = """samples AS (
  SELECT l_suppkey AS recording_id,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS t,
    CASE l_linenumber WHEN 1 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS stim,
    [l_quantity / 10, l_extendedprice * 3.1830988618e-05::DOUBLE, l_discount * 40, l_tax * 40] AS x
  FROM lineitem
)"""


def embedding_features(spark: SparkSession, sf_dir: str, domains: int = 4) -> DataFrame:
    """Vectors as features: domain by id, two classes by label."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(
        (F.col("vec_id") % domains + 1).cast("int").alias("domain"),
        F.col("vec_id").alias("trial_no"),
        (F.col("label") % 2 + 1).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    )


EMBEDDING_FEATURES = """features AS (
  SELECT (vec_id % 4 + 1)::INT AS domain, vec_id AS trial_no, (label % 2 + 1)::INT AS label, embedding::DOUBLE[] AS v FROM embeddings
)"""


def label_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks taken as truth and prediction: what quality tells of toxic, in splits and domains by id."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        (F.col("doc_id") % 5 + 1).cast("int").alias("split"),
        (F.col("doc_id") % 4 + 1).cast("int").alias("domain"),
        F.col("quality").alias("truth"),
        (1 - F.col("toxic")).alias("predicted"),
    )


LABEL_PREDICTIONS = """predictions AS (
  SELECT (doc_id % 5 + 1)::INT AS split, (doc_id % 4 + 1)::INT AS domain, quality AS truth, 1 - toxic AS predicted FROM labels
)"""
