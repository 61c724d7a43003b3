"""A frozen group model applied to features as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import apply_model, norm
from ..sources.stored import shared_path

__all__ = ["feature_stream", "score_stream", "shared_path"]


def feature_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 8) -> DataFrame:
    """Vectors of a table as a stream: domain, trial_no, label, v."""
    path = f"{folder}/{name}.parquet"
    # as a pattern, so that a table of one file will do as well as a folder
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parque[t]")
    return rows.select((F.col("vec_id") % 4 + 1).cast("int").alias("domain"), F.col("vec_id").alias("trial_no"), (F.col("label") % 2 + 1).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def score_stream(stream: DataFrame, model: DataFrame, out: str, checkpoint: str):
    """Start writing aligned features to ``out``; what is there is scored once, then the query ends.

    The join is with a static model, so the stream keeps no state; the file sink and the
    checkpoint make every row come out exactly once.
    """
    aligned = apply_model(stream, model).select("domain", "trial_no", "label", F.round(norm("v"), 8).alias("energy"))
    return aligned.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
