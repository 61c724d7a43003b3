"""Queries that run a stream to its end over a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.features import norm
from ..sources.tables import embedding_features
from ..streaming import fitting, scoring

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def stream_scores(spark, sf_dir):
    """Every vector multiplied by its domain's frozen matrix as it streams in, and its energy there."""
    entry = lambda k: F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.cos((F.col("domain") * k * i).cast("double")))
    model = spark.range(1, 5).select(F.col("id").cast("int").alias("domain")).select("domain", F.transform(F.sequence(F.lit(1), F.lit(8)), entry).alias("b"))
    out, mark = scoring.shared_path(spark, "stream-out"), scoring.shared_path(spark, "stream-mark")
    scoring.score_stream(scoring.feature_stream(spark, sf_dir, "embeddings"), model, out, mark).awaitTermination()
    return spark.read.schema("domain int, trial_no long, label int, energy double").parquet(out)


QUERIES["stream_scores"] = stream_scores
ORACLE_SQL["stream_scores"] = """WITH p AS (
  SELECT (vec_id % 4 + 1)::INT AS domain, vec_id AS trial_no, (label % 2 + 1)::INT AS label, embedding::DOUBLE[] AS v FROM embeddings
), a AS (
  SELECT domain, trial_no, label, list_sum(list_transform(range(1, 65), lambda i: v[i] * cos((domain * k * i)::DOUBLE))) AS y FROM p CROSS JOIN (SELECT unnest(range(1, 9)) AS k) ks
)
SELECT domain, trial_no, label, round(sqrt(sum(y * y)), 8) AS energy FROM a GROUP BY domain, trial_no, label"""


def stream_fit(spark, sf_dir):
    """Domain 4 fitted to domains 1 to 3 as its trials stream in: its filters' energy, coordinate by coordinate."""
    size, bins, table = 64, 8, embedding_features(spark, sf_dir)
    group = fitting.complete(fitting.running_means(table.where("domain < 4"), size, bins), 2, bins)
    stream = scoring.feature_stream(spark, sf_dir, "embeddings").where("domain = 4")
    out, mark = scoring.shared_path(spark, "fit-out"), scoring.shared_path(spark, "fit-mark")
    fitting.fit_stream(stream, group, out, mark, size, 2, bins, 1, 8).awaitTermination()
    rows = fitting.models(spark, out).select("domain", F.posexplode("b").alias("coord", "f"))
    return rows.select("domain", (F.col("coord") + 1).alias("coord"), F.round(norm("f"), 6).alias("energy"))


QUERIES["stream_fit"] = stream_fit
