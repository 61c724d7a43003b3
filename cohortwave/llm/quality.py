"""Quality scores from compression: two zstandard dictionaries, one difference.

One dictionary is built from good and one from bad labelled text. A text that
resembles the good text compresses better with the first. The difference of
both sizes, divided by the square root of the text's length, is the one measure;
a logistic curve fitted on rows that built no dictionary turns it into a
probability. Both dictionaries save some bytes of nearly every word, so the
difference grows with the length and its noise with the length's root.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, held_out

#: Labelled rows of each class, about, that a model is fitted on: the bound of the sample.
SAMPLE_ROWS = 1600
#: A text is compressed in pieces of so many bytes: each meets the dictionary anew, and memory stays bounded.
PIECE = 1 << 11
DICTIONARY_BYTES = 1 << 18
LEVEL = 3
#: Bytes of one sampled text that the driver gets, at most: with SAMPLE_ROWS, the bound of the sample in bytes.
SAMPLE_BYTES = 1 << 15


def pieces(text: bytes) -> Iterator[bytes]:
    return (text[at : at + PIECE] for at in range(0, len(text), PIECE))


@dataclass
class QualityModel:
    """``good`` and ``bad`` are dictionaries; ``curve`` is the offset and the slope of a text's measure."""

    good: bytes
    bad: bytes
    curve: np.ndarray

    def __post_init__(self):
        self._own = None

    def __getstate__(self):
        return self.__dict__ | {"_own": None}

    def sizes(self, text: bytes) -> tuple[int, int]:
        """Compressed bytes with the good and with the bad dictionary."""
        if self._own is None:
            self._own = [_compressor(self.good), _compressor(self.bad)]
        return tuple(sum(len(c.compress(p)) for p in pieces(text)) for c in self._own)

    def measure(self, text: bytes | None) -> float:
        """(size with the bad dictionary - size with the good) / root of the length; 0 for an empty text."""
        if not text or not self.good or not self.bad:
            return 0.0
        good, bad = self.sizes(text)
        return (bad - good) / len(text) ** 0.5

    def score(self, text: bytes | None) -> float:
        """The chance that a reader marks the text as good."""
        z = float(self.curve @ (1.0, self.measure(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    content = zstandard.ZstdCompressionDict(dictionary)
    content.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)


def _dictionary(texts: list[bytes]) -> bytes:
    samples = [p for t in texts for p in pieces(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Offset and slopes by Newton's method, with a small ridge on the slopes."""
    middle, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    design, beta = np.column_stack((np.ones(len(x)), (x - middle) / scale)), np.zeros(x.shape[1] + 1)
    penalty = np.diag([1e-9, *[ridge * weight.sum()] * x.shape[1]])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        bend = (design * (weight * p * (1 - p))[:, None]).T @ design + penalty + 1e-9 * np.eye(len(beta))
        step = np.linalg.solve(bend, design.T @ (weight * (y - p)) - penalty @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[1:] / scale
    return np.append(beta[0] - slopes @ middle, slopes)


def fit(texts: list[bytes], labels: list[int], prior: float) -> QualityModel:
    """Dictionaries from three of five rows, the curve from the others; ``prior`` is the share of good rows."""
    if len(set(labels)) < 2:
        return QualityModel(b"", b"", np.array([np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)), 0.0]))
    build = [i % 5 < 3 for i in range(len(texts))]
    model = QualityModel(*(_dictionary([t for t, v, b in zip(texts, labels, build, strict=True) if b and v == k]) for k in (1, 0)), np.zeros(2))
    rest = [i for i, b in enumerate(build) if not b] or list(range(len(texts)))
    x, y = np.array([[model.measure(texts[i])] for i in rest]), np.array([float(labels[i]) for i in rest])
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    model.curve = _logistic(x, y, weight)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on about ``sample_rows`` labelled documents of each class, chosen by a hash of doc_id.

    Of a document that is labelled more than once, the largest label counts; of
    one that comes with several texts, the text of the smallest hash. A sampled
    text that is longer than ``SAMPLE_BYTES`` gives so many from its middle.
    Without labels of both classes every score is the share of good rows.
    """
    labels = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sizes = {r["quality"]: r["count"] for r in labels.groupBy("quality").count().collect()}
    if not sizes:
        return fit([], [], 0.5)
    share = F.when(F.col("quality") == 1, min(1.0, sample_rows / sizes.get(1, 1))).otherwise(min(1.0, sample_rows / sizes.get(0, 1)))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.where(chance < share).withColumnRenamed("doc_id", "_id")  # its size is bound by sample_rows
    body = F.col("text").cast("binary")
    middle = F.greatest(F.lit(1), F.floor((F.length(body) - SAMPLE_BYTES) / 2) + 1).cast("int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).where("text <> ''")
    rows = rows.select("doc_id", "quality", F.struct(F.xxhash64("text").alias("hash"), F.substring(body, middle, F.lit(SAMPLE_BYTES)).alias("body")).alias("b"))
    rows = rows.groupBy("doc_id", "quality").agg(F.min("b")["body"].alias("body"))
    rows = sorted(((r["doc_id"], bytes(r["body"]), r["quality"]) for r in rows.collect()), key=lambda r: (r[2], r[0], r[1]))
    return fit([r[1] for r in rows], [r[2] for r in rows], sizes.get(1, 0) / sum(sizes.values()))


def score_column(text: Column, model: QualityModel) -> Column:
    """The score of a text column, between 0 and 1."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return of(text.cast("binary"))


def score(docs: DataFrame, model: QualityModel, name: str = "_quality") -> DataFrame:
    """``docs`` with the score of each whole text in the column ``name``.

    A null or empty text has difference 0, so it gets the curve's value there.
    Repeated rows get equal scores; an empty table stays empty. If ``docs`` has
    a column ``name``, that stays and the score's name gets underscores before it.
    """
    return docs.select("*", score_column(F.col("text"), model).alias(free_name(docs, name)))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The quality score of every document, learned from the labels not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = learn(docs, labels.where(~held_out("doc_id")))
    found = score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), F.col("_quality").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
