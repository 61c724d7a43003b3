"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's subwords are the 2-, 3- and 4-grams of its letters, words marked at
both ends. Each is hashed to a bucket, each bucket has an embedding, and their
mean goes through a linear softmax. Both are trained in numpy by stochastic
gradient descent on a bounded sample of labelled rows. As the mean is linear,
a trained model needs one table only, buckets by languages, and a prediction is
one count of buckets times that table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, held_out

BUCKETS = 1 << 13
ORDERS = (2, 3, 4)
DIMENSIONS = 16
#: Labelled rows that a model is fitted on, about: the bound of the sample.
SAMPLE_ROWS = 2400
EPOCHS = 12
#: Letters that are hashed in one step; bounds the memory that a very long text takes.
BLOCK = 1 << 18
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def subword_counts(text: str | None) -> np.ndarray:
    """How often each bucket occurs in a text; all zero if it has no letter."""
    counts = np.zeros(BUCKETS, np.int64)
    if not text:
        return counts
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return counts
    kept = letter | np.append(False, letter[:-1])  # of a run without letters, one mark stays
    codes = np.concatenate(([0], np.where(letter, codes, 0)[kept], [0] if letter[-1] else [])).astype(np.uint32)
    for at in range(0, len(codes), BLOCK):
        part = codes[at : at + BLOCK + max(ORDERS) - 1]
        inner = part != 0
        hashed, whole = part * np.uint32(0x9E3779B1), np.ones(len(part), bool)
        for order in range(2, max(ORDERS) + 1):
            if len(part) < order:
                break
            whole = whole[:-1] & (inner[order - 2 : -1] if order > 2 else True)
            hashed = (hashed[:-1] ^ part[order - 1 :]) * np.uint32(0x85EBCA6B) + np.uint32(order)
            if order in ORDERS:
                counts += np.bincount(hashed[:BLOCK][whole[:BLOCK]] >> np.uint32(32 - 13), minlength=BUCKETS)
    return counts


@dataclass(frozen=True)
class LanguageModel:
    """Logits of a text are the mean of ``table`` over its subwords, plus ``bias``.

    ``familiar`` has the log-probability of each bucket in the training sample,
    over that of even buckets, and ``spread`` its deviation there. A text whose
    mean of it, plus three standard errors, is below ``least_familiar`` is in no
    language of the sample, whatever the softmax makes of it.
    """

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least_score: float
    familiar: np.ndarray
    spread: float
    least_familiar: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, whether it is accepted)."""
        counts = subword_counts(text)
        total = counts.sum()
        if not total or not self.languages:
            return UNKNOWN, 0.0, False
        z = (counts @ self.table / total + self.bias) / self.temperature
        p = np.exp(z - z.max())
        best = int(p.argmax())
        score = float(p[best] / p.sum())
        known = _familiarity(float(counts @ self.familiar), total, self.spread)
        return self.languages[best], score, bool(score >= self.least_score and known >= self.least_familiar)


def _familiarity(score, total, spread: float):
    """Upper bound of a text's mean familiarity: three standard errors above, so that short texts are not judged by chance."""
    return score / total + 3 * spread / np.sqrt(total)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(counts: np.ndarray, labels: list[str], seed: int = 7, reject: float = 0.002, certain: float = 1 / 3, slack: float = 0.5) -> LanguageModel:
    """Train on rows of bucket counts; a fifth of them sets temperature and rejection.

    A text is rejected below the score that ``reject`` of the rightly predicted
    calibration rows fail to reach, and never at ``certain`` or above: a text in
    two languages halves its score and is no less clean for that. The softmax
    cannot tell a text in no learned language, so a text is rejected as well if
    its subwords are less familiar than the same quantile of those rows, lowered
    by ``slack`` of the quantile's distance from their median: the sample is
    small, and its least rows are not the least of the corpus. That measure
    pools all languages, does not depend on their number and keeps their mixtures.
    """
    languages = tuple(sorted(set(labels)))
    if len(counts) < 5 or not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0, np.zeros(BUCKETS), 0.0, 0.0)
    draw = np.random.default_rng(seed)
    x = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    y = np.array([languages.index(v) for v in labels])
    order = draw.permutation(len(y))
    check, learn = order[: len(y) // 5], order[len(y) // 5 :]
    embed = draw.normal(0, 1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weight, bias = np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, step = EPOCHS * -(-len(learn) // 32), 0
    for _ in range(EPOCHS):
        for rows in np.array_split(draw.permutation(learn), -(-len(learn) // 32)):
            rate = 4.0 * (1 - step / steps)
            step += 1
            mean = x[rows] @ embed
            wrong = _softmax(mean @ weight + bias)
            wrong[np.arange(len(rows)), y[rows]] -= 1
            wrong /= len(rows)
            back = wrong @ weight.T
            weight -= rate * (mean.T @ wrong)
            bias -= 0.1 * rate * wrong.sum(axis=0)
            embed -= 8 * rate * (x[rows].T @ back)
    z = x[check] @ embed @ weight + bias
    loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean()
    temperature = float(min(np.geomspace(0.25, 20, 120), key=loss))
    p = _softmax(z / temperature)
    hit = p.argmax(axis=1) == y[check]
    right = p.max(axis=1)[hit]
    least = min(certain, float(np.quantile(right, reject))) if len(right) else certain
    # each row counts as a text of median length, so that no long one outweighs the rest
    totals = counts.sum(axis=1).astype(np.float64)
    seen = x[learn].sum(axis=0, dtype=np.float64) * np.median(totals)
    share = (seen + 0.5) / (seen + 0.5).sum()
    familiar = np.log(share * BUCKETS)
    spread = float(np.sqrt(share @ (familiar - share @ familiar) ** 2))
    own = check[hit]
    known = _familiarity(x[own] @ familiar * totals[own], np.maximum(totals[own], 1), spread)
    low, middle = np.quantile(known, [reject, 0.5]) if len(own) else (-np.inf, 0.0)
    unknown_below = float(low - slack * (middle - low)) if len(own) else -np.inf
    return LanguageModel(languages, (embed @ weight).astype(np.float32), bias.astype(np.float64), temperature, least, familiar, spread, unknown_below)


def learn(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on about ``sample_rows`` of ``labelled(doc_id, text, lang)``, evenly over languages.

    The sample goes by a hash of doc_id, so it is the same at each run, and all
    languages weigh alike in it. Rows without a language do not count.
    """
    labelled = labelled.where("lang is not null")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return fit(np.zeros((0, BUCKETS)), [])
    share = F.create_map(*[F.lit(v) for lang, n in sorted(sizes.items()) for v in (lang, min(1.0, sample_rows / len(sizes) / n))])
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)

    @F.pandas_udf("binary")
    def counted(texts: pd.Series) -> pd.Series:
        def packed(text: str | None) -> bytes:
            counts = subword_counts(text)
            at = np.flatnonzero(counts)
            return np.concatenate((at, counts[at])).astype(np.uint32).tobytes()

        return texts.map(packed, na_action=None)

    rows = labelled.where(chance < share[F.col("lang")]).select("lang", "doc_id", counted("text").alias("counts")).collect()
    rows.sort(key=lambda r: (r["lang"], str(r["doc_id"]), bytes(r["counts"])))
    counts = np.zeros((len(rows), BUCKETS), np.float32)
    for i, r in enumerate(rows):
        at, n = np.frombuffer(bytes(r["counts"]), np.uint32).reshape(2, -1)
        counts[i, at] = n
    some = counts.any(axis=1)
    return fit(counts[some], [r["lang"] for r, s in zip(rows, some, strict=True) if s])


def predicted(text: Column, model: LanguageModel) -> Column:
    """struct(lang, score, accepted) of a text column."""

    @F.pandas_udf("lang string, score double, accepted boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang", "score", "accepted"])

    return of(text.cast("string"))


def identify(docs: DataFrame, model: LanguageModel, name: str = "_language") -> DataFrame:
    """``docs`` with the column ``name``: struct(lang, score, accepted) of each whole text.

    Null texts and texts without a letter are ``und`` with score 0, rejected. A
    text in no learned language, or of letter junk, gets the likeliest language
    and is rejected, unless it is too short to tell. A
    tie goes to the language first in code-point order. Repeated rows get equal
    results; an empty table stays empty; a model without languages says ``und``.
    If ``docs`` has a column ``name``, that stays and the result's name gets
    underscores before it.
    """
    return docs.select("*", predicted(F.col("text"), model).alias(free_name(docs, name)))


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, of any columns, whose language the model accepts."""
    return docs.where(predicted(F.col("text"), model)["accepted"])


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the documents not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out("doc_id")))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), F.col("_language.lang").alias("lang_pred"), F.col("_language.score").alias("score"), F.col("_language.accepted").alias("accepted"))
