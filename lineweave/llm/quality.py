"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_fold, sigmoid, prepare_python

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "stop_mark", "space", "beyond_ascii", "distinct_words", "top_word", "distinct_lines", "log_line", "marked_words")
_CLASS = np.full(256, 5, dtype=np.int64)  # 0 lower, 1 upper, 2 digit, 3 sentence mark, 4 white space, 5 other symbol, 6 beyond ASCII
for _k, _bytes in ((0, range(97, 123)), (1, range(65, 91)), (2, range(48, 58)), (3, b".,;:'\"-?"), (4, b" \t\n\r\x0b\x0c"), (6, range(128, 256))):
    _CLASS[list(_bytes)] = _k


@dataclass
class QualityModel:
    """Per class (0, 1): mean, inverse of the Cholesky factor of the shrunk covariance, log determinant, log prior."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    whiteners: np.ndarray
    log_dets: np.ndarray
    log_priors: np.ndarray


def _share(part: float, whole: float) -> float:
    """Smoothed log-odds of a share: spreads what lies near 0 or 1."""
    p = (part + 0.5) / (whole + 1.0)
    return float(np.log(p / (1.0 - p)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; null counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    by_byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    lower, upper, digit, mark, space, symbol, beyond = np.bincount(_CLASS, weights=by_byte, minlength=7)
    words = text.split()
    counts = Counter(words)
    lines = text.split("\n")
    marked = sum(c for w, c in counts.items() if not w[-1].isalnum() and not w[-1] in ".,;:'\"-?")
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(n / (len(words) + 1.0)), _share(upper, n), _share(digit, n), _share(symbol, n), _share(mark, n), _share(space, n), _share(beyond, n),
        _share(len(counts), len(words)), _share(max(counts.values(), default=0), len(words)), _share(len(set(lines)), len(lines)), np.log1p(n / len(lines)), _share(marked, len(words)),
    ]


def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = 0.1) -> QualityModel:
    """Class covariances, shrunk towards the pooled one and then towards a multiple of the identity.

    A class without rows takes the pooled mean and covariance, so that its density says nothing.
    """
    d = len(FEATURES)
    x = x.reshape(-1, d)
    centre = x.mean(axis=0) if len(x) else np.zeros(d)
    scale = x.std(axis=0) + 1e-6 if len(x) else np.ones(d)
    z = (x - centre) / scale
    pooled = np.cov(z, rowvar=False, bias=True) if len(z) > 1 else np.eye(d)
    means, whiteners, log_dets, priors = [], [], [], []
    for label in (0, 1):
        own = z[y == label]
        mean = own.mean(axis=0) if len(own) else np.zeros(d)
        cov = np.cov(own, rowvar=False, bias=True) if len(own) > 1 else pooled
        weight = shrinkage + (1 - shrinkage) * d / (d + len(own))
        cov = (1 - weight) * cov + weight * pooled
        cov = (1 - shrinkage) * cov + shrinkage * (np.trace(cov) / d + 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        whiteners.append(np.linalg.solve(factor, np.eye(d)))  # once, so that scoring is one product a batch
        log_dets.append(2 * np.log(np.diag(factor)).sum())
        priors.append(np.log((len(own) + 1.0) / (len(z) + 2.0)))
    return QualityModel(centre, scale, np.array(means), np.array(whiteners), np.array(log_dets), np.array(priors))


def score(model: QualityModel, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1: difference of the two Mahalanobis log-densities and log-priors."""
    if not texts:
        return np.zeros(0)
    z = (np.array([statistics(t) for t in texts]) - model.centre) / model.scale
    log_density = []
    for k in (0, 1):
        # |L^-1 (z - mean)|^2 is the Mahalanobis distance
        whitened = model.whiteners[k] @ (z - model.means[k]).T
        log_density.append(-0.5 * ((whitened**2).sum(axis=0) + model.log_dets[k]) + model.log_priors[k])
    return sigmoid(log_density[1] - log_density[0])


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = (5, 0), max_train_rows: int = 8000) -> QualityModel:
    """Learn from at most `max_train_rows` labelled rows outside the held-out fold, the first by a hash of doc_id.

    The bound also holds where documents repeat: of the rows that carry a sampled label, the first by hash of doc_id
    and text are measured.
    """
    rows = labels.select("doc_id", F.col("quality").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if fold:
        rows = rows.filter(~in_fold(F.col("doc_id"), *fold))
    sample = rows.orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id", "label").limit(max_train_rows)

    @F.pandas_udf("array<double>")
    def measured(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts])

    # the sample has at most max_train_rows rows of two numbers: a proven bound for the broadcast
    met = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    met = met.select(F.xxhash64(F.lit("row"), "doc_id", "text").alias("order"), "doc_id", "label", measured("text").alias("x"))
    got = met.orderBy("order", "doc_id", "label").limit(max_train_rows).collect()
    return fit(np.array([r["x"] for r in got], dtype=float), np.array([r["label"] for r in got], dtype=int))


def score_column(spark: SparkSession, model: QualityModel, text: Column) -> Column:
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(held.value, texts.tolist()), dtype="float64")

    return scored(text)


def classify_quality(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (5, 0), threshold: float = 0.3, model: QualityModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text, ...).

    Null text counts as empty and is scored like any other; repeated rows give repeated results; a null
    doc_id is not held out; other columns are ignored; no rows give no rows; no labels give the prior.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    model = model or train(docs, labels, fold)
    scored = docs.select("doc_id", in_fold(F.col("doc_id"), *fold).alias("held_out"), score_column(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
