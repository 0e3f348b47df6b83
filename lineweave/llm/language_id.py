"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, in_fold, prepare_python, softmax

UNDETERMINED = "und"
ORDERS = (2, 3)
#: A power of two.
N_BUCKETS = 1 << 15


@dataclass
class LanguageModel:
    """log_prob[language, bucket]; languages are sorted, so that ties go to the first by name."""

    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray
    orders: tuple[int, ...]


def ngram_buckets(points: np.ndarray, order: int, n_buckets: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position; n_buckets is a power of two."""
    n = len(points) - order + 1
    h = points[:n] * np.uint32(0x9E3779B1)
    for k in range(1, order):
        h ^= h >> np.uint32(15)
        h += points[k : k + n]
        h *= np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - n_buckets.bit_length() + 1)


@dataclass
class Batch:
    """Slices of lower-cased texts as one array of code points; a line break marks both ends of a text.

    A long text comes in slices that overlap by the longest n-gram less one. `owned` is how many of a slice's
    first positions are its own: each n-gram of a text starts at an owned position of one slice.
    """

    points: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    owned: np.ndarray
    owners: np.ndarray

    def outside(self, order: int, longest: int) -> np.ndarray:
        """Positions among len(points) - order + 1 where no n-gram of a slice starts that is its own."""
        ends = self.starts + np.minimum(self.owned, self.sizes - order + 1)
        at = np.concatenate([self.starts + self.sizes - back for back in range(1, longest)])
        at = at[at >= np.tile(ends, longest - 1)]
        return at[at <= len(self.points) - order]


def _batches(texts: list[str | None], longest: int) -> Iterator[Batch]:
    """Batches of about CHUNK_CHARS."""

    def slices() -> Iterator[tuple[int, str, int]]:
        for i, text in enumerate(texts):
            if text:
                marked = f"\n{text.lower()}\n"
                stop = len(marked) - longest + 1
                for start in range(0, stop, CHUNK_CHARS):
                    part = marked[start : start + CHUNK_CHARS + longest - 1]
                    yield i, part, CHUNK_CHARS if start + CHUNK_CHARS < stop else len(part)

    def batch(held: list[tuple[int, str, int]]) -> Batch:
        points = np.frombuffer("".join(part for _, part, _ in held).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.array([len(part) for _, part, _ in held])
        return Batch(points, np.cumsum(sizes) - sizes, sizes, np.array([n for *_, n in held]), np.array([i for i, *_ in held]))

    held, size = [], 0
    for each in slices():
        if held and size + len(each[1]) > CHUNK_CHARS:
            yield batch(held)
            held, size = [], 0
        held.append(each)
        size += len(each[1])
    if held:
        yield batch(held)


def ngram_counts(texts: list[str | None], orders: tuple[int, ...], n_buckets: int) -> np.ndarray:
    """How often each bucket occurs in the texts."""
    counts = np.zeros(n_buckets, dtype=np.int64)
    for batch in _batches(texts, max(orders)):
        for order in orders:
            buckets = ngram_buckets(batch.points, order, n_buckets)
            counts += np.bincount(buckets, minlength=n_buckets)
            counts -= np.bincount(buckets[batch.outside(order, max(orders))], minlength=n_buckets)
    return counts


def fit_counts(counts: dict[str, np.ndarray], orders: tuple[int, ...], n_buckets: int, alpha: float = 0.5) -> LanguageModel:
    """Model of the bucket counts of each language; no language gives a model that answers `und` for all."""
    languages = sorted(counts)
    table = np.array([counts[x] for x in languages], dtype=float).reshape(len(languages), n_buckets) + alpha
    log_prob = np.log(table) - np.log(table.sum(axis=1, keepdims=True))
    return LanguageModel(languages, log_prob.astype(np.float32), np.zeros(len(languages)), orders)


def fit(texts: list[str], langs: list[str], orders: tuple[int, ...] = ORDERS, n_buckets: int = N_BUCKETS) -> LanguageModel:
    """Fit on texts with a known language that are at hand."""
    return fit_counts({x: ngram_counts([t for t, y in zip(texts, langs, strict=True) if x == y], orders, n_buckets) for x in set(langs)}, orders, n_buckets)


def predict(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text; `und` and 0 where there is no letter."""
    n = len(texts)
    total = np.zeros((n, max(1, len(model.languages))))
    for batch in _batches(texts, max(model.orders)) if model.languages else ():
        for order in model.orders:
            buckets = ngram_buckets(batch.points, order, model.log_prob.shape[1])
            outside = batch.outside(order, max(model.orders))
            for k, table in enumerate(model.log_prob):  # a row fits the cache
                found = table.take(buckets)
                found[outside] = 0.0
                np.add.at(total[:, k], batch.owners, np.add.reduceat(found, batch.starts, dtype=np.float64))
    posterior = softmax(total + model.log_prior) if model.languages else np.zeros((n, 1))
    best = posterior.argmax(axis=1)
    known = [bool(t) and bool(model.languages) and any(map(str.isalpha, t)) for t in texts]
    names = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
    return names, np.where(known, posterior.max(axis=1), 0.0)


def train(docs: DataFrame, fold: tuple[int, int] | None = (4, 2), orders: tuple[int, ...] = ORDERS, n_buckets: int = N_BUCKETS) -> LanguageModel:
    """Learn from all rows of docs(doc_id, text, lang) outside the held-out fold.

    Tasks count n-grams where the texts are; the driver gets `n_buckets` sums for each language. Null texts and
    languages are left out.
    """
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if fold:
        rows = rows.filter(~in_fold(F.col("doc_id"), *fold))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                sums[lang] = sums.get(lang, 0) + ngram_counts(own["text"].tolist(), orders, n_buckets)
        for lang, counts in sums.items():
            seen = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": seen.astype(np.int32), "n": counts[seen]})

    summed = rows.select("text", "lang").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_lang = summed.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("counts"))
    known = {}
    for r in by_lang.toLocalIterator():
        known[r["lang"]] = np.zeros(n_buckets, dtype=np.int64)
        known[r["lang"]][np.array(r["buckets"])] = r["counts"]
    # a language of empty texts alone has no n-gram and is as good as unknown
    return fit_counts(known, orders, n_buckets)


def language_column(spark: SparkSession, model: LanguageModel, text: Column) -> Column:
    """struct(lang_pred string, score double) of a text column."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = predict(held.value, texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return identify(text)


def identify_languages(docs: DataFrame, fold: tuple[int, int] = (4, 2), model: LanguageModel | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang, ...).

    Null, empty or letterless text (no character of a letter category): `und`, score 0. Long texts are read whole;
    repeated rows give repeated results; ties go to the
    language first by name; a null doc_id is not held out; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    model = model or train(docs, fold)
    found = docs.select("doc_id", in_fold(F.col("doc_id"), *fold).alias("held_out"), language_column(spark, model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
