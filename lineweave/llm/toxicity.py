"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

Each word is the sum of two hashed embeddings (the word, its first characters). Filters of several widths
slide over the embeddings, the largest response of each filter over the whole text is kept, and a linear
layer turns the responses into a logit. The language that picks the threshold is read off the text by a
naive Bayes over the same word buckets; the lang column is only a training target.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, code_points, in_fold, sigmoid, prepare_python, span_hashes, word_spans

WIDTHS = (1, 2, 3)
GAP = max(WIDTHS) - 1


@dataclass
class ToxicityModel:
    words: np.ndarray  # embedding by word bucket
    stems: np.ndarray  # embedding by stem bucket
    filters: list[np.ndarray]  # by width: (width * dims, filters)
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    languages: list[str]
    language_log_prob: np.ndarray  # (word bucket, language)
    thresholds: np.ndarray  # logit by language; the last holds where no language is known
    decision: float  # the score that a logit at its threshold gets


def _buckets(pieces: list[str], word_bits: int, stem_bits: int, stem_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, stem buckets and piece index of each word of the pieces."""
    points, piece_starts = code_points([p.lower() for p in pieces])
    starts, ends = word_spans(points)
    whole, stem = span_hashes(points, starts, ends, np.minimum(ends, starts + stem_chars))
    of = np.searchsorted(piece_starts, starts, side="right") - 1
    return (whole >> np.uint64(64 - word_bits)).astype(np.int32), (stem >> np.uint64(64 - stem_bits)).astype(np.int32), of


def _bits(table: np.ndarray) -> int:
    return len(table).bit_length() - 1


STEM_CHARS = 4


def _responses(model: ToxicityModel, word: np.ndarray, stem: np.ndarray, of: np.ndarray, n: int, goes_on: bool = False) -> np.ndarray:
    """Largest response of each filter in each of n texts; texts without a word respond with the biases alone.

    If the last text goes on, filters that reach beyond its end are left to the piece that follows.
    """
    n_filters = sum(len(b) for b in model.biases)
    empty = np.concatenate([np.maximum(b, 0) for b in model.biases])
    best = np.tile(empty, (n, 1)).astype(np.float32)
    if not len(word):
        return best
    owners, first = np.unique(of, return_index=True)
    dims = model.words.shape[1]
    x = np.zeros((len(word) + GAP * len(owners), dims), dtype=np.float32)
    at = np.arange(len(word)) + GAP * np.searchsorted(owners, of)  # zero rows after each text keep texts apart
    x[at] = model.words[word] + model.stems[stem]
    starts = first + GAP * np.arange(len(owners))
    between = np.ones(len(x), dtype=bool)  # filters that start there would reach into the next text
    between[at] = False
    done = 0
    for width, filters, bias in zip(WIDTHS, model.filters, model.biases, strict=True):
        rows = len(x) - width + 1
        response = np.tile(bias, (rows, 1)).astype(np.float32)
        for k in range(width):
            response += x[k : k + rows] @ filters[k * dims : (k + 1) * dims]
        np.maximum(response, 0, out=response)
        response[between[:rows]] = 0
        if goes_on and of[-1] == n - 1:
            response[max(int(starts[-1]), len(x) - GAP - width + 1) :] = 0
        best[owners, done : done + len(bias)] = np.maximum.reduceat(response, starts, axis=0)
        done += len(bias)
    assert done == n_filters
    return best


def logits(model: ToxicityModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Logit and language index of each text; index len(languages) where there is no word."""
    n = len(texts)
    best = _responses(model, *(np.zeros(0, dtype=np.int32),) * 3, n)
    by_language = np.zeros((n, max(1, len(model.languages))))
    seen = np.zeros(n, dtype=bool)
    carried = (-1, *(np.zeros(0, dtype=np.int32),) * 2)  # text, and the last words of its piece before
    for (pieces, owners), after in pairwise(chain(chunks(texts), [(None, [-1])])):
        word, stem, of = _buckets(pieces, _bits(model.words), _bits(model.stems), STEM_CHARS)
        own = np.asarray(owners)
        if len(word) and model.languages:
            pieces_with, first = np.unique(of, return_index=True)
            np.add.at(by_language, own[pieces_with], np.add.reduceat(model.language_log_prob[word], first, axis=0, dtype=np.float64))
            seen[own[pieces_with]] = True
        if own[0] == carried[0]:  # so that filters span the cut
            word, stem = np.concatenate((carried[1], word)), np.concatenate((carried[2], stem))
            of = np.concatenate((np.zeros(len(carried[1]), dtype=of.dtype), of))
        np.maximum.at(best, own, _responses(model, word, stem, of, len(pieces), after[1][0] == own[-1]))
        last = of == len(pieces) - 1
        carried = (own[-1], word[last][-GAP:], stem[last][-GAP:])
    language = np.where(seen, by_language.argmax(axis=1), len(model.languages))
    return best @ model.out + model.out_bias, language


def score(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    """Score of each text: `decision` where the logit meets the threshold of the text's own language."""
    if not texts:
        return np.zeros(0)
    logit, language = logits(model, texts)
    return sigmoid(logit - model.thresholds[language] + np.log(model.decision / (1 - model.decision)))


def fit(
    texts: list[str], labels: list[int], langs: list[str | None], word_bits: int = 17, stem_bits: int = 15, dims: int = 8, filters: int = 8,
    steps: int = 6_000, rate: float = 0.05, least_docs: int = 3, least_positives: int = 30, decision: float = 0.7, seed: int = 7,
) -> ToxicityModel:
    """Train on texts with labels; every fifth is kept for calibrating the thresholds.

    Embeddings start near zero with the class log-odds of their bucket as first coordinate; buckets in fewer
    than `least_docs` training texts stay zero, so that unseen words never respond.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float32)
    tokens: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        parts = [_buckets(pieces, word_bits, stem_bits, STEM_CHARS)[:2] for pieces, _ in chunks([text])]
        tokens.append(tuple(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype=np.int32) for k in (0, 1)))
    fitted = [i for i in range(len(texts)) if i % 5]
    tables = []
    for k, bits in ((0, word_bits), (1, stem_bits)):
        docs = np.zeros((2, 1 << bits))
        for i in fitted:
            docs[int(y[i]), np.unique(tokens[i][k])] += 1
        totals = np.array([[max(1, sum(y[i] == c for i in fitted))] for c in (0, 1)], dtype=float)
        share = (docs + 0.5) / (totals + 1.0)
        table = rng.normal(0, 0.05, (1 << bits, dims)).astype(np.float32)
        table[:, 0] = np.clip(np.log(share[1] / share[0]) / 4, -0.5, 1.5)
        table[docs.sum(axis=0) < least_docs] = 0
        tables.append(table)
    weights = []
    for width in WIDTHS:
        w = rng.normal(0, 0.3, (width * dims, filters)).astype(np.float32)
        w[::dims, 0] = 1.0 / width
        weights.append(w)
    languages = sorted({x for x in langs if x is not None})
    counts = np.full((len(languages), 1 << word_bits), 0.1)
    for (word, _), x in zip(tokens, langs, strict=True):
        if x is not None:
            counts[languages.index(x)] += np.bincount(word, minlength=1 << word_bits)
    by_language = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32) if languages else np.zeros((1 << word_bits, 1), dtype=np.float32)
    model = ToxicityModel(tables[0], tables[1], weights, [np.zeros(filters, dtype=np.float32) for _ in WIDTHS], np.full(filters * len(WIDTHS), 0.1, dtype=np.float32), -0.5, languages, by_language, np.zeros(len(languages) + 1), decision)
    positive = max(1.0, float(y.sum()))
    weight = np.where(y == 1, len(y) / (2 * positive), len(y) / (2 * max(1.0, len(y) - positive)))
    # at least `steps` steps in all, so that a small sample is learned as well
    for epoch in range(max(6, min(60, steps // max(1, len(fitted))))):
        step = rate / (1 + epoch) if epoch < 6 else rate / 6
        for i in rng.permutation(fitted):
            _learn(model, *tokens[i], y[i], float(weight[i]) * step)
    held = [i for i in range(len(texts)) if i % 5 == 0]
    if y[held].sum() < least_positives:  # too few to place a threshold: all rows then
        held = list(range(len(texts)))
    if held:
        logit, language = logits(model, [texts[i] for i in held])
        model.thresholds[:] = _threshold(logit, y[held])
        for k in range(len(languages)):
            if (own := language == k).sum() >= 20 and y[held][own].sum() >= least_positives / 5:
                model.thresholds[k] = _threshold(logit[own], y[held][own], model.thresholds[-1])
    return model


def _learn(model: ToxicityModel, word: np.ndarray, stem: np.ndarray, label: float, step: float) -> None:
    """One stochastic gradient step on one text."""
    if not len(word):
        return
    dims, n = model.words.shape[1], len(word)
    x = np.zeros((n + GAP, dims), dtype=np.float32)
    x[:n] = model.words[word] + model.stems[stem]
    best, argmax = [], []
    for width, filters, bias in zip(WIDTHS, model.filters, model.biases, strict=True):
        response = sum(x[k : k + n] @ filters[k * dims : (k + 1) * dims] for k in range(width)) + bias
        at = response.argmax(axis=0)
        argmax.append(at)
        best.append(response[at, np.arange(len(at))])
    hidden = np.maximum(np.concatenate(best), 0)
    delta = (float(sigmoid(np.array(hidden @ model.out + model.out_bias))) - label) * step
    back = delta * model.out * (hidden > 0)
    model.out -= (delta * hidden).astype(np.float32)
    model.out_bias -= delta
    done = 0
    for width, filters, bias, at in zip(WIDTHS, model.filters, model.biases, argmax, strict=True):
        own = back[done : done + len(at)]
        done += len(at)
        bias -= own
        for k in range(width):
            rows = at + k
            inside = rows < n
            part = filters[k * dims : (k + 1) * dims]
            gradient = (part * own).T
            part -= (x[rows].T * own).astype(np.float32)
            for table, bucket in ((model.words, word), (model.stems, stem)):
                ids = bucket[rows[inside]]
                live = table[ids].any(axis=1)  # buckets that stay zero
                np.subtract.at(table, ids[live], gradient[inside][live])


def _threshold(logit: np.ndarray, y: np.ndarray, default: float = 0.0) -> float:
    """The logit that divides the classes with fewest errors, in the middle of the widest such gap."""
    if not (y == 1).any() or not (y == 0).any():
        return default
    order = np.argsort(logit)
    z, t = logit[order], y[order]
    errors = np.concatenate(([0], np.cumsum(t == 1))) + np.concatenate((np.cumsum((t == 0)[::-1])[::-1], [0]))
    inner = np.flatnonzero(errors[1:-1] == errors[1:-1].min()) + 1
    cut = inner[np.argmax(z[inner] - z[inner - 1])]
    return float((z[cut - 1] + z[cut]) / 2)


def train(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = (3, 1), max_train_rows_per_class: int = 2500, max_train_chars: int = 20_000) -> ToxicityModel:
    """Learn from at most `max_train_rows_per_class` labelled rows of either class outside the held-out fold.

    The first by a hash of doc_id are taken, and of the documents of these ids the first by a hash of the text, of at
    most `max_train_chars`: twice the bound of rows at most, also where documents repeat. Scoring has no such limits.
    """
    rows = labels.select("doc_id", F.col("toxic").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if fold:
        rows = rows.filter(~in_fold(F.col("doc_id"), *fold))
    first = [rows.filter(F.col("label") == c).orderBy(F.xxhash64(F.lit("toxic"), "doc_id"), "doc_id").limit(max_train_rows_per_class) for c in (0, 1)]
    # at most twice max_train_rows_per_class rows of two numbers: a proven bound for the broadcast
    sample = F.broadcast(first[0].unionByName(first[1]))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    got = docs.select("doc_id", "text", lang.alias("lang")).filter(F.length("text") <= max_train_chars).join(sample, "doc_id")
    got = got.orderBy(F.xxhash64(F.lit("row"), "doc_id", "text"), "doc_id", "label").limit(2 * max_train_rows_per_class).collect()
    got.sort(key=lambda r: (r["doc_id"], r["label"], r["text"]))
    return fit([r["text"] for r in got], [r["label"] for r in got], [r["lang"] for r in got])


def score_column(spark: SparkSession, model: ToxicityModel, text: Column) -> Column:
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score(held.value, texts.tolist()), dtype="float64")

    return scored(text)


def classify_toxicity(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] = (3, 1), threshold: float = 0.7, model: ToxicityModel | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text, lang, ...).

    Null and empty texts have no word and get the score of the biases alone; repeated rows give repeated
    results; a null doc_id is not held out; other columns are ignored; no rows give no rows; without labels the
    untrained model answers.
    """
    spark = docs.sparkSession
    prepare_python(spark)
    model = model or train(docs, labels, fold)
    scored = docs.select("doc_id", in_fold(F.col("doc_id"), *fold).alias("held_out"), score_column(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
