"""Quality by ordinal cumulative-link regression over hashed-text features.

P(grade <= k) = sigmoid(threshold_k - w.x) with one weight vector and ordered thresholds.  A text's value of a feature
is the share of its words that have it: the word without its edges, its shape (letters, digits and signs, runs made
one), its signs at the end, its length, and whether it repeats the word before.  Weights and thresholds are fitted on a
bounded labelled sample; the expected grade and the tail probability P(grade >= k) select documents.

Cases: a null or empty text has the one feature "empty"; without labels, or with one grade only, every text gets that
grade (0 without labels) and tail probability 1 if that grade reaches the cut, else 0; null labels are left out;
repeated rows score alike; other columns are kept out of the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evflow.llm.linear import MAX_FEATURES, SAMPLE_ROWS, gather, hashed, minimise, sample, screen, sigmoid
from evflow.llm.text import rows_of, slices, split_words, text_view

_EDGE = ".,!?;:\"'()[]{}<>*_-|&%$#"
_SHAPES = ((re.compile(r"[^\W\d_a-z]*[A-Z][^\W\d_a-z]*"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"))
_RUN = re.compile(r"(.)\1+", re.S)
_SIGNS = re.compile(r"[^\w\s]+$")
_EMPTY, _AGAIN = hashed("empty"), hashed("again")
#: Words remembered by a worker with their score.
MEMORY_WORDS = 150_000


class Model(NamedTuple):
    """``features`` ascending, their ``weights``, the ``grades`` ascending and the thresholds between them."""

    features: np.ndarray
    weights: np.ndarray
    grades: list[int]
    thresholds: np.ndarray


def word_features(word: str) -> list[int]:
    """Hashed features of one word as written."""
    core = word.strip(_EDGE).lower()
    shape = word
    for pattern, sign in _SHAPES:
        shape = pattern.sub(sign, shape)
    shape = _RUN.sub(r"\1", shape)[:12]
    signs = _SIGNS.search(word)
    return [hashed(f"w:{core}"), hashed(f"s:{shape}"), hashed(f"e:{signs[0][:8] if signs else ''}"), hashed(f"n:{min(len(core), 16)}")]


def repeats(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each word is the one before it in its text."""
    again = np.zeros(len(ids), bool)
    again[1:] = ids[1:] == ids[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    again[starts] = False
    return again


def featurize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, share of the row's words with it)."""
    words = split_words(texts, lower=False)
    rows = rows_of(words.offsets)
    size = np.diff(words.offsets)
    each = np.array([word_features(w) for w in words.vocab], np.int64).reshape(len(words.vocab), 4)
    again = rows[repeats(words.ids, words.offsets)]
    empty = np.flatnonzero(size == 0)
    at = np.concatenate([np.repeat(rows, 4), again, empty])
    found = np.concatenate([each[words.ids].ravel() if len(words.ids) else np.zeros(0, np.int64), np.full(len(again), _AGAIN), np.full(len(empty), _EMPTY)])
    both, n = np.unique((at.astype(np.uint64) << np.uint64(32)) | found.astype(np.uint64), return_counts=True)
    at = (both >> np.uint64(32)).astype(np.int64)
    return at, (both & np.uint64(0xFFFFFFFF)).astype(np.int64), n / np.maximum(1, size)[at]


def fit(docs: DataFrame, labels: DataFrame, ridge: float = 1e-5, rows: int = SAMPLE_ROWS, features: int = MAX_FEATURES) -> Model:
    """Fit on up to ``rows`` of ``labels`` (doc_id, grade); grades are whole numbers, two or more of them."""
    known = sample(docs, labels, rows)
    grades = sorted(r[0] for r in known.select("grade").distinct().collect())
    if len(grades) < 2:
        return Model(np.zeros(0, np.int64), np.zeros(0), grades or [0], np.zeros(0))
    chosen = screen(known, featurize, grades, limit=features)
    x, y = gather(known, featurize, chosen)
    level = np.searchsorted(grades, y)
    spread = np.sqrt(np.bincount(x.cols, x.vals**2, len(chosen)) / max(1, len(y))) + 1e-6
    x = x._replace(vals=x.vals / spread[x.cols])
    k, cuts, n = len(chosen), len(grades) - 1, len(y)

    def thresholds(free: np.ndarray) -> np.ndarray:
        return np.cumsum(np.append(free[:1], np.exp(free[1:])))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        w, free = p[:k], p[k:]
        theta = np.concatenate([[-np.inf], thresholds(free), [np.inf]])
        z = x.dot(w)
        up, low = sigmoid(theta[level + 1] - z), sigmoid(theta[level] - z)
        inside = np.maximum(up - low, 1e-12)
        slope_up, slope_low = up * (1 - up) / inside, low * (1 - low) / inside
        g_theta = np.bincount(level, -slope_up, cuts + 1)[:cuts] + np.bincount(level, slope_low, cuts + 1)[1:]
        through = g_theta[::-1].cumsum()[::-1]
        g_free = np.append(through[:1], through[1:] * np.exp(free[1:]))
        value = -np.log(inside).mean() + ridge / 2 * (w @ w)
        return float(value), np.append(x.back(slope_up - slope_low, k) / n + ridge * w, g_free / n)

    share = np.clip(np.cumsum(np.bincount(level, minlength=cuts + 1))[:cuts] / n, 1e-6, 1 - 1e-6)
    first = np.log(share / (1 - share))
    free = np.append(first[:1], np.log(np.maximum(np.diff(first), 1e-3)))
    p = minimise(loss, np.append(np.zeros(k), free))
    return Model(chosen, p[:k] / spread, grades, thresholds(p[k:]))


_scores: dict[str, float] = {}
_scores_of: list[bytes] = []


def document_levels(texts: pa.Array, model: Model) -> np.ndarray:
    """w.x of each text; a worker remembers its words for as long as the model is the same."""
    key = model.weights.tobytes()
    if _scores_of != [key] or len(_scores) > MEMORY_WORDS:
        _scores.clear()
        _scores_of[:] = [key]
    table = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    words = split_words(texts, lower=False)
    for w in words.vocab:
        if w not in _scores:
            _scores[w] = sum(table.get(f, 0.0) for f in word_features(w))
    each = np.fromiter(map(_scores.__getitem__, words.vocab), float, len(words.vocab))
    n = np.diff(words.offsets)
    value = each[words.ids] if len(words.ids) else np.zeros(0)
    value = value + table.get(_AGAIN, 0.0) * repeats(words.ids, words.offsets)
    total = np.bincount(rows_of(words.offsets), value, len(texts))
    return np.where(n > 0, total / np.maximum(1, n), table.get(_EMPTY, 0.0))


def rate(texts: pa.Array, model: Model, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade, and probability of a grade of at least ``cut``, of each text."""
    grades = np.array(model.grades, float)
    if len(grades) == 1:
        return np.full(len(texts), grades[0]), np.full(len(texts), float(grades[0] >= cut))
    tails = 1 - sigmoid(model.thresholds[None, :] - document_levels(texts, model)[:, None])
    expected = grades[0] + tails @ np.diff(grades)
    first = int(np.searchsorted(grades, cut))
    if first == 0:
        return expected, np.ones(len(texts))
    return expected, tails[:, first - 1] if first <= len(model.thresholds) else np.zeros(len(texts))


def score(docs: DataFrame, model: Model, cut: int = 1) -> DataFrame:
    """doc_id, expected_grade and tail_probability of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                expected, tail = rate(part.column("text"), model, cut)
                yield pa.record_batch([part.column("doc_id"), pa.array(expected), pa.array(tail)], names=["doc_id", "expected_grade", "tail_probability"])

    return docs.mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded ratings from the labels: 0 of poor quality, 1 good but toxic, 2 good and clean."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grade = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.cast("int").alias("grade")).where(F.col("grade").isNotNull())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document, the probability that its quality is good, and whether it stays."""
    docs = text_view(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    scored = score(docs, fit(docs, graded(spark, sf_dir)))
    return scored.withColumn("kept", F.col("tail_probability") >= 0.5)
