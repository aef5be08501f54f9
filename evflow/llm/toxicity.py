"""Counterfactual-regularised toxicity classifier over hashed words and word beginnings.

A document's value of a feature is the number of its distinct words that have it: the word itself, and its first four,
five and six letters.  Logistic weights are fitted on a bounded labelled sample.  In each labelled sentence that names
a group (identity terms below), the term is swapped for others of its kind; the squared change of the score is added
to the loss, so that naming a group by itself hardly moves a score.

Cases: a null or empty text has no feature and gets the score of the bias alone; with no labelled row of either class
the score is the share of toxic labels (0 without labels); null labels are left out; repeated rows score alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evflow.llm.linear import MAX_FEATURES, SAMPLE_ROWS, Sparse, fold_of, gather, hashed, minimise, sample, screen, sigmoid
from evflow.llm.text import rows_of, slices, split_words, text_view

# Identity terms by kind; a term is swapped for others of its own line.
IDENTITY_TERMS = """
women men girls boys transgender nonbinary
woman man girl boy
muslims christians jews hindus buddhists atheists sikhs catholics
muslim christian jewish hindu buddhist atheist sikh catholic
gay lesbian bisexual straight queer heterosexual
black white asian latino hispanic arab african european american mexican chinese indian
immigrants refugees foreigners natives migrants
disabled blind deaf autistic
old young elderly
mujeres hombres gays negros blancos inmigrantes musulmanes cristianos
frauen männer schwule schwarze weiße ausländer muslime christen juden
femmes hommes homosexuels noirs blancs immigrés musulmans chrétiens juifs
"""
_KINDS = [line.split() for line in IDENTITY_TERMS.strip().splitlines()]
_TERMS = {term: kind for kind in _KINDS for term in kind}
_EDGE = ".,!?;:\"'()[]{}<>*_-|&%$#"
_SENTENCE = re.compile(r"[.!?\n]+")
#: Words remembered by a worker with their weight.
MEMORY_WORDS = 150_000


class Model(NamedTuple):
    """``features`` ascending, their ``weights``, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def word_features(word: str) -> list[int]:
    """Hashed features of one word."""
    core = word.lower().strip(_EDGE)
    if not core:
        return []
    return [hashed(f"w:{core}"), *(hashed(f"p:{core[:k]}") for k in (4, 5, 6) if len(core) > k)]


def featurize(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, number of distinct words with it)."""
    words = split_words(texts)
    pairs = np.unique(rows_of(words.offsets) * max(1, len(words.vocab)) + words.ids)
    at, word = pairs // max(1, len(words.vocab)), pairs % max(1, len(words.vocab))
    each = [word_features(w) for w in words.vocab]
    sizes = np.array([len(x) for x in each], np.int64)
    flat = np.array([f for x in each for f in x], np.int64)
    begins = np.cumsum(sizes) - sizes
    n = sizes[word]
    take = np.repeat(begins[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    rows, found = np.repeat(at, n), flat[take] if len(flat) else np.zeros(0, np.int64)
    both, value = np.unique((rows.astype(np.uint64) << np.uint64(32)) | found.astype(np.uint64), return_counts=True)
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64), value.astype(np.float64)


def swaps(sentence: str, alternatives: int = 2) -> list[dict[int, int]]:
    """Changes of the sentence's features when a group's name is swapped for the next ones of its kind."""
    words = {w.strip(_EDGE) for w in sentence.lower().split()}
    out = []
    for term in sorted(words & _TERMS.keys()):
        kind = _TERMS[term]
        at = kind.index(term)
        for k in range(1, min(alternatives, len(kind) - 1) + 1):
            change = Counter(f for f in word_features(kind[(at + k) % len(kind)]))
            change.subtract(word_features(term))
            out.append({f: n for f, n in change.items() if n})
    return [x for x in out if x]


def counterfactuals(rows: DataFrame) -> list[tuple[list[int], list[int], int]]:
    """Feature changes of all swaps in the sample's sentences, equal ones counted; bounded by the pairs of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text and not _TERMS.keys().isdisjoint(w.strip(_EDGE) for w in text.lower().split()):
                    for sentence in _SENTENCE.split(text):
                        found.update(tuple(sorted(x.items())) for x in swaps(sentence))
        columns = [[[f for f, _ in x] for x in found], [[n for _, n in x] for x in found], list(found.values())]
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["features", "changes", "n"])

    table = rows.select("text").mapInArrow(run, "features array<long>, changes array<long>, n long")
    return [(r[0], r[1], r[2]) for r in table.groupBy("features", "changes").agg(F.sum("n").alias("n")).orderBy("features", "changes").collect()]


def fit(docs: DataFrame, labels: DataFrame, fairness: float = 10.0, ridge: float = 1e-5, rows: int = SAMPLE_ROWS, features: int = MAX_FEATURES) -> Model:
    """Fit on up to ``rows`` of ``labels`` (doc_id, grade 0 or 1); ``fairness`` weighs the score changes of swaps."""
    known = sample(docs, labels, rows)
    chosen = screen(known, featurize, [0, 1], limit=features)
    x, y = gather(known, featurize, chosen)
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return Model(np.zeros(0, np.int64), np.zeros(0), 40.0 if share else -40.0)
    n, k = len(y), len(chosen)
    place = {f: i for i, f in enumerate(chosen.tolist())}
    pairs = [([place[f] for f in fs if f in place], [c for f, c in zip(fs, cs, strict=True) if f in place], m) for fs, cs, m in counterfactuals(known)]
    pairs = [p for p in pairs if p[0]]
    swap = Sparse(np.array([c for p in pairs for c in p[0]], np.int64), np.array([v for p in pairs for v in p[1]], float), np.cumsum([0, *(len(p[0]) for p in pairs)]))
    often = np.array([p[2] for p in pairs], float)
    often /= max(1.0, often.sum())

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.dot(w[:k]) + w[k]
        change = swap.dot(w[:k])
        value = np.logaddexp(0, np.where(y == 1, -z, z)).mean() + ridge / 2 * (w[:k] @ w[:k]) + fairness * (often @ change**2)
        g = (sigmoid(z) - y) / n
        grad = np.append(x.back(g, k) + ridge * w[:k] + 2 * fairness * swap.back(often * change, k), g.sum())
        return float(value), grad

    start = np.append(np.zeros(k), np.log(share / (1 - share)))
    w = minimise(loss, start)
    return Model(chosen, w[:k], float(w[k]))


_weights: dict[str, float] = {}
_weights_of: list[bytes] = []


def word_weights(model: Model, vocab: list[str]) -> np.ndarray:
    """Sum of the weights of each word's features; a worker remembers its words for as long as the model is the same."""
    key = model.weights.tobytes()
    if _weights_of != [key] or len(_weights) > MEMORY_WORDS:
        _weights.clear()
        _weights_of[:] = [key]
    table = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    for w in vocab:
        if w not in _weights:
            _weights[w] = sum(table.get(f, 0.0) for f in word_features(w))
    return np.fromiter(map(_weights.__getitem__, vocab), float, len(vocab))


def document_scores(texts: pa.Array, model: Model) -> np.ndarray:
    """Toxicity of each text, from 0 to 1."""
    words = split_words(texts)
    weight = word_weights(model, words.vocab)
    used = np.flatnonzero(weight[words.ids] != 0) if len(words.ids) else np.zeros(0, np.int64)
    size = max(1, len(words.vocab))
    pairs = np.unique(rows_of(words.offsets)[used] * size + words.ids[used])
    z = np.bincount(pairs // size, weight[pairs % size] if len(pairs) else None, len(texts))
    return sigmoid(z + model.bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array(document_scores(part.column("text"), model))], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def train_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that may be learned from: those whose crc32(doc_id as text) mod 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("grade"))
    return labels.where(F.col("grade").isin(0, 1) & (fold_of("doc_id", 3) != 1))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document."""
    docs = text_view(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    scored = score(docs, fit(docs, train_labels(spark, sf_dir)))
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
