"""Hashed-text linear models: a bounded labelled sample, screened features and a small quasi-Newton fit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evflow.llm.store import stage
from evflow.llm.text import slices

#: Labelled rows that a fit uses at most, chosen by a hash of their id; with fewer, all.
SAMPLE_ROWS = 20_000
#: Features that a fit uses at most, those with the clearest difference between grades.
MAX_FEATURES = 20_000
#: Hashed features are 32-bit numbers.
_SPACE = (1 << 32) - 1


class Sparse(NamedTuple):
    """Rows of a sparse matrix: ``cols`` and ``vals`` of row i lie in ``offsets[i]:offsets[i + 1]``."""

    cols: np.ndarray
    vals: np.ndarray
    offsets: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows(), self.vals * w[self.cols], len(self.offsets) - 1)

    def back(self, g: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.cols, self.vals * g[self.rows()], n)


def hashed(name: str) -> int:
    """Number of a named feature."""
    return xxhash.xxh32_intdigest(name.encode("utf-8", "surrogatepass")) & _SPACE


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """Up to ``limit`` labelled documents (doc_id, text, grade), written out; a document's first label counts.

    The chosen labels are at most ``limit`` rows, so they go to every executor; of rows with one id, the one with the
    first text counts, so that the sample has no more rows than that.
    """
    chosen = labels.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(limit)
    found = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    return stage(found.select("doc_id", "text", "grade"), "labelled-sample")


#: From a column of texts to (row, feature, value) of their features, each pair once.
Featurizer = Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]


def screen(rows: DataFrame, featurize: Featurizer, grades: list[int], least: float = 3.0, limit: int = MAX_FEATURES) -> np.ndarray:
    """Features whose presence differs most between grades, by the largest z-score of the log odds over all cuts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                grade = part.column("grade").to_numpy(zero_copy_only=False).astype(np.int64)
                at, feature, _ = featurize(part.column("text"))
                pairs, n = np.unique(feature.astype(np.int64) * 64 + grade[at], return_counts=True)
                yield pa.record_batch([pa.array(pairs // 64), pa.array(pairs % 64), pa.array(n.astype(np.int64))], names=["feature", "grade", "n"])

    totals = {r["grade"]: r["n"] for r in rows.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = rows.select("text", "grade").mapInArrow(count, "feature long, grade long, n long")
    wide = counts.groupBy("feature").agg(*[F.sum(F.when(F.col("grade") == g, F.col("n")).otherwise(0)).alias(f"g{g}") for g in grades])
    scores = []
    for k in range(1, len(grades)):
        low, high = grades[:k], grades[k:]
        a, b = sum(F.col(f"g{g}") for g in high) + 0.5, sum(F.col(f"g{g}") for g in low) + 0.5
        c, d = F.lit(sum(totals.get(g, 0) for g in high) + 1.0) - a, F.lit(sum(totals.get(g, 0) for g in low) + 1.0) - b
        scores.append(F.abs(F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))
    z = F.greatest(*scores) if len(scores) > 1 else scores[0]
    best = wide.where(sum(F.col(f"g{g}") for g in grades) >= 3).select("feature", z.alias("z")).where(F.col("z") >= least)
    return np.sort(np.array([r["feature"] for r in best.orderBy(F.desc("z"), "feature").limit(limit).collect()], np.int64))


def gather(rows: DataFrame, featurize: Featurizer, chosen: np.ndarray) -> tuple[Sparse, np.ndarray]:
    """The chosen features of the sample's rows, and their grades; bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at, feature, value = featurize(part.column("text"))
                place = np.searchsorted(chosen, feature)
                place[place == len(chosen)] = 0
                kept = np.flatnonzero(chosen[place] == feature) if len(chosen) else np.zeros(0, np.int64)
                kept = kept[np.argsort(at[kept], kind="stable")]
                offsets = np.searchsorted(at[kept], np.arange(part.num_rows + 1)).astype(np.int32)
                cols = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place[kept].astype(np.int32)))
                vals = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[kept].astype(np.float64)))
                yield pa.record_batch([part.column("doc_id"), part.column("grade"), cols, vals], names=["doc_id", "grade", "cols", "vals"])

    kind = "doc_id long, grade int, cols array<int>, vals array<double>"
    table = rows.select("doc_id", "text", F.col("grade").cast("int").alias("grade")).mapInArrow(run, kind).orderBy("doc_id").toArrow()
    cols, vals = table["cols"].combine_chunks(), table["vals"].combine_chunks()
    if not table.num_rows:
        return Sparse(np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64)), np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(cols.value_lengths().to_numpy())])
    flat = cols.flatten().to_numpy().astype(np.int64)
    return Sparse(flat, vals.flatten().to_numpy(), offsets), table["grade"].to_numpy().astype(np.int64)


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 150, memory: int = 10) -> np.ndarray:
    """Limited-memory quasi-Newton descent with backtracking on a smooth convex loss and its gradient."""
    past: list[tuple[np.ndarray, np.ndarray]] = []
    value, grad = loss(x)
    for _ in range(steps):
        if np.abs(grad).max(initial=0) < 1e-6:
            break
        q, kept = grad.copy(), []
        for s, y in reversed(past):
            a = s @ q / (s @ y)
            q -= a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(past, reversed(kept), strict=True):
            q += s * (a - y @ q / (s @ y))
        step, slope = 1.0 if past else 1 / max(1.0, np.abs(grad).sum()), -(q @ grad)
        while True:
            after = x - step * q
            new, turned = loss(after)
            if new <= value + 1e-4 * step * slope or step < 1e-12:
                break
            step /= 2
        if step < 1e-12:
            break
        s, y = after - x, turned - grad
        if s @ y > 1e-12:
            past = [*past[1 - memory :], (s, y)]
        x, value, grad = after, new, turned
    return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fold_of(column: str, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(column).cast("string")) % folds
