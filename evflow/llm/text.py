"""Words and tokens of texts in Arrow batches, counted and hashed as whole columns."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that one step of a task works on; one longer text is taken alone.
SLICE_BYTES = 4 << 20


class Words(NamedTuple):
    """Words of a column of texts: ``ids[offsets[i]:offsets[i + 1]]`` are row i's, as places in ``vocab``."""

    ids: np.ndarray
    offsets: np.ndarray
    vocab: list[str]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no slice of more than one row has over ``limit`` bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array, lower: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z in lower case unless ``lower`` is false; a null text has none."""
    whole = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "")  # a copy: kernels misread some slices
    parts = pc.ascii_split_whitespace(pc.ascii_lower(whole) if lower else whole)
    flat, ends = parts.flatten(), parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = flat.filter(full).dictionary_encode()
    return Words(coded.indices.to_numpy(zero_copy_only=False), kept[ends], coded.dictionary.to_numpy(zero_copy_only=False).tolist())


def hash64(values: list[str]) -> np.ndarray:
    """Unsigned 64-bit hash of each string."""
    return np.fromiter((xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) for v in values), np.uint64, len(values))


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row that each element of the flat array belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    """A list column from a flat array and row offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def text_view(docs, extra: tuple[str, ...] = ()):
    """``docs`` as doc_id and text alone: other columns, whatever their names, don't take part."""
    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def keep_rows(docs, keep):
    """The rows of ``docs``, with all their columns, for which ``keep`` of a batch gives true; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(keep(part), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
