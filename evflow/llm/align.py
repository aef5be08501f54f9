"""Align the tokens of two tokenizers by bytes, and count how many documents link each pair of ids.

A text is cut into *units* (white space and what follows it) at places that no token of either tokenizer crosses, which
is checked against both vocabularies.  A unit is encoded once by a worker, with both libraries; where tokens of both
end at the same byte, a *group* ends, and each token of the one tokenizer in a group is linked with each of the other.

Counting: every task counts documents for the pairs it meets.  Pairs are dealt to buckets by their first id.  A minimal
perfect hash of a bucket's distinct pairs gives each a place; the tasks' counts become dense vectors by place, with the
keys verified, and are summed in two levels.  A bucket has all pairs of its first ids, so it knows the highest count
of each of them.  Pairs are at most one for each two ids, so a bucket is bounded by the vocabularies.

Second pass: documents are aligned again and look the counts up.  Tasks hold the counts of at most ``resident`` pairs,
those that the most documents have; other pairs are looked up by a join, in which no key has many rows then.

Cases: a null or empty text, and one whose tokens' bytes aren't the text's (it holds U+2581, say), has no tokens: zeros
and an empty string; repeated rows count as documents of their own; a null doc_id is kept; an empty table gives no row;
other columns are left out.  A text is one value of one row, whatever its length; a group's pairs of different ids
are made at once.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evflow.llm.mph import PerfectHash
from evflow.llm.store import open_file, stage
from evflow.llm.text import slices

#: Units that a worker remembers, and pairs that it counts before it hands them on.
UNITS, HELD = 500_000, 4_000_000
#: Characters that are encoded at once, and links from which a group's are made of its different ids.
BATCH, WIDE = 100_000, 4096
BUCKETS, SUMS = 256, 8
#: What a unit may not begin after: white space of any kind that a pattern may mean, and the sign that stands for it.
_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 ᠎​    　﻿▁" + "".join(map(chr, range(0x2000, 0x200B)))
_OTHER = re.compile("[" + _SPACE.replace(" ", "").replace("\n", "") + "]")
_PLAIN = re.compile("[ \n]*[^ \n]+|[ \n]+")
_CUT = re.compile(f"(?<=[^{_SPACE}])(?=[ \n])")
_PIECE_SPACE = "▁"
#: Fixed value: how a byte-level vocabulary cuts text before its merges.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text of signs whose kind all pattern libraries agree on.
_KNOWN = re.compile("[ \n!-~\xa1-\u024f]*")


def units_of(text: str) -> list[str]:
    """Cut a text before each space or line end that follows something else than white space."""
    return _CUT.split(text) if _OTHER.search(text) else _PLAIN.findall(text)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if it can be seen, else the next above 255."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(seen)))}


class Grown:
    """Rows of numbers that are added to."""

    def __init__(self, width: int):
        self.held, self.size = np.empty((1024, width), np.int64), 0

    def __len__(self) -> int:
        return self.size

    def add(self, rows: np.ndarray) -> None:
        if self.size + len(rows) > len(self.held):
            self.held = np.concatenate([self.held[: self.size], np.empty((max(len(rows), self.size), self.held.shape[1]), np.int64)])
        self.held[self.size : self.size + len(rows)] = rows
        self.size += len(rows)

    def rows(self) -> np.ndarray:
        return self.held[: self.size]


class Aligner:
    """Both tokenizers, and the units that this worker has aligned."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        shown = byte_letters()
        size_a, self.size_b = self.a.get_vocab_size(with_added_tokens=True), self.b.get_piece_size()
        names = [self.a.id_to_token(k) or "" for k in range(size_a)]
        self.bytes_a = [bytes(map(shown.get, t)) if all(c in shown for c in t) else t.encode() for t in names]
        self.bytes_b = []
        for k in range(self.size_b):
            p = self.b.id_to_piece(k)
            if self.b.is_byte(k):
                self.bytes_b.append(bytes([int(p[3:5], 16)]))
            else:
                self.bytes_b.append(b"" if self.b.is_control(k) else p.replace(_PIECE_SPACE, " ").encode())
                if not self.b.is_control(k) and ("\n" in p or re.search(f"[^{_SPACE}]{_PIECE_SPACE}", p)):
                    raise ValueError(f"a piece goes over the start of a word: {p!r}")
        self.fast = self._ranked(json.loads(self.a.to_str())["model"])
        self.lead = self.b.encode("\n")
        if b"".join(self.bytes_b[k] for k in self.lead) != b" \n":
            raise ValueError("the pieces don't begin with a space of their own")
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in v]) for v in (self.bytes_a, self.bytes_b))
        names = [[np.array([f"{k}{end}" for k in range(n)], object) for end in ends] for n, ends in ((size_a, ",|"), (self.size_b, ",;"))]
        self.names_a, self.names_b = names
        self.clear()

    def _ranked(self, model: dict):
        """The first tokenizer by ranks, which is faster: its merges must come in the order of the ids they make."""
        import tiktoken

        if model["ignore_merges"] or any(model["vocab"].get("".join(m)) != k for k, m in enumerate((m.split(" ") if isinstance(m, str) else m for m in model["merges"]), 256)):
            raise ValueError("the first tokenizer's merges aren't in the order of its ids")
        ranks = {b: k for k, b in enumerate(self.bytes_a[: 256 + len(model["merges"])])}
        return tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def clear(self) -> None:
        """Forget all units."""
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.sums = Grown(4)
        self.ends = Grown(1)
        self.links = Grown(2)

    def places(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the places of its units; none for an empty text or one that doesn't fit."""
        if len(self.known) > UNITS:
            self.clear()
        known = self.known
        cut = [units_of(" " + t) if t else [] for t in texts]
        new = list({u: None for units in cut for u in units if u not in known})
        at = 0
        while at < len(new):
            stop, size = at, 0
            while stop < len(new) and size < BATCH:
                size += len(new[stop])
                stop += 1
            self._align(new[at:stop])
            at = stop
        sound = self.sums.rows()[:, 3]
        out = []
        for units in cut:
            own = np.fromiter(map(known.__getitem__, units), np.int64, len(units))
            out.append(own if sound[own].all() else own[:0])
        return out

    def pairs_of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of different ids of several units, one after the other, how often each is linked, and how many a unit has."""
        ends = np.concatenate([[0], self.ends.rows()[:, 0]])
        n = np.diff(ends)[places]
        at = np.repeat(ends[places] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        found = self.links.rows()[at]
        return found[:, 0], found[:, 1], n

    def _align(self, units: list[str]) -> None:
        """Encode units in one go: a token never crosses from one into the next."""
        whole = [u for u in units if u[-1] not in _SPACE]
        plain = [_KNOWN.fullmatch(u) is not None for u in whole]
        for group in ([u for u, p in zip(whole, plain, strict=True) if p], [u for u, p in zip(whole, plain, strict=True) if not p], *[[u] for u in units if u[-1] in _SPACE]):
            if group:
                text = "".join(group)
                fast = _KNOWN.fullmatch(text)
                a = np.array(self.fast.encode_ordinary(text) if fast else self.a.encode(text, add_special_tokens=False).ids, np.int64)
                b = np.array(self.b.encode("\n" + text)[len(self.lead) :], np.int64)
                raw = text.encode("utf-8", "surrogatepass")
                fits = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw == b"".join(map(self.bytes_b.__getitem__, b.tolist()))
                if fits:
                    self._link(group, a, b)
                elif len(group) == 1:
                    self._add(group, [""], np.zeros((1, 4), np.int64), np.zeros(1, np.int64), np.zeros((0, 2), np.int64))
                else:
                    half = len(group) // 2
                    self._align(group[:half])
                    self._align(group[half:])

    def _add(self, units: list[str], texts: list[str], sums: np.ndarray, counts: np.ndarray, links: np.ndarray) -> None:
        base = len(self.texts)
        self.known.update(zip(units, range(base, base + len(units)), strict=True))
        self.texts += texts
        self.sums.add(sums)
        self.ends.add(len(self.links) + np.cumsum(counts)[:, None])
        self.links.add(links)

    def _link(self, units: list[str], a: np.ndarray, b: np.ndarray) -> None:
        """Groups and links of units whose tokens follow each other."""
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        stops = np.cumsum([len(u.encode("utf-8", "surrogatepass")) for u in units])
        common = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        first_a, first_b = np.searchsorted(group_a, np.arange(len(common))), np.searchsorted(group_b, np.arange(len(common)))
        n_a, n_b = np.diff(np.append(first_a, len(a))), np.diff(np.append(first_b, len(b)))
        unit = np.searchsorted(stops, common)
        sums = np.ones((len(units), 4), np.int64)
        for k, x in enumerate((n_a, n_b, np.ones(len(common), np.int64))):
            sums[:, k] = np.bincount(unit, x, len(units))
        # The text: each group's first ids and then its second ones, each with the sign that follows it.
        order = np.empty(len(a) + len(b), object)
        order[np.arange(len(a)) + first_b[group_a]] = np.where(np.append(group_a[1:] == group_a[:-1], False), self.names_a[0][a], self.names_a[1][a])
        order[np.arange(len(b)) + first_a[group_b] + n_a[group_b]] = np.where(np.append(group_b[1:] == group_b[:-1], False), self.names_b[0][b], self.names_b[1][b])
        cuts = np.concatenate([[0], np.cumsum(sums[:, 0] + sums[:, 1])]).tolist()
        pieces = order.tolist()
        texts = ["".join(pieces[i:j])[:-1] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        # Links: of groups with few of them at once, of others from their different ids.
        wide = n_a * n_b > WIDE
        times = np.where(wide, 0, n_b)[group_a]
        left = np.repeat(np.arange(len(a)), times)
        right = np.repeat(first_b[group_a] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        codes, of, n = a[left] * self.size_b + b[right], unit[group_a[left]], np.ones(len(left), np.int64)
        for g in np.flatnonzero(wide).tolist():
            x, m = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            y, k = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            codes = np.concatenate([codes, (x[:, None] * self.size_b + y).ravel()])
            n = np.concatenate([n, (m[:, None] * k).ravel()])
            of = np.concatenate([of, np.full(len(x) * len(y), unit[g])])
        span = len(self.sizes_a) * self.size_b
        keys, back = np.unique(of * span + codes, return_inverse=True)
        links = np.stack([keys % span, np.bincount(back, n, len(keys)).astype(np.int64)], axis=1)
        self._add(units, texts, sums, np.bincount(keys // span, minlength=len(units)), links)


@functools.cache
def _aligners(path_a: str, path_b: str) -> Aligner:
    """This worker's aligner."""
    return Aligner(path_a, path_b)


def _pieces(path: str) -> int:
    """Size of the second vocabulary."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()


def default_tokenizers() -> tuple[str, str]:
    """Paths of the public byte-level BPE file and of the piece model that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate(codes), return_inverse=True)
    return keys, np.bincount(back, np.concatenate(counts)).astype(np.int64)


def partial_counts(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Of each task and bucket: its distinct pairs, and in how many of its documents each one is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, codes, counts, held = _aligners(*paths), [], [], 0
        source = TaskContext.get().partitionId()

        def rows() -> pa.RecordBatch:
            keys, n = _summed(codes, counts)
            bucket = keys // aligner.size_b % BUCKETS
            order = np.argsort(bucket, kind="stable")
            full = np.unique(bucket)
            cuts = np.append(np.searchsorted(bucket[order], full), len(order)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x[order])) for x in (keys, n)]
            return pa.record_batch([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), source % SUMS, np.int32)), *lists], names=["bucket", "branch", "keys", "counts"])

        for batch in batches:
            for part in slices(batch):
                places = [np.unique(at) for at in aligner.places(part.column("text").to_pylist())]
                pairs, _, n = aligner.pairs_of(np.concatenate(places))
                if not len(pairs):
                    continue
                row = np.repeat(np.repeat(np.arange(len(places)), [len(at) for at in places]), n)
                keys, local = np.unique(pairs, return_inverse=True)
                once = np.unique(row * len(keys) + local) % len(keys)
                codes.append(keys)
                counts.append(np.bincount(once, minlength=len(keys)))
                held += len(keys)
                if held > HELD:
                    codes, counts = ([x] for x in _summed(codes, counts))
                    held = len(codes[0])
                    if held > HELD // 2:
                        yield rows()
                        codes, counts, held = [], [], 0
        if codes:
            yield rows()

    return docs.select("text").mapInArrow(run, "bucket int, branch int, keys array<long>, counts array<long>")


def _by_key(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, dict]]:
    """Rows of sorted batches, each with its key."""
    for batch in batches:
        for row in range(batch.num_rows):
            yield tuple(batch.column(c)[row].as_py() for c in columns), {c: batch.column(c)[row] for c in batch.schema.names}


def _numbers(cell: pa.Scalar) -> np.ndarray:
    return cell.values.to_numpy()


def _hash_of(row: dict) -> PerfectHash:
    return PerfectHash(_numbers(row["sizes"]), _numbers(row["words"]).view(np.uint64), _numbers(row["keys"]))


def hashes(partial: DataFrame) -> DataFrame:
    """The perfect hash of each bucket's distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def row() -> pa.RecordBatch:
            h = PerfectHash.build(np.unique(np.concatenate(held)))
            return pa.RecordBatch.from_pylist([{"bucket": now, "sizes": h.sizes, "words": h.words.view(np.int64), "keys": h.keys}], schema=pa.schema([("bucket", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("sizes", "words", "keys"))]))

        for (bucket,), cells in _by_key(batches, ("bucket",)):
            if bucket != now:
                if held:
                    yield row()
                now, held, size = bucket, [], 0
            held.append(_numbers(cells["keys"]))
            size += len(held[-1])
            if size > HELD:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0]) // 2
        if held:
            yield row()

    ordered = partial.select("bucket", "keys").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, "bucket int, sizes array<long>, words array<long>, keys array<long>")


def dense_counts(partial: DataFrame, hashed: DataFrame, size_b: int) -> DataFrame:
    """keys, counts and best (whether no other pair of its first id has more) by place, for each bucket's hash."""
    bare = [F.lit(None).cast("array<long>").alias(c) for c in ("sizes", "words")]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One dense vector for each bucket and branch: the first row of a branch is the hash."""
        now, hash_, total = None, None, None
        schema = pa.schema([("bucket", pa.int32()), ("branch", pa.int32()), ("counts", pa.list_(pa.int64()))])
        for key, cells in _by_key(batches, ("bucket", "branch")):
            if key != now:
                if now is not None:
                    yield pa.RecordBatch.from_pylist([{"bucket": now[0], "branch": now[1], "counts": total}], schema=schema)
                now, hash_ = key, _hash_of(cells)
                total = np.zeros(len(hash_.keys), np.int64)
                continue
            at = hash_.find(_numbers(cells["keys"]))
            if (at < 0).any():
                raise RuntimeError("a pair has no place in its bucket's hash")
            total[at] += _numbers(cells["counts"])
        if now is not None:
            yield pa.RecordBatch.from_pylist([{"bucket": now[0], "branch": now[1], "counts": total}], schema=schema)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Add a bucket's vectors and mark the highest counts."""
        now, hash_, total = None, None, None
        schema = pa.schema([("bucket", pa.int32()), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("best", pa.list_(pa.bool_()))])

        def row() -> pa.RecordBatch:
            first, back = np.unique(hash_.keys // size_b, return_inverse=True)
            highest = np.zeros(len(first), np.int64)
            np.maximum.at(highest, back, total)
            return pa.RecordBatch.from_pylist([{"bucket": now[0], "keys": hash_.keys, "counts": total, "best": total == highest[back]}], schema=schema)

        for key, cells in _by_key(batches, ("bucket",)):
            if key != now:
                if now is not None:
                    yield row()
                now, hash_ = key, _hash_of(cells)
                total = np.zeros(len(hash_.keys), np.int64)
                continue
            total += _numbers(cells["counts"])
        if now is not None:
            yield row()

    none = F.lit(None).cast("array<long>").alias("counts")
    branches = F.explode(F.array(*map(F.lit, range(SUMS)))).alias("branch")
    first = hashed.select("bucket", branches, F.lit(0).alias("kind"), "sizes", "words", "keys", none)
    rows = first.unionByName(partial.select("bucket", "branch", F.lit(1).alias("kind"), *bare, "keys", "counts"))
    vectors = rows.repartition("bucket", "branch").sortWithinPartitions("bucket", "branch", "kind").mapInArrow(summed, "bucket int, branch int, counts array<long>")
    heads = hashed.select("bucket", F.lit(0).alias("kind"), "sizes", "words", "keys", none)
    both = heads.unionByName(vectors.select("bucket", F.lit(1).alias("kind"), *bare, F.lit(None).cast("array<long>").alias("keys"), "counts"))
    return both.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(whole, "bucket int, keys array<long>, counts array<long>, best array<boolean>")


def pair_counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """Buckets of keys, counts and best of all linked pairs; a key is the first id times the second vocabulary's size plus the second id."""
    paths = paths or default_tokenizers()
    partial = stage(partial_counts(_texts(docs), paths), "pair-partial")
    return stage(dense_counts(partial, stage(hashes(partial), "pair-hashes"), _pieces(paths[1])), "pair-counts")


class Resident(NamedTuple):
    """The pairs that a worker knows, by place."""

    hash: PerfectHash
    counts: np.ndarray
    best: np.ndarray


@functools.lru_cache(maxsize=1)
def _resident(uri: str) -> Resident:
    """The counts in a staged table."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    files = sorted(f.path for f in where.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
    found = [pq.ParquetFile(open_file(f"{uri}/{f.rpartition('/')[2]}", "rb")).read(["keys", "counts", "best"]) for f in files]
    keys, counts, best = ([t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for t in found if t.num_rows] for c in ("keys", "counts", "best"))
    if not keys:
        return Resident(PerfectHash.build(np.zeros(0, np.int64)), np.zeros(0, np.int64), np.zeros(0, bool))
    keys, counts, best = map(np.concatenate, (keys, counts, best))
    built = PerfectHash.build(keys)
    at = np.empty(len(keys), np.int64)
    at[built.find(keys)] = np.arange(len(keys))
    return Resident(built, counts[at], best[at])


def _frequent(table: DataFrame, resident: int) -> DataFrame:
    """Of the buckets, the pairs of the most documents: as many as fit, all of a count or none."""
    sizes = table.select(F.explode("counts").alias("c")).groupBy(F.floor(F.log2("c") * 8).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"))
    room, least = resident, None
    for row in sorted(sizes.collect(), key=lambda r: -r.level):
        if row.n > room:
            break
        room, least = room - row.n, row.c
    zipped = F.arrays_zip("keys", "counts", "best")
    kept = F.filter(zipped, lambda x: x["counts"] >= (least if least is not None else 1 << 62))
    return table.select("bucket", kept.alias("z")).select("bucket", "z.keys", "z.counts", "z.best")


def align(docs: DataFrame, paths: tuple[str, str] | None = None, resident: int = 4_000_000, groups: bool = True) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document, and ``groups``, their text.

    ``n_best`` counts the links of a pair that no other pair of the same first id is ahead of, ``count_sum`` adds up the
    pairs' documents over the links.
    """
    paths = paths or default_tokenizers()
    texts, spark = _texts(docs), docs.sparkSession
    table = pair_counts(docs, paths)
    n = table.agg(F.sum(F.size("keys"))).first()[0] or 0
    known = table if n <= resident else stage(_frequent(table, resident), "pair-frequent")
    uri = known.staged_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, pairs = _aligners(*paths), _resident(uri)
        task, row, more, version = TaskContext.get().partitionId() << 40, 0, None, None
        for batch in batches:
            for part in slices(batch):
                places = aligner.places(part.column("text").to_pylist())
                if aligner.known is not version:
                    version, more = aligner.known, Grown(4)
                new = np.arange(len(more), len(aligner.texts))
                if len(new):
                    codes, times, width = aligner.pairs_of(new)
                    at, of = pairs.hash.find(codes), np.repeat(np.arange(len(new)), width)
                    got, lost = at >= 0, at < 0
                    worth = [times, times * got * pairs.best[at], times * got * pairs.counts[at]] if len(pairs.counts) else [times, times * 0, times * 0]
                    more.add(np.stack([*(np.bincount(of, w, len(new)) for w in worth), np.bincount(of, lost, len(new))], axis=1).astype(np.int64))
                sums = np.concatenate([aligner.sums.rows()[:, :3], more.rows()], axis=1)
                rows, texts_of, keys, counts = [], [], [], []
                for where in places:
                    total = sums[where].sum(axis=0)
                    rows.append(total[:6])
                    texts_of.append(";".join(map(aligner.texts.__getitem__, where.tolist())))
                    left = [np.zeros(0, np.int64)] * 2
                    if total[6]:
                        codes, times, _ = aligner.pairs_of(where)
                        lost = pairs.hash.find(codes) < 0
                        left = _summed([codes[lost]], [times[lost]])
                    keys.append(left[0])
                    counts.append(left[1])
                values = np.array(rows).reshape(-1, 6)
                digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts_of]
                columns = [part.column("doc_id"), pa.array(task + row + np.arange(len(rows))), *(pa.array(values[:, k].copy()) for k in range(6)), pa.array(digests)]
                row += len(rows)
                names = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
                if groups:
                    columns.append(pa.array(texts_of))
                    names.append("groups")
                if n > resident:
                    columns += [pa.array(x, pa.list_(pa.int64())) for x in (keys, counts)]
                    names += ["keys", "times"]
                yield pa.record_batch(columns, names=names)

    schema = "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string" + ", groups string" * groups
    if n <= resident:
        return texts.mapInArrow(run, schema).drop("row")
    first = stage(texts.mapInArrow(run, schema + ", keys array<long>, times array<long>"), "aligned")
    asked = first.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("n"))
    every = table.select(F.explode(F.arrays_zip("keys", "counts", "best")).alias("x")).select(F.col("x.keys").alias("key"), "x.counts", "x.best")
    more = asked.join(every.hint("merge"), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("n") * F.col("counts")).alias("more_sum"))
    found = first.drop("keys", "times").join(more.hint("shuffle_hash"), "row", "left")
    both = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return found.withColumns(both).drop("row", "more_best", "more_sum")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment between the two public tokenizers."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), groups=False)
