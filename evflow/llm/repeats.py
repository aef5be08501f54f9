"""Remove every byte of a passage of ``size`` bytes that also starts anywhere else, by a radix sort cut off at ``size``.

Every place where ``size`` bytes follow in the same text is a suffix, and suffixes are dealt to groups by digits, most
significant first, until all ``size`` bytes are compared; no byte beyond is looked at.  Groups of one are dropped after
each digit, so that later digits see few suffixes; those of two or more after the last are the repeated windows.

1. The first digit is the fingerprint of the window's *block*: of its stretches of three quarters of ``size`` bytes, the
   first one of the least hash.  Equal windows hold the same block at the same place, and neighbouring windows mostly
   share one: a *tile* is such a run of windows.
2. The second digit is that of the whole tile.  If two tiles are equal, all their windows are repeated, and one of them
   stands for all in what follows.
3. The last digit is the whole window, for the tiles whose block is shared by different tiles: the edges of passages.

Texts stay where they are.  A task counts the tiles of its own part first, so no key has more rows than there are parts,
however often a passage occurs; answers go back to the part, in a file of its own.  Digits are 64 bits and are always
compared with the block's, 128 bits together.

Cases: null texts count as empty ones; a text below ``size`` bytes keeps all; repeated rows remove each other and each
has its row; null and repeated doc_ids are rows like others; an empty table gives none; other columns are left out.
Texts above ``STEP`` bytes are worked on in steps, so memory holds the text and some 200 bytes for each byte of a step.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evflow.llm.store import new_path, stage
from evflow.llm.text import slices

#: Windows of a text that are hashed at once.
STEP = 1 << 20
#: Tiles or windows that a task counts before it hands them on.
HELD = 1 << 21
_WHOLE, _ASK = 1, 2


class Tiles(NamedTuple):
    """Runs of windows with one block: first and last start (in bytes of the step), digits of block and of tile."""

    first: np.ndarray
    last: np.ndarray
    block: np.ndarray
    tile: np.ndarray


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits, one to one."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit key of two digits."""
    return mixed(a * np.uint64(0x9FB21C651E98DF25) + b)


@functools.cache
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.empty(n, np.uint64)
        p[0], p[1:] = 1, b
        with np.errstate(over="ignore"):
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Sums:
    """Polynomial fingerprints of stretches of a byte string."""

    _letters = mixed(np.arange(1, 257, dtype=np.uint64))

    def __init__(self, data: np.ndarray, base: int, longest: int):
        power, self.inverse = _powers(longest, base)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._letters[data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprint of each stretch."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def all(self, size: int) -> np.ndarray:
        """Fingerprint of every stretch of ``size`` bytes."""
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.inverse[:n]


def least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbouring keys."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    rows = padded.reshape(-1, width)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


class Step:
    """Tiles and windows of a stretch of bytes that holds one or several texts, or a part of one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        self.size = size
        block = max(1, size * 3 // 4)
        self.windows = Sums(data, 0x5851F42D4C957F2D, STEP + size)
        blocks = mixed(Sums(data, 0x2545F4914F6CDD1D, STEP + size).all(block))
        places = np.uint64((1 << (STEP + size).bit_length()) - 1)
        chosen = (least_of((blocks & ~places) | np.arange(len(blocks), dtype=np.uint64), size - block + 1) & places).astype(np.int64)
        inside = np.zeros(len(chosen) + 1, np.int32)
        whole = np.flatnonzero(np.diff(offsets) >= size)
        inside[offsets[whole]] = 1
        inside[offsets[whole + 1] - size + 1] -= 1
        inside = np.cumsum(inside[:-1]) > 0
        turn = np.flatnonzero(chosen[1:] != chosen[:-1]) + 1
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        starts[turn] |= inside[turn]
        ends[turn - 1] |= inside[turn - 1]
        first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        at = chosen[first]
        shape = ((last - first) << 32 | at - first).astype(np.uint64)
        self.tiles = Tiles(first, last, blocks[at], mixed(self.windows.of(first, last + size) + mixed(shape)))

    def windows_of(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of all windows of the chosen tiles, their blocks' digits and their own."""
        t = self.tiles
        n = (t.last - t.first + 1)[chosen]
        start = np.repeat(t.first[chosen] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return start, np.repeat(t.block[chosen], n), mixed(self.windows.of(start, start + self.size))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after the other, and where each one starts."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def steps(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, Step]]:
    """The steps of a slice, each with its place; one text of many windows makes several, cut at the same places anywhere."""
    if len(offsets) > 2 or len(data) < STEP + size:
        if len(data) >= size:
            yield 0, Step(data, offsets, size)
        return
    for at in range(0, len(data) - size + 1, STEP):
        piece = data[at : at + STEP + size - 1]
        yield at, Step(piece, np.array([0, len(piece)]), size)


class Counter:
    """Pairs of digits of a part, counted as they come."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.held.append((a, b))
        self.size += len(a)

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        """All pairs with their counts; the counter is empty then."""
        if self.size:
            a, b = (np.concatenate(x) for x in zip(*self.held, strict=True))
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            n = np.diff(np.append(new, len(a)))
            yield pa.record_batch([pa.array(np.full(len(new), part, np.int32)), pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int64)), pa.array(n)], names=["part", "block", "digit", "n"])
        self.__init__()


class Answers:
    """What is known of a part's pairs of digits: flags, found by the pair."""

    def __init__(self, uri: str, part: int):
        table = _read_part(uri, part)
        key = joined(*(table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("block", "digit")))
        order = np.argsort(key)
        self.keys, self.flags = key[order], table.column("flags").to_numpy().astype(np.int8)[order]

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and flags of each pair; flags are 0 for one without an answer."""
        if not len(self.keys):
            return np.zeros(len(a), np.int64), np.zeros(len(a), np.int8)
        key = joined(a, b)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return at, np.where(self.keys[at] == key, self.flags[at], 0)


def _read_part(uri: str, part: int) -> pa.Table:
    """The rows that were written for a part."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(f"{uri}/part={part}")
    files = [f.path for f in where.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet")]
    found = [pq.ParquetFile(where.open_input_file(f)).read(["block", "digit", "flags"]) for f in sorted(files)]
    return pa.concat_tables(found) if found else pa.table({c: pa.array([], t) for c, t in (("block", pa.int64()), ("digit", pa.int64()), ("flags", pa.int8()))})


def _by_part(rows: DataFrame, name: str) -> str:
    """Write the answers, one folder a part; their path."""
    path = new_path(rows.sparkSession, name)
    rows.repartition("part").sortWithinPartitions("part").write.partitionBy("part").parquet(path)
    return path


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the staged texts, each of one part."""
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                for piece in slices(batch.slice(a, b - a), limit=STEP):
                    yield int(part[a]), piece


def _counted(texts: DataFrame, size: int, digits) -> DataFrame:
    """Pairs of digits that ``digits(part)(step)`` gives for the steps of each part, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, now, of = Counter(), None, None
        for part, piece in _parts(batches):
            if part != now or counter.size > HELD:
                yield from counter.rows(now)
                if part != now:
                    now, of = part, digits(part)
            for _, step in steps(*bytes_of(piece.column("text")), size):
                counter.add(*of(step))
        yield from counter.rows(now)

    return texts.select("part", "text").mapInArrow(run, "part int, block long, digit long, n long")


def repeated(pairs: DataFrame) -> DataFrame:
    """The pairs that occur twice or more; a pair has a row in each part at most."""
    often = pairs.groupBy("block", "digit").agg(F.sum("n").alias("all")).where("all > 1").select("block", "digit")
    return pairs.join(often.hint("merge"), ["block", "digit"]).select("part", "block", "digit", F.lit(_WHOLE).cast("byte").alias("flags"))


def tile_answers(tiles: DataFrame) -> DataFrame:
    """Of each part's tiles: whether all windows are repeated, and whether the windows themselves must be asked for.

    One part asks for a tile that several hold.  A block of very many different tiles is one key of the first join,
    which adaptive execution splits.
    """
    blocks = tiles.groupBy("block").agg(F.sum("n").alias("all"), (F.min("digit") != F.max("digit")).alias("differ")).where("all > 1").select("block", "differ")
    alive = stage(tiles.join(blocks.hint("merge"), "block"), "repeat-alive")
    kinds = alive.groupBy("block", "digit").agg(F.sum("n").alias("all"), F.min("part").alias("asks"))
    known = alive.join(kinds.hint("merge"), ["block", "digit"])
    flags = F.when(F.col("all") > 1, _WHOLE).otherwise(0) + F.when(F.col("differ") & (F.col("part") == F.col("asks")), _ASK).otherwise(0)
    return known.select("part", "block", "digit", flags.cast("byte").alias("flags")).where("flags > 0")


def remove_repeats(docs: DataFrame, size: int = 400, column: str = "text") -> DataFrame:
    """``docs`` as doc_id, n_bytes, spans (removed runs of bytes, end exclusive) and kept (the bytes that are left)."""
    if size < 2:
        raise ValueError("a passage has two bytes at least")
    texts = stage(
        docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(column), F.lit("")).cast("binary").alias("text")),
        "repeat-texts",
    )
    tiles = stage(_counted(texts, size, lambda part: lambda step: (step.tiles.block, step.tiles.tile)), "repeat-tiles")
    of_tiles = _by_part(tile_answers(tiles), "repeat-answers")

    def asked(part: int):
        answers, done = Answers(of_tiles, part), set()

        def of(step: Step) -> tuple[np.ndarray, np.ndarray]:
            at, flags = answers.find(step.tiles.block, step.tiles.tile)
            ask = np.flatnonzero(flags & _ASK)
            new, index = np.unique(at[ask], return_index=True)
            fresh = [k for k, x in zip(index.tolist(), new.tolist(), strict=True) if x not in done]
            done.update(new.tolist())
            return step.windows_of(ask[fresh])[1:]

        return of

    windows = stage(_counted(texts, size, asked), "repeat-windows")
    of_windows = _by_part(repeated(windows), "repeat-answers")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = tile = window = None
        for part, piece in _parts(batches):
            if part != now:
                now, tile, window = part, Answers(of_tiles, part), Answers(of_windows, part)
            data, offsets = bytes_of(piece.column("text"))
            change = np.zeros(len(data) + 1, np.int32)
            for at, step in steps(data, offsets, size):
                flags = tile.find(step.tiles.block, step.tiles.tile)[1]
                whole = flags & _WHOLE > 0
                change[at + step.tiles.first[whole]] += 1
                change[at + step.tiles.last[whole] + size] -= 1
                start, block, digit = step.windows_of(np.flatnonzero(flags == _ASK))
                start = at + start[window.find(block, digit)[1] > 0]
                change[start] += 1
                change[start + size] -= 1
            yield cut_rows(piece.column("doc_id"), data, offsets, np.cumsum(change[:-1]) > 0)

    return texts.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def cut_rows(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    """Rows of texts without the bytes that are ``gone``."""
    head, tail = gone.copy(), gone.copy()
    head[1:] &= ~gone[:-1]
    tail[:-1] &= ~gone[1:]
    begins = offsets[:-1][np.diff(offsets) > 0]
    head[begins] = gone[begins]
    tail[begins[1:] - 1] = gone[begins[1:] - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    owner = np.searchsorted(offsets, start, "right") - 1
    n = np.searchsorted(start, offsets)
    base = offsets[owner]
    spans = pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - base)], ["start", "end"]))
    left = np.concatenate([[0], np.cumsum(~gone)])[offsets].astype(np.int64)
    kept = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(left), pa.py_buffer(data[~gone].tobytes())])
    return pa.record_batch([ids, pa.array(np.diff(offsets)), spans, kept.cast(pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages of 400 bytes that start anywhere else, too."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), 400)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
