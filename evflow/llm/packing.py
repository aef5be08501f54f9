"""Hierarchical packing of token sequences into windows of several lengths.

A document of at least the longest window gives whole windows of it; what is left is routed to the shortest tier that
holds it.  From the longest tier down, each piece opens a window of its tier, and the window's gap is filled with the
longest pieces of shorter tiers that fit, then with the head of one more, which is cut there.  Every window is thus
full, but for the last ones of a task: their tokens are dealt to windows of falling powers of two, so no window needs
padding.  Windows of a tier are dealt to step groups of equal token counts, heaviest first and in turns, so that the
groups' attention costs (sum of squared piece lengths) are close.

Each task packs its own documents, some thousands at a time: nothing is shuffled, and a task holds one such lot.

Cases: a null or empty text is the end id alone; a null doc_id is kept; repeated rows are packed as often as they
occur; an empty table gives no piece; other columns of the input are left out.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from evflow.llm.text import slices, text_view
from evflow.llm.tokenize import default_tokenizer, token_bytes

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs one task's pieces (length, document, start); ``windows`` are (tier, [pieces]) with no gap."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers = tuple(sorted(tiers))
        self.pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def add(self, doc: int, tokens: int) -> None:
        """Cut whole longest windows from the document and route the rest."""
        top, start = self.tiers[-1], 0
        while tokens - start >= top:
            self.windows.append((top, [(top, doc, start)]))
            start += top
        if start < tokens:
            self.route((tokens - start, doc, start))

    def route(self, piece: tuple[int, int, int]) -> None:
        """Put a piece into the shortest tier that holds it."""
        insort(self.pools[next(t for t in self.tiers if t >= piece[0])], piece)

    def take(self, most: int, below: int) -> tuple[int, int, int] | None:
        """The longest piece of up to ``most`` tokens in a tier of up to ``below``, else the head of a longer one."""
        for tier in reversed(self.tiers):
            if tier <= below and (k := bisect_right(self.pools[tier], (most + 1, -1, -1))):
                return self.pools[tier].pop(k - 1)
        for tier in self.tiers:
            if tier <= below and self.pools[tier]:
                size, doc, start = self.pools[tier].pop()
                self.route((size - most, doc, start + most))
                return most, doc, start
        return None

    def pack(self, last: bool) -> None:
        """Empty the pools; without ``last``, what doesn't fill a window stays."""
        short: list[tuple[int, int, int]] = []
        for tier in reversed(self.tiers):
            while self.pools[tier]:
                piece = self.pools[tier].pop()
                inside, gap = [piece], tier - piece[0]
                while gap and (more := self.take(gap, tier)):
                    inside.append(more)
                    gap -= more[0]
                if gap:
                    short += inside
                else:
                    self.windows.append((tier, inside))
        if last:
            self.tail(short)
        else:
            for piece in short:
                self.route(piece)

    def tail(self, pieces: list[tuple[int, int, int]]) -> None:
        """Deal the last pieces to windows of falling powers of two."""
        left = sum(p[0] for p in pieces)
        while left:
            tier = min(self.tiers[-1], 1 << left.bit_length() - 1)
            inside, gap = [], tier
            while gap:
                size, doc, start = pieces.pop()
                if size > gap:
                    pieces.append((size - gap, doc, start + gap))
                    size = gap
                inside.append((size, doc, start))
                gap -= size
            self.windows.append((tier, inside))
            left -= tier


def groups_of(windows: list[tuple[int, list[tuple[int, int, int]]]], budget: int) -> list[int]:
    """A step group for each window: of one tier, of ``budget`` tokens, of like attention cost."""
    out, first = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = sorted((k for k, (t, _) in enumerate(windows) if t == tier), key=lambda k: -sum(p[0] ** 2 for p in windows[k][1]))
        n = max(1, -(-len(own) * tier // budget))
        for turn, k in enumerate(own):
            lap, at = divmod(turn, n)
            out[k] = first + (n - 1 - at if lap % 2 else at)
        first += n
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, tiers: tuple[int, ...] = (512, 1024, 2048, 4096), step_tokens: int = 1 << 17, lot: int = 4096, ids: bool = False) -> DataFrame:
    """Pack every text's tokens; one row a piece, with its window and the window's step group.

    ``tiers`` are powers of two.  ``lot`` is how many documents a task packs at once.  ``ids`` adds the pieces' ids.
    """
    if any(t & (t - 1) for t in tiers):
        raise ValueError("tiers must be powers of two")
    tokenizer = tokenizer or default_tokenizer()
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        packer, held, sequence, group = Packer(tiers), {}, 0, 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal sequence, group
            packer.pack(last)
            windows, packer.windows = packer.windows, []
            steps = groups_of(windows, step_tokens)
            rows = []
            for (tier, inside), step in zip(windows, steps, strict=True):
                offset = 0
                for size, doc, start in inside:
                    doc_id, raw = held[doc]
                    cut = raw[4 * start : 4 * (start + size)]
                    rows.append((doc_id, start, size, zlib.crc32(cut), len(raw) // 4, task + sequence, offset, tier, task + group + step, cut))
                    offset += size
                sequence += 1
            group += max(steps, default=-1) + 1
            waiting = {p[1] for pool in packer.pools.values() for p in pool}
            for doc in [d for d in held if d not in waiting]:
                del held[doc]
            columns = list(zip(*rows, strict=True)) or [()] * 10
            arrays = [pa.array(c, pa.int32() if k == 7 else pa.int64()) for k, c in enumerate(columns[:9])]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if ids:
                import numpy as np

                arrays.append(pa.array([np.frombuffer(c, "<i4") for c in columns[9]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.record_batch(arrays, names=names)

        count = 0
        for batch in batches:
            for part in slices(batch):
                for doc_id, raw in zip(part.column("doc_id").to_pylist(), token_bytes(part.column("text"), tokenizer), strict=True):
                    held[count] = (doc_id, raw + end)
                    packer.add(count, len(raw) // 4 + 1)
                    count += 1
                if len(held) >= lot:
                    yield flush(False)
        yield flush(True)

    return text_view(docs).mapInArrow(run, SCHEMA + ", ids array<int>" * ids)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into windows of at most 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
