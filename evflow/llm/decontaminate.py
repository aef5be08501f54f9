"""Benchmark passages in documents within an edit budget, by the pigeonhole principle.

A test item of m characters may differ from a passage by up to k = floor(m * budget) edits.  It is split into k + 1
pieces; k edits leave one piece whole, so every passage within the budget has an exact hit of some piece.  All pieces of
all items are looked up in one pass over each text (Aho-Corasick), and each hit's surroundings are verified with Myers'
bit-parallel edit distance, whose columns are whole numbers as wide as the item.  Both sides are compared in lower case
with white space made one space.

The items are sent to every executor, up to ``SENT_CHARS`` characters of them at once: a larger benchmark is dealt to
parts by a hash, and the documents are read once for each part.

Cases: null or empty texts and items match nothing; an item too short for pieces of ``MIN_PIECE`` characters gets as many
pieces as fit, and a smaller budget; repeated rows match alike; ties give the first end; other columns are left out; without
documents there is no pair, without items every document stays.  A text is searched whole, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evflow.llm.store import stage
from evflow.llm.text import keep_rows, slices, text_view

#: Share of an item's characters that may be edited.
BUDGET = 0.06
#: Shorter pieces would hit too often by chance.
MIN_PIECE = 8
#: Characters of items that are sent to every executor at once; a larger benchmark takes several passes over the documents.
SENT_CHARS = 4_000_000


class Item(NamedTuple):
    """A test item: its text, its edit budget and, per character, the bits of the places that hold it."""

    item_id: int
    text: str
    budget: int
    masks: dict[str, int]


def normalise(text: str | None) -> str:
    """Lower case, with each run of white space made one space."""
    return " ".join((text or "").lower().split())


def make_item(item_id: int, text: str | None, budget: float = BUDGET) -> Item | None:
    """The item with as many edits as leave pieces of ``MIN_PIECE`` characters; None if it has no characters."""
    whole = normalise(text)
    if not whole:
        return None
    masks: dict[str, int] = {}
    for i, c in enumerate(whole):
        masks[c] = masks.get(c, 0) | 1 << i
    return Item(item_id, whole, max(0, min(int(len(whole) * budget), len(whole) // MIN_PIECE - 1)), masks)


def pieces(item: Item) -> Iterator[tuple[int, str]]:
    """Start and text of budget-plus-one pieces of almost equal length."""
    n, parts = len(item.text), item.budget + 1
    for k in range(parts):
        start = k * n // parts
        yield start, item.text[start : (k + 1) * n // parts]


def myers(item: Item, text: str) -> tuple[int, int]:
    """Least edit distance of the item to any substring of ``text``, and the first end of one that has it."""
    m = len(item.text)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, get = full, 0, m, item.masks.get
    best, end = m, 0
    for i, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, i + 1
        ph <<= 1
        plus = ((mh << 1) | ~(xv | ph)) & full
        minus = ph & xv & full
    return best, end


def automaton(items: list[Item]) -> ahocorasick.Automaton:
    """All pieces of all items, each with the items and places it comes from."""
    places: dict[str, list[tuple[int, int]]] = {}
    for k, item in enumerate(items):
        for start, piece in pieces(item):
            places.setdefault(piece, []).append((k, start))
    found = ahocorasick.Automaton()
    for piece, where in places.items():
        found.add_word(piece, (len(piece), where))
    if places:
        found.make_automaton()
    return found


def matches(text: str, items: list[Item], search: ahocorasick.Automaton) -> list[tuple[int, int, int, int]]:
    """(item, distance, end, hits) of every item within its budget of some passage; the passage nearest to it."""
    spans: dict[int, list[list[int]]] = {}
    for end, (size, where) in search.iter(text):
        for k, start in where:
            item = items[k]
            low = end + 1 - size - start - item.budget
            high = low + len(item.text) + 2 * item.budget
            own = spans.setdefault(k, [])
            for span in reversed(own):  # hits come by their ends, so one far behind ends the search
                if span[1] < low - 3 * (high - low):
                    own.append([low, high, 1])
                    break
                if span[0] <= high and low <= span[1]:
                    span[0], span[1], span[2] = min(span[0], low), max(span[1], high), span[2] + 1
                    break
            else:
                own.append([low, high, 1])
    out = []
    for k, own in spans.items():
        item, best = items[k], None
        for low, high, hits in own:
            low = max(0, low)
            at = text.find(item.text, low, high)
            distance, end = (0, at + len(item.text)) if at >= 0 else (lambda d, e: (d, low + e))(*myers(item, text[low:high]))
            if distance <= item.budget and (best is None or distance < best[1]):
                best = (k, distance, end, hits)
        if best:
            out.append(best)
    return out


_loaded: dict[int, tuple[list[Item], ahocorasick.Automaton]] = {}


def loaded(rows: list[tuple[int, str]], budget: float) -> tuple[list[Item], ahocorasick.Automaton]:
    """This worker's items and automaton."""
    key = hash((tuple(rows), budget))
    if key not in _loaded:
        _loaded.clear()
        items = [x for i, t in rows if (x := make_item(i, t, budget))]
        _loaded[key] = items, automaton(items)
    return _loaded[key]


def sent_in_parts(benchmark: DataFrame, most: int | None = None) -> list:
    """The benchmark's items in parts of about ``most`` characters (``SENT_CHARS``), each sent to every executor.

    Items are dealt to parts by a hash; one item that is longer by itself is not cut.
    """
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // (most or SENT_CHARS)) or 1
    context = benchmark.sparkSession.sparkContext
    parts = (items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text") for k in range(n))
    return [context.broadcast([(r[0], r[1]) for r in part.collect()]) for part in parts]


def clean(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item of the benchmark."""
    parts = sent_in_parts(benchmark)
    kept = docs
    for sent in parts:

        def keep(part: pa.RecordBatch, sent=sent) -> list[bool]:
            items, search = loaded(sent.value, budget)
            texts = map(normalise, part.column("text").to_pylist())
            return [not (items and text and matches(text, items, search)) for text in texts]

        kept = keep_rows(kept, keep)
        if sent is not parts[-1]:
            kept = stage(kept, "decontaminated")
    return kept


def find_leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Pairs (doc_id, item_id) of texts that hold a passage within an item's budget.

    Also: distance, budget, end (characters of the normalised text up to the passage's end), hits (pieces found there).
    """
    kind = "doc_id long, item_id long, distance long, budget long, end long, hits long"

    def found_in(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, search = loaded(sent.value, budget)
            for batch in batches:
                for part in slices(batch):
                    out = []
                    if items:
                        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                            if whole := normalise(text):
                                out += [(doc, items[k].item_id, d, items[k].budget, end, hits) for k, d, end, hits in matches(whole, items, search)]
                    columns = list(zip(*out, strict=True)) or [()] * 6
                    yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "budget", "end", "hits"])

        return docs.mapInArrow(run, kind)

    return reduce(DataFrame.unionByName, map(found_in, sent_in_parts(benchmark)))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item found in it."""
    docs = text_view(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
