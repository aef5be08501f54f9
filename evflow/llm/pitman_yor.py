"""Hierarchical Pitman-Yor language model over words, sampled and scored by blocks of words.

The predictive probability of a word is that of the restaurant of its context, which backs off to its parent's:

    p(w | u) = (c - d * t + (s + d * T) * p(w | parent)) / (s + C)

with the word's customers c and tables t in u, and C, T over all words.  Each word before is a context of its own.  Its
parent is its class: 64 by the last letter, each shared as parent by 64 by the last three letters, or the whole word if
it is short; above them is the restaurant without context, and above that an even chance for each known word and one
more that stands for all others.  A table of a restaurant is a customer of its parent.

All customers of a word, in whatever context, are in one block, so the seating of a word is sampled within a task: table
counts are drawn by Gibbs from their distribution given the customers and the parent's probability, first the contexts',
then their classes', these classes' parents', then the root's, some sweeps over.  What a draw needs from other words are
each restaurant's total tables.  Those of classes and above are 4161 numbers, which are summed over the blocks between
rounds and sent to all.  Those of words grow with the text: each belongs by its hash to one of as many parts as there
are blocks; blocks tell the parts their tables, the parts sum them and tell the blocks that have the context.  Strengths
s are drawn between rounds, too: by auxiliary variables, for the words' restaurants from a grid.  Discounts d come from
how many words have one and two customers.  A round goes on from the seating that the round before has left.  The
probability of a word is the mean over the last rounds' seatings, each with the totals of that same seating, so the
probabilities of all next words add up to one.  A word of over 512 customers and many tables in a
context is seated in runs, which gives too many tables.

Documents are worked on in chunks of some megabytes, which ask the blocks for the words and contexts that they hold; the
answers go back to the chunk.  Chunks, blocks and parts are files of the shared folder; what is shuffled are requests,
answers and totals.

Cases: a null or empty text is its end alone; without training documents all words are unknown and equally unlikely;
a null doc_id trains; repeated rows train and are scored as often as they occur; a very long text is a chunk of its
own, which a task holds; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evflow.llm.store import drop, new_path, open_file, remove, rename, stage
from evflow.llm.text import hash64, slices, split_words, text_view

PARENTS, CHILDREN = 64, 64
CONTEXTS = PARENTS * CHILDREN
#: Tasks that add up the blocks' totals before these come to the driver.
ADDERS = 16
#: Bits of a context's number below its class.
CLASS_SHIFT = 51
#: Bytes of text of a chunk; one longer text is a chunk alone.
CHUNK_BYTES = 8 << 20
#: Tokens whose pairs make a block, about; more text makes more blocks.
BLOCK_TOKENS = 4 << 20
#: Customers of a word in a context up to which table counts are drawn exactly.
EXACT = 512
_END = "\n"


class State(NamedTuple):
    """What all blocks share: restaurants' customers and tables, discounts and strengths by level, and vocabulary."""

    customers: tuple[np.ndarray, np.ndarray, np.ndarray]
    tables: tuple[np.ndarray, np.ndarray, np.ndarray]
    discount: tuple[float, float, float]
    strength: tuple[float, float, float]
    words: int


class Low(NamedTuple):
    """Discount and strength of the words' restaurants."""

    discount: float
    strength: float


def context_of(word: str) -> int:
    """Context class that a word gives to the next one."""
    raw = word.encode("utf-8", "surrogatepass").rstrip(b".,!?;:")
    tail = raw if len(raw) <= 4 else raw[-3:] + b"*"
    return zlib.crc32(raw[-1:]) % PARENTS * CHILDREN + zlib.crc32(tail) % CHILDREN


def held_out(doc: int | None, folds: int = 5) -> bool:
    """Whether a document is kept from training: crc32(doc_id as text) mod 5 is 1."""
    return doc is not None and zlib.crc32(str(doc).encode()) % folds == 1


def context_ids(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Each word's own restaurant: its class, then 51 bits of its hash, as a number of 63 bits."""
    return classes.astype(np.int64) << CLASS_SHIFT | (hashes.view(np.uint64) >> np.uint64(64 - CLASS_SHIFT)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: first the first byte of all numbers, then the second, which are more alike."""
    head = [len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), a.size))]
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays)
    raw = b"".join([np.array(head, np.int64).tobytes(), *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(data) -> list[np.ndarray]:
    """The arrays of ``pack``."""
    data = memoryview(data)
    raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 * (1 + 2 * n), []
    for kind, size in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(-1, 2).tolist():
        width = np.dtype(chr(kind)).itemsize
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(chr(kind)))
        at += size * width
    return out


def save(uri: str, *arrays: np.ndarray) -> None:
    """Write arrays to a file of the shared folder; a task that is run again writes the same.

    The file has a name of the attempt's own until it is whole, so one that is killed never leaves a part of it.
    """
    own = f"{uri}.{TaskContext.get().taskAttemptId()}"
    with open_file(own, "wb") as f:
        f.write(pack(*arrays))
    rename(own, uri)


def load(uri: str) -> list[np.ndarray]:
    with open_file(uri, "rb") as f:
        return unpack(f.read())


def rows(names: tuple[str, ...], found: list[tuple[int, int, bytes]]) -> pa.Table:
    """A table of two numbers and bytes."""
    columns = list(zip(*found, strict=True)) or [(), (), ()]
    return pa.table({names[0]: pa.array(columns[0], pa.int64()), names[1]: pa.array(columns[1], pa.int64()), "data": pa.array(columns[2], pa.binary())})


def in_turn(table: pa.Table, by: str) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """The rows' numbers in ascending order, and the arrays of each row."""
    turn = table[by].to_numpy()
    order = np.argsort(turn)
    return turn[order], [unpack(table["data"][int(k)].as_buffer()) for k in order]


def encode(docs: DataFrame, base: str) -> DataFrame:
    """A file for each chunk: its documents, their tokens as places in the chunk's words, each word's hash and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, limit=CHUNK_BYTES):
                words = split_words(part.column("text"))
                vocab = [*words.vocab, _END]
                lengths = (np.diff(words.offsets) + 1).astype(np.int32)
                tokens = np.insert(words.ids.astype(np.int32), words.offsets[1:], len(vocab) - 1)
                ids = part.column("doc_id").to_pylist()
                docs, known = np.array([i or 0 for i in ids], np.int64), np.array([i is not None for i in ids], bool)
                classes = np.fromiter(map(context_of, vocab), np.int16, len(vocab))
                save(f"{base}/chunk-{turn}", docs, known, lengths, tokens, hash64(vocab).view(np.int64), classes)
                yield pa.record_batch([pa.array([turn], pa.int64()), pa.array([len(tokens)], pa.int64())], names=["chunk", "tokens"])
                turn += 1

    return stage(docs.mapInArrow(run, "chunk long, tokens long"), "chunks")


class Pairs(NamedTuple):
    """Distinct (word, word before) pairs of a chunk, by block, and where each token finds its own."""

    order: np.ndarray  # words by block
    block: np.ndarray  # block of each of them
    rank: np.ndarray  # place of each word in ``order``
    word: np.ndarray  # of each pair, as place in ``order``
    before: np.ndarray  # of each pair, as place in the chunk's words
    back: np.ndarray  # pair of each token


def pairs_of(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, blocks: int) -> Pairs:
    """The pairs of a chunk, in an order that depends on the chunk alone."""
    block = (hashes.view(np.uint64) % np.uint64(blocks)).astype(np.int64)
    order = np.lexsort((hashes, block))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    before = np.empty(len(tokens), np.int64)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = len(hashes) - 1  # a text follows the end of another
    found, back = np.unique(rank[tokens] * len(hashes) + before, return_inverse=True)
    return Pairs(order, block[order], rank, found // len(hashes), found % len(hashes), back)


def requests(chunks: DataFrame, base: str, blocks: int) -> DataFrame:
    """What each chunk asks each block: words, how many words before each has, these, and their customers in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in (c for batch in batches for c in batch.column("chunk").to_pylist()):
            docs, known, lengths, tokens, hashes, classes = load(f"{base}/chunk-{chunk}")
            p = pairs_of(tokens, lengths, hashes, blocks)
            train = np.array([not (ok and held_out(d)) for d, ok in zip(docs.tolist(), known.tolist(), strict=True)], float)
            count = np.bincount(p.back, np.repeat(train, lengths), len(p.word)).astype(np.int32)
            sizes = np.bincount(p.word, minlength=len(p.order)).astype(np.int32)
            cut_w = np.searchsorted(p.block, np.arange(blocks + 1))
            cut_p = np.concatenate([[0], np.cumsum(sizes)])[cut_w]
            words, contexts = hashes[p.order], context_ids(hashes, classes)[p.before]
            for b in np.flatnonzero(np.diff(cut_w)).tolist():
                w, q = slice(cut_w[b], cut_w[b + 1]), slice(cut_p[b], cut_p[b + 1])
                ids, place = np.unique(contexts[q], return_inverse=True)
                yield rows(("block", "chunk"), [(b, chunk, pack(np.diff(words[w], prepend=0), sizes[w], np.diff(ids, prepend=0), place.astype(np.int32), count[q]))]).to_batches()[0]

    return chunks.repartition(blocks).mapInArrow(run, "block long, chunk long, data binary")


def blocks_of(asked: DataFrame, base: str, parts: int) -> DataFrame:
    """A file for each block: all requests, and the customers of its pairs; rows tell each part its contexts' customers.

    The distinct contexts of a block are in the order of their parts, and of their classes and hashes in each.
    """

    def gather(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        chunks, found = in_turn(table, "chunk")
        n_words, n_pairs = (np.array([len(f[k]) for f in found], np.int64) for k in (0, 3))
        contexts = np.concatenate([np.cumsum(f[2])[f[3]] for f in found])
        words = np.concatenate([np.cumsum(f[0]) for f in found])
        sizes, count = (np.concatenate([f[k] for f in found]) for k in (1, 4))
        del found
        vocab, word = np.unique(words, return_inverse=True)
        ids, context = np.unique(contexts, return_inverse=True)
        order = np.argsort(ids % parts, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        ids, context = ids[order], place[context]
        keys, back = np.unique(np.repeat(word, sizes) * len(ids) + context, return_inverse=True)
        total = np.bincount(back, count, len(keys)).astype(np.int64)
        save(f"{base}/block-{block}", chunks, n_words, n_pairs, word.astype(np.int32), back.astype(np.int32), np.diff(keys, prepend=0), total, (ids >> CLASS_SHIFT).astype(np.int16), np.bincount(ids % parts, minlength=parts), np.array([len(vocab)]))
        own = np.bincount(keys % len(ids), total, len(ids)).astype(np.int64)
        tables = np.bincount(keys % len(ids), total > 0, len(ids)).astype(np.int32)
        seating, *_ = block_of(base, block)
        cut = np.searchsorted(ids % parts, np.arange(parts + 1))
        told = [(k, block, pack(ids[cut[k] : cut[k + 1]], own[cut[k] : cut[k + 1]], tables[cut[k] : cut[k + 1]])) for k in np.flatnonzero(np.diff(cut)).tolist()]
        return rows(("part", "block"), [*told, (-1 - block % ADDERS, block, pack(seating.totals().ravel()))])

    return asked.repartition(parts, "block").groupBy("block").applyInArrow(gather, TOLD)


TOLD = "part long, block long, data binary"
HEARD = "block long, part long, data binary"


def contexts_of(told: DataFrame, base: str, parts: int, first: bool, discount: float) -> DataFrame:
    """Customers (the first time) and tables of each context over all blocks, sent back to those that have it.

    Rows of block -1 are the strength's log likelihood at each point of ``GRID``, summed over the part's contexts, those
    of block -2 the totals of the restaurants above, summed over some blocks.
    """

    def add(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        blocks, found = in_turn(table, "block")
        if part < 0:
            return rows(("block", "part"), [(-2, part, pack(sum(f[0] for f in found)))])
        tables = np.concatenate([f[-1] for f in found]).astype(np.int64)
        if first:
            cuts = np.concatenate([[0], np.cumsum([len(f[-1]) for f in found])])
            ids, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            customers = np.bincount(back, np.concatenate([f[1] for f in found]), len(ids)).astype(np.int64)
            save(f"{base}/part-{part}", cuts, back.astype(np.int32), customers)
        else:
            cuts, back, customers = load(f"{base}/part-{part}")
        total = np.bincount(back, tables, len(customers)).astype(np.int64)
        pairs, n = np.unique(np.stack([customers, total])[:, customers > 1], axis=1, return_counts=True)
        likely = np.array([(n * strength_log(s, discount, *pairs)).sum() for s in GRID])
        sent = [(b, part, pack(*([customers[back[i:j]]] if first else []), total[back[i:j]].astype(np.int32))) for b, i, j in zip(blocks.tolist(), cuts[:-1], cuts[1:], strict=True)]
        return rows(("block", "part"), [*sent, (-1, part, pack(likely))])

    return stage(told.repartition(parts, "part").groupBy("part").applyInArrow(add, HEARD), "contexts")


#: Strengths of the words' restaurants that are tried, and the log likelihood of one.
GRID = np.geomspace(1e-3, 1e4, 96)


def gammaln(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - sum(np.log(x + k) for k in range(8))


def strength_log(s: float, d: float, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Log likelihood of the strength of restaurants with these customers and tables."""
    return gammaln(s / d + tables) - gammaln(s / d + 1) - gammaln(s + customers) + gammaln(s + 1)


def summed(packed: DataFrame, size: int) -> np.ndarray:
    """Sum of packed arrays: one row a task is moved, 16 come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column("data"):
                total += unpack(x.as_buffer())[0]
        yield pa.record_batch([pa.array([pack(total)], pa.binary())], names=["data"])

    found = packed.select("data").mapInArrow(add, "data binary").repartition(ADDERS).mapInArrow(add, "data binary").collect()
    return np.sum([unpack(r[0])[0] for r in found], 0)


def low_strength(heard: DataFrame, seed: int) -> float:
    """Strength of the words' restaurants, drawn from its distribution on the grid."""
    log = summed(heard.where("block = -1"), len(GRID)) - GRID + np.log(GRID)
    p = np.exp(log - log.max())
    return float(np.random.default_rng([seed, 4]).choice(GRID, p=p / p.sum()))


@lru_cache(maxsize=8)
def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) for c and t up to ``EXACT``."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, EXACT):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - discount * t)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c + 1, 1 : c + 2], out[c, : c + 1])
    return out


def draw_tables(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Table counts of words with these customers; ``weight`` is what a new table has against a seat, for each.

    Counts t of c customers have S(c, t) * weight^t as their likelihood.  Beyond ``EXACT`` customers the last row of S
    serves, whose share of t moves with c by (1 - a / c^discount)^(t - 1) to the next order; where as many tables as
    ``EXACT``^discount are likely, that order is not enough, and customers are seated in runs.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    logs = stirling(round(discount, 6))
    log_weight = np.log(np.maximum(weight, 1e-300))

    def draw(rows: np.ndarray, c: int, bend: np.ndarray | None = None) -> None:
        t = np.arange(1, c + 1)
        for part in np.array_split(np.arange(len(rows)), max(1, len(rows) * c // 1_000_000)):
            if len(part):
                own = rows[part]
                slope = log_weight[own] if bend is None else log_weight[own] + bend[part]
                logp = logs[c, 1 : c + 1] + slope[:, None] * t
                p = np.cumsum(np.exp(logp - logp.max(1, keepdims=True)), 1)
                tables[own] = 1 + (p < rng.random((len(own), 1)) * p[:, -1:]).sum(1)

    small = np.where(customers > EXACT, 0, customers)
    order = np.argsort(small, kind="stable")
    cuts = np.searchsorted(small[order], np.arange(EXACT + 2))
    for c in np.flatnonzero(np.diff(cuts)).tolist():
        if c > 1:
            draw(order[cuts[c] : cuts[c + 1]], c)
    large = customers > EXACT
    few = weight <= discount * EXACT**discount
    rows = np.flatnonzero(large & few)
    a = math.gamma(-discount) / (2 * math.gamma(-2 * discount)) if len(rows) and 2 * discount != 1 else 0.0
    draw(rows, EXACT, np.log1p(-a * customers[rows].astype(float) ** -discount) - np.log1p(-a * EXACT**-discount))
    rest = np.flatnonzero(large & ~few)
    seated = np.minimum(customers[rest], 1)
    while len(rest):
        run = np.minimum(customers[rest] - seated, np.maximum(1, seated // 16))
        new = weight[rest] / (seated - discount * tables[rest] + weight[rest])
        tables[rest] += rng.binomial(run, np.clip(new, 0, 1))
        seated = seated + run
        more = seated < customers[rest]
        rest, seated = rest[more], seated[more]
    return tables


class Seating:
    """Customers and tables of one block's words in all restaurants."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, n_words: int):
        self.context = keys % CONTEXTS
        self.word = keys // CONTEXTS
        self.counts = counts
        self.upper, self.to_upper = np.unique(self.word * PARENTS + self.context // CHILDREN, return_inverse=True)
        self.parent, self.upper_word = self.upper % PARENTS, self.upper // PARENTS
        self.n_words = n_words
        self.tables = np.ones(len(keys), np.int64)
        self.upper_tables = np.ones(len(self.upper), np.int64)
        self.count_up()
        self.root_tables = (self.root > 0).astype(np.int64)

    def count_up(self) -> None:
        """A table below is a customer above."""
        self.upper_counts = np.bincount(self.to_upper, self.tables, len(self.upper)).astype(np.int64)
        self.root = np.bincount(self.upper_word, self.upper_tables, self.n_words).astype(np.int64)

    def root_p(self, s: State) -> np.ndarray:
        base = (s.strength[0] + s.discount[0] * s.tables[0][0]) / (s.words + 1)
        return (self.root - s.discount[0] * self.root_tables + base) / (s.strength[0] + s.customers[0][0])

    def upper_p(self, s: State, root: np.ndarray) -> np.ndarray:
        h = self.parent
        back = (s.strength[1] + s.discount[1] * s.tables[1][h]) * root[self.upper_word]
        return (self.upper_counts - s.discount[1] * self.upper_tables + back) / (s.strength[1] + s.customers[1][h])

    def context_p(self, s: State) -> np.ndarray:
        g = self.context
        back = (s.strength[2] + s.discount[2] * s.tables[2][g]) * self.upper_p(s, self.root_p(s))[self.to_upper]
        return (self.counts - s.discount[2] * self.tables + back) / (s.strength[2] + s.customers[2][g])

    def sweep(self, s: State, rng: np.random.Generator) -> None:
        """Draw all table counts anew, from the contexts up."""
        upper = self.upper_p(s, self.root_p(s))
        weight = (s.strength[2] + s.discount[2] * s.tables[2][self.context]) * upper[self.to_upper]
        self.tables = draw_tables(self.counts, weight, s.discount[2], rng)
        self.count_up()
        weight = (s.strength[1] + s.discount[1] * s.tables[1][self.parent]) * self.root_p(s)[self.upper_word]
        self.upper_tables = draw_tables(self.upper_counts, weight, s.discount[1], rng)
        self.count_up()
        weight = np.full(self.n_words, (s.strength[0] + s.discount[0] * s.tables[0][0]) / (s.words + 1))
        self.root_tables = draw_tables(self.root, weight, s.discount[0], rng)

    def totals(self) -> np.ndarray:
        """Customers, tables, and words with one and with two customers, of each restaurant, root first."""
        out = []
        for where, n, c, t in ((np.zeros(self.n_words, np.int64), 1, self.root, self.root_tables), (self.parent, PARENTS, self.upper_counts, self.upper_tables), (self.context, CONTEXTS, self.counts, self.tables)):
            out.append(np.stack([np.bincount(where, v, n).astype(np.int64) for v in (c, t, c == 1, c == 2)], 1))
        return np.concatenate(out)


class WordSeating:
    """Customers and tables of one block's words after each word before; a table is a customer of its class."""

    def __init__(self, word: np.ndarray, context: np.ndarray, counts: np.ndarray, classes: np.ndarray, n_words: int):
        self.word, self.context, self.counts = word, context, counts
        keys, self.to_class = np.unique(word * CONTEXTS + classes[context], return_inverse=True)
        self.tables = np.ones(len(word), np.int64)
        self.keys = keys
        self.above = Seating(keys, self.class_counts(), n_words)

    def class_counts(self) -> np.ndarray:
        return np.bincount(self.to_class, self.tables, len(self.keys)).astype(np.int64)

    def sweep(self, s: State, low: Low, total: np.ndarray, rng: np.random.Generator) -> None:
        """Draw all table counts anew; ``total`` is the tables of each context over all blocks."""
        weight = (low.strength + low.discount * total[self.context]) * self.above.context_p(s)[self.to_class]
        self.tables = draw_tables(self.counts, weight, low.discount, rng)
        self.above.counts = self.class_counts()
        self.above.sweep(s, rng)

    def drawn(self) -> list[np.ndarray]:
        """All table counts, for :meth:`restore`."""
        return [x.astype(np.int32) for x in (self.tables, self.above.tables, self.above.upper_tables, self.above.root_tables)]

    def restore(self, tables: np.ndarray, above: np.ndarray, upper: np.ndarray, root: np.ndarray) -> None:
        """Take back a seating."""
        self.tables, self.above.tables, self.above.upper_tables = (x.astype(np.int64) for x in (tables, above, upper))
        self.above.counts = self.class_counts()
        self.above.count_up()
        self.above.root_tables = root.astype(np.int64)

    def totals(self) -> np.ndarray:
        """Those of the restaurants above, and of all words' restaurants together."""
        own = [x.sum() for x in (self.counts, self.tables, self.counts == 1, self.counts == 2)]
        return np.concatenate([self.above.totals(), np.array([own], np.int64)])


def block_of(base: str, block: int) -> tuple[WordSeating, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's seating, its requests, the words and contexts of all asked pairs, its contexts' classes, and how many each part has."""
    *asked, keys, total, classes, sizes, n_words = load(f"{base}/block-{block}")
    keys = np.cumsum(keys)
    word, context, kept = keys // len(classes), keys % len(classes), total > 0
    classes = classes.astype(np.int64)
    return WordSeating(word[kept], context[kept], total[kept], classes, int(n_words[0])), asked, word, context, classes, sizes


def seat(heard: DataFrame, base: str, state: State, low: Low, parts: int, sweeps: int, turn: int, seed: int) -> DataFrame:
    """Each block's tables after some sweeps: rows for the parts of its contexts, and the totals of the restaurants above.

    The chain goes on from the seating of round ``turn``; the next one, and the totals heard of this one, are files.
    """

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        _, found = in_turn(table, "part")
        total = np.concatenate([f[-1] for f in found])
        seating, *_, classes, sizes = block_of(base, block)
        if turn:
            seating.restore(*load(f"{base}/tables-{turn}-{block}"))
            save(f"{base}/total-{turn}-{block}", total)
        else:
            save(f"{base}/customers-{block}", np.concatenate([f[0] for f in found]))
        rng = np.random.default_rng([seed, block])
        for _ in range(sweeps):
            seating.sweep(state, low, total, rng)
        save(f"{base}/tables-{turn + 1}-{block}", *seating.drawn())
        tables = np.bincount(seating.context, seating.tables, len(classes)).astype(np.int32)
        cut = np.concatenate([[0], np.cumsum(sizes)])
        told = [(k, block, pack(tables[cut[k] : cut[k + 1]])) for k in np.flatnonzero(sizes).tolist()]
        return rows(("part", "block"), [*told, (-1 - block % ADDERS, block, pack(seating.totals().ravel()))])

    return heard.where("block >= 0").repartition(parts, "block").groupBy("block").applyInArrow(run, TOLD)


def totals_of(heard: DataFrame) -> np.ndarray:
    """Totals of the restaurants of classes and above over all blocks; the last row is of all words' restaurants."""
    return summed(heard.where("block = -2"), 4 * (1 + PARENTS + CONTEXTS + 1)).astype(np.int64).reshape(-1, 4)


def next_state(totals: np.ndarray, before: State | None, seed: int) -> State:
    """The shared state from the totals; strengths are drawn by auxiliary variables given customers and tables."""
    levels = np.split(totals, [1, 1 + PARENTS])
    customers, tables = (tuple(x[:, k].copy() for x in levels) for k in (0, 1))
    ones, twos = (np.array([x[:, k].sum() for x in levels], float) for k in (2, 3))
    if before is None:
        discount = tuple(float(np.clip(a / max(1.0, a + 2 * b), 0.05, 0.95)) for a, b in zip(ones, twos, strict=True))
        return State(customers, tables, discount, (1.0, 1.0, 1.0), int(tables[0][0]))
    rng, strength = np.random.default_rng(seed), []
    for level in range(3):
        s, d, full = before.strength[level], before.discount[level], customers[level] > 1
        c, t = customers[level][full].astype(float), tables[level][full].astype(float)
        for _ in range(10):
            log_x = np.log(rng.beta(s + 1, np.maximum(c - 1, 1e-3)))
            seats = rng.poisson(np.maximum(0, s / d * np.log((s / d + t) / (s / d + 1)))).sum()
            s = float(rng.gamma(1 + seats, 1 / (1 - log_x.sum())))
            s = float(np.clip(s, 1e-3, 1e6))
        strength.append(s)
    return State(customers, tables, before.discount, tuple(strength), before.words)


ANSWER = "chunk long, block long, data binary"


def answers(heard: DataFrame, base: str, draws: list[tuple[int, State, Low]], parts: int) -> DataFrame:
    """For each request: log10 of the mean predictive probability of its pairs, and its words' training counts.

    ``draws`` are rounds with their state, in order; ``heard`` are the totals of the last.
    """

    def run(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        _, found = in_turn(table, "part")
        last = np.concatenate([f[-1] for f in found])
        seating, (chunks, n_words, n_pairs, asked, back), w, context, classes, _ = block_of(base, block)
        customers = load(f"{base}/customers-{block}")[0]
        above = seating.above
        g = classes[context]
        h = g // CHILDREN

        def find(have: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if not len(have):
                return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
            at = np.minimum(np.searchsorted(have, want), len(have) - 1)
            return at, have[at] == want

        at3, in3 = find(seating.word * len(classes) + seating.context, w * len(classes) + context)
        at2, in2 = find(seating.keys, w * CONTEXTS + g)
        at1, in1 = find(above.upper, w * PARENTS + h)

        def taken(values: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
            return np.where(there, values[at], 0) if len(values) else np.zeros(len(at))

        mean = np.zeros(len(w))
        for turn, s, low in draws:
            seating.restore(*load(f"{base}/tables-{turn}-{block}"))
            total = last if turn == draws[-1][0] else load(f"{base}/total-{turn}-{block}")[0]
            root = above.root_p(s)[w]
            p1 = (taken(above.upper_counts, at1, in1) - s.discount[1] * taken(above.upper_tables, at1, in1) + (s.strength[1] + s.discount[1] * s.tables[1][h]) * root) / (s.strength[1] + s.customers[1][h])
            p2 = (taken(above.counts, at2, in2) - s.discount[2] * taken(above.tables, at2, in2) + (s.strength[2] + s.discount[2] * s.tables[2][g]) * p1) / (s.strength[2] + s.customers[2][g])
            mean += (taken(seating.counts, at3, in3) - low.discount * taken(seating.tables, at3, in3) + (low.strength + low.discount * total[context]) * p2) / (low.strength + customers[context])
        logp = np.log10(np.maximum(mean / len(draws), 1e-300)).astype(np.float32)[back]
        known = np.bincount(seating.word, seating.counts, above.n_words).astype(np.int64)[asked]
        end_w, end_p = np.cumsum(n_words), np.cumsum(n_pairs)
        return rows(("chunk", "block"), [(c, block, pack(logp[j - m : j], known[i - n : i])) for c, i, n, j, m in zip(chunks.tolist(), end_w, n_words, end_p, n_pairs, strict=True)])

    return heard.where("block >= 0").repartition(parts, "block").groupBy("block").applyInArrow(run, ANSWER)


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, rounds: int = 3, sweeps: int = 3, samples: int = 2, seed: int = 1) -> DataFrame:
    """Learn from the documents that are not held out, and score all.

    ``rounds`` is how often the restaurants' totals are summed, ``sweeps`` the Gibbs sweeps in each, and ``samples`` the
    last rounds whose seatings are in the mean.
    """
    if not 1 <= samples <= rounds:
        raise ValueError("samples are rounds")
    base = new_path(docs.sparkSession, "pitman-yor")
    chunks = encode(text_view(docs), base)
    n_tokens = chunks.agg(F.sum("tokens")).first()[0] or 0
    n_blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // BLOCK_TOKENS))
    told = blocks_of(requests(chunks, base, n_blocks), base, n_blocks)
    heard = contexts_of(told, base, n_blocks, True, 0.5)
    totals = totals_of(heard)
    state, (trained, _, ones, twos) = next_state(totals[:-1], None, seed), totals[-1].tolist()
    low = Low(float(np.clip(ones / max(1.0, ones + 2 * twos), 0.05, 0.95)), 1.0)
    draws = []
    for k in range(rounds):
        told = seat(heard, base, state, low, n_blocks, sweeps, k, seed + k)
        before, heard = heard, contexts_of(told, base, n_blocks, False, low.discount)
        drop(before)
        state, low = next_state(totals_of(heard)[:-1], state, seed + k), low._replace(strength=low_strength(heard, seed + k))
        draws.append((k + 1, state, low))
    words = state.words

    def run(table: pa.Table) -> pa.Table:
        docs, known, lengths, tokens, hashes, _ = load(f"{base}/chunk-{table['chunk'][0].as_py()}")
        _, found = in_turn(table, "block")
        p = pairs_of(tokens, lengths, hashes, n_blocks)
        logp, count = (np.concatenate(x) for x in zip(*found, strict=True))
        logp, count = logp.astype(float), count[p.rank[tokens]]
        row = np.repeat(np.arange(len(lengths)), lengths)
        base_p = np.log10((count + 0.5) / (trained + 0.5 * (words + 1)))
        ids = [d if ok else None for d, ok in zip(docs.tolist(), known.tolist(), strict=True)]
        n = len(ids)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64()),
                "held_out": pa.array([held_out(d) for d in ids], pa.bool_()),
                "n_tokens": pa.array(lengths.astype(np.int64)),
                "n_known": pa.array(np.bincount(row, count > 0, n).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, trained, np.int64)),
                "base_score": pa.array(np.bincount(row, base_p, n)),
                "score": pa.array(np.bincount(row, logp[p.back], n)),
            }
        )

    scored = stage(answers(heard, base, draws[-samples:], n_blocks).groupBy("chunk").applyInArrow(run, SCORE), "scored")
    for table in (heard, chunks):
        drop(table)
    remove(base)
    return scored


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document, with its add-half score beside."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
