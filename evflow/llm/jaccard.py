"""Exact near-duplicate classes at a Jaccard similarity of word shingles, by a size-aware heavy-light join.

Two sets of sizes a and b are linked when 7 * overlap >= 3 * (a + b) (similarity 0.75).

* Light sets (up to ``boundary`` shingles): linked sets of sizes a <= b share a subset of ceil(0.75 * b) shingles, so each
  light set enumerates its subsets of every such size, and equal subsets meet.
* Heavy sets: in one order of all shingles, rare ones first, linked sets share one of their first n - ceil(0.75 * n) + 1
  shingles.  These are posted to inverted lists (light sets that a heavy one can be linked to are posted, too), and the
  lists are scanned.
* The boundary is where enumerating subsets of the sets of a size stops being cheaper than scanning their lists, both
  estimated on a sample.  The sample also tells which shingles are frequent: that orders the lists and changes no result.

Sets with equal shingles are one node.  Within a list, the node with the least share of rare shingles (an original
rather than a changed copy) is verified with each other one, and linked nodes are joined to components; then the pairs in
a list whose nodes are not yet in one component are verified, if they share as many lists as linked sets must and, in
long lists, if bitmaps of their shingles leave room for it.  So a large group of copies costs one check a copy and no
link between components is lost.  Shingles and sets are known by 64-bit hashes.

Cases: a null text, or one without words, has the empty set and is its own class; fewer than five words are one shingle;
repeated rows are one class; rows of one doc_id with different texts are linked as their texts are; a null doc_id is
kept in its class, links others through it and never names a class, unless all its rows lack one; a very long text is
one row, whose set a task holds; an empty table gives no row; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evflow.llm.components import components
from evflow.llm.store import stage
from evflow.llm.text import hash64, rows_of, slices, split_words, text_view

#: Words of a shingle.
WORDS = 5
#: One of so many documents tells which shingles are frequent, and the sizes of small sets.
SAMPLE = 16
#: Frequent shingles that are told to every executor at most (8 bytes each).
MAX_FREQUENT = 200_000
#: Largest size for which subsets are ever enumerated.
MAX_LIGHT = 12
#: Bytes of text whose postings make a block, at most, about; more text makes more blocks.
BLOCK_BYTES = 64 << 20
#: Bits of a set's bitmap; sets of more shingles have none.
BITS = 512
#: Lists of more nodes compare bitmaps first.
LONG_LIST = 64
#: Postings that a task gathers before it hands them on.
LOT = 1_500_000
#: Up to so many documents to be verified (8 bytes each), their ids go to every executor; beyond that, a shuffle join.
BROADCAST_IDS = 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Ascending distinct hashes of each text's shingles."""
    words = split_words(texts)
    if not len(words.ids):
        return [np.zeros(0, np.uint64)] * len(texts)
    h = hash64(words.vocab)[words.ids]
    size = np.diff(words.offsets)
    n = max(0, len(h) - WORDS + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(WORDS):
        rolled = (rolled ^ h[k : k + n]) * _MIX
        rolled ^= rolled >> np.uint64(31)
    out = []
    for start, count in zip(words.offsets[:-1].tolist(), size.tolist(), strict=True):
        if count >= WORDS:
            out.append(np.unique(rolled[start : start + count - WORDS + 1]))
        elif count:
            out.append(np.array([xxhash.xxh64_intdigest(h[start : start + count].tobytes(), seed=count)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def prefix_size(n: int) -> int:
    """How many of a set's first shingles a linked set must share one of."""
    return n - -(-3 * n // 4) + 1


def subset_sizes(n: int) -> list[int]:
    """Sizes of the subsets that a light set enumerates."""
    return sorted({-(-3 * b // 4) for b in range(n, 4 * n // 3 + 1) if -(-3 * b // 4) <= n})


def subsets(shingles: np.ndarray) -> np.ndarray:
    """Hashes of the subsets of a light set; ``shingles`` ascends."""
    found = [xxhash.xxh64_intdigest(np.array(c, np.uint64).tobytes(), seed=k + 7919) for k in subset_sizes(len(shingles)) for c in combinations(shingles.tolist(), k)]
    return np.array(found, np.uint64)


def sample_facts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Frequent shingles (ascending) with their sampled counts, the boundary of light sets, and the number of blocks."""
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("text")
    size = SAMPLE * (part.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                if not len(flat):
                    continue
                sizes = np.repeat([min(len(s), MAX_LIGHT + 1) for s in sets], [len(s) for s in sets])
                block = (flat % np.uint64(blocks)).astype(np.int32)
                order = np.argsort(block, kind="stable")
                cuts = np.searchsorted(block[order], np.arange(blocks + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(v[order])) for v in (flat.view(np.int64), sizes.astype(np.int32))]
                yield pa.record_batch([pa.array(np.arange(blocks, dtype=np.int32)), *lists], names=["block", "hashes", "sizes"])

    def count(table: pa.Table) -> pa.Table:
        h = table["hashes"].combine_chunks().flatten().to_numpy()
        s = table["sizes"].combine_chunks().flatten().to_numpy()
        values, back, n = np.unique(h, return_inverse=True, return_counts=True)
        often = n >= 3
        small = s <= MAX_LIGHT
        scanned = np.bincount(s[small], n[back][small], MAX_LIGHT + 1)
        posted = np.bincount(s[small], minlength=MAX_LIGHT + 1)
        key = np.concatenate([values[often], np.arange(MAX_LIGHT + 1)])
        value = np.concatenate([n[often], scanned]).astype(np.int64)
        posts = np.concatenate([np.full(often.sum(), -1), posted]).astype(np.int64)
        return pa.table({"key": key, "value": value, "posts": posts})

    posted = part.mapInArrow(post, "block int, hashes array<long>, sizes array<int>")
    facts = stage(posted.groupBy("block").applyInArrow(count, "key long, value long, posts long"), "shingle-sample")
    frequent = facts.where("posts < 0").orderBy(F.desc("value"), "key").limit(MAX_FREQUENT).collect()
    small = {r[0]: (r[1], r[2]) for r in facts.where("posts >= 0").groupBy("key").agg(F.sum("value"), F.sum("posts")).collect()}
    best, boundary, saved = 0.0, 0, 0.0
    for n in range(1, MAX_LIGHT + 1):
        scanned, posts = small.get(n, (0, 0))
        sets = posts / n
        enumerated = sets * sum(comb(n, k) for k in subset_sizes(n))
        saved += sets * prefix_size(n) * (1 + SAMPLE * scanned / max(1, posts)) - enumerated
        if saved >= best:
            best, boundary = saved, n
    keys, seen = (np.array([r[k] for r in frequent], np.int64) for k in (0, 1))
    order = np.argsort(keys.view(np.uint64))
    return keys.view(np.uint64)[order], seen[order], boundary, blocks


def first_shingles(shingles: np.ndarray, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles of a set in the order of all: by sampled count, then by hash; and its share of rare ones in 1024ths."""
    n = prefix_size(len(shingles))
    if len(frequent):
        place = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rank = np.where(frequent[place] == shingles, counts[place], 0)
        if rank.any():
            return shingles[np.argsort(rank, kind="stable")[:n]], 1024 * int((rank == 0).sum()) // len(shingles)
    return shingles[:n], 1024


def bitmap(shingles: np.ndarray) -> bytes | None:
    """A bit for each shingle by its hash: sets whose bitmaps differ in d bits share at most (a + b - d) / 2 shingles."""
    if len(shingles) > BITS:
        return None
    bits = np.zeros(BITS, bool)
    bits[(shingles % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


LISTS = "block int, docs array<long>, known array<boolean>, signs array<binary>, hashes array<long>, nodes array<long>, sizes array<int>, places array<int>, leads array<short>"


def postings(docs: DataFrame, frequent: np.ndarray, counts: np.ndarray, boundary: int, blocks: int) -> DataFrame:
    """Lists by block: postings (hash, node, size, place) in blocks from 0, documents (id, node, size) in those below.

    The place of a subset of a light set is -1.  A task posts a set once in each lot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        posts: list[tuple[np.ndarray, int, int, np.ndarray, int]] = []
        rows: list[tuple[int | None, int, int, bytes | None]] = []
        turn = held = 0

        def lists(values: np.ndarray, cuts: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(cuts), pa.array(values, kind))

        def flush() -> pa.RecordBatch:
            nonlocal turn
            lengths = [len(p[0]) for p in posts]
            h = np.concatenate([p[0] for p in posts]) if posts else np.zeros(0, np.uint64)
            node = np.repeat(np.array([p[1] for p in posts], np.int64), lengths)
            size = np.repeat(np.array([p[2] for p in posts], np.int32), lengths)
            place = np.concatenate([p[3] for p in posts]) if posts else np.zeros(0, np.int32)
            lead = np.repeat(np.array([p[4] for p in posts], np.int16), lengths)
            block = (h % np.uint64(blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            cuts = np.concatenate([[0, 0], np.searchsorted(block[order], np.arange(1, blocks + 1))]).astype(np.int32)
            none = np.full(blocks + 2, len(rows), np.int32)
            none[0] = 0
            ids = pa.array([r[0] or 0 for r in rows], pa.int64())
            known = pa.array([r[0] is not None for r in rows], pa.bool_())
            own_nodes, own_sizes = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int32)
            wide = cuts + len(rows)
            wide[0] = 0
            turn += 1
            return pa.record_batch(
                [
                    pa.array(np.concatenate([[-turn % blocks - blocks], np.arange(blocks)]).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(none), ids),
                    pa.ListArray.from_arrays(pa.array(none), known),
                    pa.ListArray.from_arrays(pa.array(none), pa.array([r[3] for r in rows], pa.binary())),
                    lists(h[order].view(np.int64), cuts, pa.int64()),
                    lists(np.concatenate([own_nodes, node[order]]), wide, pa.int64()),
                    lists(np.concatenate([own_sizes, size[order]]), wide, pa.int32()),
                    lists(place[order], cuts, pa.int32()),
                    lists(lead[order], cuts, pa.int16()),
                ],
                names=["block", "docs", "known", "signs", "hashes", "nodes", "sizes", "places", "leads"],
            )

        for batch in batches:
            for part in slices(batch):
                for doc, shingles in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text")), strict=True):
                    n = len(shingles)
                    node = node_of(shingles)
                    rows.append((doc, node, n, bitmap(shingles) if n else None))
                    if n and node not in seen:
                        seen.add(node)
                        if n <= boundary:
                            found = subsets(shingles)
                            posts.append((found, node, n, np.full(len(found), -1, np.int32), 0))
                            held += len(found)
                        if 4 * n > 3 * boundary:
                            found, rare = first_shingles(shingles, frequent, counts)
                            posts.append((found, node, n, np.arange(len(found), dtype=np.int32), rare))
                            held += len(found)
                if held >= LOT or len(rows) >= LOT:
                    yield flush()
                    seen.clear()
                    posts.clear()
                    rows.clear()
                    held = 0
        if rows:
            yield flush()

    return docs.mapInArrow(run, LISTS)


def shared_lists(posted: DataFrame, boundary: int) -> DataFrame:
    """The lists that more than one node is in, of which one is heavy or all are by subset; documents pass through."""

    def gather(table: pa.Table) -> pa.Table:
        def flat(name: str) -> np.ndarray:
            return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)

        block = table["block"][0].as_py()
        h, node, size, place, lead = (flat(c) for c in ("hashes", "nodes", "sizes", "places", "leads"))
        run = np.zeros(0, np.int32)
        if block >= 0:
            order = np.argsort(h, kind="stable")
            again = np.zeros(len(h), bool)
            same = h[order][1:] == h[order][:-1]
            again[1:] |= same
            again[:-1] |= same
            kept = order[again]
            kept = kept[np.lexsort((node[kept], h[kept]))]
            new = np.ones(len(kept), bool)
            new[1:] = (h[kept][1:] != h[kept][:-1]) | (node[kept][1:] != node[kept][:-1])
            kept = kept[new]
            starts = np.flatnonzero(np.append(True, h[kept][1:] != h[kept][:-1])) if len(kept) else np.zeros(0, np.int64)
            lengths = np.diff(np.append(starts, len(kept)))
            heavy = np.maximum.reduceat(size[kept], starts) > boundary if len(kept) else np.zeros(0, bool)
            subset = place[kept][starts] < 0
            good = np.repeat((lengths > 1) & (heavy | subset), lengths)
            run = np.repeat(np.arange(len(starts), dtype=np.int32), lengths)[good]
            kept = kept[good]
            node, size, place, lead = node[kept], size[kept], place[kept], lead[kept]

        def one(values: np.ndarray, kind: pa.DataType) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.array([0, len(values)], np.int32)), pa.array(values, kind))

        signs = table["signs"].combine_chunks().flatten()
        signs = pa.ListArray.from_arrays(pa.array([0, len(signs)], pa.int32()), signs)
        return pa.table({"block": pa.array([block], pa.int32()), "docs": one(flat("docs"), pa.int64()), "known": one(flat("known").astype(bool), pa.bool_()), "signs": signs, "runs": one(run, pa.int32()), "nodes": one(node, pa.int64()), "sizes": one(size, pa.int32()), "places": one(place, pa.int32()), "leads": one(lead, pa.int16())})

    kind = "block int, docs array<long>, known array<boolean>, signs array<binary>, runs array<int>, nodes array<long>, sizes array<int>, places array<int>, leads array<short>"
    return posted.groupBy("block").applyInArrow(gather, kind)


#: How much a list of equal subsets counts for a pair: it needs no other.
SURE = 1 << 20


def enough(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets of sizes a and b that share enough first shingles (n of them) to be linked.

    Of two sets, the one whose first shingles end earlier in the order of all has its other common shingles among its
    own later ones, ceil(0.75 * size) - 1 of them; so the overlap is at most n and the larger of both such numbers.
    """
    bound = F.expr("ceil(3 * (a + b) / 7) - greatest(ceil(3 * a / 4), ceil(3 * b / 4)) + 1")
    return pairs.groupBy("u", "v", "a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= bound).select("u", "v")


def central_pairs(shared: DataFrame) -> DataFrame:
    """In each list, the node with the least share of rare shingles, with every other one that it may link to.

    Of a group of changed copies that is the least changed one, the same in most of their lists.  Pairs that share too
    few lists in this way are left to :func:`crossing_pairs`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                run, node, size, place, rare = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("runs", "nodes", "sizes", "places", "leads"))
                if not len(run):
                    continue
                size = size.astype(np.int64)
                lead = np.lexsort((node, rare, run))
                starts = np.flatnonzero(np.append(True, run[lead][1:] != run[lead][:-1]))
                lengths = np.diff(np.append(starts, len(run)))
                hub = np.repeat(lead[starts], lengths)
                fits = (hub != lead) & (4 * np.minimum(size[hub], size[lead]) >= 3 * np.maximum(size[hub], size[lead]))
                hub, other = hub[fits], lead[fits]
                first = np.where(node[hub] < node[other], hub, other)
                second = np.where(node[hub] < node[other], other, hub)
                order = np.lexsort((node[second], node[first]))
                first, second = first[order], second[order]
                if not len(order):
                    continue
                starts = np.flatnonzero(np.append(True, (node[first][1:] != node[first][:-1]) | (node[second][1:] != node[second][:-1])))
                n = np.add.reduceat(np.where(place[first] < 0, SURE, 1), starts)
                first, second = first[starts], second[starts]
                yield pa.record_batch([pa.array(v) for v in (node[first], node[second], size[first], size[second], n)], names=["u", "v", "a", "b", "n"])

    kind = "u long, v long, a long, b long, n long"
    return enough(shared.where("block >= 0").select("runs", "nodes", "sizes", "places", "leads").mapInArrow(run, kind))


#: Nodes of a cell's side; longer lists are cut into cells.
PART = 1024
#: Comparisons that a task makes at a time.
COMPARED = 500_000


def summed(pairs: np.ndarray) -> np.ndarray:
    """Columns (u, v, n, share) with n summed over equal pairs."""
    order = np.lexsort((pairs[1], pairs[0]))
    pairs = pairs[:, order]
    if not len(order):
        return pairs
    starts = np.flatnonzero(np.append(True, (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])))
    return np.stack([pairs[0, starts], pairs[1, starts], np.add.reduceat(pairs[2], starts), pairs[3, starts]])


def open_lists(posts: DataFrame) -> DataFrame:
    """The postings of lists of several components, with the one that most nodes are in and how many sides a list has.

    ``m`` is the number of sides for the nodes of that component, ``r`` that for the rest.  Lists are counted by two
    aggregates: no task holds a whole list.
    """
    counts = posts.groupBy("list", "component").agg(F.count(F.lit(1)).alias("n"))
    facts = counts.groupBy("list").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.max("n").alias("main"), F.sum("n").alias("n"))
    sides = lambda n: F.when(n > PART, F.pow(F.lit(2.0), F.ceil(F.log2(n / PART)))).otherwise(1).cast("int")
    facts = stage(facts.where("main < n").select("list", "most", F.col("n").alias("in_list"), sides(F.col("main")).alias("m"), sides(F.col("n") - F.col("main")).alias("r")), "list-facts")
    return posts.join(facts.hint("shuffle_hash"), "list")


def cells(posts: DataFrame, signs: DataFrame) -> DataFrame:
    """Cells (lead, a, b) of nodes to be compared: those of a with those of b, or with each other where b is null.

    In each list, the nodes of the component that most of its nodes are in need no comparison with each other.  They
    and the rest are dealt to as many sides, by the hash of the node, as ``PART`` asks for; each side of the rest meets
    itself, every other side of the rest and every side of the others.
    """
    short, long = posts.where(F.col("in_list") <= LONG_LIST), posts.where(F.col("in_list") > LONG_LIST)
    marked = short.withColumn("sign", F.lit(None).cast("binary")).unionByName(long.join(signs.hint("shuffle_hash"), "node"))
    dealt = marked.withColumn("rest", F.col("component") != F.col("most"))
    dealt = dealt.withColumn("side", F.pmod(F.col("node"), F.when(F.col("rest"), F.col("r")).otherwise(F.col("m"))).cast("int"))
    one = lambda kind, i, j, at: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(at).alias("at"))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    k = F.col("side")
    own = F.transform(every(F.col("r")), lambda x: F.when(x < k, one(0, x, k, 1)).otherwise(one(0, k, x, 0)))
    across = F.transform(every(F.col("m")), lambda x: one(1, k, x, 0))
    met = F.transform(every(F.col("r")), lambda x: one(1, x, k, 1))
    placed = dealt.withColumn("cell", F.explode(F.when(F.col("rest"), F.concat(own, across)).otherwise(met))).select("list", "cell.*", F.struct("node", "size", "place", "component", "sign").alias("x"))
    first, second = F.collect_list(F.when(F.col("at") == 0, F.col("x"))), F.collect_list(F.when(F.col("at") == 1, F.col("x")))
    found = placed.groupBy("list", "kind", "i", "j").agg(F.min("x.node").alias("lead"), first.alias("a"), second.alias("b"))
    alone = (F.col("kind") == 0) & (F.col("i") == F.col("j"))
    kept = found.where(F.when(alone, F.size("a") > 1).otherwise((F.size("a") > 0) & (F.size("b") > 0)))
    return kept.select("lead", "a", F.when(~alone, F.col("b")).alias("b"))


def met_pairs(posts: DataFrame, signs: DataFrame, parts: int) -> DataFrame:
    """Pairs (u, v) of different components that meet in as many lists as linked sets do.

    Of sets of sizes x <= y, only the first x - ceil(0.75 y) + 1 and y - ceil(0.75 y) + 1 shingles count here; as in
    :func:`enough`, linked sets share as many of those as their least overlap exceeds ceil(0.75 y) - 1.  Pairs are
    summed within each task, then by the hash of u.
    """
    rows = cells(posts, signs)
    fields = [F.col(f"{side}.{f}").alias(f"{side}_{f}") for side in "ab" for f in ("node", "size", "place", "component", "sign")]
    names = [f"{side}_{f}" for side in "ab" for f in ("node", "size", "place", "component")]

    def words(signs: pa.Array) -> np.ndarray:
        """The bitmaps as rows of 64-bit numbers, of ones where there is none."""
        out = np.full((len(signs), BITS // 64), ~np.uint64(0))
        there = signs.is_valid().to_numpy(zero_copy_only=False)
        kept = signs.drop_null().cast(pa.binary(BITS // 8))
        out[there] = np.frombuffer(kept.buffers()[1], np.uint64)[kept.offset * BITS // 64 :][: len(kept) * BITS // 64].reshape(-1, BITS // 64) if len(kept) else 0
        return out

    def compare(flat: dict[str, np.ndarray], bits: np.ndarray, known: np.ndarray, at_a: np.ndarray, n_a: np.ndarray, at_b: np.ndarray, n_b: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Pairs of the nodes ``at_a``, ``n_a`` with those ``at_b``, ``n_b`` that a list may link; ``own`` are the same ones."""
        node, size, place, component = (flat[f] for f in ("node", "size", "place", "component"))
        n = n_a * n_b
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        i, j = at_a[row] + k // n_b[row], at_b[row] + k % n_b[row]
        kept = (component[i] != component[j]) & (~own[row] | (node[i] < node[j]))
        i, j = i[kept], j[kept]
        x, y = size[i], size[j]
        more = -(-3 * np.maximum(x, y) // 4)
        kept = (4 * np.minimum(x, y) >= 3 * np.maximum(x, y)) & (place[i] <= x - more) & (place[j] <= y - more)
        i, j, more = i[kept], j[kept], more[kept]
        need = -(-3 * (size[i] + size[j]) // 7)
        differ = np.zeros(len(i), np.int64)
        for w in bits.T if known.any() else ():
            differ += np.bitwise_count(w[i] ^ w[j])
        kept = ~(known[i] & known[j]) | (size[i] + size[j] - differ >= 2 * need)
        i, j = i[kept], j[kept]
        return summed(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), np.where(place[i] < 0, SURE, 1), (need - more + 1)[kept]]))

    def units(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """The batch's pairs, some comparisons at a time; a cell of more is taken in parts of its first side."""
        columns = {n: batch.column(n) for n in names}
        length = {side: columns[f"{side}_node"].value_lengths().fill_null(0).to_numpy().astype(np.int64) for side in "ab"}
        flat = {f: np.concatenate([columns[f"{side}_{f}"].flatten().to_numpy() for side in "ab"]) for f in ("node", "size", "place", "component")}
        signs = [batch.column(f"{side}_sign").flatten() for side in "ab"]
        bits = np.concatenate([words(s) for s in signs])
        known = np.concatenate([s.is_valid().to_numpy(zero_copy_only=False) for s in signs])
        own = length["b"] == 0
        at_a = np.cumsum(length["a"]) - length["a"]
        at_b = np.where(own, at_a, int(length["a"].sum()) + np.cumsum(length["b"]) - length["b"])
        n_b = np.where(own, length["a"], length["b"])
        step = np.maximum(1, COMPARED // np.maximum(1, n_b))
        cut = np.maximum(1, -(-length["a"] // step))
        row = np.repeat(np.arange(len(cut)), cut)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(cut) - cut, cut)
        at_a, n_a = at_a[row] + turn * step[row], np.minimum(step[row], length["a"][row] - turn * step[row])
        at_b, n_b, own = at_b[row], n_b[row], own[row]
        weight, start = np.cumsum(n_a * n_b), 0
        while start < len(row):
            stop = max(start + 1, int(np.searchsorted(weight, (weight[start - 1] if start else 0) + COMPARED, "right")))
            yield compare(flat, bits, known, at_a[start:stop], n_a[start:stop], at_b[start:stop], n_b[start:stop], own[start:stop])
            start = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[np.ndarray]) -> pa.RecordBatch:
            pairs = summed(np.concatenate(found, 1))
            part = (pairs[0].view(np.uint64) * _MIX >> np.uint64(33)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(row[order])) for row in pairs]
            return pa.record_batch([pa.array(np.arange(parts, dtype=np.int32)), *lists], names=["part", "u", "v", "n", "share"])

        found, held = [], 0
        for batch in batches:
            for pairs in units(batch):
                found.append(pairs)
                held += pairs.shape[1]
                if held > LOT // 2:
                    yield emit(found)
                    found, held = [], 0
        if held:
            yield emit(found)

    def once(table: pa.Table) -> pa.Table:
        pairs = summed(np.stack([table[c].combine_chunks().flatten().to_numpy() for c in ("u", "v", "n", "share")]))
        pairs = pairs[:, pairs[2] >= pairs[3]]
        return pa.table({"u": pairs[0], "v": pairs[1]})

    near = rows.repartition(parts, "lead").select(*fields)
    kind = "part int, u array<long>, v array<long>, n array<long>, share array<long>"
    return near.mapInArrow(run, kind).groupBy("part").applyInArrow(once, "u long, v long")


def crossing_pairs(shared: DataFrame, groups: DataFrame, signs: DataFrame) -> DataFrame:
    """All pairs (u, v) that may be linked and are in different components."""
    parts = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posts = shared.where("block >= 0").select("block", F.explode(F.arrays_zip("runs", "nodes", "sizes", "places")).alias("p"))
    posts = posts.select((F.col("block") * (1 << 32) + F.col("p.runs")).alias("list"), F.col("p.nodes").alias("node"), F.col("p.sizes").cast("long").alias("size"), F.col("p.places").cast("long").alias("place"))
    grouped = posts.join(groups.hint("shuffle_hash"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = stage(grouped, "postings")
    return met_pairs(stage(open_lists(grouped), "open-postings"), signs, parts)


def node_of(shingles: np.ndarray) -> int:
    """The hash that a set is known by."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), seed=len(shingles) & 0xFFFF) - (1 << 63) if len(shingles) else 0


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs of nodes whose sets are linked; the sets are made again from the documents of one id of each node.

    That id finds the texts, without an id those of all rows without one; which of them have the set tells its hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(part.column("text"))
                offsets = np.cumsum([0, *map(len, sets)])
                yield pa.record_batch([pa.array(list(map(node_of, sets)), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "shingles"])

    wanted = stage(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes.hint("shuffle_hash"), "node").select("node", "doc_id"), "wanted")
    ids = wanted.select("doc_id").distinct()
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    made = texts.select("text").mapInArrow(run, "node long, shingles array<long>")
    sets = stage(made.join(wanted.select("node").hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"]), "sets")
    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")).hint("shuffle_hash"), "u")
    both = one.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")).hint("shuffle_hash"), "v")
    return both.where("7 * size(array_intersect(a, b)) >= 3 * (size(a) + size(b))").select("u", "v")


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), node and component of every row.

    ``node`` is the hash of the row's set, ``component`` one of the class; both are null where the set is empty.
    """
    docs = text_view(docs)
    frequent, counts, boundary, blocks = sample_facts(docs)
    shared = stage(shared_lists(postings(docs, frequent, counts, boundary, blocks), boundary), "lists")
    each = shared.where("block < 0").select(F.explode(F.arrays_zip("docs", "known", "signs", "nodes", "sizes")).alias("d"))
    signed = each.select(F.when(F.col("d.known"), F.col("d.docs")).alias("doc_id"), F.when(F.col("d.sizes") > 0, F.col("d.nodes")).alias("node"), F.col("d.sizes").cast("long").alias("n_shingles"), F.col("d.signs").alias("sign"))
    rows = signed.drop("sign")
    nodes = stage(signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("sign").alias("sign")), "nodes")
    links = stage(verified(stage(central_pairs(shared), "pairs"), docs, nodes), "links")
    groups = components(links)
    more = stage(crossing_pairs(shared, groups, nodes.select("node", "sign")), "pairs")
    if more.limit(1).count():
        later = stage(verified(more, docs, nodes), "links")
        if later.limit(1).count():
            groups = components(later.unionByName(groups.select(F.col("node").alias("u"), F.col("component").alias("v"))).where("u <> v"))
    named = nodes.join(groups.hint("shuffle_hash"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stage(named.join(least.hint("shuffle_hash"), "component").select("node", "component", "component_id"), "classes")
    found = rows.join(named.hint("shuffle_hash"), "node", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "node", "component")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of ``docs``."""
    return labelled(docs).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each class, with all its columns: of the smallest doc_id, rows without one last.

    Rows whose set is empty all stay.  Where an id stands once, it tells the row; rows of repeated ids and without one
    are told by their sets' hashes, and of those with the same id and set the one of the least text stays.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([node_of(x) or None for x in shingle_sets(part.column("text"))], pa.int64())], names=[*part.schema.names, name])

    name = "_node"
    while name in docs.columns:
        name += "_"
    found = stage(labelled(docs).select("doc_id", "node", "component"), "classes")
    best = found.where("node is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("x")).select("x.doc_id", "x.node")
    kept = stage(best.unionByName(found.where("node is null").select("doc_id", "node")), "kept")
    odd = stage(found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select("doc_id"), "odd-ids")

    def those(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
        few = ids.count() <= BROADCAST_IDS
        return rows.join(F.broadcast(ids) if few else ids.hint("shuffle_hash"), rows["doc_id"].cast("long").eqNullSafe(ids["doc_id"]), how)

    if not odd.limit(1).count():
        return those(docs, kept.select("doc_id"), "left_semi")
    plain = those(those(docs, odd, "left_anti"), kept.select("doc_id"), "left_semi")
    rest = those(docs, odd, "left_semi").mapInArrow(hashed, StructType([*docs.schema.fields, StructField(name, LongType())]))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    chosen = rest.where(F.col(name).isNotNull()).groupBy("doc_id", name).agg(F.min_by(whole, F.col("text")).alias("x"))
    own = kept.select(F.col("doc_id").alias("k"), F.col("node").alias("n")).hint("shuffle_hash")
    chosen = chosen.join(own, chosen["doc_id"].cast("long").eqNullSafe(own["k"]) & (chosen[name] == own["n"]), "left_semi").select("x.*")
    return plain.unionByName(chosen).unionByName(rest.where(F.col(name).isNull()).select(*docs.columns))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * o >= 75 * (x.n + y.n - o)
), r AS (
  SELECT doc_id AS d, doc_id AS t FROM documents
  UNION
  SELECT l.v, r.t FROM r JOIN l ON l.u = r.d
)
SELECT r.d AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.t) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.d GROUP BY r.d
"""
