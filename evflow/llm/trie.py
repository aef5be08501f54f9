"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt to shards of neighbouring ids.  A shard indexes (position, turn) to the bitset of its
conversations that have that turn there, and walks depth first: a child's bitset is its parent's, intersected with the
posting of one of the members' next turns; the popcount counts members, and members of just that length are its ends.
Shards then meet by node, a row a shard and node at most, so a turn that all conversations share is as many rows as
there are shards.  The lists of ends come in order of shards and are hashed as they pass, whatever their length.

Sums over subtrees need no walk over the whole trie.  A node belongs to its smallest member, who then has all nodes
below on its own path; so a sum over the distinct nodes of a subtree is a sum over members, which shards can add up
alone: each shard counts the nodes whose owner it has, and the shards' sums are the whole.

Cases: rows without conv_id are left out; a null role or text counts as empty; turns are in order of ``turn``, null
first, then of role and text; equal rows are turns of their own; an empty table gives no node; other columns are left
out.  A shard holds up to ``SHARD`` conversations or ``TURNS`` turns, or else one longer conversation's turns (a digest
of 16 bytes each).  Turns and nodes are known by 128 bits of SHA-256 and BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evflow.llm.store import stage

#: Conversations, and turns, from which a shard is full.
SHARD, TURNS = 4096, 1 << 18
ROOT = bytes(16)
_WORD = r"[^\x20\x09-\x0D]+"
_NODES = pa.schema([("shard", pa.int64()), ("place", pa.int64()), ("above", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("n_ends", pa.int64()), ("ends", pa.string())])


def encode(conversations: DataFrame) -> DataFrame:
    """conv_id, d (place of the turn from 1 on), digest of role and text, and words of the text."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")}
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *text.values())
    by_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256), 1, 32))
    return rows.withColumn("d", F.row_number().over(by_turn).cast("long")).select("conv_id", "d", digest.alias("digest"), F.regexp_count("text", F.lit(_WORD)).cast("long").alias("words"))


def rebuild(encoded: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Begin each conversation c with the first h turns of conversation c - c % ``every``, h = crc32(c) % ``most``.

    Its own turns follow from the h-th on.  A conversation that is left without turns keeps a row of place 0.
    """
    c = F.col("conv_id")
    group, h = c - c % every, F.when(c % every == 0, 0).otherwise(F.crc32(c.cast("string").cast("binary")) % most)
    own = encoded.where(F.col("d") > h)
    members = encoded.where("d = 1").select("conv_id", F.lit(0).cast("long").alias("d"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    heads = encoded.where((c % every == 0) & (F.col("d") < most)).select(c.alias("group"), "d", "digest", "words")
    wants = encoded.where("d = 1").select("conv_id", group.alias("group"), h.alias("h")).where("h > 0")
    begun = wants.join(heads.hint("shuffle_hash"), "group").where("d <= h").select("conv_id", "d", "digest", "words")
    return own.unionByName(members).unionByName(begun)


def walk(ids: list[int], turns: list[list[bytes]], words: list[list[int]]) -> Iterator[tuple]:
    """Nodes of a shard in depth-first order: place, parent's place, node, parent, depth, words, members, least id, ends."""
    postings: list[dict[bytes, int]] = []
    ended: dict[int, int] = {}
    for k, own in enumerate(turns):
        bit = 1 << k
        ended[len(own)] = ended.get(len(own), 0) | bit
        for p, t in enumerate(own):
            if p == len(postings):
                postings.append({})
            postings[p][t] = postings[p].get(t, 0) | bit
    stack = [((1 << len(ids)) - 1, 0, ROOT, b"", -1, 0)]
    place = 0
    while stack:
        bits, depth, node, parent, above, size = stack.pop()
        ends = bits & ended.get(depth, 0)
        yield place, above, node, parent, depth, size, bits.bit_count(), ids[(bits & -bits).bit_length() - 1], [ids[k] for k in _bits(ends)]
        rest = bits & ~ends
        while rest:
            k = (rest & -rest).bit_length() - 1
            turn = turns[k][depth]
            child = bits & postings[depth][turn]
            stack.append((child, depth + 1, hashlib.blake2b(node + turn, digest_size=16).digest(), node, place, words[k][depth]))
            rest &= ~child
        place += 1


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def shard_nodes(encoded: DataFrame) -> DataFrame:
    """The nodes of each shard, with members, the smallest of them and the ends within the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, turns, words, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for place, above, node, parent, depth, n_words, n, least, ends in walk(ids, turns, words):
                rows.append((ids[0], place, above, node, parent, depth, n_words, n, least, len(ends), ",".join(map(str, ends))))
                if len(rows) == 10_000:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODES, strict=True)], schema=_NODES)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODES, strict=True)], schema=_NODES)

        for batch in batches:
            for c, d, digest, n in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "d", "digest", "words")), strict=True):
                if not ids or c != ids[-1]:
                    if len(ids) >= SHARD or size >= TURNS:
                        yield from flush()
                        ids, turns, words, size = [], [], [], 0
                    ids.append(c)
                    turns.append([])
                    words.append([])
                if d:
                    turns[-1].append(digest)
                    words[-1].append(n)
                    size += 1
        if ids:
            yield from flush()

    schema = "shard long, place long, above long, node binary, parent binary, depth long, words long, n long, least long, n_ends long, ends string"
    return encoded.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "d").mapInArrow(run, schema)


def merge(nodes: DataFrame) -> DataFrame:
    """One row a node: all shards' members and ends, and the hash of the ends in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, digest = None, None, None
        schema = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("n_ends", pa.int64()), ("ends_sha256", pa.string())])
        out = []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("node", "parent", "depth", "words", "n", "least", "n_ends", "ends")]
            for node, parent, depth, words, n, least, n_ends, ends in zip(*columns, strict=True):
                if node != now:
                    if now is not None:
                        out.append((*total, digest.hexdigest()))
                    now, total, digest = node, [node, parent, depth, words, 0, least, 0], hashlib.sha256()
                total[4] += n
                if n_ends:
                    digest.update(("," * (total[6] > 0) + ends).encode())
                    total[6] += n_ends
            if len(out) > 10_000:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if now is not None:
            out.append((*total, digest.hexdigest()))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    ordered = nodes.select("node", "parent", "depth", "words", "n", "least", "n_ends", "ends").repartition("node").sortWithinPartitions("node", "least")
    return ordered.mapInArrow(run, "node binary, parent binary, depth long, words long, n_convs long, conv_id long, n_ends long, ends_sha256 string")


def subtree_sums(rows: DataFrame) -> DataFrame:
    """Of each shard's nodes: leaves and saved tokens of their subtrees, as far as they are this shard's, and the parent's owner.

    ``rows`` are a shard's nodes with the owner of each and its number of children.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("node", pa.binary()), ("leaves", pa.int64()), ("saved", pa.int64()), ("parent_conv_id", pa.int64())])
        now, nodes, above, owners, leaves, saved = None, [], [], [], [], []

        def flush() -> pa.RecordBatch:
            for k in range(len(nodes) - 1, 0, -1):
                leaves[above[k]] += leaves[k]
                saved[above[k]] += saved[k]
            return pa.record_batch([pa.array(nodes, pa.binary()), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64()), pa.array([owners[a] if a >= 0 else None for a in above], pa.int64())], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "node", "above", "words", "n", "least", "conv_id", "n_children")]
            for shard, node, up, words, n, least, owner, children in zip(*columns, strict=True):
                if shard != now:
                    if nodes:
                        yield flush()
                    now, nodes, above, owners, leaves, saved = shard, [], [], [], [], []
                own = least == owner
                nodes.append(node)
                above.append(up)
                owners.append(owner)
                leaves.append(int(own and not children))
                saved.append((n - own) * words)
        if nodes:
            yield flush()

    ordered = rows.select("shard", "place", "node", "above", "words", "n", "least", "conv_id", "n_children").repartition("shard").sortWithinPartitions("shard", "place")
    return ordered.mapInArrow(run, "node binary, leaves long, saved long, parent_conv_id long")


def trie(encoded: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations as ``encode`` gives them.

    node and parent (keys), conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (words that a cache of prefixes saves below and at the node), n_ends and ends_sha256.
    """
    by_shard = stage(shard_nodes(encoded), "trie-shards")
    nodes = stage(merge(by_shard), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    known = stage(nodes.join(children.hint("shuffle_hash"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-known")
    local = by_shard.select("shard", "place", "node", "above", "words", "n", "least").join(known.select("node", "conv_id", "n_children").hint("shuffle_hash"), "node")
    sums = subtree_sums(local).groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.min("parent_conv_id").alias("parent_conv_id"))
    return known.join(sums.hint("shuffle_hash"), "node").select("node", F.when(F.col("depth") > 0, F.col("parent")).alias("parent"), "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends", "ends_sha256")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    encoded = stage(encode(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "trie-turns")
    return trie(rebuild(encoded)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: CRC-32 of a decimal number's characters, bit by bit.
_CRC = """xor(list_reduce(flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda a, b: CASE WHEN xor(a, b) & 1 = 1 THEN xor(xor(a, b) >> 1, 3988292384) ELSE xor(a, b) >> 1 END, 4294967295::BIGINT), 4294967295)"""

OP11_SQL = f"""
WITH turns AS (
    SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d,
        coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c FROM turns),
heads AS (SELECT c, c - c % 20 AS g, CASE WHEN c % 20 = 0 THEN 0 ELSE {_CRC} % 4 END AS h FROM ids),
rebuilt AS (
    SELECT t.c, t.d, t.role, t.text FROM turns t JOIN heads USING (c) WHERE t.d > h
    UNION ALL SELECT heads.c, t.d, t.role, t.text FROM heads JOIN turns t ON t.c = g AND t.d <= h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY d) AS d, role, text FROM rebuilt),
paths AS (
    SELECT c, d, list((role, text)) OVER (PARTITION BY c ORDER BY d) AS path, text FROM placed
    UNION ALL SELECT c, 0, [], '' FROM ids),
nodes AS (
    SELECT path, d, min(c) AS conv_id, count(*) AS n, len(regexp_extract_all(any_value(text), '[^ \\t-\\r]+')) AS words
    FROM paths GROUP BY path, d),
lengths AS (SELECT c, max(d) AS d FROM paths GROUP BY c),
ends AS (
    SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM paths JOIN lengths USING (c, d) GROUP BY path),
children AS (SELECT path[1:d - 1] AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
    SELECT path[1:k] AS path, sum((n - 1) * words) AS saved, count(*) FILTER (children IS NULL) AS leaves
    FROM (SELECT nodes.*, children.n AS children, unnest(range(d + 1)) AS k FROM nodes LEFT JOIN children USING (path)) GROUP BY ALL)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n AS n_convs, coalesce(c.n, 0) AS n_children,
    b.leaves AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes a LEFT JOIN nodes p ON a.d > 0 AND p.path = a.path[1:a.d - 1] LEFT JOIN children c ON c.path = a.path
    JOIN below b ON b.path = a.path LEFT JOIN ends e ON e.path = a.path
"""
