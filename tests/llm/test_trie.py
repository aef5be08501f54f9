import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from evflow.llm import trie as T

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def whole(c):
    """Remainder with the sign of the number, as SQL has it."""
    return abs(c) % 20 * (1 if c >= 0 else -1)


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - whole(c), [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = Counter()
    for p, own_ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(own_ids) if len(built[c]) == len(p))
        out[min(own_ids), len(p), min(members[p[:-1]]) if p else None, len(own_ids), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def made(seed, n=300):
    r = random.Random(seed)
    says = ["", "a", "b c", "x  y\tz", " ", "é w", None]
    rows = []
    for c in r.sample(range(-60, 400), n // 3) + [10**12, 10**12 + 7, -(10**15)]:
        for k in range(r.choice([1, 1, 2, 3, 5])):
            rows.append((c, r.choice([k, k, k, None, 3]), r.choice(["user", "assistant", None]), r.choice(says)))
    rows += [(401, k, "user", f"t{k % 3}") for k in range(60)] + [(None, 0, "user", "lost")] + rows[:5]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def found(spark, rows, parts):
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], SCHEMA + ", depth int, node binary").repartition(parts)
    return Counter(tuple(r[c] for c in COLUMNS) for r in T.trie(T.rebuild(T.encode(df))).collect())


@pytest.mark.parametrize("seed", range(2))
def test_against_all_prefixes(spark, seed):
    rows = made(seed)
    assert found(spark, rows, 1 + 2 * seed) == brute(rows)


def test_small_shards_make_the_same_nodes():
    ids = list(range(20))
    r = random.Random(3)
    turns = [[bytes([r.randrange(2)]) for _ in range(r.randrange(5))] for _ in ids]
    got = list(T.walk(ids, turns, [[1] * len(t) for t in turns]))
    prefixes = Counter(tuple(t[:d]) for t in turns for d in range(len(t) + 1))
    assert sorted(x[6] for x in got) == sorted(prefixes.values())
    assert sorted(k for x in got for k in x[8]) == ids
    assert all(x[1] < x[0] for x in got)


def test_empty_and_nameless(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert T.trie(T.rebuild(T.encode(none))).count() == 0
    assert found(spark, [(None, 1, "user", "x")], 1) == Counter()


def test_many_equal_conversations(spark):
    rows = [(c, k, "user", "hi there" if k == 0 else f"{c % 3}") for c in range(0, 200) for k in range(2)] + [(c, 0, None, None) for c in range(500, 530)]
    assert found(spark, rows, 4) == brute(rows)


def test_query_against_sql(spark, tmp_path):
    import duckdb

    rows = made(7)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(T.OP11_SQL)
    names = [x[0] for x in want.description]
    assert Counter(tuple(r[names.index(c)] for c in COLUMNS) for r in want.fetchall()) == brute(rows)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in T.op11_trie(spark, str(tmp_path)).collect()) == brute(rows)
