import hashlib
import random
from collections import Counter

import pytest

from evflow.llm import repeats as R


def brute(texts, size):
    """n_bytes, spans and kept bytes of each text, by counting all its windows."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + size] for b in raw for p in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if count[b[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        spans, p = [], 0
        while p < len(b):
            q = p
            while q < len(b) and gone[q] == gone[p]:
                q += 1
            if gone[p]:
                spans.append((p, q))
            p = q
        out.append((len(b), tuple(spans), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def found(spark, texts, size, parts):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, part int, kept string").repartition(parts)
    rows = sorted(R.remove_repeats(df, size).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    return [(r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in rows]


def made(seed):
    r = random.Random(seed)
    letters = "abcé" if seed % 2 else "ab\n☃漢xyz0123"
    passages = ["".join(r.choices(letters, k=r.randint(20, 120))) for _ in range(5)]
    texts = [None, "", "ab", "a" * 200, "a" * 41, "é" * 60, "xy" * 90, "abc" * 50]
    for _ in range(40):
        body = "".join(r.choices(letters, k=r.randint(0, 150)))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            a, b = sorted(r.randrange(len(p) + 1) for _ in range(2))
            at = r.randrange(len(body) + 1)
            body = body[:at] + p[a:b] * r.randint(1, 2) + body[at:]
        texts.append(body)
    for t in list(texts[-6:]):
        k = r.randrange(len(t) + 1)
        texts += [t, t[:k] + "!" + t[k + 1 :]]
    return texts


@pytest.mark.parametrize("seed", range(2))
def test_against_all_windows(spark, seed):
    texts = made(seed)
    for size, parts in ((40, 3), (41, 1), (7, 2)):
        assert found(spark, texts, size, parts) == brute(texts, size)


def test_steps_and_flushes_change_nothing(spark, monkeypatch):
    texts = made(9) + ["".join(random.Random(5).choices("abcdefgh ", k=900)) * 2]
    for step, held in ((64, 50), (200, 10)):
        monkeypatch.setattr(R, "STEP", step)
        monkeypatch.setattr(R, "HELD", held)
        assert list(local(texts, 40)) == brute(texts, 40)


def local(texts, size):
    """The same by the classes of one process, through the same steps and counters."""
    import numpy as np
    import pyarrow as pa

    tiles, windows = Counter(), Counter()
    every = [R.bytes_of(pa.array([(t or "").encode()])) for t in texts]
    for data, offsets in every:
        for _, s in R.steps(data, offsets, size):
            tiles.update(zip(s.tiles.block.tolist(), s.tiles.tile.tolist(), strict=True))
    seen = set()
    for data, offsets in every:
        for _, s in R.steps(data, offsets, size):
            for k, key in enumerate(zip(s.tiles.block.tolist(), s.tiles.tile.tolist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    windows.update(zip(*(x.tolist() for x in s.windows_of(np.array([k]))[1:]), strict=True))
    for data, offsets in every:
        gone = np.zeros(len(data), bool)
        for at, s in R.steps(data, offsets, size):
            for k, key in enumerate(zip(s.tiles.block.tolist(), s.tiles.tile.tolist(), strict=True)):
                start, block, digit = s.windows_of(np.array([k]))
                for p, *d in zip(start.tolist(), block.tolist(), digit.tolist(), strict=True):
                    if tiles[key] > 1 or windows[tuple(d)] > 1:
                        gone[at + p : at + p + size] = True
        row = R.cut_rows(pa.array([1]), data, offsets, gone).to_pylist()[0]
        yield row["n_bytes"], tuple((x["start"], x["end"]) for x in row["spans"]), row["kept"]


def test_hard_rows_and_empty_table(spark, hard, none):
    assert R.remove_repeats(none, 40).count() == 0
    rows = hard.collect()
    want = Counter((r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], 40), strict=True))
    got = Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in R.remove_repeats(hard, 40).collect())
    assert got == want


def test_query_digests(spark, tmp_path):
    texts = ["x" * 399, "y" * 401, "z" * 400, "".join(random.Random(1).choices("abcd", k=1000)), None]
    texts.append(texts[3][100:700] + "é")
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, R.op13_repeats(spark, str(tmp_path)).collect()))
    want = [(k, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for k, (n, spans, kept) in enumerate(brute(texts, 400))]
    assert got == want
