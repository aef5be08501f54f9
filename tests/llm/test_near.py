import random
from collections import Counter, defaultdict

from evflow.llm import jaccard as J

WORDS = [f"w{k}" for k in range(400)]


def shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute(rows):
    """doc_id, set size and smallest id of the class of each row, by comparing all sets."""
    sets = sorted({shingles(t) for _, t in rows}, key=sorted)
    root = {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for a in sets:
        for b in sets:
            if a and b and a is not b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for i, t in rows:
        if i is not None:
            least[find(shingles(t))].append(i)
    out = []
    for i, t in rows:
        s = shingles(t)
        out.append((i, len(s), min(least[find(s)], default=None) if s else i))
    return out, {s: find(s) for s in sets}


def sure(rows):
    return Counter(brute(rows)[0])


def found(spark, rows, parts):
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component_id int").repartition(parts)
    return Counter(map(tuple, J.classes(df).collect()))


def span(a, b):
    return " ".join(WORDS[a:b])


def test_links_pass_through_rows_without_id(spark):
    rows = [(1, span(0, 60)), (None, span(6, 66)), (3, span(12, 72)), (None, span(200, 260)), (None, span(203, 263)), (None, None)]
    for parts in (1, 4):
        assert found(spark, rows, parts) == sure(rows)


def test_texts_of_one_id_are_linked_as_texts(spark):
    rows = [(5, span(0, 60)), (5, span(100, 160)), (7, span(103, 163)), (5, span(0, 60)), (9, span(2, 62)), (5, "a b"), (8, "A  b")]
    for parts in (1, 2, 5):
        assert found(spark, rows, parts) == sure(rows)


def test_large_groups_are_compared_in_cells(spark, monkeypatch):
    monkeypatch.setattr(J, "PART", 4)
    monkeypatch.setattr(J, "LONG_LIST", 3)
    r = random.Random(4)
    rows = []
    for k in range(60):  # near copies that are not all linked, with a passage that others have
        words = WORDS[:80]
        for _ in range(r.randint(0, 9)):
            words = list(words)
            words[r.randrange(80)] = f"x{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join([*WORDS[20:70], *(f"y{r.randrange(10**6)}" for _ in range(r.choice([2, 5, 12, 40])))])) for k in range(40)]
    assert found(spark, rows, 3) == sure(rows)


def test_one_row_of_each_class_stays(spark):
    rows = [
        (1, span(0, 60)), (2, span(0, 60)), (2, span(100, 160)), (3, span(104, 164)), (4, None), (4, None), (4, ""), (None, span(1, 61)),
        (None, span(200, 260)), (None, span(201, 261)), (6, span(300, 360)), (6, span(300, 360)), (7, "lone words"), (None, None),
    ]
    for case in (rows, rows[:2] + rows[3:5] + rows[10:11], []):
        df = spark.createDataFrame([(i, t, "s", "n") for i, t in case], "doc_id long, text string, source string, _node string").repartition(3)
        kept = J.representatives(df)
        assert kept.columns == df.columns
        got = [(x.doc_id, x.text) for x in kept.collect()]
        root = brute(case)[1]
        classes = Counter(root[shingles(t)] for _, t in got if shingles(t))
        assert set(classes) == {c for s, c in root.items() if s} and set(classes.values()) <= {1}
        assert Counter(x for x in got if not shingles(x[1])) == Counter(x for x in case if not shingles(x[1]))
        for i, t in got:
            ids = [k for k, x in case if root[shingles(x)] == root[shingles(t)] and k is not None] if shingles(t) else []
            assert not ids or i == min(ids)


def test_blocks_follow_the_text(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_BYTES", 100)
    monkeypatch.setattr(J, "SAMPLE", 1)
    rows = [(k, span(3 * (k % 50), 3 * (k % 50) + 60)) for k in range(90)]
    assert found(spark, rows, 2) == sure(rows)


def test_frequent_shingles_are_found_in_order(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(J, "SAMPLE", 1)
    df = spark.createDataFrame([(k, f"{span(0, 60)} z{k}") for k in range(9)], "doc_id long, text string")
    frequent, counts, _, _ = J.sample_facts(df)
    assert len(frequent) == 56 and set(counts.tolist()) == {9} and (frequent[1:] > frequent[:-1]).all()
    own = np.sort(np.concatenate([frequent, np.array([1, 1 << 63], np.uint64)]))
    assert set(J.first_shingles(own, frequent, counts)[0][:2].tolist()) == {1, 1 << 63}
