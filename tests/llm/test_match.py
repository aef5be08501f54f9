import random

import pytest

from evflow.llm import decontaminate as D
from evflow.llm import licenses as L


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    r = random.Random(2)
    for _ in range(200):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 70)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 90)))
        assert D.myers(D.make_item(0, p), t)[0] == distance(p, t)


def edited(text, n, r):
    out = list(text)
    for _ in range(n):
        k = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[k] = "q"
        elif kind == 1:
            del out[k]
        else:
            out.insert(k, "z")
    return "".join(out)


def test_every_passage_within_the_budget_is_found(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "theta"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(k, prose(r.randint(8, 30))) for k in range(12)] + [(90, None), (91, ""), (92, "tiny")]
    docs = []
    for n in range(60):
        k, text = items[n % 12]
        docs.append((n, f"{prose(20)} {edited(text, r.randint(0, 12), r)}  {prose(20)}"))
    docs += [(100, None), (101, ""), (102, prose(100)), (0, docs[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((x.doc_id, x.item_id, x.distance) for x in D.find_leaks(df, bench).collect())
    want = []
    for d, t in docs:
        for k, text in items:
            item = D.make_item(k, text)
            if item and (n := distance(item.text, D.normalise(t))) <= item.budget:
                want.append((d, k, n))
    assert got == sorted(want) and len(want) > 20
    kept = {x.doc_id for x in D.clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _, _ in want}


def test_empty_benchmark(spark, hard, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(hard, bench).count() == 0
    assert D.find_leaks(none, bench).count() == 0
    assert D.clean(hard, bench).count() == hard.count()


def test_parts_of_a_benchmark_find_the_same(spark, monkeypatch):
    r = random.Random(4)
    prose = lambda n: " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    items = [(k, prose(12)) for k in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(n, f"{prose(9)} {edited(items[n % 9][1], n % 4, r)} {prose(9)}") for n in range(30)] + [(30, prose(20)), (31, items[0][1] * 40)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int").repartition(2)
    found = lambda: (sorted(map(tuple, D.find_leaks(df, bench).collect())), sorted(map(tuple, D.clean(df, bench).collect())))
    whole = found()
    assert len(whole[0]) > 20
    monkeypatch.setattr(D, "SENT_CHARS", 200)
    assert len(D.sent_in_parts(bench)) > 2
    assert found() == whole


def test_hits_far_apart_are_looked_at_in_time():
    import time

    item = D.make_item(1, "one two three four five six seven eight nine ten")
    search = D.automaton([item])
    took = []
    for n in (500, 5000):
        begun = time.process_time()
        assert D.matches(("one two three " + "x" * 400) * n, [item], search) == []
        took.append(time.process_time() - begun)
    assert took[1] < 30 * max(took[0], 0.02)


def test_alignment_rises_and_covers():
    a = "x y the quick brown fox z jumps over the dog".split()
    b = "the quick red fox jumps over the lazy dog".split()
    pairs = L.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
    assert len(pairs) == 7


def test_licenses_are_found(spark, hard):
    mit = L.TEMPLATES["mit-text"]
    rows = [
        (1, "Some words first. Licensed under CC BY-NC 4.0."),
        (2, f"intro {mit.replace('merge, publish', 'merge')} outro"),
        (3, "Released under the MIT License.\n" * 3 + "text"),
        (4, "The license to drive a car under the bridge was released by the city in 2004."),
        (5, f"{L.TEMPLATES['gpl-3.0']} {'filler ' * 3000} All rights reserved."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x for x in L.scan(df).collect()}
    assert got[1].license == "cc-by-nc-4.0" and got[1].coverage == 1
    assert got[2].license == "mit-text" and 0.9 < got[2].coverage < 1
    assert got[3].license == "mit" and got[3].n_notices == 3
    assert got[4].license is None
    assert got[5].license == "gpl-3.0" and got[5].licenses == ["all-rights-reserved", "gpl-3.0"]
    assert L.scan(hard.select("doc_id", "text")).where("license is not null").count() == 0


def test_notices_one_after_another_in_time_that_grows_with_length():
    import time

    mit = next(t for t in L.make_templates(L.TEMPLATES) if t.name == "mit-text")
    for gap in (0, 3, 40, 400):
        words = (["other"] * gap + mit.words) * 9
        share, first, last, n = L.coverage(words, mit, 0.8)
        assert (share, n) == (1, 9)
        assert words[first : last + 1] == mit.words
    r, took = random.Random(2), []
    for n in (4_000, 32_000):
        begun = time.process_time()
        assert L.coverage(r.choices(mit.words, k=n), mit, 0.8)[3] == 0
        took.append(time.process_time() - begun)
    assert took[1] < 24 * max(took[0], 0.02)
