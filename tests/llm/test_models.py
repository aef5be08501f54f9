import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from evflow.llm import pitman_yor as P
from evflow.llm import quality as Q
from evflow.llm import toxicity as T
from evflow.llm.linear import minimise

WORDS = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in ("nt", "rk", "ss", "l")]


def corpus(seed, n=400):
    """Toxic texts hold a bad word; a group is named in many of them and in few others."""
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(5, 60))]
        toxic = k % 4 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["vilest", "hatefulness", "slurring"]))
        if r.random() < (0.6 if toxic else 0.1):
            words.insert(r.randrange(len(words)), "muslims")
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def test_minimise_finds_the_least_value():
    a = np.array([[3.0, 1.0], [1.0, 2.0]])
    b = np.array([1.0, -1.0])
    x = minimise(lambda v: (float(v @ a @ v / 2 - b @ v), a @ v - b), np.zeros(2))
    assert np.allclose(x, np.linalg.solve(a, b), atol=1e-5)


def test_toxicity_learns_and_swaps_bind(spark):
    rows, labels = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([*labels, (7, None)], "doc_id long, grade int").where("grade is not null")
    fair, plain = T.fit(docs, marks, fairness=1000.0), T.fit(docs, marks, fairness=0.0)
    new, truth = corpus(2)
    for model in (fair, plain):
        scores = T.document_scores(pa.array([t for _, t in new]), model)
        y = np.array([v for _, v in truth])
        assert ((scores >= 0.5) == y).mean() > 0.97
    neutral = pa.array(["the baker met muslims in town", "the baker met christians in town"])
    gap = [abs(np.subtract(*T.document_scores(neutral, m))) for m in (fair, plain)]
    assert gap[0] < gap[1] / 3


def test_toxicity_of_hard_rows(spark, hard, none):
    rows, labels = corpus(3, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame(labels, "doc_id long, grade int"))
    got = T.score(hard.select("doc_id", "text"), model).collect()
    assert len(got) == hard.count() and all(0 <= r.score <= 1 for r in got)
    assert T.score(none.select("doc_id", "text"), model).count() == 0
    empty = spark.createDataFrame([], "doc_id long, grade int")
    assert {r.score for r in T.score(docs, T.fit(docs, empty)).collect()} == {T.sigmoid(np.array(-40.0)).item()}


def graded(seed, n=400):
    r = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = [r.choice(WORDS) for _ in range(r.randint(5, 80))]
        grade = k % 3
        junk = [0.6, 0.25, 0.0][grade]
        words = [w.upper() + "!!" if r.random() < junk else w for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, grade))
    return rows, labels


def test_quality_is_ordinal(spark):
    rows, labels = graded(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, grade int"))
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    new, truth = graded(2)
    expected, tail = Q.rate(pa.array([t for _, t in new]), model, 1)
    y = np.array([g for _, g in truth])
    assert (np.abs(expected - y) < 0.5).mean() > 0.85
    assert ((tail >= 0.5) == (y >= 1)).mean() > 0.9
    sure = Q.rate(pa.array([t for _, t in new]), model, 0)[1]
    assert (sure == 1).all() and (Q.rate(pa.array(["a"]), model, 9)[1] == 0).all()


def test_quality_of_hard_rows(spark, hard, none):
    rows, labels = graded(3, 150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame(labels, "doc_id long, grade int"))
    got = Q.score(hard.select("doc_id", "text"), model).collect()
    assert len(got) == hard.count() and all(0 <= r.tail_probability <= 1 for r in got)
    assert Q.score(none.select("doc_id", "text"), model).count() == 0
    one = Q.fit(docs, spark.createDataFrame([(1, 2)], "doc_id long, grade int"))
    assert {tuple(r)[1:] for r in Q.score(docs, one).collect()} == {(2.0, 1.0)}


def test_table_counts_follow_their_distribution():
    d, weight, c = 0.6, 2.0, 9
    logs = P.stirling(d)
    p = np.exp(logs[c, 1 : c + 1] + np.log(weight) * np.arange(1, c + 1))
    drawn = P.draw_tables(np.full(40_000, c), np.full(40_000, weight), d, np.random.default_rng(1))
    share = np.bincount(drawn, minlength=c + 1)[1:] / len(drawn)
    assert np.abs(share - p / p.sum()).max() < 0.01
    large = P.draw_tables(np.array([1, 0, 5000]), np.ones(3) * 3, d, np.random.default_rng(2))
    assert large[0] == 1 and large[1] == 0 and 1 <= large[2] <= 5000


def test_language_model_probabilities_sum_to_one(spark):
    """Through scores alone: texts of up to two words give a matrix that is similar to that of next-word probabilities.

    With E the text's end, M[E, w] = 1, M[w, E] = P("w") and M[u, w] = P("u w") / P("w") are p(w | u) up to a change of
    scale of each word, so the largest eigenvalue is one where the probabilities after each word are of sum one.
    """
    r = random.Random(4)
    docs = [(k, " ".join(r.choice(WORDS[:12]) for _ in range(40))) for k in range(60)]
    keep = [(i, t) for i, t in docs if not P.held_out(i)]
    words = [*sorted({w for _, t in keep for w in t.split()}), "neverseen"]
    probes = ["", *words, *(f"{u} {w}" for u in words for w in words)]
    held = [i for i in range(10_000, 60_000) if P.held_out(i)]
    rows = [*keep, *zip(held, probes, strict=False)]
    got = {x.doc_id: x for x in P.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), seed=3).collect()}
    assert all(got[i].n_known == got[i].n_tokens for i, _ in keep)
    p = {t: 10 ** got[i].score for i, t in zip(held, probes, strict=False)}
    m = np.array([[p[""], *[1.0] * len(words)], *([p[u], *(p[f"{u} {w}"] / p[w] for w in words)] for u in words)])
    assert abs(np.linalg.eigvals(m)).max() == pytest.approx(1, abs=1e-5)


def test_large_groups_follow_their_distribution():
    """Beyond the exact rows, against rows of the recursion carried on."""
    for c, d, weight, error in ((700, 0.6, 3.0, 0.03), (1500, 0.8, 0.5, 0.03), (1500, 0.5, 9.0, 0.03), (1500, 0.3, 50.0, 0.6)):  # the last in runs
        row = np.full(c + 2, -np.inf)
        row[1] = 0
        for n in range(1, c):
            t = np.arange(1, n + 2)
            stay = np.where(t <= n, row[1 : n + 2] + np.log(np.maximum(n - d * t, 1e-9)), -np.inf)
            row[1 : n + 2] = np.logaddexp(row[: n + 1], stay)
        t = np.arange(1, c + 1)
        p = np.exp(row[1 : c + 1] + t * np.log(weight) - (row[1 : c + 1] + t * np.log(weight)).max())
        mean = (t * p).sum() / p.sum()
        drawn = P.draw_tables(np.full(3000, c), np.full(3000, weight), d, np.random.default_rng(1))
        assert abs(drawn.mean() / mean - 1) < error, (c, d, weight, mean, drawn.mean())


def test_language_model_against_plain_counts(spark, hard, none):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    got = P.score(hard, seed=5).collect()
    assert len(got) == len(rows)
    from collections import Counter

    train = Counter()
    for i, t in rows:
        if not P.held_out(i):
            train.update([*(t or "").encode().lower().split(), b"\n"])
    total = sum(train.values())
    texts = {i: t for i, t in rows}
    for x in got:
        own = [*(texts[x.doc_id] or "").encode().lower().split(), b"\n"]
        base = sum(np.log10((train[w] + 0.5) / (total + 0.5 * (len(train) + 1))) for w in own)
        assert x.n_tokens == len(own) and x.n_known == sum(train[w] > 0 for w in own) and x.train_tokens == total
        assert x.base_score == pytest.approx(base, rel=1e-6) and x.score < 0
    assert P.score(none).count() == 0


def test_seating_gives_proper_probabilities():
    r = np.random.default_rng(6)
    keys = np.unique(r.integers(0, 50, 400) * P.CONTEXTS + r.integers(0, 9, 400))
    counts = r.integers(1, 30, len(keys))
    seating = P.Seating(keys, counts, 50)
    state = P.next_state(seating.totals(), None, 1)
    for k in range(3):
        seating.sweep(state, np.random.default_rng(k))
        state = P.next_state(seating.totals(), state, k)
    root = seating.root_p(state)
    unknown = (state.strength[0] + state.discount[0] * state.tables[0][0]) / (state.words + 1) / (state.strength[0] + state.customers[0][0])
    assert root.sum() + unknown * (state.words + 1 - len(root)) == pytest.approx(1)
    assert (seating.tables >= 1).all() and (seating.tables <= seating.counts).all()
    assert (seating.root_tables <= seating.root).all()


def test_each_word_before_is_a_context_of_its_own(spark):
    first, second = "harbourent", "lanternent"
    assert P.context_of(first) == P.context_of(second)
    train = [k for k in range(600) if not P.held_out(k)][:200]
    rows = [(k, f"{first} apple" if n % 2 else f"{second} stone") for n, k in enumerate(train)]
    held = [k for k in range(1000, 2000) if P.held_out(k)][:4]
    rows += zip(held, [f"{first} apple", f"{first} stone", f"{second} apple", f"{second} stone"], strict=True)
    got = {x.doc_id: x.score for x in P.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    # a class of both words before would give either word one half
    assert got[held[0]] > got[held[1]] + 1 and got[held[3]] > got[held[2]] + 1


def test_words_seating_adds_up_to_the_classes():
    r = np.random.default_rng(7)
    classes = np.array([3, 3, 3, 70, 70, 500])
    pairs = np.unique(r.integers(0, 40, 150) * 6 + r.integers(0, 6, 150))
    seating = P.WordSeating(pairs // 6, pairs % 6, r.integers(1, 30, len(pairs)), classes, 40)
    state, low = P.next_state(seating.totals()[:-1], None, 1), P.Low(0.6, 2.0)
    for k in range(3):
        total = np.bincount(seating.context, seating.tables, 6)
        seating.sweep(state, low, total, np.random.default_rng(k))
        state = P.next_state(seating.totals()[:-1], state, k)
    assert (seating.tables >= 1).all() and (seating.tables <= seating.counts).all()
    assert seating.above.counts.sum() == seating.tables.sum() == seating.totals()[-1, 1] == state.customers[2].sum()
    assert [state.customers[2][g] for g in (3, 70, 500)] == [seating.tables[classes[seating.context] == g].sum() for g in (3, 70, 500)]


def test_sample_has_one_row_an_id(spark):
    from evflow.llm import linear

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "a"), (3, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, grade int")
    assert sorted(map(tuple, linear.sample(docs, labels, 10).collect())) == [(1, "text 0", 0), (2, "a", 1)]
    assert linear.sample(docs, labels, 1).count() == 1


def test_toxicity_scores_are_the_sums_of_their_words(spark, hard):
    docs = spark.createDataFrame([(k, ("vile awful words here" if k % 2 else "kind gentle words there") + f" n{k % 7}") for k in range(80)], "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, grade int"))
    weights = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    texts = [r.text for r in hard.collect()] + ["vile kind vile", "Vile\tWORDS n3", "none of them"]
    for text, got in zip(texts, T.document_scores(pa.array(texts, pa.string()), model).tolist(), strict=True):
        words = {w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w}
        z = sum(weights.get(f, 0.0) for w in words for f in T.word_features(w)) + model.bias
        assert got == pytest.approx(1 / (1 + math.exp(-z)))
    assert T.score(docs.where("false"), model).count() == 0


def test_quality_grades_follow_from_thresholds(spark, hard):
    kinds = ["zz zz qq", "plain prose of some kind", "fine prose, well written and whole"]
    docs = spark.createDataFrame([(k, f"{kinds[k % 3]} t{k % 5}") for k in range(90)], "doc_id long, text string")
    model = Q.fit(docs, spark.createDataFrame([(k, k % 3) for k in range(90)], "doc_id long, grade int"))
    table = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    texts = [r.text for r in hard.collect()] + kinds
    expected, tail = Q.rate(pa.array(texts, pa.string()), model, 1)
    for text, grade, share in zip(texts, expected.tolist(), tail.tolist(), strict=True):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        z = (sum(table.get(f, 0.0) for w in words for f in Q.word_features(w)) + table.get(Q._AGAIN, 0.0) * again) / len(words) if words else table.get(Q._EMPTY, 0.0)
        above = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        assert share == pytest.approx(above[0])
        assert grade == pytest.approx(sum(above))
    assert [round(x) for x in expected[-3:]] == [0, 1, 2]


def test_language_model_leaves_no_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "new_path", lambda session, name: f"file://{tmp_path}/{name}")
    docs = spark.createDataFrame([(k, f"a few words {k % 4} of text") for k in range(30)], "doc_id long, text string").repartition(2)
    found = P.score(docs, rounds=2, sweeps=1, samples=1)
    assert found.count() == 30
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []
