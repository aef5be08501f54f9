import random

from pyspark.sql import functions as F

from evflow.llm import hamming


def brute(rows, asks, k, bits):
    code = {i: [1 if j < len(v) and v[j] is not None and v[j] > 0 else 0 for j in range(bits)] for i, v in rows if i is not None and v is not None}
    out = []
    for q in code:
        if asks(q):
            near = sorted((sum(a != b for a, b in zip(code[q], c, strict=True)), i) for i, c in code.items() if i != q)[:k]
            out += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    return sorted(out)


def check(spark, rows, k, bits, width):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, code string").repartition(3)
    got = hamming.search(df, F.col("vec_id") % 5 == 0, k, bits, width)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda q: q % 5 == 0, k, bits)


def test_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) for _ in range(20)]) for i in range(60)]
    check(spark, rows, 4, 20, 8)


def test_ties_nulls_and_copies(spark):
    same = [1.0, -1.0] * 8
    rows = [(i, same) for i in range(25)] + [(30, None), (35, [1.0]), (40, [None, float("nan"), 2.0]), (None, same), (41, [])]
    check(spark, rows, 5, 16, 8)


def test_fewer_rows_than_k(spark):
    check(spark, [(0, [1.0, 1.0]), (5, [-1.0, 1.0]), (7, [-1.0, -1.0])], 10, 8, 4)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert hamming.search(empty, F.col("vec_id") % 5 == 0, 3, 8, 4).count() == 0
