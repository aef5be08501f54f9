"""Ranks and quantiles against pandas and numpy, with bounds so small that every way is taken."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evflow.operators import evaluation as E
from evflow.operators import ranking as R


def rows(seed, n=600):
    r = random.Random(seed)
    kinds = {"a": lambda: r.gauss(0, 1), "b": lambda: float(r.randrange(3)), "c": lambda: None, "d": lambda: r.choice([1.5, 1.5, 1.5, r.random()]), None: lambda: r.expovariate(1)}
    out = [(g, kinds[g](), k) for k in range(n) for g in [r.choice(list(kinds))]]
    return [*out, ("e", 7.0, n), ("f", 1e300, n + 1), ("a", None, n + 2)]


LEVELS = [0.0, 0.16, 0.5, 0.84, 0.999, 1.0]


@pytest.mark.parametrize(("most", "groups"), [(100_000, 10), (20, 10), (1, 1)])
def test_quantiles_are_numpys(spark, most, groups, monkeypatch):
    monkeypatch.setattr(R, "GRID", 32)
    data = rows(most)
    df = spark.createDataFrame(data, "g string, v double, k int").repartition(3)
    got = {r.g: (r.n, r.quantiles) for r in R.quantiles(df, F.col("v"), LEVELS, ["g"], most, groups).collect()}
    for g in {x[0] for x in data}:
        values = [v for h, v, _ in data if h == g and v is not None]
        assert got[g][0] == len(values)
        assert got[g][1] == (pytest.approx(np.quantile(values, LEVELS).tolist()) if values else None)
    whole = R.quantiles(df, F.col("v"), LEVELS, None, most, groups).first()
    finite = sorted(v for _, v, _ in data if v is not None)
    assert whole.quantiles[:5] == pytest.approx(np.quantile(finite, LEVELS[:5]).tolist())
    assert R.quantiles(df.where("false"), F.col("v"), [0.5]).collect() == [(0, None)]
    assert R.quantiles(df.where("false"), F.col("v"), [0.5], ["g"]).count() == 0


def test_ranks_leave_nulls_out(spark):
    values = [5.0, None, None, 1.0, 3.0, 3.0]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    want = pd.Series(values).rank().tolist()
    got = [r.r for r in sorted(E.average_ranks(df, "v", "r").collect(), key=lambda r: r.k)]
    assert [None if np.isnan(x) else x for x in want] == got


def test_spearman_is_of_rows_with_both(spark):
    r = random.Random(1)
    data = [(r.choice([None, float(r.randrange(6)), r.random()]), r.choice([None, float(r.randrange(4)), r.random()])) for _ in range(300)]
    df = spark.createDataFrame(data, "a double, b double")
    both = pd.DataFrame(data, columns=["a", "b"]).dropna().rank()
    assert E.spearman(df, "a", "b").first().rho == pytest.approx(both["a"].corr(both["b"]))


def test_running_sums_of_structs_with_equal_first_fields(spark):
    data = [(g, (1, k), k) for g in (None, 1, 2) for k in range(100)]
    df = spark.createDataFrame(random.Random(2).sample(data, len(data)), "g int, o struct<a:int,b:int>, n int").repartition(3)
    for r in R.running_sums(df, "o", ["n"], ["g"]).collect():
        assert r.n_before == r.o.b * (r.o.b - 1) // 2


def test_ablation_computes_its_table_once(spark):
    from evflow.operators import modelling as M

    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    rows = [(k, float(k % 7), float(k % 5), int(k % 7 > 3)) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, good double, bad double, y int").mapInArrow(count, "k int, good double, bad double, y int")
    found = {r.name: r for r in M.ablation(df, {"base": ["bad"], "more": ["bad", "good"]}, ["k"], [1, 2], "base", rounds=2).collect()}
    assert seen.value == 400
    assert found["more"].improved == 2
    assert found["more"].min_delta > 0.2
