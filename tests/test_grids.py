"""Forests, lookups, merged edges, blocks, dumps, refit reports and the incremental map on small made tables."""

import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from evflow.operators import forests as T
from evflow.operators import grids as G
from evflow.operators import trajectories as R
from evflow.operators.modelling import tree_score
from evflow.sources import collections as C
from evflow.streaming import incremental as I


def random_model(seed, trees, depth):
    r = random.Random(seed)
    out = []
    for _ in range(trees):
        tree = {k: [] for k in ("feature", "threshold", "children_left", "children_right", "value")}

        def grow(level, tree=tree):
            at = len(tree["feature"])
            leaf = level == depth or r.random() < 0.2
            for k, v in (("feature", -2 if leaf else r.randrange(3)), ("threshold", r.choice([0.1, 0.5, 0.7])), ("children_left", -1), ("children_right", -1), ("value", r.uniform(-1, 1))):
                tree[k].append(v)
            if not leaf:
                tree["children_left"][at] = grow(level + 1)
                tree["children_right"][at] = grow(level + 1)
            return at

        grow(0)
        out.append([tree])
    return {"init_predict": [0.1], "norm": 0.3, "trees": out}


def walked(model, x, less):
    total = np.float32(model["init_predict"][0])
    for (tree,) in model["trees"]:
        i = 0
        while tree["feature"][i] != -2:
            a, b = np.float32(x[tree["feature"][i]]), np.float32(tree["threshold"][i])
            i = tree["children_left"][i] if (a < b if less else a <= b) else tree["children_right"][i]
        total = np.float32(total + np.float32(tree["value"][i]))
    return float(np.float32(total * np.float32(model["norm"])))


@pytest.mark.parametrize("most", [10**6, 40])
def test_forest_is_the_walk(spark, most):
    model, r = random_model(1, 30, 6), random.Random(2)
    data = [tuple(r.choice([0.1, 0.5, r.random()]) for _ in range(3)) for _ in range(80)]
    df = spark.createDataFrame(data, "a double, b double, c double")
    x = [F.col(c) for c in "abc"]
    for sign in ("<", "<="):
        found = T.forest_score(df, T.forest_of(spark, model), x, 6, "s", 0.1, 0.3, sign, most).collect()
        assert sorted((f.a, f.b, f.c, f.s) for f in found) == sorted((*v, walked(model, v, sign == "<")) for v in data)
    nested = df.select(tree_score(model | {"trees": model["trees"][:3]}, x).alias("s"))
    few = T.forest_score(df, T.forest_of(spark, model | {"trees": model["trees"][:3]}), x, 6, "s", 0.1, 0.3)
    assert sorted(v.s for v in nested.collect()) == sorted(v.s for v in few.collect())
    with pytest.raises(Exception, match="more levels"):
        T.forest_score(df, T.forest_of(spark, model), x, 2).collect()


@pytest.mark.parametrize("most", [100, 0])
def test_lookup_on_three_axes(spark, most):
    r = random.Random(3)
    edges = {"x": [0.0, 1.0, 2.5, 4.0], "y": [-1.0, 1.0], "z": [float(k) for k in range(9)]}
    points = [(r.choice("pq"), *(r.choice([None, float("nan"), -5.0, 50.0, r.choice(e), r.uniform(e[0], e[-1])]) for e in edges.values())) for _ in range(300)]
    df = spark.createDataFrame(points, "k string, x double, y double, z double")
    sides = spark.createDataFrame([("p", *edges.values())], "k string, x array<double>, y array<double>, z array<double>")
    cells = spark.createDataFrame([("p", i, 0, k, 100.0 * i + k) for i in range(3) for k in range(7)], "k string, x int, y int, z int, v double")
    found = G.lookup(df, {a: F.col(a) for a in edges}, sides, cells, ["v"], ["k"], most).collect()
    assert len(found) == len(points)
    for f in found:
        place = [None if f[a] is None or f.k == "q" else int(np.clip(np.digitize(f[a], e) - 1, 0, len(e) - 2)) for a, e in edges.items()]
        assert [f.bin_x, f.bin_y, f.bin_z] == place
        assert f.v == (None if None in place or place[2] > 6 else 100.0 * place[0] + place[2])


def test_merged_edges_over_ranges(spark):
    r = random.Random(4)
    values = [round(r.uniform(-2, 2), r.choice([1, 2, 3])) for _ in range(400)] + [1e6, 1e6 + 1, 1e6 + 3000]
    df = spark.createDataFrame([(k % 2, values[k::20]) for k in range(20)] + [(0, None), (1, [None])], "g int, e array<double>").repartition(4)
    for by in ([], ["g"]):
        found = sorted(map(tuple, G.merged_edges(df, "e", 1e-3, by).collect()))
        want = []
        for g in [0, 1] if by else [None]:
            all_ = np.sort([v for k in range(20) for v in values[k::20] if g is None or k % 2 == g])
            keep = np.concatenate([[True], np.diff(all_) > 1e-3 * (1 + np.abs(all_[1:]))])
            want += [(g, v) if by else (v,) for v in all_[keep]]
        assert found == sorted(want)


def test_blocks(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 1e-12), ("a", 1e12), ("b", -1.5), ("b", 2.0), ("c", 0.0)], "g string, v double")
    found = {(r.g, r.v): r for r in G.decode_blocks(G.encode_blocks(df, "v", ["g"])).collect()}
    assert (found["a", 1e-12].code, found["a", 1e12].code, found["b", -1.5].code) == (-27000, 27000, None)
    assert found["a", 5.0].decoded == pytest.approx(5, rel=1e-3)
    assert (found["b", -1.5].decoded, found["c", 0.0].quant) == (-1.5, "f32")
    for odd in (float("nan"), float("inf"), None):
        with pytest.raises(ValueError, match="finite"):
            G.encode_blocks(df.unionByName(spark.createDataFrame([("a", odd)], "g string, v double")), "v", ["g"])


def test_slices_leave_odd_values_out(spark):
    df = spark.createDataFrame([(0, "u", 1.0, 2.0), (0, "v", 4.0, 0.0), (0, "w", float("nan"), 1.0), (1, "u", float("inf"), 1.0), (2, "u", 6.0, 3.0)], "x int, y string, a double, b double")
    found = {r.x: (r.middle, r.n) for r in G.grid_slice(df, ["x"], "a", below="b", invert=True).collect()}
    assert found == {0: (1.0, 2), 1: (0.0, 1), 2: (0.5, 1)}
    assert {(r.x, r.y, r.middle) for r in G.grid_slice(df, ["x", "y"], "a", cuts={"x": (0, 0)}, agg="mean").collect()} == {(0, "u", 1.0), (0, "v", 4.0), (0, "w", None)}
    with pytest.raises(ValueError, match="free axes"):
        G.grid_slice(df, ["x"], "a", {"x": 1})
    bands = G.envelope(G.grid_slice(df, ["y"], "b"), "y", ks=(2.0,))
    assert {(r.y, r.low, r.high) for r in bands.collect()} == {("u", -4.0, 4.0), ("v", 0.0, 0.0), ("w", -2.0, 2.0)}


def test_dumps_of_other_classes_are_errors(spark, tmp_path):
    probs = [F.array(F.lit(0.25), F.lit(0.75)).cast("array<float>").alias("class_probs"), F.lit(1).cast("short").alias("y_true")]
    for name in ("1111__a__b__s1", "0000__a__s0", "1111__z__s0", "notes"):
        spark.range(3).select(*probs).write.parquet(str(tmp_path / f"{name}.parquet"))
    rows, groups = C.union_dumps(spark, str(tmp_path), ["x", "y"], ["p"], ["pt"], ["1111"], ["z"])
    assert [(g.id, g.row_offset, g.has_charge) for g in groups.orderBy("row_offset").collect()] == [("1111__z__s0", 0, False), ("1111__a__b__s1", 3, False), ("0000__a__s0", 6, False)]
    found = rows.collect()
    assert sorted(r.row for r in found) == list(range(9))
    assert {(r.prob_x, r.prob_p, r.pt, r.charge_label) for r in found} == {(0.25, -1.0, -1.0, -1.0)}
    with pytest.raises(ValueError, match="classes"):
        C.union_dumps(spark, str(tmp_path), ["x", "y", "z"], ["p"], [], [], [])


def test_refit_report_of_one_track(spark):
    track = (1, 0, 2.0, 4, True, 0.5, 3.0, 0.2, 2.5, None, 2.0, 0.0, 0.0, 0.1, 9.0, "1010")
    names = "event int, idx int, chi2ZRed double, nStubs int, refitPerformed boolean, d0 double, z0 double, refit_d0 double, refit_z0 double, tpD0 double, tpZ0 double, phi0 double, GenVtx_x double, GenVtx_y double, GenVtx_z double, config string"
    tracks = spark.createDataFrame([track, (1, 1, 3.0, 1, False, *track[5:])], names)
    hits = [(1, 0, 0, 1, True, 5.0, 1.0), (1, 0, 1, 1, True, 6.0, 2.0), (1, 0, 2, 2, True, 7.0, 9.0), (1, 0, 3, 3, False, 1.0, 1.0), (1, 0, 4, 3, True, 8.0, 4.0), (1, 1, 0, 1, True, 1.0, 1.0)]
    found = R.refit_trajectory(tracks, spark.createDataFrame(hits, "event int, trackIdx int, hit int, layer int, hitAccepted boolean, chi2IncRPhi double, chi2IncRZ double"), ["event"], F.col("config"))
    rows = sorted(found.collect(), key=lambda r: (r.trackIdx, r.step))
    assert [(r.trackIdx, r.label, r.ndof, r.cum_rphi, r.reduced_chi2) for r in rows] == [(0, "OT L1Track", 3, 0.0, 2.0), (0, "after L1", 5, 6.0, 8 / 5), (0, "after L3", 7, 14.0, 12 / 7), (1, "OT L1Track", 1, 0.0, 3.0)]
    assert rows[0].error_d0 == pytest.approx(0.6)
    assert rows[1].error_d0 is None
    assert (rows[2].error_z0, rows[2].change_z0) == (pytest.approx(0.5), pytest.approx(-50))
    assert rows[3].change_z0 is None


def test_untouched_cells_are_not_read_again(spark, tmp_path):
    path, store, state = (str(tmp_path / n) for n in ("in", "store", "state"))
    run = lambda: I.start_exact_map(spark, path, "a int, b int, v double", store, state, "a", "b", "v").awaitTermination()
    first = [(1, 1, float(k)) for k in range(5)] + [(2, 1, 7.0), (None, 1, 5.0)]
    spark.createDataFrame(first, "a int, b int, v double").coalesce(1).write.parquet(path)
    run()
    for cell in (tmp_path / "store" / "rows" / "batch=0" / "a=2" / "b=1").iterdir():
        cell.write_bytes(b"not a table")
    spark.createDataFrame([(1, 1, 100.0), (3, 0, 1.0)], "a int, b int, v double").coalesce(1).write.mode("append").parquet(path)
    run()
    found = {(r.a, r.b): (r.n, r.quantiles[1], r.total) for r in I.current_map(spark, f"{store}/map").collect()}
    assert found == {(1, 1): (6, 2.5, 110.0), (2, 1): (1, 7.0, 7.0), (3, 0): (1, 1.0, 1.0)}
    shutil.rmtree(tmp_path / "store" / "rows" / "batch=0" / "a=2")
