"""Exact tables, closure tests and guards on small fixtures."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from evflow.functions import scalars as S
from evflow.operators import aggregates as A
from evflow.operators import builders as B
from evflow.operators import evaluation as E
from evflow.operators import joins as J
from evflow.operators import modelling as M
from evflow.operators import nested as N
from evflow.operators import selection as K
from evflow.sources import collections as C
from evflow.streaming import incremental as T


def column(spark, values, expr, kind="int"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("v"))).collect()]


def test_interior_gaps(spark):
    assert column(spark, [0b1111111, 0b1000001, 0b0000101, 0b0000001, 0], S.interior_gaps) == [0, 5, 1, 0, 0]


def test_charge_classes(spark):
    flavours = [1, -1, 2, -2, 3, -3, 4, -4, 5, -5, 6, -6, 21, 0]
    assert column(spark, flavours, S.charge_class) == [0, 2, 2, 0, 0, 2, 2, 0, 0, 2, 2, 0, 1, 1]


def test_words_decode(spark):
    lsb = 2 * 20.46912512 / 4096
    got = column(spark, [0, 2048, 4095], lambda v: S.undigitise(v, 12, lsb))
    assert got == pytest.approx([0.5 * lsb, -2047.5 * lsb, -0.5 * lsb])
    bend = [0, 0.5, 1.25, 2, 3, 3.5, 5, 20]
    assert column(spark, [0, 5, 7, 9], lambda v: S.bin_value(v, bend)) == [0, 3.5, 20, None]


def test_angles_and_logs(spark):
    got = column(spark, [math.pi, -math.pi, 3 * math.pi / 2, 0.0, 7.0], S.wrap_angle, "double")
    assert got == pytest.approx([-math.pi, -math.pi, -math.pi / 2, 0.0, 7 - 2 * math.pi])
    assert column(spark, [float("nan"), None, -5.0, 1e9], lambda v: S.log1p_clipped(v, 2e6), "double") == [None, None, 0.0, pytest.approx(math.log1p(2e6))]
    assert column(spark, [1.0, float("nan"), None, 2.0], lambda v: S.in_range(v, 1, 2), "double") == [True, False, False, True]


def test_edges(spark):
    edges = [0.0, 1.0, 2.0]
    assert column(spark, [-0.1, 0.0, 1.0, 2.0, 2.1], lambda v: S.edge_bin(v, edges), "double") == [None, 0, 1, 1, None]
    assert column(spark, [-0.1, 0.0, 1.0, 2.0, 2.1], lambda v: S.clamped_bin(v, edges), "double") == [0, 0, 1, 1, 1]


def test_jet_charge(spark):
    kids = spark.createDataFrame([(1, 1, 4.0), (1, -1, 1.0), (1, 0, 0.0)], "jet long, q int, pt double")
    jets = spark.createDataFrame([(1,), (2,)], "jet long")
    half = {r.jet: r.jet_charge for r in A.jet_charge(kids, jets, ["jet"], "q", "pt", 0.5).collect()}
    assert half[1] == pytest.approx(1 / math.sqrt(5)) and half[2] == 0
    assert A.jet_charge(kids, jets, ["jet"], "q", "pt", 0.5, False).where("jet = 1").first().jet_charge == pytest.approx(1 / 3)
    assert A.jet_charge(kids, jets, ["jet"], "q", "pt", 1.0).where("jet = 1").first().jet_charge == pytest.approx(0.6)


def test_kernels():
    assert A.kernel_weights("triangular", 3) == [0.5, 1, 0.5]
    assert A.kernel_weights("epanechnikov", 3) == [0.75, 1, 0.75]
    with pytest.raises(ValueError):
        A.kernel_weights("square", 3)


def fit(spark, rows, width=3, **options):
    points = spark.createDataFrame(rows, "event long, z double, pt double, phi double, d0 double")
    events = points.select("event").distinct()
    w = F.least(F.col("pt"), F.lit(50.0))
    filled = A.weighted_histogram(points, ["event"], "z", w, -20.0, 20.0, 256)
    start = A.peak_window(filled, events, ["event"], A.kernel_weights("flat", width), 256)
    windows = A.window_centroid(points, start, ["event"], "z", w, -20.0, 20.0, 256, width)
    return A.transverse_fit(points, windows, ["event"], "z", w, "d0", "phi", **options).first(), windows.first()


def test_vertex_fit_recovers_exactly(spark):
    r = random.Random(1)
    rows = [(1, 3.0 + r.uniform(-0.05, 0.05), r.uniform(2, 9), p, 0.3 * math.sin(p) + 0.1 * math.cos(p)) for p in (r.uniform(-3, 3) for _ in range(25))]
    found, window = fit(spark, rows)
    assert found.vx == pytest.approx(0.3, abs=1e-9) and found.vy == pytest.approx(-0.1, abs=1e-9)
    assert window.z0 == pytest.approx(3.0, abs=0.1)
    flat, _ = fit(spark, [(1, 3.0, 1.0, 0.5, 0.1)] * 5)
    assert flat.vx is None and flat.vy is None
    gated, same = fit(spark, [*rows, (1, 3.0, 9.0, 1.0, 50.0)], gate=1.0)
    assert gated.vx == pytest.approx(0.3, abs=1e-9) and gated.n_window == found.n_window


@pytest.mark.parametrize("kind,width", [("triangular", 3), ("gaussian", 4), ("flat", 9)])
def test_peak_window_against_all_starts(spark, kind, width):
    r, bins, kernel = random.Random(width), 8, A.kernel_weights(kind, width)
    rows = [(e, b, float(r.randint(0, 3))) for e in range(60) for b in r.sample(range(bins), r.randint(1, bins))]
    events = spark.createDataFrame([(e,) for e in range(62)], "event long")
    got = {x.event: x.start for x in A.peak_window(spark.createDataFrame(rows, "event long, bin int, w double"), events, ["event"], kernel, bins).collect()}
    want = {e: 0 for e in range(62)}
    for e in range(60):
        w = {b: x for k, b, x in rows if k == e}
        values = {start: round(sum(c * w.get(start + k, 0.0) for k, c in enumerate(kernel)), 9) for start in range(bins - width + 1)}
        if any(v > 0 for v in values.values()):
            want[e] = min(values, key=lambda s: (-values[s], s))
    assert got == want


def test_peaks_are_made_where_an_events_points_are(spark):
    rows = [(e, 0.37 * k % 64, 1.0 + k % 5) for e in range(200) for k in range(20)]
    points = A.dealt(spark.createDataFrame(rows, "event long, z double, pt double"), ["event"], 100)
    parts = points.select("event", F.spark_partition_id().alias("p")).groupBy("event").agg(F.min("p").alias("low"), F.max("p").alias("high")).collect()
    assert points.rdd.getNumPartitions() == 40 and all(x.low == x.high for x in parts) and len(parts) == 200
    filled = A.weighted_histogram(points, ["event"], "z", F.col("pt"), 0.0, 64.0, 256)
    start = A.peak_window(filled, points.select("event").distinct(), ["event"], A.kernel_weights("triangular", 3), 256)
    plan = A.window_centroid(points, start, ["event"], "z", F.col("pt"), 0.0, 64.0, 256, 3)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and all(re.search(r"hashpartitioning\([^)]*, 40\)", x) for x in shuffles)  # as many partitions as the points have, whatever the stage
    assert not any("bin#" in x or "start#" in x for x in shuffles)


def test_peak_without_weight_starts_at_zero(spark):
    _, window = fit(spark, [(1, 99.0, 1.0, 0.0, 0.0)])
    assert window.start == 0 and window.z0 == pytest.approx((window.edge_low + window.edge_high) / 2)


def test_nearest_match(spark):
    objects = spark.createDataFrame([(1, 0, 0.0, 3.1), (1, 1, 5.0, 0.0), (2, 0, 0.0, 0.0)], "event long, idx long, eta double, phi double")
    targets = spark.createDataFrame([(1, 0, 0.0, -3.1), (1, 1, 0.0, -3.1), (1, 2, 5.0, 0.45)], "event long, idx long, eta double, phi double")
    got = {(r.event, r.idx): r.match for r in J.nearest_match(objects, targets, ["event"], "idx", "idx", 0.4).collect()}
    assert got == {(1, 0): 0, (1, 1): -1, (2, 0): -1}


def test_auc_equals_the_count_of_pairs(spark):
    r = random.Random(2)
    rows = [(r.randrange(20), r.random() < 0.4) for _ in range(300)]
    df = spark.createDataFrame(rows, "score int, pos boolean")
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert E.auc(df, "score", F.col("pos")).first().auc == pytest.approx(want)
    assert E.auc(df.where("pos"), "score", F.col("pos")).first().auc is None


def test_split_is_exact_and_doesn_t_depend_on_partitions(spark):
    df = spark.range(1001).withColumnRenamed("id", "k")
    a = K.exact_split(df.repartition(1), ["k"], 0.3, 5)
    b = K.exact_split(df.repartition(8), ["k"], 0.3, 5)
    assert a.where("is_test").count() == 300
    assert {r.k for r in a.where("is_test").collect()} == {r.k for r in b.where("is_test").collect()}


def test_alignment_and_dangling(spark):
    parents = spark.createDataFrame([(1, 2), (2, 1), (3, 0)], "event long, n int")
    links = spark.createDataFrame([(1, 0), (1, 5), (2, 0)], "event long, ref int")
    N.check_alignment(parents, links, ["event"], "n")
    with pytest.raises(ValueError):
        N.check_alignment(parents, links.where("ref = 0"), ["event"], "n")
    values = spark.createDataFrame([(1, 0), (2, 0)], "event long, idx int")
    assert [tuple(r) for r in N.dangling(links, values, ["event"], "ref", "idx").collect()] == [(1, 5)]


def test_references_and_schemas(spark):
    tables = {"link": spark.createDataFrame([(1, 0)], "event long, jetIdx int")}
    found = C.check_references(tables, {("link", "jetIdx"): "jet", ("link", "candIdx"): "cand", ("hit", "trackIdx"): "track"})
    assert found == [("link", "jetIdx", "jet", "no target table"), ("link", "candIdx", "cand", "no index column")]
    split = spark.createDataFrame([(1.0, 2.0)], "x double, alpha double")
    assert C.unify_sums(split, {"rphi": ("x", "alpha")}).first().rphi == 3.0
    with pytest.raises(ValueError):
        C.unify_sums(split, {"rz": ("y", "beta")})
    assert C.inventory(spark.createDataFrame([(1, 2, 3)], "a_x int, a_y int, b_z int")).orderBy("prefix").first().columns == ["a_x", "a_y"]


def test_feature_groups():
    assert B.feature_names(["trkquality", "vertexdxy_pv", "trkquality"]) == ["trk_trkMVA1", "vtxpv_dxy", "vtxpv_dz"]
    with pytest.raises(KeyError):
        B.feature_names(["nope"])


def tracks(spark, n=30):
    r = random.Random(3)
    rows = [(e, k, r.randrange(65536), r.randrange(4096), r.randrange(8), r.randrange(16), r.randrange(16), r.randrange(128), r.randrange(4, 7), k % 3 != 0, False, 0.01, 0.1, 0.5, 1.0, 0.02, 0.8) for e in range(4) for k in range(n)]
    ref = spark.createDataFrame(rows, "event long, idx long, hwTanl int, hwZ0 int, hwBendChi2 int, hwChi2RPhi int, hwChi2RZ int, hitPattern int, nStubs int, genuine boolean, unknown boolean, rInv double, phi double, tanL double, z0 double, d0 double, trkMVA1 double")
    var = ref.select("event", "idx", (F.col("idx") % 4 != 0).alias("refitPerformed"), *[F.lit(v).alias(c) for c, v in (("nCrossings", 4), ("nAcceptedHits", 3), ("layerHitMask", 15), ("maxWindowMult", 2), ("nKFUpdates", 6))], F.lit(False).cast("int").alias("anyWindowTruncated"), F.lit(-999.0).alias("chi2IncRPhiTot"), F.lit(2.5).alias("chi2IncRZTot"), *[(F.col(c) + 0.5).alias(c) for c in ("rInv", "phi", "tanL", "z0", "d0")])
    hits = ref.select("event", F.col("idx").alias("trackIdx"), F.explode(F.sequence(F.lit(1), F.lit(2))).alias("layer")).select("event", "trackIdx", "layer", F.lit(1.0).alias("pull_x"), F.when(F.col("layer") == 1, -999.0).otherwise(2.0).alias("pull_y"), F.lit(0.1).alias("res_x"), F.lit(-0.2).alias("res_y"), F.lit(-999.0).alias("pull_alpha"), F.lit(3.0).alias("pull_beta"), F.lit(0.5).alias("sig_alpha"), F.lit(0.25).alias("sig_beta"), F.lit(True).alias("has_alpha"), (F.col("layer") == 1).alias("has_beta"))
    return ref, var, hits


def test_refit_tiers_grow(spark):
    ref, var, hits = tracks(spark)
    sizes = []
    for tier in "ABCD":
        table, names = B.refit_tiers(ref, var, hits, ["event"], tier)
        assert table.count() == 120 and len(names) == len(set(names))
        row = table.first()
        assert all(row[n] is not None and not math.isnan(row[n]) for n in names)
        sizes.append(len(names))
    assert sizes[0] == 7 and sizes == sorted(set(sizes))
    assert row.n_hits == 2 and row.sum_pull2_alpha == 0 and row.n_beta == 1 and row.chi2IncRPhiTot == 0
    with pytest.raises(ValueError):
        B.refit_tiers(ref, var, hits, ["event"], "Z")


def test_contract_vector(spark):
    ref, var, hits = tracks(spark)
    v0, v1 = (B.contract_vector(ref, var, hits, ["event"], k) for k in (0, 1))
    assert len(B.CONTRACT) == 17 and len(B.CONTRACT_V1) == 24
    assert v0.count() == var.where("refitPerformed").count()
    key = ["event", "idx"]
    assert v1.select(*key, *B.CONTRACT).exceptAll(v0.select(*key, *B.CONTRACT)).count() == 0
    row = v0.first()
    assert row.chi2IncRPhiTot == 0 and row.sumPullY2 == 4 and row.sumPullAlpha2 == 0 and row.sumPullBeta2 == 18
    assert row.dD0 == pytest.approx(0.52)
    five = B.contract_vector(ref, var, hits, ["event"], 0, True, 5, 5).first()
    assert five.dD0 == pytest.approx(0.5)


def test_truth_guard(spark):
    ref, _, _ = tracks(spark)
    with pytest.raises(ValueError):
        B.track_quality(ref.withColumn("unknown", F.lit(True)))


def test_trees_are_scored_in_single_precision(spark):
    model = {"splitting_convention": "<", "init_predict": [0.1], "norm": 2.0, "trees": [[{"feature": [0, -2, -2], "threshold": [1.5, 0, 0], "children_left": [1, -1, -1], "children_right": [2, -1, -1], "value": [0, 0.2, 0.3]}]]}
    import numpy as np

    got = column(spark, [1.0, 1.5, 2.0], lambda v: M.tree_score(model, [v]), "double")
    f = np.float32
    assert got == [float(f(f(f(0.1) + f(x)) * f(2.0))) for x in (0.2, 0.3, 0.3)]
    with pytest.raises(ValueError):
        M.tree_score(model | {"splitting_convention": ">"}, [F.lit(1.0)])


def test_training_separates(spark):
    r = random.Random(4)
    rows = [(k, float(y) + r.gauss(0, 0.5), r.gauss(0, 1), y) for k in range(600) for y in [k % 2]]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    found = M.train_and_report(df, ["a", "b"], ["k"], rounds=5)
    assert found["auc"] > 0.85 and found["n_pos"] + found["n_neg"] == 150
    assert found["gains"]["a"] > found["gains"]["b"]


def test_labels_of_jets(spark):
    jets = spark.createDataFrame([(1, 0, 20.0, 0.0, 0.0), (1, 1, 20.0, 2.0, 1.0), (1, 2, 20.0, -2.0, 1.0)], "event long, idx long, pt double, eta double, phi double")
    gen = spark.createDataFrame([(1, 0, 18.0, 0.0, 0.1, 5, 5), (1, 1, 4.0, 2.0, 1.0, 21, 0)], "event long, idx long, pt double, eta double, phi double, partonFlavour int, hadronFlavour int")
    taus = spark.createDataFrame([], "event long, idx long, pt double, eta double, phi double, charge int")
    parts = spark.createDataFrame([(1, 0, 15.0, -2.0, 1.0, 13, 1), (1, 1, 15.0, 0.0, 0.0, 11, 0)], "event long, idx long, pt double, eta double, phi double, pdgId int, statusFlags int")
    got = {r.idx: r for r in B.label_jets(jets, gen, taus, parts, ["event"]).collect()}
    assert [got[k].label for k in range(3)] == [0, -1, 6]
    assert got[0].target == pytest.approx(0.9) and got[0].keep and not got[1].keep and got[2].true_pt == 15
    charge = {r.idx: r.charge_class for r in B.label_charge(jets, gen, ["event"]).collect()}
    assert charge == {0: 0, 1: 1, 2: 1}


def test_jets_at_one_place_are_matched_once(spark, monkeypatch):
    """Twenty jets a place, null ones too: each place is sought once a kind, and all its jets have its labels."""
    r = random.Random(3)
    places = [(k % 2, r.uniform(-0.5, 0.5), r.uniform(-0.5, 0.5)) for k in range(6)] + [(1, None, 0.0), (None, 0.0, 0.0), (0, 0.0, -0.0), (0, -0.0, 0.0)]
    jets = [(e, 20 * k + j, 10.0 + j, eta, phi) for k, (e, eta, phi) in enumerate(places) for j in range(20)]
    gen = [(k % 2, k, 18.0 + k, r.uniform(-0.5, 0.5), r.uniform(-0.5, 0.5), 5, 5) for k in range(8)]
    taus = spark.createDataFrame([], "event int, idx long, pt double, eta double, phi double, charge int")
    parts = spark.createDataFrame([], "event int, idx long, pt double, eta double, phi double, pdgId int, statusFlags int")
    sought = []
    monkeypatch.setattr(B, "nearest_match", lambda objects, *a: (sought.append(objects.count()), J.nearest_match(objects, *a))[1])
    frames = spark.createDataFrame(jets, "event int, idx long, pt double, eta double, phi double"), spark.createDataFrame(gen, "event int, idx long, pt double, eta double, phi double, partonFlavour int, hadronFlavour int")
    got = {x.idx: x for x in B.label_jets(*frames, taus, parts, ["event"]).collect()}
    assert sought == [8] * 4 and sorted(got) == list(range(200))
    for e, k, pt, eta, phi in jets:
        near = [] if eta is None else [((eta - g[3]) ** 2 + (phi - g[4]) ** 2, g[2]) for g in gen if g[0] == e]
        near = [x for x in near if x[0] < 0.16]
        assert (got[k].event, got[k].label) == (e, 0 if near else -1)
        assert got[k].true_pt == (min(near)[1] if near else 0.0) and got[k].target == pytest.approx(max(0.3, min(2.0, got[k].true_pt / pt)))


def test_exact_incremental_map(spark, tmp_path):
    rows = [(k % 2, k % 3, float(k)) for k in range(120)]
    schema = "a int, b int, value double"
    df = spark.createDataFrame(rows, schema)
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    df.where("value < 60").repartition(2).write.parquet(source)
    for _ in range(2):
        T.refresh_exact(spark, source, schema, store, str(tmp_path / "state"), "a", "b", "value").awaitTermination()
    df.where("value >= 60").write.mode("append").parquet(source)
    T.refresh_exact(spark, source, schema, store, str(tmp_path / "state"), "a", "b", "value").awaitTermination()
    want = A.residual_map(df, "a", "b", "value", 2, 3, 10)
    got = T.exact_map(spark, store, "a", "b", "value", 2, 3)
    assert sorted(map(tuple, A.residual_map(spark.read.parquet(store), "a", "b", "value", 2, 3, 10).collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 6


def test_auc_by_length_holds_every_labelled_document(spark, tmp_path):
    from evflow.plans.registry import QUERIES

    docs = [(k, 100 * (k % 200), "en") for k in range(9_000, 13_000)]
    spark.createDataFrame(docs, "doc_id long, n_chars long, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, k % 3 // 2) for k, _, _ in docs], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["e15_auc_by_length"](spark, str(tmp_path)).collect()
    assert sum(x.n_pos + x.n_neg for x in got) == len(docs)
    assert {x.bin: x.n_pos + x.n_neg for x in got} == {0: 100, 1: 100, 2: 200, 3: 400, 4: 3200}


def test_constituents_make_the_baseline_features(spark):
    jets = spark.createDataFrame([(0, 0, 10.0, 0.5, 3.0), (0, 1, 0.0, 0.0, 0.0)], "event int, idx int, pt double, eta double, phi double")
    links = spark.createDataFrame([(0, 0, 1, 0), (0, 0, 0, 1), (0, 1, 2, 0), (0, 0, 2, 5)], "event int, jetIdx int, candIdx int, slot int")
    kinds = [(0, 0, 5.0, 0.4, -3.1, 1, -1), (0, 1, 2.0, 0.6, 2.9, 3, 0), (0, 2, 1.0, 0.0, 0.1, 0, 1)]
    rows = [(*k, 0.1, 1.0, 2.0, 0.5, 4.0, 3.0) for k in kinds]
    cands = spark.createDataFrame(rows, "event int, idx int, pt double, eta double, phi double, id int, charge int, mass double, z0 double, dxy double, puppiweight double, emid double, quality double")
    names = B.feature_names(["baseline"])
    got = {r.jetIdx: r for r in B.padded_features(B.constituents(jets, links, cands, ["event"], 3), ["event", "jetIdx"], names, 3).collect()}
    first = {n: list(got[0][n]) for n in names}
    assert first["pt"] == [2.0, 5.0, 0.0] and first["isfilled"] == [1.0, 1.0, 0.0]
    assert first["isPhoton"] == [1.0, 0.0, 0.0] and first["isElectronMinus"] == [0.0, 1.0, 0.0] and first["isElectronPlus"] == [0.0] * 3
    assert [round(x, 5) for x in first["pt_rel"]] == [0.2, 0.5, 0.0] and round(first["dphi"][1], 4) == round(-3.1 - 3.0 + 2 * 3.141592653589793, 4)
    assert got[1]["pt_rel"][0] == 0.0 and got[1]["isChargedHadronPlus"][0] == 1.0


def test_running_sums_by_ranges(spark):
    r = random.Random(5)
    rows = [(g, v, r.randrange(1, 9)) for g in ("a", None) for v in r.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "g string, v int, n int")
    for parts in (2, 7):
        for row in E.running_sums(df, "v", ["n"], ["g"], parts).collect():
            assert row.n_before == sum(n for g, v, n in rows if g == row.g and v < row.v)
    assert E.running_sums(df.where("v < 0"), "v", ["n"]).count() == 0


def test_normal_distribution(spark):
    xs = [-7.0, -6.0, -2.5, -0.3, 0.0, 1.0, 4.0, 6.0, 9.0]
    assert column(spark, xs, S.normal_cdf, "double") == pytest.approx([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], abs=2e-9)


def estimate(spark, rows, **options):
    points = spark.createDataFrame(rows, "event long, z double, pt double, phi double, d0 double")
    windows = spark.createDataFrame([(1, -1.0, 1.0), (2, -1.0, 1.0)], "event long, edge_low double, edge_high double")
    return {x.event: x for x in A.vertex_estimate(points, windows, ["event"], "z", F.least(F.col("pt"), F.lit(50.0)), "d0", "phi", **options).collect()}


def test_vertex_estimate(spark):
    r = random.Random(2)
    rows = [(1, r.uniform(-0.9, 0.9), r.uniform(2, 90), p, 0.3 * math.sin(p) + 0.1 * math.cos(p) + r.gauss(0, 0.01)) for p in (r.uniform(-3, 3) for _ in range(12))] + [(1, 5.0, 9.0, 0.0, 9.0)]
    found = estimate(spark, rows)
    one, empty = found[1], found[2]
    kept = [(min(pt, 50), math.sin(p), math.cos(p), d) for _, z, pt, p, d in rows if -1 <= z < 1]
    rest = sum(w * (d - one.vx * s + one.vy * c) ** 2 for w, s, c, d in kept)
    assert one.n_window == 12 and one.vx == pytest.approx(0.3, abs=0.02) and one.vy == pytest.approx(-0.1, abs=0.02)
    assert one.scatter == pytest.approx(math.sqrt(rest / sum(w for w, *_ in kept)), rel=1e-6)
    for step in (1e-4, -1e-4):
        assert sum(w * (d - (one.vx + step) * s + one.vy * c) ** 2 for w, s, c, d in kept) > rest
    assert one.vx_sig == pytest.approx(one.vx / one.sigma_vx)
    assert empty.n_window == 0 and empty.sum_w == 0 and empty.vx is None and empty.condition is None
    even = estimate(spark, rows, isotropic=True)[1]
    assert even.vx == pytest.approx(2 * sum(w * d * s for w, s, c, d in kept) / sum(w for w, *_ in kept))
    gated = estimate(spark, [(1, 0.0, 5.0, 0.2, 1.0), (1, 0.0, 5.0, 1.2, 2.0), (2, 0.0, 5.0, 0.2, 1.0)], gate=1.0)
    assert gated[1].n_window == 1 and gated[1].vx is None and gated[1].sum_w == 5


def test_vertex_features_need_impact_parameters(spark):
    points = spark.createDataFrame([(1, 0.0, 5.0, 0.2, 0.0)], "event long, z double, pt double, phi double, d0 double")
    windows = spark.createDataFrame([(1, -1.0, 1.0)], "event long, edge_low double, edge_high double")
    with pytest.raises(ValueError):
        B.vertex_features(points, windows, ["event"], "z", F.col("pt"), "d0", "phi")


def test_refit_scores(spark):
    ref, var, hits = tracks(spark, 6)
    leaf = {"feature": [B.CONTRACT_V1.index("seedTrkMVA1"), -2, -2], "threshold": [0.5, 0, 0], "children_left": [1, -1, -1], "children_right": [2, -1, -1], "value": [0, -1.0, 1.5]}
    model = {"splitting_convention": "<=", "init_predict": [0.5], "norm": 1.0, "trees": [[leaf]]}
    cands = spark.createDataFrame([(0, 0, 1), (0, 1, 4), (0, 2, -1)], "event long, idx long, trk long")
    got = {r.idx: r.refit_bdt_score for r in B.refit_scores(cands, ref, var, hits, ["event"], "trk", model).collect()}
    assert got == {0: pytest.approx(1 / (1 + math.exp(-2.0))), 1: 0.0, 2: 0.0}


def test_study_sets(spark):
    ref, var, hits = tracks(spark, 4)
    wide = hits.select("event", "trackIdx", "layer", *[F.col("layer").cast("double").alias(c) for c in B.STUDY_COLUMNS["fullL"]])
    vector = B.contract_vector(ref, var, hits, ["event"])
    table, sets = B.study_sets(vector, wide, B.track_quality(ref), ["event"], [1, 2, 3])
    assert {k: len(v) for k, v in sets.items()} == {"spec17": 17, "spec17_guard": 17, "spec17+pullL": 29, "spec17+occL": 20, "spec17+chi2L": 23, "spec17+fullL": 47, "perlayer_subst": 41, "spec17+tierA": 24}
    row = table.select(*dict.fromkeys(n for names in sets.values() for n in names)).first()
    assert row.resX_L2 == 2 and row.resX_L3 == 0 and row.sumPullY2_log == pytest.approx(math.log(5))
    assert table.count() == vector.count()


def test_model_matrix(spark):
    ref, var, hits = tracks(spark, 60)
    cells = {(t, c): B.refit_tiers(ref, var, hits, ["event"], t) for t in "AB" for c in ("x", "y")}
    rows = M.model_matrix(cells, ["event", "idx"], rounds=1).collect()
    assert [(r.tier, r.config) for r in rows] == [("A", "*"), ("B", "x"), ("B", "y")]
    assert all(0 <= r.auc <= 1 and set(r.fake_rates) == {"0.95", "0.97", "0.99"} for r in rows)


@pytest.mark.parametrize("radius", [0.4, 2.5, 7.0])
def test_nearest_match_meets_every_near_pair(spark, radius):
    r = random.Random(9)
    place = lambda: (r.uniform(-3, 3), r.choice([-math.pi, math.pi, r.uniform(-math.pi, math.pi)]))
    objects = [(e, k, *place()) for e in range(3) for k in range(40)]
    targets = [(e, k, *place()) for e in range(2) for k in range(30)] + [(0, 90, None, 0.0)]
    found = J.nearest_match(spark.createDataFrame(objects, "e int, idx int, eta double, phi double"), spark.createDataFrame(targets, "e int, t int, eta double, phi double"), ["e"], "idx", "t", radius)
    got = {(x.e, x.idx): x.match for x in found.collect()}
    for e, k, eta, phi in objects:
        near = [((eta - b) ** 2 + (math.pi - abs(math.pi - abs(phi - c))) ** 2, t) for f, t, b, c in targets if f == e and b is not None]
        near = [x for x in near if x[0] < radius * radius]
        assert got[e, k] == (min(near)[1] if near else -1)
    assert len(got) == len(objects)


@pytest.mark.parametrize("most", [1, 3])
def test_nearest_match_of_crowded_and_far_places(spark, most):
    """A dense crowd, a few places apart, and objects in, around and far off both: one list a pass, whatever the density."""
    r = random.Random(4)
    crowd = [(1, k, round(r.gauss(0, 0.02), 3), round(r.gauss(3.1, 0.02), 3)) for k in range(200)]
    targets = [*crowd, *[(1, 200 + k, r.uniform(-3, 3), r.uniform(-math.pi, math.pi)) for k in range(10)], *[(1, 300 + k, *crowd[k][2:]) for k in range(20)]]
    objects = [(1, k, r.choice([0.0, r.gauss(0, 0.05), r.uniform(-4, 4)]), r.choice([-3.15, r.uniform(-math.pi, math.pi)])) for k in range(150)] + [(1, 150, None, 0.0), (2, 0, 0.0, 0.0)]
    columns = "e int, idx int, eta double, phi double"
    found = J.nearest_match(spark.createDataFrame(objects, columns), spark.createDataFrame(targets, columns), ["e"], "idx", "idx", 1.2, most)
    got = {(x.e, x.idx): x.match for x in found.collect()}
    assert len(got) == len(objects)
    for e, k, eta, phi in objects:
        near = [] if eta is None else [((eta - b) * (eta - b) + (math.pi - abs(math.pi - abs(phi - c))) ** 2, t) for f, t, b, c in targets if f == e]
        near = [x for x in near if x[0] < 1.44]
        assert got[e, k] == (min(near)[1] if near else -1)


def test_split_takes_its_rows_from_whole_buckets_and_one_ranked(spark):
    """The rows that a rank over all would take, for any share; only the bucket at the edge is ranked."""
    df = spark.range(5000).select((F.col("id") % 2500).alias("k"))
    order = sorted(r.h for r in df.select(K.hash_key("k", seed=2).alias("h")).collect())
    for fraction in (0.0, 0.1, 0.25, 1.0):
        rows = K.exact_split(df, ["k"], fraction, 2).select("is_test", K.hash_key("k", seed=2).alias("h")).collect()
        assert len(rows) == 5000
        assert sorted(r.h for r in rows if r.is_test) == order[: int(5000 * fraction)]
    assert K.exact_split(df.where("false"), ["k"], 0.5).count() == 0
    cut = [r.pid for r in K.exact_split(df.repartition(6), ["k"], 0.25).select(F.spark_partition_id().alias("pid")).distinct().collect()]
    assert len(cut) >= 6


def test_rows_alike_are_fitted_as_one(spark):
    """A table and its fivefold copy give one model; rows of one kind are merged, however many there are."""
    r = random.Random(1)
    kinds = [(float(r.randrange(6)), float(r.randrange(4))) for _ in range(200)]
    df = spark.createDataFrame([(a, b, int(a + b > 4 + r.gauss(0, 1))) for a, b in kinds], "a double, b double, y int")
    fivefold = df.join(spark.range(5).select("id"), how="cross").drop("id")
    merged = M.merged_rows(fivefold, ["a", "b", "y"], 10)
    assert merged.agg(F.sum("_n")).first()[0] == 1000 and merged.count() == df.distinct().count()
    assert merged.rdd.getNumPartitions() == -(-df.distinct().count() // 10)
    models = [M.fit_trees(x, ["a", "b"], rounds=3) for x in (df, fivefold)]
    scores = [{(x.a, x.b): x.score for x in M.with_score(m, df).collect()} for m in models]
    assert scores[0] == pytest.approx(scores[1])
    weights = {x.y: x.weight for x in M.class_weights(merged, "y", "_n").collect()}
    assert weights == pytest.approx({x.y: x.weight for x in M.class_weights(fivefold, "y").collect()})


def noisy_rows(spark, n, seed=3):
    r = random.Random(seed)
    rows = [(k, r.uniform(0, 9), r.choice([None, float("nan"), r.uniform(0, 5)])) for k in range(n)]
    return spark.createDataFrame([(k, a, b, int(a + r.gauss(0, 2) > 5)) for k, a, b in rows], "k int, a double, b double, y int").repartition(3)


def test_best_seed_fits_bins_of_all_rows(spark, monkeypatch):
    """Rows that differ in values, but not in bins, are fitted as one; losses are those of the model on the rows themselves."""
    df, fitted, weigh = noisy_rows(spark, 3000), [], M.class_weights

    def seen(rows, label, times=None):
        fitted.append(rows.agg(F.count(F.lit(1)), F.sum("_n")).first())
        return weigh(rows, label, times)

    monkeypatch.setattr(M, "class_weights", seen)
    for features, most in ((["a"], 2 * 33), (["a", "b"], 2250)):
        fitted.clear()
        model, losses = M.best_seed(df, features, ["k"], [4, 5, 6], rounds=3)
        assert all(rows <= most and times == 2250 for rows, times in fitted)
        losses = {x.seed: (x.loss, x.best) for x in losses.collect()}
        best = min(losses, key=lambda seed: losses[seed][0])
        assert [seed for seed in losses if losses[seed][1]] == [best]
        held = K.exact_split(df, ["k"], 0.25, best).where("is_test")
        assert M.log_loss(M.with_score(model, held, "p"), "p", "y") == pytest.approx(losses[best][0])


def test_shared_splits_are_exact_splits(spark):
    df = noisy_rows(spark, 500)
    for seed, split in M.shared_splits(df, ["k"], [1, 2]).items():
        members = [{(x.k, x.is_test) for x in s.collect()} for s in (split, K.exact_split(df, ["k"], 0.25, seed))]
        assert members[0] == members[1] and len(members[0]) == 500


def test_bins_of_features(spark):
    nan, far = float("nan"), float("inf")
    df = spark.createDataFrame([(float(v), 1.5, None) for v in range(100)] + [(nan, 1.5, None), (None, None, None), (far, nan, None), (-far, 1.5, None)], "a double, b double, c double")
    bins = M.feature_bins(df, ["a", "b", "c"])
    rows = M.with_bins(bins, df).collect()
    assert len({x._bin_a for x in rows[:100]}) == 32 and [x._bin_a for x in rows[:100]] == sorted(x._bin_a for x in rows[:100])
    assert rows[100]._bin_a == rows[101]._bin_a > rows[102]._bin_a >= rows[99]._bin_a and rows[103]._bin_a <= rows[0]._bin_a
    assert {x._bin_b for x in rows} == {1.0, 2.0} and len({x._bin_c for x in rows}) == 1


@pytest.mark.parametrize(("losses", "rounds"), [([3, 2, 1], 3), ([3, 2, 2.5, 1], 4), ([3, 2, 2.5, 2.4, 1], 2), ([3], 1)])
def test_best_round_waits(losses, rounds):
    assert M.best_round(losses, 2) == rounds


def test_rounds_go_on_while_they_gain(spark):
    """Small gains end no rounds, and rounds end where rows that aren't fitted say; rows count as often as they are there."""
    df = M.with_stop(noisy_rows(spark, 4000), ["k"]).select("a", "y", "_stop", (F.hash("k") % 2 == 0).cast("int").alias("chance"))
    model = M.fit_trees(df, ["a"], rounds=24, step=0.05, validation="_stop", patience=24).stages[-1]
    assert model.getNumTrees > 12
    noise = M.fit_trees(df, ["a"], "chance", rounds=20, step=1.0, validation="_stop", patience=3).stages[-1]
    assert noise.getNumTrees < 20
    counted = M.binned_split(df.withColumn("is_test", F.lit(False)), ["a"], "y", "_stop")[1]
    expanded = counted.withColumn("_e", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).withColumn("_n", F.lit(1))
    trees = [M.fit_binned(x, ["a"], rounds=8, step=1.0, validation="_stop", patience=1).stages[-1].getNumTrees for x in (counted, expanded)]
    assert trees[0] == trees[1]


def test_area_counts_rows_as_often_as_they_are(spark):
    r = random.Random(8)
    rows = [(float(r.randrange(6)), r.random() < 0.4, r.randrange(1, 5)) for _ in range(60)]
    df = spark.createDataFrame(rows, "s double, pos boolean, n int")
    expanded = df.withColumn("e", F.explode(F.sequence(F.lit(1), "n")))
    assert E.auc(df, "s", F.col("pos"), times="n").first() == E.auc(expanded, "s", F.col("pos")).first()


def test_ablation_query_does_the_studys_rounds(spark, monkeypatch):
    """80 rounds that may gain for as long as 15, over eight splits, for each set of features."""
    import __spark_entry__

    asked = []
    monkeypatch.setattr(M, "ablation", lambda df, sets, keys, seeds, base, **options: asked.append((len(sets), list(seeds), options)))
    __spark_entry__.queries()["m10_ablation"](spark, "/root/testdata/sf0.001")
    n_sets, seeds, options = asked[0]
    assert n_sets == 3 and seeds == list(range(8))
    assert (options["rounds"], options["depth"], options["step"], options["patience"]) == (80, 3, 0.15, 15)
