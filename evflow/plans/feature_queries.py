"""Feature tables that users build first, over events, jets, tracks and hits made of the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evflow.operators import builders as B
from evflow.plans.catalog import query, table
from evflow.sources import collections as C

ORDERED = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def lines(spark, d):
    """Lines of each order, with the order's event and a slot."""
    slot = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDERED)) - 1
    return table(spark, d, "lineitem").withColumns({"event": F.col("l_orderkey") % 100, "slot": slot})


LINES = "n AS (SELECT *, l_orderkey % 100 AS event, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS slot FROM lineitem)"


# --- constituents and labels of jets ----------------------------------------------------------------------------------------


@query(
    "b1_b2_padded_constituents",
    f"""WITH {LINES}, c AS (SELECT l_orderkey AS jet, slot, l_quantity AS pt, l_discount * 20 - 1 AS eta, l_tax * 30 - 1.2 AS phi, l_partkey % 6 AS id, l_suppkey % 3 - 1 AS charge FROM n WHERE l_partkey % 7 <> 0 AND slot < 4),
 j AS (SELECT o_orderkey AS jet, o_totalprice / 1000 AS pt, (o_orderkey % 40) / 20.0 - 1 AS eta, (o_orderkey % 62) / 10.0 - 3.1 AS phi FROM orders),
 r AS (SELECT c.jet, slot, c.pt, c.pt / j.pt AS rel, c.eta - j.eta AS deta, ((c.phi - j.phi + pi()) - 2 * pi() * floor((c.phi - j.phi + pi()) / (2 * pi()))) - pi() AS dphi, id = 3 AS photon, id = 0 AND charge > 0 AS plus FROM c JOIN j USING (jet))
 SELECT jet, count(*) AS n_filled, round(sum(ln(pt)), 3) AS sum_log, round(sum(rel), 3) AS sum_rel, round(sum(deta), 3) AS sum_deta, round(sum(dphi), 3) AS sum_dphi, sum(CASE WHEN photon THEN 1 ELSE 0 END)::DOUBLE AS photons, sum(CASE WHEN plus THEN 1 ELSE 0 END)::DOUBLE AS plus, round(arg_min(pt, slot), 3)::DOUBLE AS first_pt FROM r GROUP BY 1""",
)
def b1_b2(spark, d):
    rows = lines(spark, d)
    place = F.col("l_orderkey") * 8 + F.col("slot")
    jets = table(spark, d, "orders").select((F.col("o_orderkey") % 100).alias("event"), F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") / 1000).alias("pt"), ((F.col("o_orderkey") % 40) / 20 - 1).alias("eta"), ((F.col("o_orderkey") % 62) / 10 - 3.1).alias("phi"))
    links = rows.select("event", F.col("l_orderkey").alias("jetIdx"), F.when(F.col("l_partkey") % 7 == 0, F.lit(-1)).otherwise(place).alias("candIdx"), "slot")
    cands = rows.select("event", place.alias("idx"), F.col("l_quantity").alias("pt"), (F.col("l_discount") * 20 - 1).alias("eta"), (F.col("l_tax") * 30 - 1.2).alias("phi"), (F.col("l_partkey") % 6).alias("id"), (F.col("l_suppkey") % 3 - 1).alias("charge"))
    names = ["pt", "pt_log", "pt_rel", "deta", "dphi", "isPhoton", "isChargedHadronPlus"]
    found = B.padded_features(B.constituents(jets, links, cands, ["event"], 4), ["event", "jetIdx"], names, 4)

    def total(name):
        return F.aggregate(F.col(name), F.lit(0.0), lambda s, x: s + x.cast("double"))

    sums = {"sum_log": total("pt_log"), "sum_rel": total("pt_rel"), "sum_deta": total("deta"), "sum_dphi": total("dphi"), "first_pt": F.col("pt")[0].cast("double")}
    return found.select(F.col("jetIdx").alias("jet"), total("mask").cast("long").alias("n_filled"), *[F.round(c, 3).alias(n) for n, c in sums.items()], total("isPhoton").alias("photons"), total("isChargedHadronPlus").alias("plus"))


JETS = "j AS (SELECT o_orderkey % 100 AS event, o_orderkey AS idx, o_totalprice / 10000 AS pt, (o_orderkey % 97) / 40.0 - 1.2 AS eta, (o_orderkey % 61) / 10.0 - 3.0 AS phi FROM orders)"
NEAR = {"gj": ("customer", "c_custkey"), "tau": ("supplier", "s_suppkey"), "pt": ("part", "p_partkey")}


def near_sql(name: str, source: str, fields: str) -> str:
    """The nearest object of a kind for each jet, within 0.4."""
    return f"""{name}_m AS (SELECT j.event, j.idx, arg_min(o.idx, (power(j.eta - o.eta, 2) + power(pi() - abs(pi() - abs(j.phi - o.phi)), 2), o.idx)) AS m FROM j JOIN {source} o ON j.event = o.event AND power(j.eta - o.eta, 2) + power(pi() - abs(pi() - abs(j.phi - o.phi)), 2) < 0.16 GROUP BY 1, 2),
 {name}_n AS (SELECT x.event, x.idx, {fields} FROM {name}_m x JOIN {source} o ON o.event = x.event AND o.idx = x.m)"""


OBJECTS = """g AS (SELECT c_custkey % 100 AS event, c_custkey AS idx, c_acctbal / 100 AS pt, (c_custkey % 89) / 40.0 - 1.1 AS eta, (c_custkey % 59) / 10.0 - 2.9 AS phi, (c_custkey % 9) - 3 + CASE WHEN c_custkey % 4 = 0 THEN 21 - (c_custkey % 9) + 3 ELSE 0 END AS parton, CASE c_custkey % 5 WHEN 0 THEN 5 WHEN 1 THEN 4 ELSE 0 END AS hadron FROM customer),
 t AS (SELECT s_suppkey % 100 AS event, s_suppkey AS idx, s_acctbal / 100 AS pt, (s_suppkey % 83) / 40.0 - 1 AS eta, (s_suppkey % 53) / 10.0 - 2.6 AS phi, s_suppkey % 3 - 1 AS charge FROM supplier),
 p AS (SELECT p_partkey % 100 AS event, p_partkey AS idx, p_size::DOUBLE AS pt, (p_partkey % 79) / 40.0 - 1 AS eta, (p_partkey % 47) / 10.0 - 2.3 AS phi, CASE p_partkey % 30 WHEN 0 THEN 11 WHEN 1 THEN -13 ELSE 22 END AS pdg FROM part WHERE p_partkey % 2 = 1 AND p_size > 5),
 el AS (SELECT * FROM p WHERE abs(pdg) = 11), mu AS (SELECT * FROM p WHERE abs(pdg) = 13)"""


@query(
    "b3_jet_labels",
    f"""WITH {JETS}, {OBJECTS}, {near_sql('a', 'g', 'o.pt AS gpt, o.parton, o.hadron')}, {near_sql('b', 't', 'o.pt AS tpt, o.charge')}, {near_sql('c', 'el', 'o.pt AS ept')}, {near_sql('d', 'mu', 'o.pt AS mpt')},
 x AS (SELECT j.event, j.idx, j.pt, gpt, parton, hadron, tpt, charge, ept, mpt, (tpt IS NOT NULL)::INTEGER + (ept IS NOT NULL)::INTEGER + (mpt IS NOT NULL)::INTEGER AS k FROM j LEFT JOIN a_n USING (event, idx) LEFT JOIN b_n USING (event, idx) LEFT JOIN c_n USING (event, idx) LEFT JOIN d_n USING (event, idx)),
 y AS (SELECT *, CASE WHEN k = 0 AND gpt > 5 AND hadron = 5 THEN 0 WHEN k = 0 AND gpt > 5 AND hadron = 4 THEN 1 WHEN k = 0 AND gpt > 5 AND hadron = 0 AND parton BETWEEN -3 AND 3 THEN 2 WHEN k = 0 AND gpt > 5 AND hadron = 0 AND parton = 21 THEN 3
  WHEN k = 1 AND tpt IS NOT NULL AND gpt > 5 AND charge > 0 THEN 4 WHEN k = 1 AND tpt IS NOT NULL AND gpt > 5 AND charge < 0 THEN 5 WHEN k = 1 AND mpt IS NOT NULL THEN 6 WHEN k = 1 AND ept IS NOT NULL THEN 7 ELSE -1 END AS label FROM x),
 z AS (SELECT *, CASE WHEN label < 0 THEN 0 WHEN k = 0 THEN gpt ELSE coalesce(tpt, ept, mpt) END AS true_pt FROM y)
 SELECT idx, label::INTEGER AS label, round(greatest(0.3, least(2, CASE WHEN pt > 0 THEN true_pt / pt ELSE 0 END)), 6) AS target, round(true_pt, 6) AS true_pt, label >= 0 AND true_pt > 5 AS keep FROM z""",
)
def b3(spark, d):
    def placed(name, key, eta, phi, low, pt, *more):
        k = F.col(key)
        return table(spark, d, name).select((k % 100).alias("event"), k.alias("idx"), pt.alias("pt"), ((k % eta) / 40 - low).alias("eta"), ((k % phi) / 10 - {61: 3.0, 59: 2.9, 53: 2.6, 47: 2.3}[phi]).alias("phi"), *more)

    c = F.col("c_custkey")
    jets = placed("orders", "o_orderkey", 97, 61, 1.2, F.col("o_totalprice") / 10000)
    gluon = F.when(c % 4 == 0, 21 - (c % 9) + 3).otherwise(0)
    gen = placed("customer", "c_custkey", 89, 59, 1.1, F.col("c_acctbal") / 100, ((c % 9) - 3 + gluon).alias("partonFlavour"), F.when(c % 5 == 0, 5).when(c % 5 == 1, 4).otherwise(0).alias("hadronFlavour"))
    taus = placed("supplier", "s_suppkey", 83, 53, 1.0, F.col("s_acctbal") / 100, (F.col("s_suppkey") % 3 - 1).alias("charge"))
    p = F.col("p_partkey")
    particles = placed("part", "p_partkey", 79, 47, 1.0, F.col("p_size").cast("double"), F.when(p % 30 == 0, 11).when(p % 30 == 1, -13).otherwise(22).alias("pdgId"), (p % 2).cast("int").alias("statusFlags"))
    found = B.label_jets(jets, gen, taus, particles, ["event"])
    return found.select("idx", "label", F.round("target", 6).alias("target"), F.round("true_pt", 6).alias("true_pt"), "keep")


# --- tracks and their refits ------------------------------------------------------------------------------------------------


def refitted(spark, d):
    """Orders as tracks and their variants, lines as hits."""
    k, c, price = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice") / 100000
    orders = table(spark, d, "orders")
    place = [(k % 100).alias("event"), k.alias("idx")]
    helix = {p: price * f for p, f in (("rInv", 1.0), ("phi", 0.5), ("tanL", 2.0), ("z0", 3.0), ("d0", 0.25))}
    reference = orders.select(
        *place, (c % 65536).alias("hwTanl"), (k % 4096).alias("hwZ0"), (k % 8).alias("hwBendChi2"), (c % 7).alias("nStubs"), (c % 128).alias("hitPattern"), (k % 16).alias("hwChi2RPhi"), (c % 16).alias("hwChi2RZ"),
        (F.col("o_orderstatus") == "F").alias("genuine"), F.lit(False).alias("unknown"), price.alias("trkMVA1"), *[v.alias(n) for n, v in helix.items()],
    )
    variant = orders.select(
        *place, (k % 5).alias("nCrossings"), (k % 4).alias("nAcceptedHits"), (c % 16).alias("layerHitMask"), (k % 3).alias("maxWindowMult"), (k % 2).cast("int").alias("anyWindowTruncated"), (c % 6).alias("nKFUpdates"),
        F.when(k % 11 == 0, -999.0).otherwise(price * 10).alias("chi2IncRPhiTot"), F.when(k % 13 == 0, -999.0).otherwise(price * 20).alias("chi2IncRZTot"), (k % 5 != 0).alias("refitPerformed"),
        (c % 4096).alias("hwTanl"), (k % 100).alias("hwZ0"), (k % 4).alias("hwBendChi2"), (k % 128).alias("hitPattern"), (c % 8).alias("hwChi2RPhi"), (k % 8).alias("hwChi2RZ"), *[(v * 1.5).alias(n) for n, v in helix.items()],
    )
    part = F.col("l_partkey")
    hits = lines(spark, d).select(
        "event", F.col("l_orderkey").alias("trackIdx"), (F.col("slot") % 4 + 1).cast("int").alias("layer"), F.when(part % 11 == 0, -999.0).otherwise(F.col("l_discount") * 10).alias("pull_x"), (F.col("l_tax") * 10).alias("pull_y"), F.col("l_quantity").alias("res_x"), (F.col("l_quantity") / 2).alias("res_y"),
        F.when(part % 7 == 0, -999.0).otherwise(F.col("l_discount") * 5).alias("pull_alpha"), (F.col("l_tax") * 5).alias("pull_beta"), (part % 2 == 0).alias("has_alpha"), (part % 3 == 0).alias("has_beta"), F.col("l_tax").alias("sig_alpha"), F.col("l_discount").alias("sig_beta"),
    )
    return reference, variant, hits


SIGNED = "(CASE WHEN ctan >= 32768 THEN ctan - 65536 ELSE ctan END)::DOUBLE AS tanl, (CASE WHEN kz >= 2048 THEN kz - 4096 ELSE kz END)::DOUBLE AS z0_scaled"
GAPS = "(CASE WHEN hp = 0 THEN 0 ELSE floor(log2(hp)) - floor(log2(hp & -hp)) + 1 - bit_count(hp) END)::DOUBLE AS gaps"
TRACKS = f"""{LINES}, k AS (SELECT o_orderkey AS idx, o_custkey AS c, o_totalprice / 100000 AS p, o_orderstatus = 'F' AS good, (o_custkey % 65536) AS ctan, o_orderkey % 4096 AS kz, (o_custkey % 128)::INTEGER AS hp FROM orders),
 w AS (SELECT *, {SIGNED}, {GAPS} FROM k),
 h AS (SELECT l_orderkey AS idx, CASE WHEN l_partkey % 11 = 0 THEN -999.0 ELSE l_discount * 10 END AS px, l_tax * 10 AS py, l_quantity AS rx, CASE WHEN l_partkey % 7 = 0 THEN -999.0 ELSE l_discount * 5 END AS pa, l_tax * 5 AS pb, l_partkey % 2 = 0 AS ha, l_partkey % 3 = 0 AS hb, l_tax AS sa, slot % 4 + 1 AS layer FROM n),
 s AS (SELECT idx, count(*) AS n_hits, sum(px * px) AS sx, max(rx) AS mx, sum(CASE WHEN ha AND pa > -900 THEN pa * pa END) AS a2, count(CASE WHEN ha AND pa > -900 THEN 1 END) AS na, avg(sa) AS ms, sum(CASE WHEN hb THEN pb * pb END) AS b2, sum(CASE WHEN px > -900 THEN px * px END) AS gx, sum(CASE WHEN pa > -900 THEN pa * pa END) AS ga FROM h GROUP BY 1)"""


def log_sql(x: str) -> str:
    return f"ln(1 + greatest({x}, 0))"


@query(
    "b7_refit_tier_d",
    f"WITH {TRACKS} SELECT w.idx, round((tanl)::FLOAT::DOUBLE, 3) AS tanl, gaps AS nlaymiss_interior, (c % 6)::DOUBLE AS nKFUpdates, round((p * 3 * 0.5)::FLOAT::DOUBLE, 4) AS dZ0, coalesce(n_hits, 0)::DOUBLE AS n_hits, round((coalesce(mx, 0))::FLOAT::DOUBLE, 3) AS max_abs_res_x, round(({log_sql('CASE WHEN w.idx % 11 = 0 THEN -999 ELSE p * 10 END')})::FLOAT::DOUBLE, 4) AS chi2IncRPhiTot, round(({log_sql('CASE WHEN w.idx % 13 = 0 THEN -999 ELSE p * 20 END')})::FLOAT::DOUBLE, 4) AS chi2IncRZTot, round((coalesce(a2, 0))::FLOAT::DOUBLE, 3) AS sum_pull2_alpha, coalesce(na, 0)::DOUBLE AS n_alpha, round((coalesce(ms, 0))::FLOAT::DOUBLE, 4) AS mean_sig_alpha, round((coalesce(b2, 0))::FLOAT::DOUBLE, 3) AS sum_pull2_beta, good::INTEGER AS y, 31 AS n_names FROM w LEFT JOIN s USING (idx)",
)
def b7(spark, d):
    found, names = B.refit_tiers(*refitted(spark, d), ["event"], "D")
    places = {"tanl": 3, "nlaymiss_interior": 3, "nKFUpdates": 3, "dZ0": 4, "n_hits": 3, "max_abs_res_x": 3, "chi2IncRPhiTot": 4, "chi2IncRZTot": 4, "sum_pull2_alpha": 3, "n_alpha": 3, "mean_sig_alpha": 4, "sum_pull2_beta": 3}
    return found.select("idx", *[F.round(F.col(c).cast("double"), n).alias(c) for c, n in places.items()], "y", F.lit(len(names)).alias("n_names"))


@query("b7_words_of_the_variant", "WITH k AS (SELECT o_orderkey AS idx, o_custkey % 4096 AS t, o_orderkey % 100 AS z, (o_orderkey % 128)::INTEGER AS hp, o_custkey % 7 AS st, o_orderkey % 4 AS be, o_orderstatus FROM orders) SELECT idx, t::FLOAT AS tanl, z::FLOAT AS z0_scaled, be::FLOAT AS bendchi2_bin, st::FLOAT AS nstub, (CASE WHEN hp = 0 THEN 0 ELSE floor(log2(hp)) - floor(log2(hp & -hp)) + 1 - bit_count(hp) END)::FLOAT AS nlaymiss_interior, (o_orderstatus = 'F')::INTEGER AS y FROM k")
def b7_words(spark, d):
    found, _ = B.refit_tiers(*refitted(spark, d), ["event"], "A", words_of_variant=True)
    return found.select("idx", "tanl", "z0_scaled", "bendchi2_bin", "nstub", "nlaymiss_interior", "y")


@query(
    "b8_contract_vector",
    f"WITH {TRACKS} SELECT w.idx, (w.idx % 5)::DOUBLE AS nCrossings, (c % 16)::DOUBLE AS layerHitMask, round((coalesce(gx, 0))::FLOAT::DOUBLE, 3) AS sumPullX2, round((coalesce(ga, 0))::FLOAT::DOUBLE, 3) AS sumPullAlpha2, round((CASE WHEN w.idx % 11 = 0 THEN 0 ELSE p * 10 END)::FLOAT::DOUBLE, 3) AS chi2IncRPhiTot, round((p * 0.5)::FLOAT::DOUBLE, 4) AS dRinv, round((p * 0.25 * 1.5)::FLOAT::DOUBLE, 4) AS dD0, round((p)::FLOAT::DOUBLE, 4) AS seedTrkMVA1, tanl, gaps AS nlaymiss_interior, good::INTEGER AS y, 24 AS n_names FROM w LEFT JOIN s USING (idx) WHERE w.idx % 5 <> 0",
)
def b8(spark, d):
    found = B.contract_vector(*refitted(spark, d), ["event"], 1)
    places = {"nCrossings": 3, "layerHitMask": 3, "sumPullX2": 3, "sumPullAlpha2": 3, "chi2IncRPhiTot": 3, "dRinv": 4, "dD0": 4, "seedTrkMVA1": 4, "tanl": 3, "nlaymiss_interior": 3}
    return found.select("idx", *[F.round(F.col(c).cast("double"), n).alias(c) for c, n in places.items()], "y", F.lit(len(found.columns) - 3).alias("n_names"))


#: A small ensemble over the contract vector, as a producer would load it.
STUMPS = {
    "init_predict": [0.1],
    "norm": 1.0,
    "trees": [
        [{"feature": [B.CONTRACT_V1.index("nCrossings"), -2, -2], "threshold": [2.5, 0, 0], "children_left": [1, -1, -1], "children_right": [2, -1, -1], "value": [0, -0.5, 0.75]}],
        [{"feature": [B.CONTRACT_V1.index("nlaymiss_interior"), -2, -2], "threshold": [1.5, 0, 0], "children_left": [1, -1, -1], "children_right": [2, -1, -1], "value": [0, 0.25, -1.0]}],
    ],
}


@query("b6_refit_scores", f"WITH {TRACKS}, m AS (SELECT idx, (0.1::FLOAT + CASE WHEN idx % 5 <= 2.5 THEN -0.5 ELSE 0.75 END::FLOAT + CASE WHEN gaps <= 1.5 THEN 0.25 ELSE -1.0 END::FLOAT)::FLOAT AS v FROM w WHERE idx % 5 <> 0) SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(1 / (1 + exp(-v::DOUBLE)), 0), 5) AS score FROM n LEFT JOIN m ON m.idx = CASE WHEN l_partkey % 9 = 0 THEN -1 ELSE l_orderkey END")
def b6(spark, d):
    rows = lines(spark, d).select("event", "l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 9 == 0, F.lit(-1)).otherwise(F.col("l_orderkey")).alias("trk"))
    reference, variant, hits = refitted(spark, d)
    found = B.refit_scores(rows, reference, variant, hits, ["event"], "trk", STUMPS)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("refit_bdt_score").cast("double"), 5).alias("score"))


@query(
    "b12_study_sets",
    f"WITH {TRACKS}, l AS (SELECT idx, min(CASE WHEN layer = 1 THEN rx END) AS a, min(CASE WHEN layer = 3 THEN rx END) AS b FROM h GROUP BY 1) SELECT w.idx, round(({log_sql('least(coalesce(gx, 0), 2e6)')})::FLOAT::DOUBLE, 4) AS sumPullX2_log, round((coalesce(a, 0))::FLOAT::DOUBLE, 3)::DOUBLE AS \"resX_L1\", round((coalesce(b, 0))::FLOAT::DOUBLE, 3)::DOUBLE AS \"resX_L3\", tanl, 8 AS n_sets, 57 AS n_full FROM w LEFT JOIN s USING (idx) LEFT JOIN l USING (idx) WHERE w.idx % 5 <> 0",
)
def b12(spark, d):
    reference, variant, hits = refitted(spark, d)
    wide = hits.select("event", "trackIdx", "layer", *[F.col("res_x").cast("double").alias(c) for c in B.STUDY_COLUMNS["fullL"]])
    found, sets = B.study_sets(B.contract_vector(reference, variant, hits, ["event"]), wide, B.track_quality(reference), ["event"], [1, 2, 3, 4])
    return found.select("idx", *[F.round(F.col(c).cast("double"), n).alias(c) for c, n in (("sumPullX2_log", 4), ("resX_L1", 3), ("resX_L3", 3), ("tanl", 3))], F.lit(len(sets)).alias("n_sets"), F.lit(len(sets["spec17+fullL"])).alias("n_full"))


@query("b14_track_records", f"WITH {LINES}, h AS (SELECT l_orderkey AS idx, count(*) AS n_hits, list(slot % 4 + 1 ORDER BY slot % 4 + 1) AS layers, count(CASE WHEN l_partkey % 2 = 0 THEN 1 END) AS n_stubs, sum(CASE WHEN l_partkey % 2 = 0 THEN l_tax END) AS r FROM n GROUP BY 1) SELECT o_orderkey AS idx, coalesce(n_hits, 0)::INTEGER AS n_hits, coalesce(array_to_string(layers, ','), '') AS layers, coalesce(n_stubs, 0)::INTEGER AS n_stubs, round(coalesce(r, 0), 4) AS sum_r FROM orders LEFT JOIN h ON idx = o_orderkey")
def b14(spark, d):
    reference, _, hits = refitted(spark, d)
    stubs = lines(spark, d).select("event", F.col("l_orderkey").alias("trackIdx"), F.col("slot").alias("layer"), (F.col("l_partkey") % 2 == 0).alias("isBarrel"), F.col("l_tax").cast("double").alias("r"), *[F.lit(0.0).alias(c) for c in "xyz"])
    found = B.track_records(reference.select("event", "idx"), hits, stubs, ["event"])
    layers = F.array_join(F.transform("hits", lambda h: h["layer"].cast("string")), ",")
    total = F.aggregate("stubs", F.lit(0.0), lambda s, x: s + x["r"])
    return found.select("idx", F.coalesce(F.size("hits"), F.lit(0)).alias("n_hits"), F.coalesce(layers, F.lit("")).alias("layers"), F.coalesce(F.size("stubs"), F.lit(0)).alias("n_stubs"), F.round(F.coalesce(total, F.lit(0.0)), 4).alias("sum_r"))


@query("b9_displaced_vertices", "WITH t AS (SELECT p_partkey AS k, p_size::FLOAT AS pt, p_retailprice::FLOAT AS z0 FROM part) SELECT o_orderkey AS idx, coalesce(a.pt, 0)::DOUBLE AS first_pt, coalesce(b.pt, 0)::DOUBLE AS second_pt, round(coalesce(b.z0, 0)::DOUBLE, 2) AS second_z0, round((o_totalprice / 1000)::FLOAT::DOUBLE, 3) AS d_T, (o_orderstatus = 'F')::INTEGER AS y, 20 AS n_features FROM orders LEFT JOIN t a ON a.k = CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey % 2000 END LEFT JOIN t b ON b.k = o_custkey % 2000")
def b9(spark, d):
    parts = table(spark, d, "part").select(F.lit(0).alias("event"), F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("pt"), F.col("p_retailprice").cast("double").alias("z0"), *[F.lit(1.0).alias(c) for c in ("eta", "phi", "d0", "chi2ZRed", "chi2BendRed", "trkMVA1")])
    pairs = table(spark, d, "orders").select(
        F.lit(0).alias("event"), F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(-1)).otherwise(F.col("o_orderkey") % 2000).alias("firstIndexTrk"), (F.col("o_custkey") % 2000).alias("secondIndexTrk"),
        (F.col("o_totalprice") / 1000).alias("d_T"), *[F.lit(0.5).alias(c) for c in ("R_T", "cos_T", "del_Z", "score")], (F.col("o_orderstatus") == "F").alias("isReal"),
    )
    found = B.displaced_vertices(pairs, parts, ["event"])
    return found.select("idx", F.col("first_pt").cast("double").alias("first_pt"), F.col("second_pt").cast("double").alias("second_pt"), F.round(F.col("second_z0").cast("double"), 2).alias("second_z0"), F.round(F.col("d_T").cast("double"), 3).alias("d_T"), "y", F.lit(len(found.columns) - 4).alias("n_features"))


# --- what tables hold -------------------------------------------------------------------------------------------------------


@query("s5_s6_inventory", "SELECT split_part(column_name, '_', 1) AS prefix, count(*) AS n, array_to_string(list(column_name ORDER BY column_name), ' ') AS columns, CASE split_part(column_name, '_', 1) WHEN 'o' THEN 'o_custkey: no target table' ELSE '' END AS missing FROM (DESCRIBE SELECT * FROM orders JOIN lineitem ON l_orderkey = o_orderkey) GROUP BY 1")
def s5_s6(spark, d):
    """Columns of two joined tables by prefix, and the references that a file without customers can't follow."""
    tables = {n: table(spark, d, n) for n in ("orders", "lineitem")}
    found = C.inventory(tables["orders"].join(tables["lineitem"], F.col("l_orderkey") == F.col("o_orderkey")))
    missing = C.check_references(tables, {("orders", "o_custkey"): "customer", ("lineitem", "l_orderkey"): "orders", ("nation", "n_regionkey"): "region"})
    said = F.lit("")
    for source, column, _, what in missing:
        said = F.when(F.col("prefix") == source[0], F.lit(f"{column}: {what}")).otherwise(said)
    return found.select("prefix", "n", F.array_join("columns", " ").alias("columns"), said.alias("missing"))


@query("p23_feature_groups", "SELECT o_orderkey, round(ln(greatest(o_totalprice / 1000, 1e-3)), 6) AS log_pt, abs((o_orderkey % 40) / 20.0 - 1) AS abs_eta, o_totalprice / 1000 AS pt FROM orders")
def p23(spark, d):
    """Two groups with a feature in common: each is there once, computed ones by name."""
    names = B.feature_names(["first", "second"], {"first": ["log_pt", "abs_eta"], "second": ["abs_eta", "pt"]})
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("pt"), ((F.col("o_orderkey") % 40) / 20 - 1).alias("eta"))
    return rows.select("o_orderkey", *[B.feature(n) for n in names]).withColumn("log_pt", F.round("log_pt", 6))
