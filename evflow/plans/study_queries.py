"""Metrics over classes, seeds and samples, vertex estimates and stacked models on the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from evflow.functions import scalars as S
from evflow.operators import aggregates as A
from evflow.operators import builders as B
from evflow.operators import evaluation as E
from evflow.operators import modelling as M
from evflow.plans.aggregate_queries import TRACKS, windows
from evflow.plans.catalog import query, table
from evflow.plans.evaluation_queries import SCORED, auc_sql, rounded, scored
from evflow.plans.model_queries import learnable

ONE_VS_REST = """SELECT class, score, l_returnflag = class AS pos FROM (SELECT l_returnflag, l_quantity AS "A", l_discount * 100 AS "N", l_tax * 100 AS "R" FROM lineitem) UNPIVOT (score FOR class IN ("A", "N", "R"))"""


@query("e4_one_vs_rest", f"WITH s AS ({ONE_VS_REST}), a AS (WITH {auc_sql('class', 's', 'pos')}) SELECT class, n_pos, n_neg, auc, round(avg(auc) OVER (), 4) AS macro FROM a")
def e4(spark, d):
    lines = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", (F.col("l_discount") * 100).alias("disc"), (F.col("l_tax") * 100).alias("tax"))
    found = E.one_vs_rest(lines, "l_returnflag", {"A": "l_quantity", "N": "disc", "R": "tax"})
    return rounded(found, "auc").withColumn("macro", F.round("macro", 4))


SEEDS = [0, 1, 2]
SPLITS = " UNION ALL ".join(f"SELECT *, {k} AS seed FROM (SELECT *, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || '|{k}'), doc_id) AS place, count(*) OVER () AS whole FROM s) WHERE place <= floor(whole * 0.25)" for k in SEEDS)


@query("e21_auc_over_seeds", f"WITH {SCORED}, t AS ({SPLITS}), a AS (WITH {auc_sql('seed', 't')}) SELECT count(auc) AS n_seeds, round(avg(auc), 4) AS mean_auc, round(stddev_pop(auc), 4) AS std_auc FROM a")
def e21(spark, d):
    found = E.auc_over_seeds(scored(spark, d), "score", F.col("toxic") == 1, ["doc_id"], 0.25, SEEDS)
    return found.select("n_seeds", F.round("mean_auc", 4).alias("mean_auc"), F.round("std_auc", 4).alias("std_auc"))


LEVELS = [0.05, 0.25, 0.5, 0.75, 0.95]
SIDES = ", ".join(f"round(avg(v) FILTER (h = {h}), 2) AS mean_{n}, round(stddev_pop(v) FILTER (h = {h}), 2) AS std_{n}, " + ", ".join(f"round(quantile_cont(v::DOUBLE, {q}) FILTER (h = {h}), 4) AS q{int(q * 100)}_{n}" for q in LEVELS) for h, n in ((0, "left"), (1, "right")))


@query("e10_two_sample_report", f"""WITH x AS (SELECT o_totalprice AS v, o_orderkey % 2 AS h FROM orders), c AS (SELECT v, sum(CASE WHEN h = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN h = 1 THEN 1 ELSE 0 END) AS b FROM x GROUP BY 1),
 u AS (SELECT max(abs(d)) AS ks FROM (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS d FROM c)), n AS (SELECT count(*) FILTER (h = 0) AS n_left, count(*) FILTER (h = 1) AS n_right, {SIDES} FROM x),
 p AS (SELECT sum(2 * power(-1, k - 1) * exp(-2.0 * k * k * ks * ks * n_left * n_right / (n_left + n_right))) AS p FROM generate_series(1, 50) g(k), u, n)
SELECT n.*, round(ks, 6) AS ks, round(least(1.0, greatest(0.0, p)), 6) AS p_value FROM n, u, p""")
def e10(spark, d):
    orders = table(spark, d, "orders")
    found = E.two_sample_report(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), "o_totalprice", tuple(LEVELS))
    sides = [F.round(f"{c}_{n}", 2).alias(f"{c}_{n}") for n in ("left", "right") for c in ("mean", "std")]
    quantiles = [F.round(F.col(f"quantiles_{n}")[k], 4).alias(f"q{int(q * 100)}_{n}") for n in ("left", "right") for k, q in enumerate(LEVELS)]
    return found.select("n_left", "n_right", F.round("ks", 6).alias("ks"), F.round("p_value", 6).alias("p_value"), *sides, *quantiles)


SERIES = reduce(lambda rest, k: f"(1 + v * v / {2 * k + 1} * {rest})", range(60, 0, -1), "1.0")


@query("e11_ks_normal", f"""WITH m AS (SELECT avg(l_extendedprice) AS mu, stddev_pop(l_extendedprice) AS sd FROM lineitem), x AS (SELECT (l_extendedprice - mu) / sd AS v FROM lineitem, m), c AS (SELECT v, count(*) AS n FROM x GROUP BY 1),
 f AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS up, sum(n) OVER () AS total, CASE WHEN v > 6 THEN 1.0 WHEN v < -6 THEN 0.0 ELSE 0.5 + v * {SERIES} * exp(-v * v / 2) / sqrt(2 * pi()) END AS p FROM c)
SELECT any_value(total)::BIGINT AS n, round(max(greatest(up / total - p, p - (up - n) / total)), 6) AS ks FROM f""")
def e11(spark, d):
    """Standardised prices against the standard normal distribution."""
    lines = table(spark, d, "lineitem")
    moments = lines.agg(F.avg("l_extendedprice").alias("mu"), F.stddev_pop("l_extendedprice").alias("sd"))
    values = lines.crossJoin(F.broadcast(moments)).select(((F.col("l_extendedprice") - F.col("mu")) / F.col("sd")).alias("v"))
    return rounded(E.ks_normal(values, "v"), "ks")


@query("a5_charge_of_flags", "WITH c AS (SELECT l_orderkey AS jet, CASE WHEN l_linenumber % 5 IN (0, 1, 4) THEN l_suppkey % 3 - 1 ELSE 0 END AS q, l_extendedprice AS pt FROM lineitem) SELECT o_orderkey AS jet, round(coalesce(v, 0), 6) AS jet_charge FROM orders LEFT JOIN (SELECT jet, sum(q * power(pt, 0.5)) / sum(power(pt, 0.5)) AS v FROM c GROUP BY 1) ON jet = o_orderkey")
def a5(spark, d):
    """Charges come back from the flags of hadrons, electrons and muons."""
    kinds = S.particle_flags(F.col("l_linenumber") % 5, F.col("l_suppkey") % 3 - 1)
    kids = table(spark, d, "lineitem").withColumns(kinds).select(F.col("l_orderkey").alias("jet"), S.charge_of_flags().alias("q"), F.col("l_extendedprice").alias("pt"))
    jets = table(spark, d, "orders").select(F.col("o_orderkey").alias("jet"))
    return A.jet_charge(kids, jets, ["jet"], "q", "pt", 0.5, False).select("jet", F.round("jet_charge", 6).alias("jet_charge"))


CHARGES = "c AS (SELECT l_orderkey % 3 AS klass, round(sum((l_suppkey % 3 - 1) * l_extendedprice) / sum(l_extendedprice), 6) AS score FROM lineitem GROUP BY l_orderkey)"


@query("a6_charge_benchmark", f"WITH {CHARGES}, s AS (SELECT * FROM c WHERE klass <> 1), a AS (WITH {auc_sql('', 's', 'klass = 2')}) SELECT klass AS class, count(*) AS n, round(avg(score), 5) AS mean_charge, any_value(auc) AS auc_charged FROM c, a GROUP BY 1")
def a6(spark, d):
    kids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("jet"), (F.col("l_suppkey") % 3 - 1).alias("q"), F.col("l_extendedprice").alias("pt"))
    charges = A.jet_charge(kids, kids.select("jet").distinct(), ["jet"], "q", "pt", 1.0).select((F.col("jet") % 3).alias("class"), F.round("jet_charge", 6).alias("q"))
    return A.charge_benchmark(charges, "q", "class").select("class", "n", F.round("mean_charge", 5).alias("mean_charge"), F.round("auc_charged", 6).alias("auc_charged"))


def vertex_sql(gate: float) -> str:
    """Sums, solution and residuals of each window; residuals are added up track by track."""
    return f"""{TRACKS}, p AS (SELECT win.event, CASE WHEN abs(d0) <= {gate} THEN least(pt, 30) ELSE 0 END AS w, sin(phi) AS s, cos(phi) AS c, d0 AS d FROM win JOIN t ON t.event = win.event AND z >= lo AND z < hi),
 n AS (SELECT event, count(CASE WHEN w > 0 THEN 1 END) AS n, sum(w) AS sw, sum(w * s * s) AS ss, sum(w * c * c) AS cc, sum(w * s * c) AS sc, sum(w * d * s) AS ds, sum(w * d * c) AS dc FROM p GROUP BY 1),
 q AS (SELECT *, ss * cc - sc * sc AS det, CASE WHEN sw > 0 THEN CASE WHEN ss > 0 AND cc > 0 THEN (ss * cc - sc * sc) / (ss * cc) ELSE 0 END END AS cond FROM n),
 v AS (SELECT *, CASE WHEN n >= 2 AND det > 0 AND cond >= 1e-3 THEN (cc * ds - sc * dc) / det END AS vx, CASE WHEN n >= 2 AND det > 0 AND cond >= 1e-3 THEN (sc * ds - ss * dc) / det END AS vy FROM q),
 r AS (SELECT v.event, sum(w * power(d - vx * s + vy * c, 2)) AS rest FROM v JOIN p USING (event) GROUP BY 1),
 f AS (SELECT v.*, sqrt(rest / sw) AS scatter, CASE WHEN n >= 3 THEN sqrt(rest / (n - 2) * cc / det) END AS sx, CASE WHEN n >= 3 THEN sqrt(rest / (n - 2) * ss / det) END AS sy FROM v JOIN r USING (event)),
 e AS (SELECT win.event, coalesce(n, 0) AS n_window, coalesce(sw, 0) AS sum_w, cond, vx, vy, CASE WHEN vx IS NOT NULL THEN scatter END AS scatter, CASE WHEN vx IS NOT NULL THEN sx END AS sx, CASE WHEN vy IS NOT NULL THEN sy END AS sy FROM win LEFT JOIN f USING (event))"""


def vertices(spark, d):
    points, found = windows(spark, d)
    return points, found.select("event", "edge_low", "edge_high"), F.least(F.col("pt"), F.lit(30.0))


@query("a11_vertex_estimate", f"WITH {vertex_sql(0.31)} SELECT event, n_window, round(sum_w, 4) AS sum_w, round(cond, 6) AS condition, round(vx, 4) AS vx, round(vy, 4) AS vy, round(scatter, 4) AS scatter, round(sx, 4) AS sigma_vx, round(sy, 4) AS sigma_vy FROM e")
def a11(spark, d):
    points, found, weight = vertices(spark, d)
    fit = A.vertex_estimate(points, found, ["event"], "z", weight, "d0", "phi", gate=0.31, least_condition=1e-3)
    return fit.select("event", "n_window", F.round("condition", 6).alias("condition"), *[F.round(c, 4).alias(c) for c in ("sum_w", "vx", "vy", "scatter", "sigma_vx", "sigma_vy")])


@query("a12_four_vertex_features", f"WITH {vertex_sql(10.0)} SELECT event, round(coalesce(vx, 0)::FLOAT, 3) AS vtx_dx, round(coalesce(vy, 0)::FLOAT, 3) AS vtx_dy, round(CASE WHEN vx <> 0 AND sx > 0 THEN sx ELSE 0 END, 3) AS deviation_x, round(CASE WHEN vy <> 0 AND sy > 0 THEN sy ELSE 0 END, 3) AS deviation_y FROM e")
def a12(spark, d):
    """The significances are shown by the deviation that each stands for: of two tracks it is next to nothing."""
    points, found, weight = vertices(spark, d)
    features = B.vertex_features(points, found, ["event"], "z", weight, "d0", "phi", sanitise=True, gate=10.0, least_condition=1e-3)
    of = {f"deviation_{c}": F.abs(F.coalesce(F.try_divide(F.col(f"vtx_d{c}").cast("double"), F.col(f"vtx_d{c}sig").cast("double")), F.lit(0.0))) for c in "xy"}
    return features.select("event", F.round("vtx_dx", 3).alias("vtx_dx"), F.round("vtx_dy", 3).alias("vtx_dy"), *[F.round(c, 3).alias(n) for n, c in of.items()])


@query("b10_vertexing_table", """WITH r AS (SELECT o_custkey AS event, l_quantity AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) - 1 AS slot FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
 a AS (SELECT event, count(*) AS n, max(CASE WHEN slot = 0 THEN q END) AS q0, max(CASE WHEN slot = 3 THEN q END) AS q3 FROM r GROUP BY 1), s AS (SELECT o_custkey AS event, arg_min(o_totalprice, o_orderkey) AS z FROM orders GROUP BY 1)
SELECT c_custkey AS event, least(coalesce(n, 0), 4)::BIGINT AS n_filled, coalesce(q0, 0)::DOUBLE AS first, coalesce(q3, 0)::DOUBLE AS fourth, c_acctbal AS true_z, s.z AS stock_z0 FROM customer LEFT JOIN a ON a.event = c_custkey LEFT JOIN s ON s.event = c_custkey""")
def b10(spark, d):
    people, orders = table(spark, d, "customer"), table(spark, d, "orders")
    lines = table(spark, d, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    slot = F.row_number().over(Window.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")) - 1
    tracks = lines.select(F.col("o_custkey").alias("event"), slot.alias("slot"), F.col("l_quantity").alias("pt"))
    events = people.select(F.col("c_custkey").alias("event"))
    truth = people.select(F.col("c_custkey").alias("event"), F.col("c_acctbal").alias("z"))
    stock = orders.select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("z0"))
    found = B.vertexing_table(tracks, truth, stock, events, ["event"], ["pt"], 4)
    filled = F.aggregate("mask", F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))
    return found.select("event", filled.alias("n_filled"), F.col("pt")[0].cast("double").alias("first"), F.col("pt")[3].cast("double").alias("fourth"), "true_z", "stock_z0")


FEATURES = ["l_quantity", "l_extendedprice", "l_discount"]


@query("m8_best_seed")
def m8(spark, d):
    """Losses of models on three splits; models differ by engine, so there is no SQL."""
    return M.best_seed(learnable(spark, d), FEATURES, ["k", "n", "p"], SEEDS, rounds=3)[1]


@query("m9_stacked_scores")
def m9(spark, d):
    """A scorer's output, alone and with coded columns, as input of further models."""
    columns = {"q_price": S.quantise_chi2(F.col("l_extendedprice") / 1000), "q_quantity": S.quantise_count(F.col("l_quantity"), 3)}
    consumers = {"TS0": [], "TS1": ["q_price"], "TS1b": ["q_quantity"], "TS2": ["q_price", "q_quantity"]}
    return M.stacked_scores(learnable(spark, d), ["l_quantity", "l_discount"], columns, consumers, ["k", "n", "p"], rounds=3)


def sizes_sql(seed: int) -> str:
    """Test rows of each class of an exact split by keys."""
    return f"""(SELECT count(CASE WHEN y = 1 THEN 1 END) AS n_pos, count(CASE WHEN y = 0 THEN 1 END) AS n_neg FROM (SELECT y, row_number() OVER (ORDER BY md5(k || '|' || n || '|' || p || '|{seed}'), k, n, p) <= floor(count(*) OVER () * 0.25) AS is_test FROM l) WHERE is_test)"""


LEARNABLE = "l AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE WHEN l_partkey % 10 = 0 THEN l_partkey % 2 ELSE (l_extendedprice > l_quantity * 1500)::BIGINT END AS y FROM lineitem)"


@query("m2_model_matrix", f"WITH {LEARNABLE} SELECT tier, config, n_features::INTEGER AS n_features, n_pos, n_neg, true AS has_auc FROM (VALUES ('A', '*', 1), ('B', '1100', 2), ('B', '1111', 2), ('C', '1100', 3)) v(tier, config, n_features), {sizes_sql(0)}")
def m2(spark, d):
    """Cells of three tiers and two configurations, one of which has no table of the third; the areas differ by engine."""
    rows, names = learnable(spark, d), ["l_discount", "l_quantity", "l_extendedprice"]
    other = rows.withColumn("l_extendedprice", F.col("l_extendedprice") * 2)
    cells = {("A", "1100"): (rows, names[:1]), ("A", "1111"): (other, names[:1]), ("B", "1100"): (rows, names[:2]), ("B", "1111"): (other, names[:2]), ("C", "1100"): (rows, names)}
    return M.model_matrix(cells, ["k", "n", "p"], rounds=2).select("tier", "config", "n_features", "n_pos", "n_neg", F.col("auc").between(0.0, 1.0).alias("has_auc"))


#: Splits and trees of the study that is rebuilt (eval_refitq/modelspace/perlayer_study.py:49-57).
STUDY_SEEDS = list(range(8))
STUDY_TREES = {"rounds": 80, "depth": 3, "step": 0.15, "patience": 15}


@query("m10_ablation")
def m10(spark, d):
    """Feature sets against the discount alone, with the study's splits and trees; models differ by engine, so there is no SQL."""
    sets = {"base": ["l_discount"], "quantity": ["l_discount", "l_quantity"], "all": FEATURES}
    return M.ablation(learnable(spark, d), sets, ["k", "n", "p"], STUDY_SEEDS, "base", workers=8, **STUDY_TREES)
