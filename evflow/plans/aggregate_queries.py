"""Aggregations, peaks, fits and maps on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evflow.operators import aggregates as A
from evflow.operators import grids as G
from evflow.operators import joins as J
from evflow.operators import nested as N
from evflow.plans.catalog import query, table
from evflow.sources import collections as C


def hits(spark, d):
    """Lines of an order as hits of a track; a residue class of each number is missing."""
    part = F.col("l_partkey")

    def some(x, k):
        return F.when(part % k == 0, F.lit(-999.0)).otherwise(x)

    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track"), some(F.col("l_discount"), 11).alias("pull_x"), F.col("l_tax").alias("pull_y"), some(F.col("l_quantity"), 11).alias("res_x"), F.col("l_quantity").alias("res_y"), some(F.col("l_discount"), 7).alias("pull_alpha"), F.col("l_tax").alias("pull_beta"), some(F.col("l_tax"), 5).alias("sig_alpha"), F.col("l_tax").alias("sig_beta"), (part % 2 == 0).alias("has_alpha"), (part % 3 == 0).alias("has_beta"), F.col("l_linenumber").alias("layer"))


HITS = """h AS (SELECT l_orderkey AS track, CASE WHEN l_partkey % 11 = 0 THEN -999.0 ELSE l_discount END AS pull_x, l_tax AS pull_y, CASE WHEN l_partkey % 11 = 0 THEN -999.0 ELSE l_quantity END AS res_x,
 l_quantity AS res_y, CASE WHEN l_partkey % 7 = 0 THEN -999.0 ELSE l_discount END AS pull_alpha, l_tax AS pull_beta, CASE WHEN l_partkey % 5 = 0 THEN -999.0 ELSE l_tax END AS sig_alpha, l_tax AS sig_beta, l_partkey % 2 = 0 AS has_alpha, l_partkey % 3 = 0 AS has_beta, l_linenumber AS layer FROM lineitem)"""


def hit_sql(gate: bool) -> str:
    g = (lambda c: f"CASE WHEN {c} > -900 THEN {c} END") if gate else (lambda c: c)
    return f"""WITH {HITS}, a AS (SELECT track, count(*) AS n_hits, sum(power({g('pull_x')}, 2)) AS px, greatest(0, max(abs({g('res_x')}))) AS rx, sum(CASE WHEN has_alpha AND pull_alpha > -900 THEN power(pull_alpha, 2) END) AS pa,
 count(CASE WHEN has_alpha AND pull_alpha > -900 THEN 1 END) AS na, avg(CASE WHEN sig_alpha > -900 THEN sig_alpha END) AS ma FROM h GROUP BY 1)
SELECT o_orderkey AS track, coalesce(n_hits, 0)::BIGINT AS n_hits, round(coalesce(px, 0), 4) AS sum_pull2_x, coalesce(rx, 0)::DOUBLE AS max_abs_res_x, round(coalesce(pa, 0), 4) AS sum_pull2_alpha, coalesce(na, 0)::BIGINT AS n_alpha, round(coalesce(ma, 0), 6) AS mean_sig_alpha FROM orders LEFT JOIN a ON track = o_orderkey"""


def hit_sums(spark, d, gate):
    tracks = table(spark, d, "orders").select(F.col("o_orderkey").alias("track"))
    found = A.hit_sums(hits(spark, d), tracks, ["track"], gate)
    return found.select("track", "n_hits", F.round("sum_pull2_x", 4).alias("sum_pull2_x"), "max_abs_res_x", F.round("sum_pull2_alpha", 4).alias("sum_pull2_alpha"), "n_alpha", F.round("mean_sig_alpha", 6).alias("mean_sig_alpha"))


@query("a1_hit_sums", hit_sql(False))
def a1(spark, d):
    return hit_sums(spark, d, False)


@query("a2_hit_sums_gated", hit_sql(True))
def a2(spark, d):
    return hit_sums(spark, d, True)


@query("a3_layer_columns", f"WITH {HITS} SELECT track, " + ", ".join(f"min(CASE WHEN layer = {n} THEN pull_x END) AS pull_x_L{n}, count(CASE WHEN layer = {n} THEN 1 END) > 0 AS \"crossed_L{n}\"" for n in (1, 2, 3, 4)) + " FROM h GROUP BY track")
def a3(spark, d):
    return A.layer_columns(hits(spark, d), ["track"], "layer", [1, 2, 3, 4], ["pull_x"])


CHARGE = "WITH c AS (SELECT l_orderkey AS jet, l_suppkey % 3 - 1 AS q, l_extendedprice AS pt FROM lineitem), s AS (SELECT jet, sum(q * power(pt, 0.5)) / {0} AS v FROM c GROUP BY 1) SELECT o_orderkey AS jet, round(coalesce(v, 0), 6) AS jet_charge FROM orders LEFT JOIN s ON jet = o_orderkey"


def charge(spark, d, by_total):
    kids = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("jet"), (F.col("l_suppkey") % 3 - 1).alias("q"), F.col("l_extendedprice").alias("pt"))
    jets = table(spark, d, "orders").select(F.col("o_orderkey").alias("jet"))
    return A.jet_charge(kids, jets, ["jet"], "q", "pt", 0.5, by_total).select("jet", F.round("jet_charge", 6).alias("jet_charge"))


@query("a4_jet_charge", CHARGE.format("power(sum(pt), 0.5)"))
def a4(spark, d):
    return charge(spark, d, True)


@query("a4_jet_charge_by_weight", CHARGE.format("sum(power(pt, 0.5))"))
def a4b(spark, d):
    return charge(spark, d, False)


@query("a7_balance_weights", "WITH c AS (SELECT l_linenumber % 3 AS y, floor(l_quantity / 10)::INTEGER AS pt_bin, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT c.y::INTEGER AS y, c.pt_bin, c.n, round(coalesce(r.n / c.n, 1.0), 6) AS weight FROM c LEFT JOIN c r ON r.y = 0 AND r.pt_bin = c.pt_bin")
def a7(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("y"), F.floor(F.col("l_quantity") / 10).cast("int").alias("pt_bin"))
    return A.balance_weights(rows, "y", "pt_bin").select("y", "pt_bin", "n", F.round("weight", 6).alias("weight"))


LOW, HIGH, BINS = 0.0, 64.0, 256


def tracks(spark, d, *names):
    """Lines as tracks of their customer's event: z from the price, phase from the ship date; all columns or those named."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    phi = F.dayofyear("l_shipdate") * (2 * 3.141592653589793 / 366)
    z = F.pmod(F.col("l_extendedprice") / 97, F.lit(70.0)) - 3
    found = lines.select(F.col("o_custkey").alias("event"), z.alias("z"), F.col("l_quantity").alias("pt"), phi.alias("phi"), (0.3 * F.sin(phi) - 0.1 * F.cos(phi) + F.col("l_tax") / 100).alias("d0"))
    return A.dealt(C.staged(found.select(*names or found.columns), "tracks"), ["event"])


TRACKS = """t AS (SELECT o_custkey AS event, (l_extendedprice / 97 - 70.0 * floor(l_extendedprice / 97 / 70.0)) - 3 AS z, l_quantity AS pt, dayofyear(l_shipdate) * (2 * 3.141592653589793 / 366) AS phi,
 0.3 * sin(dayofyear(l_shipdate) * (2 * 3.141592653589793 / 366)) - 0.1 * cos(dayofyear(l_shipdate) * (2 * 3.141592653589793 / 366)) + l_tax / 100 AS d0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
 hist AS (SELECT event, least(floor(z / 0.25), 255)::INTEGER AS bin, sum(least(pt, 30)) AS w FROM t WHERE z >= 0 AND z <= 64 GROUP BY 1, 2),
 k AS (SELECT * FROM (VALUES (0, 0.5), (1, 1.0), (2, 0.5)) v(o, c)),
 sums AS (SELECT event, bin - o AS start, round(sum(w * c), 9) AS v FROM hist, k WHERE bin - o BETWEEN 0 AND 253 GROUP BY 1, 2),
 best AS (SELECT event, arg_max(start, (v, -start)) AS start FROM sums GROUP BY 1),
 win AS (SELECT c_custkey AS event, coalesce(start, 0)::INTEGER AS start, coalesce(start, 0) * 0.25 AS lo, (coalesce(start, 0) + 3) * 0.25 AS hi FROM customer LEFT JOIN best ON event = c_custkey)"""


def windows(spark, d, *names):
    points = tracks(spark, d, *names)
    events = table(spark, d, "customer").select(F.col("c_custkey").alias("event"))
    weight = F.least(F.col("pt"), F.lit(30.0))
    filled = A.weighted_histogram(points, ["event"], "z", weight, LOW, HIGH, BINS)
    start = A.peak_window(filled, events, ["event"], A.kernel_weights("triangular", 3), BINS)
    return points, A.window_centroid(points, start, ["event"], "z", weight, LOW, HIGH, BINS, 3)


@query("a8_weighted_histogram", f"WITH {TRACKS} SELECT event, bin, round(w, 4) AS w FROM hist")
def a8(spark, d):
    return A.weighted_histogram(tracks(spark, d, "event", "z", "pt"), ["event"], "z", F.least(F.col("pt"), F.lit(30.0)), LOW, HIGH, BINS).select("event", "bin", F.round("w", 4).alias("w"))


@query("a9_a10_peak_and_centroid", f"WITH {TRACKS} SELECT win.event, start, round(coalesce(sum(CASE WHEN z >= lo AND z < hi THEN least(pt, 30) * z END) / sum(CASE WHEN z >= lo AND z < hi THEN least(pt, 30) END), (any_value(lo) + any_value(hi)) / 2), 6) AS z0 FROM win LEFT JOIN t ON t.event = win.event GROUP BY 1, 2")
def a9(spark, d):
    return windows(spark, d, "event", "z", "pt")[1].select("event", "start", F.round("z0", 6).alias("z0"))


@query("a11_transverse_fit", f"""WITH {TRACKS}, s AS (SELECT win.event, count(w) AS n_window, coalesce(sum(w), NULL) AS sum_w, sum(w * sin(phi) * sin(phi)) AS ss, sum(w * cos(phi) * cos(phi)) AS cc, sum(w * sin(phi) * cos(phi)) AS sc, sum(w * d0 * sin(phi)) AS ds, sum(w * d0 * cos(phi)) AS dc
 FROM win LEFT JOIN (SELECT t.*, CASE WHEN abs(d0) < 0.31 THEN least(pt, 30) END AS w, win.event AS e FROM t JOIN win ON win.event = t.event AND z >= lo AND z < hi) x ON x.e = win.event GROUP BY 1),
 f AS (SELECT *, ss * cc - sc * sc AS det, (ss + cc) / 2 AS half FROM s), g AS (SELECT *, sqrt(greatest(0, half * half - det)) AS gap FROM f)
SELECT event, n_window, round(sum_w, 4) AS sum_w, round(CASE WHEN (half - gap) / (half + gap) > 1e-3 THEN (ds * cc - dc * sc) / det END, 4) AS vx, round(CASE WHEN (half - gap) / (half + gap) > 1e-3 THEN (ds * sc - dc * ss) / det END, 4) AS vy FROM g""")
def a11(spark, d):
    points, found = windows(spark, d)
    fit = A.transverse_fit(points, found.select("event", "edge_low", "edge_high"), ["event"], "z", F.least(F.col("pt"), F.lit(30.0)), "d0", "phi", gate=0.31, least_condition=1e-3)
    return fit.select("event", "n_window", F.round("sum_w", 4).alias("sum_w"), F.round("vx", 4).alias("vx"), F.round("vy", 4).alias("vy"))


@query("a13_summary", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value::DOUBLE, 0.5), 6) AS median, round(quantile_cont(value::DOUBLE, 0.16), 6) AS q16, round(quantile_cont(value::DOUBLE, 0.84), 6) AS q84 FROM events GROUP BY 1")
def a13(spark, d):
    return A.summary(table(spark, d, "events"), "value", ["event_type"]).select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "median", "q16", "q84")])


def cells(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 10).cast("int").alias("a"), F.hour("ts").alias("b"), "value")


MAP = """c AS (SELECT (user_id % 10)::INTEGER AS a, hour(ts)::INTEGER AS b, value FROM events), m AS (SELECT a, b, count(*) AS n, quantile_cont(value::DOUBLE, 0.5) AS bias, greatest(1e-4, (quantile_cont(value::DOUBLE, 0.84) - quantile_cont(value::DOUBLE, 0.16)) / 2) AS sigma FROM c GROUP BY 1, 2),
 p AS (SELECT quantile_cont(value::DOUBLE, 0.5) AS bias, greatest(1e-4, (quantile_cont(value::DOUBLE, 0.84) - quantile_cont(value::DOUBLE, 0.16)) / 2) AS sigma FROM c),
 r AS (SELECT i::INTEGER AS a, j::INTEGER AS b, coalesce(m.n, 0)::BIGINT AS n, round(CASE WHEN coalesce(m.n, 0) >= 25 THEN m.bias ELSE p.bias END, 6) AS bias, round(CASE WHEN coalesce(m.n, 0) >= 25 THEN m.sigma ELSE p.sigma END, 6) AS sigma FROM generate_series(0, 9) g(i) CROSS JOIN generate_series(0, 23) h(j) CROSS JOIN p LEFT JOIN m ON m.a = i AND m.b = j)"""


def bias_map(spark, d):
    return A.residual_map(cells(spark, d), "a", "b", "value", 10, 24).select("a", "b", "n", F.round("bias", 6).alias("bias"), F.round("sigma", 6).alias("sigma"))


@query("a14_residual_map", f"WITH {MAP} SELECT * FROM r")
def a14(spark, d):
    return bias_map(spark, d)


@query("j5_e12_standardised_residual", f"WITH {MAP} SELECT count(*) AS n, round(avg((c.value - r.bias) / r.sigma), 6) AS mean, round(stddev_pop((c.value - r.bias) / r.sigma), 6) AS std FROM c JOIN r USING (a, b)")
def j5(spark, d):
    edges_a, edges_b = [float(k) for k in range(11)], [float(k) for k in range(25)]
    rows = cells(spark, d).select(F.col("a").alias("_x"), F.col("b").alias("_y"), "value")
    looked = J.grid_lookup(rows, {"a": (F.col("_x"), edges_a), "b": (F.col("_y"), edges_b)}, bias_map(spark, d), ["bias", "sigma"])
    pull = (F.col("value") - F.col("bias")) / F.col("sigma")
    return looked.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(pull), 6).alias("mean"), F.round(F.stddev_pop(pull), 6).alias("std"))


@query("a15_outside_share", "SELECT round(avg(CASE WHEN o_totalprice BETWEEN 50000 AND 400000 THEN 0.0 ELSE 1.0 END), 6) AS o_totalprice FROM orders")
def a15(spark, d):
    return A.outside_share(table(spark, d, "orders"), {"o_totalprice": (50000.0, 400000.0)}).select(F.round("o_totalprice", 6).alias("o_totalprice"))


@query("a16_sign_check", "SELECT round(quantile_cont(abs(l_tax - l_discount - (l_tax - l_discount)), 0.5), 6) AS as_is, round(quantile_cont(abs(l_tax - l_discount + (l_tax - l_discount)), 0.5), 6) AS flipped FROM lineitem")
def a16(spark, d):
    rows = table(spark, d, "lineitem").withColumn("res", F.col("l_tax") - F.col("l_discount"))
    return A.sign_check(rows, "l_tax", "l_discount", "res").select(F.round("as_is", 6).alias("as_is"), F.round("flipped", 6).alias("flipped"))


@query("a17_multiplicity", "WITH c AS (SELECT count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT n_rows, count(*) AS n_keys FROM c GROUP BY 1")
def a17(spark, d):
    return A.multiplicity(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("a18_tail_report", "SELECT max(value) AS largest, count(CASE WHEN value > 20 THEN 1 END) AS n_above, round(quantile_cont(value::DOUBLE, 0.99), 6) AS q99, round(quantile_cont(value::DOUBLE, 0.999), 6) AS q999 FROM events")
def a18(spark, d):
    return A.tail_report(table(spark, d, "events"), "value", 20.0).select("largest", "n_above", F.round("q99", 6).alias("q99"), F.round("q999", 6).alias("q999"))


@query("a19_a20_class_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1")
def a19(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"))


@query("a21_resolution_table", "WITH x AS (SELECT 'price' AS config, l_extendedprice / 1000 AS v, l_quantity AS t FROM lineitem UNION ALL SELECT 'disc', l_discount * 100, l_quantity FROM lineitem) SELECT config, round(quantile_cont(abs(v - t), 0.5) * 1e4, 2) AS median_error, count(*) AS n FROM x GROUP BY 1")
def a21(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_extendedprice") / 1000).alias("p"), (F.col("l_discount") * 100).alias("q"), "l_quantity")
    return A.resolution_table(rows, {"price": "p", "disc": "q"}, "l_quantity").select("config", F.round("median_error", 2).alias("median_error"), "n")


@query("a22_u3_merged_edges", "WITH e AS (SELECT DISTINCT unnest([p_size::DOUBLE, p_size + 0.5, p_retailprice]) AS edge FROM part), g AS (SELECT edge, edge - lag(edge) OVER (ORDER BY edge) AS gap FROM e) SELECT edge FROM g WHERE gap IS NULL OR gap > 0.001 * (1 + abs(edge))")
def a22(spark, d):
    rows = table(spark, d, "part").select(F.array(F.col("p_size").cast("double"), F.col("p_size") + 0.5, "p_retailprice").alias("edges"))
    return G.merged_edges(rows, "edges", 0.001)


@query("j3_nearest_match", """WITH o AS (SELECT o_custkey % 25 AS event, o_orderkey AS idx, o_totalprice / 100000 - 2.5 AS eta, (o_orderkey % 628) / 100.0 - 3.14 AS phi FROM orders),
 t AS (SELECT s_nationkey AS event, s_suppkey AS tid, s_acctbal / 2500 - 2 AS eta, (s_suppkey % 628) / 100.0 - 3.14 AS phi FROM supplier),
 m AS (SELECT o.event, o.idx, tid, power(o.eta - t.eta, 2) + power(pi() - abs(pi() - abs(o.phi - t.phi)), 2) AS d FROM o JOIN t USING (event)),
 b AS (SELECT event, idx, arg_min(tid, (d, tid)) AS tid, min(d) AS d FROM m WHERE d < 1.44 GROUP BY 1, 2)
SELECT o.event, o.idx, coalesce(tid, -1) AS match, round(d, 6) AS dr2 FROM o LEFT JOIN b USING (event, idx)""")
def j3(spark, d):
    objects = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("event"), F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") / 100000 - 2.5).alias("eta"), ((F.col("o_orderkey") % 628) / 100.0 - 3.14).alias("phi"))
    targets = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("event"), F.col("s_suppkey").alias("tid"), (F.col("s_acctbal") / 2500 - 2).alias("eta"), ((F.col("s_suppkey") % 628) / 100.0 - 3.14).alias("phi"))
    return J.nearest_match(objects, targets, ["event"], "idx", "tid", 1.2).select("event", "idx", "match", F.round("dr2", 6).alias("dr2"))


@query("j1_j4_reference_default", "SELECT c_custkey, coalesce(n_regionkey, -1)::INTEGER AS region FROM customer LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE c_nationkey END")
def j1(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"), F.col("n_regionkey").alias("region"))
    people = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit(-1)).otherwise(F.col("c_nationkey")).alias("ref"))
    return N.gather(people, nations, [], "ref", "idx", {"region": -1}).select("c_custkey", "region")


@query("j6_j7_semi_and_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def j6(spark, d):
    people = table(spark, d, "customer").select("c_custkey")
    keys = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    with_, without = people.join(keys, "c_custkey", "left_semi"), people.join(keys, "c_custkey", "left_anti")
    return with_.withColumn("has_orders", F.lit(True)).unionByName(without.withColumn("has_orders", F.lit(False)))


@query("j9_pair_similarity", "WITH e AS (SELECT vec_id // 8 AS batch, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL) SELECT a.batch, a.vec_id AS left_key, b.vec_id AS right_key, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dot FROM e a JOIN e b ON a.batch = b.batch AND a.vec_id <> b.vec_id")
def j9(spark, d):
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("batch"), "vec_id", "embedding")
    return J.pairs_in_batch(rows, "batch", "vec_id", "embedding").withColumn("dot", F.round("dot", 5))


@query("e25_pair_loss", "WITH e AS (SELECT vec_id // 8 AS batch, vec_id, embedding FROM embeddings), p AS (SELECT a.batch, a.vec_id AS l, b.vec_id AS r, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / 0.5 AS s FROM e a JOIN e b ON a.batch = b.batch AND a.vec_id <> b.vec_id) SELECT batch, l AS left_key, round(ln(sum(exp(s))) - max(CASE WHEN r // 2 = l // 2 THEN s END), 5) AS loss FROM p GROUP BY 1, 2")
def e25(spark, d):
    rows = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("batch"), "vec_id", "embedding")
    pairs = J.pairs_in_batch(rows, "batch", "vec_id", "embedding")
    same = F.floor(F.col("left_key") / 2) == F.floor(F.col("right_key") / 2)
    return J.pair_loss(pairs, "batch", same).withColumn("loss", F.round("loss", 5))
