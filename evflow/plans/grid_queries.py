"""Grids, deep ensembles, refit reports, dumps of predictions, losses and the exact incremental map on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evflow.functions import scalars as S
from evflow.operators import aggregates as A
from evflow.operators import evaluation as E
from evflow.operators import forests as T
from evflow.operators import grids as G
from evflow.operators import joins as J
from evflow.operators import trajectories as R
from evflow.operators.modelling import parity, tree_score
from evflow.plans.catalog import query, table
from evflow.plans.model_queries import TREES
from evflow.sources import collections as C
from evflow.streaming import incremental


def rounded(df, places, *columns):
    return df.withColumns({c: F.round(c, places) for c in columns})


# --- deep ensembles ---------------------------------------------------------------------------------------------------

#: A forest by rule: 400 trees of six levels in heap order.
TREES_N, INNER = 400, 63
CUTS = "CASE (t * 7 + k * 3) % 3 WHEN 0 THEN (t * 13 + k * 29) % 50 + 0.5 WHEN 1 THEN 900.0 + (t * 17 + k * 31) % 1200 ELSE (t * 5 + k * 11) % 25 + 0.5 END"
LEAF = "((t * 37 + k * 101) % 2001 - 1000) / 10000.0"


def forest(spark, shift=0):
    """The trees by rule; ``shift`` starts at another tree."""
    inner, t = f"k < {INNER}", f"(t + {shift})"
    cuts, leaf = CUTS.replace("t *", f"{t} *"), LEAF.replace("t *", f"{t} *")
    node = f"named_struct('feature', CAST(IF({inner}, ({t} * 7 + k * 3) % 3, -2) AS INT), 'threshold', CAST(IF({inner}, {cuts}, 0) AS FLOAT), 'below', CAST(2 * k + 1 AS INT), 'above', CAST(2 * k + 2 AS INT), 'value', CAST(IF({inner}, 0, {leaf}) AS FLOAT))"
    return spark.range(TREES_N).select(F.col("id").cast("int").alias("t")).select(F.col("t").alias("tree"), F.expr(f"transform(sequence(0, {2 * INNER}), k -> {node}) AS nodes"))


def parts(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")


def features():
    return [F.col("p_size"), F.col("p_retailprice"), F.col("p_partkey") % 25]


def walk_sql(shift: int = 0) -> str:
    """Walks of all parts through all trees, level by level, summed in order in single precision."""
    return f"""nodes AS (SELECT r.t, k, (t * 7 + k * 3) % 3 AS f, ({CUTS})::FLOAT AS cut FROM (SELECT t + {shift} AS t FROM range({TREES_N}) g(t)) r, range({INNER}) h(k)),
 x AS (SELECT p_partkey, p_size::FLOAT AS x0, p_retailprice::FLOAT AS x1, (p_partkey % 25)::FLOAT AS x2 FROM part),
 walk AS (SELECT x.*, t + {shift} AS t, 0::BIGINT AS k FROM x, range({TREES_N}) g(t)
  UNION ALL SELECT w.p_partkey, x0, x1, x2, t, CASE WHEN CASE f WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END <= cut THEN 2 * k + 1 ELSE 2 * k + 2 END FROM walk w JOIN nodes USING (t, k)),
 sums AS (SELECT p_partkey, list_reduce(list_prepend(0.25::FLOAT, list(({LEAF})::FLOAT ORDER BY t)), lambda a, b: (a + b)::FLOAT) AS s FROM walk WHERE k >= {INNER} GROUP BY 1)"""


@query("m3_deep_forest", f"WITH RECURSIVE {walk_sql()} SELECT p_partkey, (s * 0.5::FLOAT)::FLOAT AS score FROM sums")
def m3_deep(spark, d):
    return T.forest_score(parts(spark, d), forest(spark), features(), 6, init=0.25, norm=0.5).select("p_partkey", "score")


@query("m4_scorer_parity", "SELECT 0.0::FLOAT AS largest, count(*) AS equal, count(*) AS n FROM lineitem")
def m4_scorers(spark, d):
    """The nested conditions of a small model against its table of nodes."""
    inputs = [F.col("l_quantity"), F.col("l_discount")]
    rows = table(spark, d, "lineitem").select("l_quantity", "l_discount", tree_score(TREES, inputs).alias("a"))
    return parity(T.forest_score(rows, T.forest_of(spark, TREES), inputs, 2, "b", TREES["init_predict"][0], TREES["norm"], TREES["splitting_convention"]), "a", "b")


M5_FIRST, M5_SECOND = walk_sql(), walk_sql(1000)


@query("m5_bagged_forests", f"WITH a AS (WITH RECURSIVE {M5_FIRST} SELECT p_partkey, (s * 0.5::FLOAT)::FLOAT AS a FROM sums), b AS (WITH RECURSIVE {M5_SECOND} SELECT p_partkey, (s * 0.5::FLOAT)::FLOAT AS b FROM sums) SELECT p_partkey, round((a::DOUBLE + b::DOUBLE) / 2, 6) AS score FROM a JOIN b USING (p_partkey)")
def m5_bagged(spark, d):
    both = [forest(spark), forest(spark, 1000)]
    return rounded(T.bagged_forests(parts(spark, d), both, features(), 6, init=0.25, norm=0.5).select("p_partkey", "score"), 6, "score")


# --- refit reports ----------------------------------------------------------------------------------------------------


def replayed(spark, d):
    """Orders as tracks, their lines as hits on four layers."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice") / 100000
    tracks = table(spark, d, "orders").select(
        (key % 100).alias("event"), key.alias("idx"), (price / 10).alias("chi2ZRed"), (key % 8).cast("int").alias("nStubs"), (key % 5 != 0).alias("refitPerformed"),
        (price - 1).alias("d0"), (price * 2).alias("z0"), (price / 2).alias("refit_d0"), (price * 1.5).alias("refit_z0"), ((key % 7) / 10 - 0.3).alias("phi0"),
        F.when(key % 3 == 0, price / 4).alias("tpD0"), F.when(key % 4 == 0, price).alias("tpZ0"), F.lit(0.5).alias("GenVtx_x"), F.lit(-0.25).alias("GenVtx_y"), F.lit(1.5).alias("GenVtx_z"),
        F.when(key % 2 == 0, F.lit("1100")).otherwise(F.lit("1011")).alias("config"),
    )
    hits = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 100).alias("event"), F.col("l_orderkey").alias("trackIdx"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("hit"), (F.col("l_partkey") % 4 + 1).cast("int").alias("layer"),
        (F.col("l_discount") < 0.08).alias("hitAccepted"), F.col("l_quantity").cast("double").alias("chi2IncRPhi"), (F.col("l_tax") * 100).cast("double").alias("chi2IncRZ"),
    )
    return tracks, hits


REPLAY = """t AS (SELECT o_orderkey AS idx, o_totalprice / 100000 AS p, greatest(2 * greatest(o_orderkey % 8, 3) - 5, 1) AS nd, o_orderkey % 5 <> 0 AS done, (o_orderkey % 7) / 10.0 - 0.3 AS phi,
  CASE WHEN o_orderkey % 2 = 0 THEN '1100' ELSE '1011' END AS config FROM orders),
 u AS (SELECT *, p / 10 * nd AS chi2, p - 1 AS sd, p * 2 AS sz, p / 2 AS rd, p * 1.5 AS rz, CASE WHEN idx % 3 = 0 THEN p / 4 ELSE 0.5 * sin(phi) + 0.25 * cos(phi) END AS td, CASE WHEN idx % 4 = 0 THEN p ELSE 1.5 END AS tz FROM t),
 h AS (SELECT l_orderkey AS idx, (l_partkey % 4 + 1)::INTEGER AS layer, arg_max(l_quantity::DOUBLE, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS rphi, arg_max(l_tax * 100, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS rz FROM lineitem WHERE l_discount < 0.08 GROUP BY 1, 2),
 s AS (SELECT idx, 0 AS layer, 0.0 AS rphi, 0.0 AS rz, 0 AS more FROM u UNION ALL SELECT idx, layer, rphi, h.rz, 2 FROM h JOIN u USING (idx) WHERE done AND substr(config, layer, 1) = '1'),
 w AS (SELECT *, row_number() OVER o - 1 AS step, count(*) OVER (PARTITION BY idx) - 1 AS last, sum(rphi) OVER o AS cphi, sum(rz) OVER o AS cz, sum(more) OVER o AS md FROM s WINDOW o AS (PARTITION BY idx ORDER BY layer))"""


@query(
    "b15_refit_trajectory",
    f"""WITH {REPLAY} SELECT idx AS track, step::INTEGER AS step, CASE layer WHEN 0 THEN 'OT L1Track' ELSE 'after L' || layer END AS label, round(rz, 4) AS chi2_rz, round(cphi, 4) AS cum_rphi, (nd + md)::BIGINT AS ndof, round((chi2 + cz) / (nd + md), 8) AS reduced_chi2,
 round(CASE WHEN step = last AND done AND step > 0 THEN rd - td WHEN step = 0 THEN sd - td END, 6) AS error_d0, round(CASE WHEN step = last AND done AND step > 0 AND abs(sz - tz) >= 1e-12 THEN 100 * (abs(rz2 - tz) - abs(sz - tz)) / abs(sz - tz) END, 3) AS change_z0, idx % 3 <> 0 AS prompt_only
 FROM w JOIN (SELECT idx, nd, chi2, sd, td, rd, done, sz, tz, rz AS rz2 FROM u) USING (idx)""",
)
def b15(spark, d):
    """Errors lie on half units of the sixth digit at times: they are rounded as products, as the SQL's engine does."""
    tracks, hits = replayed(spark, d)
    found = R.refit_trajectory(tracks, hits, ["event"], F.col("config"))
    return found.select(F.col("trackIdx").alias("track"), "step", "label", F.round("chi2_rz", 4).alias("chi2_rz"), F.round("cum_rphi", 4).alias("cum_rphi"), "ndof", F.round("reduced_chi2", 8).alias("reduced_chi2"), (F.round(F.col("error_d0") * 1e6) / 1e6).alias("error_d0"), F.round("change_z0", 3).alias("change_z0"), "prompt_only")


# --- lookup on three axes -------------------------------------------------------------------------------------------------

AXES = {"quantity": [1.0, 10.0, 20.0, 40.0], "discount": [0.0, 0.03, 0.05, 0.07, 0.1], "tax": [0.01, 0.04]}
WIDER = {"quantity": [5.0, 25.0, 45.0], "discount": [0.02, 0.06], "tax": [0.0, 0.02, 0.03, 0.08]}


def place_sql(x: str, axis: str) -> str:
    def of(edges):
        return f"greatest(0, least(len(list_filter({edges}, lambda e: e <= {x})) - 1, {len(edges) - 2}))"

    return f"(CASE WHEN flag = 'R' THEN {of(WIDER[axis])} ELSE {of(AXES[axis])} END)::INTEGER"


@query(
    "j5_three_axes",
    f"""WITH r AS (SELECT l_returnflag AS flag, l_quantity::DOUBLE AS quantity, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax, l_extendedprice::DOUBLE AS price FROM lineitem),
 b AS (SELECT *, {place_sql('quantity', 'quantity')} AS bq, {place_sql('discount', 'discount')} AS bd, {place_sql('tax', 'tax')} AS bt FROM r),
 c AS (SELECT flag, bq, bd, bt, avg(price) AS bias FROM b WHERE flag <> 'N' GROUP BY ALL)
 SELECT flag, bq AS bin_quantity, bd AS bin_discount, bt AS bin_tax, count(*) AS n, round(avg(price - bias), 4) AS residual, round(min(bias), 4) AS bias FROM b LEFT JOIN c USING (flag, bq, bd, bt) GROUP BY ALL""",
)
def j5_three(spark, d):
    """Means of the cells of two categories; the third has edges of its own, but no cell."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), *[F.col(f"l_{a}").cast("double").alias(a) for a in AXES], F.col("l_extendedprice").cast("double").alias("price"))
    edges = spark.createDataFrame([("A", *AXES.values()), ("N", *AXES.values()), ("R", *WIDER.values())], "flag string, " + ", ".join(f"{a} array<double>" for a in AXES))
    axes, none = {a: F.col(a) for a in AXES}, rows.sparkSession.createDataFrame([], "flag string, quantity int, discount int, tax int, bias double")
    placed = G.lookup(rows, axes, edges, none, ["bias"], ["flag"]).drop("bias")
    cells = placed.where("flag <> 'N'").groupBy("flag", *[F.col(f"bin_{a}").alias(a) for a in AXES]).agg(F.avg("price").alias("bias"))
    found = G.lookup(rows, axes, edges, C.staged(cells, "cells"), ["bias"], ["flag"])
    return found.groupBy("flag", *[f"bin_{a}" for a in AXES]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("price") - F.col("bias")), 4).alias("residual"), F.round(F.min("bias"), 4).alias("bias"))


@query("u3_edges_by_category", "WITH e AS (SELECT DISTINCT p_size % 5 AS category, unnest([p_size::DOUBLE, p_size + 0.0001, p_retailprice::DOUBLE]) AS edge FROM part), g AS (SELECT *, edge - lag(edge) OVER (PARTITION BY category ORDER BY edge) AS gap FROM e) SELECT category, edge FROM g WHERE gap IS NULL OR gap > 1e-4 * (1 + abs(edge))")
def u3(spark, d):
    rows = table(spark, d, "part").select((F.col("p_size") % 5).alias("category"), F.array(F.col("p_size").cast("double"), F.col("p_size") + F.lit(0.0001), F.col("p_retailprice").cast("double")).alias("edges"))
    return G.merged_edges(rows, "edges", 1e-4, ["category"])


# --- slices ---------------------------------------------------------------------------------------------------------------


def grid(spark, d):
    """A grid made of events: their type, user group and hour, with two values in each cell."""
    cell = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).cast("int").alias("a"), F.hour("ts").alias("b"))
    return C.staged(cell.agg(F.avg("value").alias("v"), F.count_if(F.col("value") > 10).alias("many"), F.count(F.lit(1)).alias("all")), "grid")


GRID = "g AS (SELECT event_type, (user_id % 10)::INTEGER AS a, hour(ts)::INTEGER AS b, avg(value) AS v, count(CASE WHEN value > 10 THEN 1 END) AS many, count(*) AS \"all\" FROM events GROUP BY ALL)"


def q_sql(v: str, p: float) -> str:
    return f"round(quantile_cont({v}, {p}), 6)"


@query("e18_slice", f"WITH {GRID} SELECT b, {q_sql('v', 0.5)} AS middle, {q_sql('v', 0.16)} AS low, {q_sql('v', 0.84)} AS high, count(*) AS n FROM g WHERE event_type = 'click' AND a BETWEEN 2 AND 7 GROUP BY b")
def e18_slice(spark, d):
    return rounded(G.grid_slice(grid(spark, d), ["b"], "v", {"event_type": "click"}, {"a": (2, 7)}), 6, "middle", "low", "high")


@query("e18_surface", f"WITH {GRID} SELECT a, b, round(avg(v), 6) AS middle, count(*) AS n FROM g GROUP BY a, b")
def e18_surface(spark, d):
    return rounded(G.grid_slice(grid(spark, d), ["a", "b"], "v", agg="mean"), 6, "middle")


@query("e18_inverted_ratio", f"WITH {GRID}, r AS (SELECT a, 1 / (CASE WHEN many > 0 THEN many / \"all\" END) AS v FROM g) SELECT a, {q_sql('v', 0.5)} AS middle, {q_sql('v', 0.16)} AS low, {q_sql('v', 0.84)} AS high, count(v) AS n FROM r GROUP BY a")
def e18_ratio(spark, d):
    return rounded(G.grid_slice(grid(spark, d), ["a"], "many", below="all", invert=True), 6, "middle", "low", "high")


@query("e19_envelope_of_slices", f"WITH {GRID}, s AS (SELECT b, quantile_cont(v, 0.5) AS sigma FROM g WHERE event_type = 'view' GROUP BY b), m AS (SELECT b, quantile_cont(v, 0.5) AS bias FROM g WHERE event_type = 'click' GROUP BY b) SELECT b, round(bias, 6) AS middle, k, round(bias - k * sigma, 6) AS low, round(bias + k * sigma, 6) AS high FROM s JOIN m USING (b), (SELECT unnest([1.0, 2.0])::DOUBLE AS k)")
def e19_envelope(spark, d):
    cells = grid(spark, d)
    sigma, bias = (G.grid_slice(cells, ["b"], "v", {"event_type": kind}) for kind in ("view", "click"))
    return rounded(G.envelope(sigma, "b", bias), 6, "middle", "low", "high")


@query("p16_blocks", "WITH x AS (SELECT o_orderkey AS k, o_orderkey % 3 AS block, CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN o_totalprice - 100000 ELSE o_totalprice * 1e-16 END AS v FROM orders), m AS (SELECT block, min(v) > 0 AS pos FROM x GROUP BY 1) SELECT k, CASE WHEN pos THEN 'log10_i16' ELSE 'f32' END AS quant, CASE WHEN pos THEN round_even(log10(least(greatest(v, 1e-9), 1e9)) * 3000, 0)::SMALLINT END AS code, CASE WHEN NOT pos THEN v::FLOAT END AS raw FROM x JOIN m USING (block)")
def p16_blocks(spark, d):
    v = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).when(F.col("o_orderkey") % 3 == 1, F.col("o_totalprice") - 100000).otherwise(F.col("o_totalprice") * 1e-16)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3).alias("block"), v.alias("v"))
    return G.encode_blocks(rows, "v", ["block"]).select("k", "quant", "code", "raw")


# --- dumps ------------------------------------------------------------------------------------------------------------------


@query("s10_union_of_files", "WITH g AS (SELECT CASE WHEN l_returnflag = 'A' THEN '1111' ELSE '0000' END AS view, CASE WHEN l_linestatus = 'F' THEN 'both__chargehead' ELSE 'plain' END AS variant, (l_linenumber % 2)::INTEGER AS seed, l_discount::FLOAT AS p, l_quantity::FLOAT AS pt FROM lineitem), s AS (SELECT view, variant, seed, count(*) AS n, sum(p::DOUBLE) AS p, sum(pt::DOUBLE) AS pt FROM g GROUP BY ALL) SELECT view || '__' || variant || '__s' || seed AS id, view, variant, seed, variant = 'both__chargehead' AS has_charge, n AS n_rows, (sum(n) OVER (ORDER BY view DESC, variant DESC, seed) - n)::BIGINT AS row_offset, round(p, 3) AS prob, (CASE WHEN variant = 'plain' THEN -1.0 ELSE 0.5 END)::DOUBLE AS charge, round(CASE WHEN variant = 'plain' THEN -n::DOUBLE ELSE pt END, 2) AS pt, (sum(n) OVER (ORDER BY view DESC, variant DESC, seed) - n)::BIGINT AS first_row, n AS n_numbers FROM s")
def s10_files(spark, d):
    """Tables of two schemas, a file for each view, variant and seed, numbered through."""
    folder = C.new_path(spark, "dumps")
    rows = table(spark, d, "lineitem")
    for view, of_view in (("1111", F.col("l_returnflag") == "A"), ("0000", F.col("l_returnflag") != "A")):
        for variant, status in (("plain", "O"), ("both__chargehead", "F")):
            for seed in (0, 1):
                own = rows.where(of_view & (F.col("l_linestatus") == status) & (F.col("l_linenumber") % 2 == seed))
                probs = [F.array(F.col("l_discount").cast("float"), (1 - F.col("l_discount")).cast("float")).alias("class_probs"), (F.col("l_partkey") % 2).cast("short").alias("y_true")]
                more = [F.array(F.lit(0.5).cast("float"), F.lit(0.5).cast("float")).alias("charge_probs"), F.lit(1).cast("short").alias("charge_true"), F.col("l_quantity").cast("float").alias("pt")] if status == "F" else []
                own.select(*probs, *more).write.parquet(f"{folder}/{view}__{variant}__s{seed}.parquet")
    every, groups = C.union_dumps(spark, folder, ["b", "light"], ["plus", "minus"], ["pt"], ["1111", "0000"], ["plain"])
    sums = every.groupBy(F.col("group").alias("id")).agg(F.round(F.sum(F.col("prob_b").cast("double")), 3).alias("prob"), F.max("prob_plus").cast("double").alias("charge"), F.round(F.sum(F.col("pt").cast("double")), 2).alias("pt"), F.min("row").alias("first_row"), F.count_distinct("row").alias("n_numbers"))
    return groups.join(sums, "id").drop("cell")


# --- losses, vertices, picks ------------------------------------------------------------------------------------------------


def outputs(spark, d):
    """Lines with the logits of three classes and their true one."""
    logits = F.array(F.col("l_discount") * 20, F.col("l_tax") * 20, F.col("l_quantity") / 25)
    truth = F.array(*[(F.col("l_partkey") % 3 == k).cast("double") for k in range(3)])
    return table(spark, d, "lineitem").select(logits.alias("logits"), truth.alias("truth"), (F.col("l_quantity") / 30).alias("ratio"), (F.col("l_tax") * 10 + 0.3).alias("target"), "l_returnflag")


OUTPUTS = "o AS (SELECT l_discount * 20 AS x0, l_tax * 20 AS x1, l_quantity / 25 AS x2, l_partkey % 3 AS c, l_quantity / 30 AS ratio, l_tax * 10 + 0.3 AS target, l_returnflag FROM lineitem), e AS (SELECT *, exp(x0) + exp(x1) + exp(x2) AS z, CASE c WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END AS xc FROM o)"


@query("e24_head_losses", f"WITH {OUTPUTS} SELECT l_returnflag, round(avg(ln(z) - xc), 6) AS cross_entropy, round(avg(power(ratio - target, 2)), 6) AS mse, round(avg(abs(ratio - target)), 6) AS mae, round(avg(ln((exp(ratio - target) + exp(target - ratio)) / 2)), 6) AS logcosh, round(abs(avg(ratio / target - 1)), 6) AS pt_bias FROM e GROUP BY 1")
def e24_losses(spark, d):
    rows, by = outputs(spark, d), ["l_returnflag"]
    found = E.head_loss(rows, "truth", "logits", by=by).withColumnRenamed("loss", "cross_entropy")
    for loss in ("mse", "mae", "logcosh"):
        found = found.join(E.head_loss(rows, "target", "ratio", loss, by=by).withColumnRenamed("loss", loss), by)
    return rounded(found.join(E.pt_bias(rows, "target", "ratio", by), by), 6, "cross_entropy", "mse", "mae", "logcosh", "pt_bias")


@query("e24_soft_working_point", f"WITH {OUTPUTS}, s AS (SELECT c, 1 / (1 + exp(-((exp(x1) + exp(x2)) / z - 0.5) / 0.05)) AS soft FROM e) SELECT round(sum(CASE WHEN c IN (0, 2) THEN soft END) / (count(CASE WHEN c IN (0, 2) THEN 1 END) + 1e-7), 6) AS soft_efficiency FROM s")
def e24_soft(spark, d):
    return rounded(E.soft_efficiency(outputs(spark, d), "truth", "logits", [0, 2], [1, 2]), 6, "soft_efficiency")


@query("e7_vertices_and_association", "WITH v AS (SELECT l_discount * 10 AS g, l_tax * 10 AS s, l_quantity / 50 AS n FROM lineitem), a AS (SELECT avg(s - g) AS stock_res_mean, stddev_pop(s - g) AS stock_res_std, avg(CASE WHEN abs(s - g) < 0.15 THEN 1.0 ELSE 0.0 END) AS stock_efficiency, avg(n - g) AS new_res_mean, stddev_pop(n - g) AS new_res_std, avg(CASE WHEN abs(n - g) < 0.15 THEN 1.0 ELSE 0.0 END) AS new_efficiency, stddev_pop(s - n) AS stock_vs_new_std FROM v), r AS (SELECT l_returnflag = 'R' AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rk FROM lineitem WHERE l_linenumber % 3 > 0), u AS (SELECT count(CASE WHEN y THEN 1 END) AS p, count(CASE WHEN NOT y THEN 1 END) AS q, sum(CASE WHEN y THEN rk END) AS s FROM r) SELECT round(stock_res_mean, 6) AS stock_res_mean, round(stock_res_std, 6) AS stock_res_std, round(stock_efficiency, 6) AS stock_efficiency, round(new_res_mean, 6) AS new_res_mean, round(new_res_std, 6) AS new_res_std, round(new_efficiency, 6) AS new_efficiency, round(stock_vs_new_std, 6) AS stock_vs_new_std, round((s - p * (p + 1) / 2.0) / (p * q), 6) AS assoc_auc FROM a, u")
def e7_vertices(spark, d):
    rows = table(spark, d, "lineitem")
    placed = rows.select((F.col("l_discount") * 10).alias("g"), (F.col("l_tax") * 10).alias("s"), (F.col("l_quantity") / 50).alias("n"))
    compared = E.compare_vertices(placed, "g", "s", "n")
    linked = rows.select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_quantity", (F.col("l_linenumber") % 3).alias("mask"))
    area = E.association_auc(linked, "y", "l_quantity", "mask").select(F.col("auc").alias("assoc_auc"))
    both = compared.crossJoin(F.broadcast(area))
    return rounded(both, 6, *both.columns)


@query("e29_picks_between_two", "WITH v AS (SELECT l_returnflag, l_quantity / 10 AS f, l_discount * 50 AS a, l_tax * 50 AS b, l_linenumber / 3.0 AS ratio FROM lineitem), h AS (SELECT *, f - CASE WHEN ratio > 1 THEN b ELSE a END AS res FROM v) SELECT l_returnflag, round(avg(CASE WHEN f > least(a, b) + 0.05 AND f < greatest(a, b) - 0.05 THEN 1.0 ELSE 0.0 END), 6) AS midpoint_rate, round(avg(CASE WHEN abs(res) < 0.15 THEN 0.0 ELSE 1.0 END), 6) AS wrong_rate, round(avg(res), 6) AS res_mean, round(stddev_pop(res), 6) AS res_std, round(quantile_cont(abs(res), 0.68), 6) AS res_q68 FROM h GROUP BY 1")
def e29_picks(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_quantity") / 10).alias("f"), (F.col("l_discount") * 50).alias("a"), (F.col("l_tax") * 50).alias("b"), (F.col("l_linenumber") / 3).alias("ratio"))
    found = E.pick_quality(rows, "f", "a", "b", "ratio", 0.1, ["l_returnflag"])
    return rounded(found, 6, "midpoint_rate", "wrong_rate", "res_mean", "res_std", "res_q68")


# --- the exact incremental map ----------------------------------------------------------------------------------------------


@query("t1_exact_map", "SELECT (user_id % 10)::INTEGER AS a, hour(ts)::INTEGER AS b, count(value) AS n, round(sum(value), 4) AS total, round(quantile_cont(value::DOUBLE, 0.5), 6) AS median, round((quantile_cont(value::DOUBLE, 0.84) - quantile_cont(value::DOUBLE, 0.16)) / 2, 6) AS width FROM events GROUP BY 1, 2")
def t1_exact(spark, d):
    """Files of events come one by one; each makes the cells that it touches new."""
    path, store = C.new_path(spark, "stream"), C.new_path(spark, "stream-exact")
    rows = table(spark, d, "events").select((F.col("user_id") % 10).cast("int").alias("a"), F.hour("ts").alias("b"), F.col("value").cast("double").alias("value"))
    rows.repartitionByRange(3, "b", "a").write.parquet(path)
    incremental.start_exact_map(spark, path, "a int, b int, value double", store, C.new_path(spark, "stream-state"), "a", "b", "value").awaitTermination()
    found = incremental.current_map(spark, f"{store}/map")
    q = F.col("quantiles")
    return found.select("a", "b", "n", F.round("total", 4).alias("total"), F.round(q[1], 6).alias("median"), F.round((q[2] - q[0]) / 2, 6).alias("width"))


@query("a1_clipped_chi2", "WITH h AS (SELECT l_orderkey AS track, sum(greatest(l_discount - 0.05, 0)) AS s FROM lineitem GROUP BY 1) SELECT o_orderkey AS track, round(coalesce(s, 0), 6) AS sum_chi2_rphi FROM orders LEFT JOIN h ON track = o_orderkey")
def a1_chi2(spark, d):
    hits = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track"), (F.col("l_discount") - 0.05).alias("chi2IncRPhi"))
    tracks = table(spark, d, "orders").select(F.col("o_orderkey").alias("track"))
    return rounded(A.sum_clipped_chi2(hits, tracks, ["track"]), 6, "sum_chi2_rphi")


# --- guards and joins on two tables -----------------------------------------------------------------------------------------


@query("u2_parts_that_no_supplier_key_names", "SELECT p_partkey FROM part EXCEPT SELECT l_suppkey FROM lineitem")
def u2(spark, d):
    named = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("p_partkey")).distinct()
    return table(spark, d, "part").select("p_partkey").distinct().join(named, "p_partkey", "left_anti")


@query("a16_sign_with_noise", "WITH x AS (SELECT l_tax AS t, l_discount AS p, l_tax - l_discount + l_quantity / 10000 AS r FROM lineitem) SELECT round(quantile_cont(abs(t - p - r), 0.5), 6) AS as_is, round(quantile_cont(abs(t - p + r), 0.5), 6) AS flipped FROM x")
def a16(spark, d):
    rows = table(spark, d, "lineitem").withColumn("res", F.col("l_tax") - F.col("l_discount") + F.col("l_quantity") / 10000)
    return rounded(A.sign_check(rows, "l_tax", "l_discount", "res"), 6, "as_is", "flipped")


@query("j2_twins_in_two_tables", "WITH a AS (SELECT o_custkey % 100 AS event, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) - 1 AS place, o_totalprice AS price FROM orders), b AS (SELECT c_custkey % 100 AS event, row_number() OVER (PARTITION BY c_custkey % 100 ORDER BY c_custkey) - 1 AS place, c_acctbal AS balance FROM customer) SELECT event, place::INTEGER AS place, price, balance FROM a JOIN b USING (event, place)")
def j2(spark, d):
    """Two tables whose rows belong together by their place within the event."""
    a = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("event"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    b = table(spark, d, "customer").select((F.col("c_custkey") % 100).alias("event"), F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"))
    return J.positional_twins(a, b, ["event"], ["k"], ["k"]).select("event", "place", "price", "balance")


@query("p25_other_convention", "SELECT l_orderkey, l_linenumber, l_partkey, l_tax AS alpha, l_discount AS beta, -l_tax AS residual_alpha, -l_discount AS residual_beta FROM lineitem")
def p25(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_discount").alias("alpha"), F.col("l_tax").alias("beta"), F.col("l_discount").alias("residual_alpha"), F.col("l_tax").alias("residual_beta"))
    return S.other_convention(rows, {"alpha": "beta", "beta": "alpha", "residual_alpha": "residual_beta", "residual_beta": "residual_alpha"}, ["residual_alpha", "residual_beta"])
