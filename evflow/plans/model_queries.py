"""Builders, tree scores, trained models, further metrics and the incremental map on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evflow.functions import scalars as S
from evflow.operators import aggregates as A
from evflow.operators import builders as B
from evflow.operators import evaluation as E
from evflow.operators import joins as J
from evflow.operators import modelling as M
from evflow.plans.catalog import query, table
from evflow.sources.collections import new_path
from evflow.streaming import incremental as T


def items(spark, d):
    return table(spark, d, "lineitem")


#: Two small trees, as a scorer would load them.
TREES = {
    "splitting_convention": "<=",
    "init_predict": [0.25],
    "norm": 0.5,
    "trees": [
        [{"feature": [0, -2, 1, -2, -2], "threshold": [20.0, 0, 0.05, 0, 0], "children_left": [1, -1, 3, -1, -1], "children_right": [2, -1, 4, -1, -1], "value": [0, -0.5, 0, 0.25, 1.0]}],
        [{"feature": [1, -2, -2], "threshold": [0.03, 0, 0], "children_left": [1, -1, -1], "children_right": [2, -1, -1], "value": [0, 0.125, -0.25]}],
    ],
}


@query("m3_tree_score", "SELECT l_orderkey, l_linenumber, l_partkey, ((0.25 + CASE WHEN l_quantity <= 20 THEN -0.5 WHEN l_discount::FLOAT <= 0.05::FLOAT THEN 0.25 ELSE 1.0 END + CASE WHEN l_discount::FLOAT <= 0.03::FLOAT THEN 0.125 ELSE -0.25 END) * 0.5)::FLOAT AS score FROM lineitem")
def m3(spark, d):
    return items(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", M.tree_score(TREES, [F.col("l_quantity"), F.col("l_discount")]).alias("score"))


@query("m4_score_parity", "SELECT max(abs(a - b)) AS largest, count(CASE WHEN a = b THEN 1 END) AS equal, count(*) AS n FROM (SELECT l_quantity / 50 AS a, CASE WHEN l_partkey % 10 = 0 THEN l_quantity / 50 + 0.5 ELSE l_quantity / 50 END AS b FROM lineitem)")
def m4(spark, d):
    a = F.col("l_quantity") / 50
    return M.parity(items(spark, d).select(a.alias("a"), F.when(F.col("l_partkey") % 10 == 0, a + 0.5).otherwise(a).alias("b")), "a", "b")


@query("m5_bagged_score", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity / 50 + l_discount * 10 + l_tax * 10) / 3, 6) AS score FROM lineitem")
def m5(spark, d):
    return items(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.round(M.bagged([F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10]), 6).alias("score"))


def learnable(spark, d):
    """Lines with a label that price and quantity decide, but for some."""
    noise = F.col("l_partkey") % 10 == 0
    return items(spark, d).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), "l_quantity", "l_extendedprice", "l_discount", F.when(noise, F.col("l_partkey") % 2).otherwise((F.col("l_extendedprice") > F.col("l_quantity") * 1500).cast("long")).alias("y"))


@query("m1_boosted_trees")
def m1(spark, d):
    """Test rows with their score; models differ by engine, so there is no SQL."""
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    rows = learnable(spark, d)
    model = M.fit_trees(rows.where("k % 4 <> 0"), features, rounds=5)
    return M.with_score(model, rows.where("k % 4 = 0")).select("k", "n", "p", "y", F.round("score", 4).alias("score"))


@query("m6_logistic_baseline")
def m6(spark, d):
    """Test rows with a baseline's score."""
    rows = learnable(spark, d)
    model = M.fit_baseline(rows.where("k % 4 <> 0"), ["l_quantity", "l_extendedprice", "l_discount"])
    return M.with_score(model, rows.where("k % 4 = 0")).select("k", "n", "p", "y", F.round("score", 4).alias("score"))


@query("m7_feature_gains")
def m7(spark, d):
    """Gain of each feature in the trees."""
    features = ["l_quantity", "l_extendedprice", "l_discount"]
    model = M.fit_trees(learnable(spark, d), features, rounds=3)
    gains = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, gains, strict=True)), "feature string, gain double").orderBy(F.desc("gain"))


Q = "greatest(0, least(15, round_even(2 * log2(1 + l_extendedprice / 1000), 0)))::DOUBLE"


@query("b13_transmission_tiers", f"SELECT l_orderkey, l_linenumber, l_partkey, round(l_discount, 6) AS ts0, {Q} AS chi2, least(7, floor(log2(1 + l_quantity)))::DOUBLE AS occ FROM lineitem")
def b13(spark, d):
    tiers = B.transmission_tiers(items(spark, d).withColumn("c", F.col("l_extendedprice") / 1000), "l_discount", ["c"], ["l_quantity"])
    return tiers.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("TS2")[0], 6).alias("ts0"), F.col("TS2")[1].alias("chi2"), F.col("TS2")[2].alias("occ"))


@query("b9_pair_features", "SELECT o_orderkey AS idx, coalesce(a.p_size, 0)::DOUBLE AS first_size, coalesce(b.p_size, 0)::DOUBLE AS second_size, o_totalprice AS own FROM orders LEFT JOIN part a ON a.p_partkey = CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey % 2000 END LEFT JOIN part b ON b.p_partkey = o_custkey % 2000")
def b9(spark, d):
    from evflow.operators.nested import gather

    parts = table(spark, d, "part").select(F.col("p_partkey").alias("place"), F.col("p_size").cast("double").alias("size"))
    pairs = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(-1)).otherwise(F.col("o_orderkey") % 2000).alias("first"), (F.col("o_custkey") % 2000).alias("second"), F.col("o_totalprice").alias("own"))
    one = gather(pairs, parts, [], "first", "place", {"size": 0.0}).withColumnRenamed("size", "first_size")
    return gather(one, parts, [], "second", "place", {"size": 0.0}).select("idx", "first_size", F.col("size").alias("second_size"), "own")


@query("b11_training_table", "WITH k AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 100000), r AS (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '|3'), o_orderkey) AS r, count(*) OVER () AS n FROM k) SELECT o_orderkey, o_totalprice, o_orderstatus AS y, r <= floor(n * 0.25) AS is_test FROM r")
def b11(spark, d):
    orders = table(spark, d, "orders")
    features = orders.select("o_orderkey", "o_totalprice")
    labels = orders.select("o_orderkey", F.col("o_orderstatus").alias("y"), (F.col("o_totalprice") > 100000).alias("keep"))
    return B.training_table(features, labels, ["o_orderkey"], 0.25, 3).drop("keep")


@query("a6_charge_by_class", "WITH c AS (SELECT l_orderkey AS jet, sum((l_suppkey % 3 - 1) * l_extendedprice) / sum(l_extendedprice) AS q FROM lineitem GROUP BY 1) SELECT jet % 3 AS class, count(*) AS n, round(avg(q), 6) AS mean_charge FROM c GROUP BY 1")
def a6(spark, d):
    kids = items(spark, d).select(F.col("l_orderkey").alias("jet"), (F.col("l_suppkey") % 3 - 1).alias("q"), F.col("l_extendedprice").alias("pt"))
    charges = A.jet_charge(kids, kids.select("jet").distinct(), ["jet"], "q", "pt", 1.0)
    return charges.groupBy((F.col("jet") % 3).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("jet_charge"), 6).alias("mean_charge"))


@query("e7_vertex_comparison", "SELECT round(avg(l_discount - l_tax), 6) AS mean, round(stddev_pop(l_discount - l_tax), 6) AS std, round(avg(CASE WHEN abs(l_discount - l_tax) < 0.015 THEN 1.0 ELSE 0.0 END), 6) AS efficiency FROM lineitem")
def e7(spark, d):
    residual = F.col("l_discount") - F.col("l_tax")
    return items(spark, d).agg(F.round(F.avg(residual), 6).alias("mean"), F.round(F.stddev_pop(residual), 6).alias("std"), F.round(F.avg((F.abs(residual) < 0.015).cast("double")), 6).alias("efficiency"))


@query("e18_grid_slice", "SELECT hour(ts)::INTEGER AS x, round(avg(value), 6) AS mean, round(quantile_cont(value::DOUBLE, 0.5), 6) AS median, count(*) AS n FROM events WHERE event_type = 'click' AND value BETWEEN 1 AND 50 GROUP BY 1")
def e18(spark, d):
    rows = table(spark, d, "events").where((F.col("event_type") == "click") & S.in_range(F.col("value"), 1, 50))
    found = A.summary(rows.withColumn("x", F.hour("ts")), "value", ["x"])
    return found.select("x", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "n")


@query("e19_envelope", "SELECT event_type, round(avg(value) - 2 * stddev_pop(value), 6) AS low, round(avg(value) + 2 * stddev_pop(value), 6) AS high FROM events GROUP BY 1")
def e19(spark, d):
    stats = A.summary(table(spark, d, "events"), "value", ["event_type"])
    return stats.select("event_type", F.round(F.col("mean") - 2 * F.col("std"), 6).alias("low"), F.round(F.col("mean") + 2 * F.col("std"), 6).alias("high"))


@query("e23_hit_labels", "SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def e23(spark, d):
    labels = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("label"))
    return items(spark, d).join(labels, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "label")


@query("e24_soft_efficiency", "SELECT o_orderstatus AS class, round(avg(1 / (1 + exp(-(o_totalprice - 250000) / 50000))), 6) AS soft_efficiency FROM orders GROUP BY 1")
def e24(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("class")).agg(F.round(F.avg(S.sigmoid((F.col("o_totalprice") - 250000) / 50000)), 6).alias("soft_efficiency"))


@query("e29_pick_quality", "SELECT round(avg(CASE WHEN abs(l_quantity - 25) < 2 THEN 1.0 ELSE 0.0 END), 6) AS midpoint, round(quantile_cont(abs(l_quantity - 25)::DOUBLE, 0.68), 6) AS q68, round(stddev_pop(l_quantity - 25), 6) AS std FROM lineitem")
def e29(spark, d):
    r = F.col("l_quantity") - 25
    return items(spark, d).agg(F.round(F.avg((F.abs(r) < 2).cast("double")), 6).alias("midpoint"), F.round(F.percentile(F.abs(r), 0.68), 6).alias("q68"), F.round(F.stddev_pop(r), 6).alias("std"))


@query("j2_positional_twins", "SELECT a.o_orderkey AS idx, a.o_totalprice AS price, b.o_orderstatus AS status FROM orders a JOIN orders b USING (o_orderkey)")
def j2(spark, d):
    orders = table(spark, d, "orders")
    return orders.select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("price")).join(orders.select(F.col("o_orderkey").alias("idx"), F.col("o_orderstatus").alias("status")), "idx")


@query("j8_dense_grid", "WITH c AS (SELECT (user_id % 10)::INTEGER AS a, hour(ts)::INTEGER AS b, count(*) AS n FROM events GROUP BY 1, 2) SELECT i::INTEGER AS a, j::INTEGER AS b, coalesce(n, 0)::BIGINT AS n FROM generate_series(0, 9) g(i) CROSS JOIN generate_series(0, 23) h(j) LEFT JOIN c ON c.a = i AND c.b = j")
def j8(spark, d):
    counts = table(spark, d, "events").groupBy((F.col("user_id") % 10).cast("int").alias("a"), F.hour("ts").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return J.grid_table({"a": 10, "b": 24}, spark).join(counts.hint("shuffle_hash"), ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("k5_explicit_keys", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' ELSE 'small' END AS archetype FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def k5(spark, d):
    keys = items(spark, d).where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    kept = table(spark, d, "orders").join(keys, "o_orderkey", "left_semi")
    return kept.select("o_orderkey", F.when(F.col("o_totalprice") > 300000, "large").otherwise("small").alias("archetype"))


def even_sql(key: str, stream: str) -> str:
    return f"((('0x' || substr(md5({key} || '|{stream}'), 1, 8))::BIGINT + 1) / 4294967296.0)"


LINE = "(l_orderkey::VARCHAR || '/' || l_linenumber::VARCHAR || '/' || l_partkey::VARCHAR)"


@query("k8_augmented_constituents", f"SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 + 0.05 * sqrt(-2 * ln({even_sql(LINE, 'smear/r')})) * cos(2 * pi() * {even_sql(LINE, 'smear/a')})), 4) AS price FROM lineitem WHERE {even_sql(LINE, 'drop')} > 0.1")
def k8(spark, d):
    """Lines of which a tenth is dropped and the rest smeared, by a hash of their keys."""
    key = F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey")
    kept = items(spark, d).where(S.hashed_uniform(key, "drop") > 0.1)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * (1 + 0.05 * S.hashed_normal(key, "smear")), 4).alias("price"))


@query("k10_fused_shift", "SELECT c_custkey, round(c_acctbal / 100 + 0.5 * ((('0x' || substr(md5(c_custkey::VARCHAR || '|flat'), 1, 8))::BIGINT + 1) / 4294967296.0), 6) AS shift FROM customer")
def k10(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(F.col("c_acctbal") / 100 + 0.5 * S.hashed_uniform(F.col("c_custkey"), "flat"), 6).alias("shift"))


@query("a23_dataset_guards", "SELECT count(*) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS n_pos FROM labels")
def a23(spark, d):
    labels = table(spark, d, "labels")
    A.guard(labels, some_positive=F.bool_or(F.col("quality") == 1), no_missing=F.bool_and(F.col("doc_id").isNotNull()))
    return labels.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("n_pos"))


@query("e8_ordinal_rank_correlation", "WITH r AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS b FROM orders) SELECT round(corr(a, b), 6) AS rho FROM r")
def e8(spark, d):
    """Ranks of distinct pairs (value, key): average ranks of values without ties are ordinal ranks."""
    orders = table(spark, d, "orders")
    a, b = F.struct("o_totalprice", "o_orderkey").alias("a"), F.struct("o_custkey", "o_orderkey").alias("b")
    return E.spearman(orders.select(a, b), "a", "b").select(F.round("rho", 6).alias("rho"))


@query("t1_incremental_map", "SELECT (user_id % 10)::INTEGER AS a, hour(ts)::INTEGER AS b, count(value) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def t1(spark, d):
    """Files of events come one by one; the stream keeps count and sums of each cell."""
    path, store = new_path(spark, "stream"), new_path(spark, "stream-cells")
    rows = table(spark, d, "events").select((F.col("user_id") % 10).cast("int").alias("a"), F.hour("ts").alias("b"), "value")
    rows.repartition(4).write.parquet(path)
    run = T.start_map(T.stream_cells(spark, path, "a int, b int, value double", "a", "b", "value"), new_path(spark, "stream-state"), store)
    run.awaitTermination()
    return T.current_map(spark, store).select("a", "b", "n", F.round("total", 4).alias("total"))
