"""Windows, splits, subsamples, quotas and unions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evflow.operators import selection as K
from evflow.plans.catalog import query, table


def lines(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("step"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"), F.col("l_tax").alias("tax"))


LINES = "l AS (SELECT l_orderkey AS track, l_linenumber AS step, l_partkey AS part, l_extendedprice AS price, l_quantity AS qty, l_tax AS tax FROM lineitem)"
OVER = "(PARTITION BY track ORDER BY step, part, price, qty ROWS UNBOUNDED PRECEDING)"
ORDER = ["step", "part", "price", "qty"]


@query("w1_running_sum", f"WITH {LINES} SELECT track, step, part, round(sum(qty) OVER {OVER}, 4) AS total FROM l")
def w1(spark, d):
    return lines(spark, d).select("track", "step", "part", F.round(K.running_sum("qty", ["track"], ORDER), 4).alias("total"))


@query("w2_running_reduced_chi2", f"WITH {LINES} SELECT track, step, part, round((2.0 * 4 + sum(tax * 10) OVER {OVER}) / (4 + sum(1 + part % 2) OVER {OVER}), 6) AS reduced_chi2 FROM l")
def w2(spark, d):
    rows = lines(spark, d).withColumns({"chi2": F.lit(2.0), "ndof": F.lit(4), "inc": F.col("tax") * 10, "more": 1 + F.col("part") % 2})
    found = K.running_reduced_chi2(rows, ["track"], ORDER, "chi2", "ndof", "inc", "more")
    return found.select("track", "step", "part", F.round("reduced_chi2", 6).alias("reduced_chi2"))


@query("w3_step_change", f"WITH {LINES}, e AS (SELECT *, abs(price - 40000) AS err, lag(abs(price - 40000)) OVER (PARTITION BY track ORDER BY step, part, price, qty) AS before FROM l) SELECT track, step, part, round(CASE WHEN before >= 1e-12 THEN 100 * (err - before) / before END, 4) AS percent_change FROM e")
def w3(spark, d):
    found = K.step_change(lines(spark, d).withColumn("truth", F.lit(40000.0)), ["track"], ORDER, "price", "truth")
    return found.select("track", "step", "part", F.round("percent_change", 4).alias("percent_change"))


@query("k1_custom_order", "SELECT o_orderkey, (CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '5-LOW' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 3 END)::INTEGER AS place FROM orders")
def k1(spark, d):
    return table(spark, d, "orders").select("o_orderkey", K.order_by_list(F.col("o_orderpriority"), ["1-URGENT", "5-LOW", "2-HIGH"]).alias("place"))


@query("k3_best_of", "SELECT o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, min(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def k3(spark, d):
    return K.best_of(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


@query("k4_curate", """WITH a AS (SELECT o_orderkey, 'large' AS archetype FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 20),
 b AS (SELECT o_orderkey, 'late' AS archetype FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT o_orderkey FROM a) ORDER BY o_orderkey LIMIT 20) SELECT * FROM a UNION ALL SELECT * FROM b""")
def k4(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return K.curate(orders, [("large", F.col("o_totalprice") > 400000, 20), ("late", F.col("o_orderstatus") == "F", 20)], ["o_orderkey"]).select("o_orderkey", "archetype")


@query("k6_exact_split", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '|0'), o_orderkey) AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, r <= floor(n * 0.2) AS is_test FROM r")
def k6(spark, d):
    return K.exact_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 0.2)


@query("k7_balanced_subsample", "WITH r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR || '|0'), event_id) AS r FROM events) SELECT event_id, event_type FROM r WHERE r <= 500 // (SELECT count(DISTINCT event_type) FROM events)")
def k7(spark, d):
    return K.balanced_subsample(table(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"], 500)


@query("u1_union", "SELECT o_orderkey AS k, o_totalprice AS v, -1.0::DOUBLE AS w FROM orders UNION ALL SELECT c_custkey, c_acctbal, 1.0 FROM customer")
def u1(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(1.0).alias("w"))
    return K.union_all([a, b], -1.0)


@query("s10_dump_groups", "WITH c AS (SELECT l_returnflag AS cell, l_linenumber AS seed, count(*) AS n_rows FROM lineitem GROUP BY 1, 2) SELECT cell, seed, n_rows, (sum(n_rows) OVER (ORDER BY cell, seed) - n_rows)::BIGINT AS row_offset FROM c")
def s10(spark, d):
    return K.dump_groups(table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cell"), F.col("l_linenumber").alias("seed")), "cell", "seed")


@query("u2_missing_keys", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def u2(spark, d):
    return table(spark, d, "customer").select("c_custkey").exceptAll(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct())
