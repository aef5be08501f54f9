"""Metrics and curves on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evflow.operators import evaluation as E
from evflow.plans.catalog import query, table


def scored(spark, d):
    """Labelled documents with their length as a score."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", "lang", F.floor(F.col("n_chars") / 50).cast("double").alias("score"), "quality", "toxic")


SCORED = "s AS (SELECT doc_id, lang, floor(n_chars / 50)::DOUBLE AS score, quality, toxic FROM labels JOIN documents USING (doc_id))"


def auc_sql(by: str = "", source: str = "s", pos: str = "toxic = 1") -> str:
    """Pairs are counted one by one: another way to the same area."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""r AS (SELECT *, rank() OVER ({part}ORDER BY score) + (count(*) OVER (PARTITION BY {keys}score) - 1) / 2.0 AS rk FROM {source})
SELECT {keys}count(CASE WHEN {pos} THEN 1 END) AS n_pos, count(CASE WHEN NOT ({pos}) THEN 1 END) AS n_neg,
 round((sum(CASE WHEN {pos} THEN rk END) - count(CASE WHEN {pos} THEN 1 END) * (count(CASE WHEN {pos} THEN 1 END) + 1) / 2.0) / nullif(count(CASE WHEN {pos} THEN 1 END) * count(CASE WHEN NOT ({pos}) THEN 1 END), 0), 6) AS auc FROM r{group}"""


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("e1_auc", f"WITH {SCORED}, {auc_sql()}")
def e1(spark, d):
    return rounded(E.auc(scored(spark, d), "score", F.col("toxic") == 1), "auc")


@query("e15_auc_by_bin", f"WITH {SCORED}, b AS (SELECT *, least(floor(doc_id / 2000), 4)::INTEGER AS bin FROM s), {auc_sql('bin', 'b')}")
def e15(spark, d):
    return rounded(E.binned_auc_of_all(scored(spark, d), F.col("doc_id"), "score", F.col("toxic") == 1, [0.0, 2000.0, 4000.0, 6000.0, 8000.0, 10000.0]), "auc")


LENGTHS = [0.0, 500.0, 1000.0, 2000.0, 4000.0, 8000.0]


@query("e15_auc_by_length", f"WITH n AS (SELECT doc_id, n_chars, lang FROM documents WHERE n_chars IS NOT NULL), b AS (SELECT floor(n_chars / 50)::DOUBLE AS score, toxic, (CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 2000 THEN 2 WHEN n_chars < 4000 THEN 3 ELSE 4 END)::INTEGER AS bin FROM labels JOIN n USING (doc_id)), {auc_sql('bin', 'b')}")
def e15_length(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    rows = table(spark, d, "labels").join(docs, "doc_id").withColumn("score", F.floor(F.col("n_chars") / 50).cast("double"))
    return rounded(E.binned_auc_of_all(rows, F.col("n_chars"), "score", F.col("toxic") == 1, LENGTHS), "auc")


@query("e4_e21_auc_by_class", f"WITH {SCORED}, {auc_sql('lang')}")
def e4(spark, d):
    return rounded(E.auc(scored(spark, d), "score", F.col("toxic") == 1, ["lang"]), "auc")


@query("e22_auc_by_column", "WITH s AS (SELECT name, score, pos FROM (SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_returnflag = 'R' AS pos FROM lineitem) UNPIVOT (score FOR name IN (quantity, discount, tax))), " + auc_sql("name", "s", "pos"))
def e22(spark, d):
    long = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").alias("pos"), F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"l_{n}").alias("score")) for n in ("quantity", "discount", "tax")])).alias("x"))
    return rounded(E.auc(long.select("pos", "x.*"), "score", F.col("pos"), ["name"]), "auc")


@query("e2_fake_rates", f"WITH {SCORED}, e AS (SELECT unnest([0.95, 0.97, 0.99])::DOUBLE AS efficiency), t AS (SELECT efficiency, (SELECT quantile_cont(score, [1 - 0.95, 1 - 0.97, 1 - 0.99]) FROM s WHERE toxic = 1)[CASE efficiency WHEN 0.95 THEN 1 WHEN 0.97 THEN 2 ELSE 3 END] AS threshold FROM e) SELECT efficiency, round(threshold, 4) AS threshold, round(avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END), 6) AS fake_rate FROM t, s WHERE toxic = 0 GROUP BY efficiency, threshold")
def e2(spark, d):
    return E.fake_rates(scored(spark, d), "score", F.col("toxic") == 1).select("efficiency", F.round("threshold", 4).alias("threshold"), F.round("fake_rate", 6).alias("fake_rate"))


def judged(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_linenumber") % 4).alias("truth"), F.when(F.col("l_quantity") > 30, F.col("l_linenumber") % 4).otherwise(F.col("l_partkey") % 4).cast("int").alias("guess"))


JUDGED = "j AS (SELECT (l_linenumber % 4)::INTEGER AS truth, (CASE WHEN l_quantity > 30 THEN l_linenumber % 4 ELSE l_partkey % 4 END)::INTEGER AS guess FROM lineitem)"
MATRIX = f"{JUDGED}, m AS (SELECT truth, guess, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY truth) AS share FROM j GROUP BY 1, 2)"


@query("e3_w6_confusion", f"WITH {MATRIX} SELECT truth, guess, n, round(share, 6) AS share FROM m")
def e3(spark, d):
    return rounded(E.confusion(judged(spark, d), "truth", "guess"), "share")


@query("e3_accuracy", f"WITH {JUDGED}, p AS (SELECT truth, count(*) AS n, count(CASE WHEN truth = guess THEN 1 END) AS hit FROM j GROUP BY 1) SELECT round(sum(hit) / sum(n), 6) AS accuracy, round(avg(hit / n), 6) AS balanced_accuracy FROM p")
def e3b(spark, d):
    return rounded(E.accuracy(judged(spark, d), "truth", "guess"), "accuracy", "balanced_accuracy")


@query("e5_k2_confusable_pairs", f"WITH {MATRIX} SELECT least(truth, guess) AS class_a, greatest(truth, guess) AS class_b, round(sum(share) / 2, 6) AS confusion FROM m WHERE truth <> guess GROUP BY 1, 2")
def e5(spark, d):
    return rounded(E.confusable_pairs(E.confusion(judged(spark, d), "truth", "guess"), "truth", "guess"), "confusion")


@query("e6_regression_metrics", "WITH x AS (SELECT l_extendedprice::DOUBLE AS p, p_retailprice * l_quantity AS t FROM lineitem JOIN part ON p_partkey = l_partkey) SELECT round(avg(abs(p - t)), 3) AS mae, round(sqrt(avg((p - t) * (p - t))), 3) AS rmse, round(avg(p - t), 3) AS bias, round(1 - avg((p - t) * (p - t)) / var_pop(t), 5) AS r2, round(quantile_cont(p / t, 0.5), 5) AS response_median, round((quantile_cont(p / t, 0.84) - quantile_cont(p / t, 0.16)) / 2, 5) AS response_width FROM x")
def e6(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_extendedprice").alias("p"), (F.col("p_retailprice") * F.col("l_quantity")).alias("t"))
    found = E.regression_metrics(rows, "t", "p")
    return found.select(*[F.round(c, 3).alias(c) for c in ("mae", "rmse", "bias")], *[F.round(c, 5).alias(c) for c in ("r2", "response_median", "response_width")])


@query("e9_spearman", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS rho FROM r")
def e9(spark, d):
    return rounded(E.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "rho")


KS = """x AS (SELECT o_totalprice AS v, o_orderkey % 2 AS h FROM orders), c AS (SELECT v, sum(CASE WHEN h = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN h = 1 THEN 1 ELSE 0 END) AS b FROM x GROUP BY 1),
 u AS (SELECT sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER () AS d FROM c)"""


@query("e10_ks_two_sample", f"WITH {KS} SELECT (SELECT count(*) FROM x WHERE h = 0) AS n_left, (SELECT count(*) FROM x WHERE h = 1) AS n_right, round(max(abs(d)), 6) AS ks FROM u")
def e10(spark, d):
    orders = table(spark, d, "orders")
    found = E.ks_two_sample(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 2 = 1"), "o_totalprice")
    return found.select("n_left", "n_right", F.round("ks", 6).alias("ks"))


@query("e11_ks_uniform", "WITH x AS (SELECT l_quantity / 50 AS v FROM lineitem), c AS (SELECT v, count(*) AS n FROM x GROUP BY 1), f AS (SELECT v, n, sum(n) OVER (ORDER BY v) AS up, sum(n) OVER () AS total FROM c) SELECT any_value(total)::BIGINT AS n, round(max(greatest(up / total - v, v - (up - n) / total)), 6) AS ks FROM f")
def e11(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("v"))
    return rounded(E.ks_uniform(rows, "v"), "ks")


EDGES = [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]
BIN = "least(floor(l_quantity / 10), 4)::INTEGER"


@query("e13_binned_stats", f"SELECT {BIN} AS bin, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 4) AS median, round(quantile_cont(l_extendedprice::DOUBLE, 0.16), 4) AS q16, round(quantile_cont(l_extendedprice::DOUBLE, 0.84), 4) AS q84 FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def e13(spark, d):
    found = E.binned_stats(table(spark, d, "lineitem"), F.col("l_quantity"), "l_extendedprice", EDGES)
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "median", "q16", "q84")})


@query("e14_binned_efficiency", f"SELECT {BIN} AS bin, round(avg(CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END END), 6) AS efficiency, round(avg(CASE WHEN l_returnflag <> 'R' THEN CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END END), 6) AS mistag, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def e14(spark, d):
    found = E.binned_efficiency(table(spark, d, "lineitem"), F.col("l_quantity"), "l_discount", F.col("l_returnflag") == "R", 0.05, EDGES)
    return rounded(found, "efficiency", "mistag")


@query("e16_histogram", f"SELECT {BIN} AS bin, count(*) AS n, round(count(*) / sum(count(*)) OVER () / 10, 6) AS density FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def e16(spark, d):
    return rounded(E.histogram(table(spark, d, "lineitem"), F.col("l_quantity"), EDGES), "density")


@query("e17_combine_curves", f"WITH c AS (SELECT {BIN} AS bin, l_linenumber AS seed, avg(l_tax) AS v FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 2) SELECT bin, round(avg(v), 6) AS mean, round(min(v), 6) AS low, round(max(v), 6) AS high, count(*) AS n_curves FROM c GROUP BY 1")
def e17(spark, d):
    from evflow.functions.scalars import edge_bin

    curves = table(spark, d, "lineitem").withColumn("bin", edge_bin(F.col("l_quantity"), EDGES)).where("bin is not null").groupBy("bin", "l_linenumber").agg(F.avg("l_tax").alias("v"))
    return rounded(E.combine_curves(curves, "bin", "v"), "mean", "low", "high")


@query("e20_paired_deltas", "WITH s AS (SELECT l_returnflag AS name, l_linenumber AS seed, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1, 2) SELECT a.name, round(avg(a.v - b.v), 4) AS mean_delta, round(stddev_pop(a.v - b.v), 4) AS std_delta, round(min(a.v - b.v), 4) AS min_delta, round(max(a.v - b.v), 4) AS max_delta, count(CASE WHEN a.v > b.v THEN 1 END) AS improved FROM s a JOIN s b ON a.seed = b.seed AND b.name = 'A' WHERE a.name <> 'A' GROUP BY 1")
def e20(spark, d):
    scores = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("name"), F.col("l_linenumber").alias("seed")).agg(F.avg("l_extendedprice").alias("v"))
    found = E.paired_deltas(scores, "name", "seed", "v", "A")
    return found.withColumns({c: F.round(c, 4) for c in ("mean_delta", "std_delta", "min_delta", "max_delta")})


@query("e26_mutual_information", f"WITH j AS (SELECT {BIN} AS a, l_linenumber AS b, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1, 2), m AS (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM j) SELECT round(sum(n / t * ln(n * t / (na * nb))), 8) AS mutual_information FROM m")
def e26(spark, d):
    from evflow.functions.scalars import edge_bin

    return E.mutual_information(table(spark, d, "lineitem"), edge_bin(F.col("l_quantity"), EDGES), F.col("l_linenumber")).select(F.round("mutual_information", 8).alias("mutual_information"))


@query("e27_rows_that_differ", "WITH a AS (SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders), b AS (SELECT k, CASE WHEN k % 10 = 0 THEN price + 1 ELSE price END AS price, status FROM a WHERE k % 1000 <> 1) SELECT 'price' AS \"column\", count(CASE WHEN a.price IS DISTINCT FROM b.price OR b.k IS NULL THEN 1 END) AS n_differ FROM a LEFT JOIN b USING (k) UNION ALL SELECT 'status', count(CASE WHEN a.status IS DISTINCT FROM b.status OR b.k IS NULL THEN 1 END) FROM a LEFT JOIN b USING (k)")
def e27(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"))
    b = a.where("k % 1000 <> 1").withColumn("price", F.when(F.col("k") % 10 == 0, F.col("price") + 1).otherwise(F.col("price")))
    return E.rows_that_differ(a, b, ["k"])


@query("e28_acceptance", "SELECT o_orderstatus AS status, round(avg(o_totalprice), 2) AS value, abs(avg(o_totalprice) - 250000) <= 5000 AS passed FROM orders GROUP BY 1")
def e28(spark, d):
    means = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.avg("o_totalprice").alias("value"))
    tested = E.acceptance(means.withColumns({"expected": F.lit(250000.0), "tolerance": F.lit(5000.0)}), "value", "expected", "tolerance")
    return tested.select("status", F.round("value", 2).alias("value"), "passed")


@query("e30_result_matrix", "SELECT l_returnflag AS view, round(avg(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 6) AS F, round(avg(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 6) AS O FROM lineitem GROUP BY 1")
def e30(spark, d):
    wide = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("view")).pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_quantity"))
    return rounded(wide, "F", "O")
