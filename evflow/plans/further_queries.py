"""Further sinks, ranks, windows and features on the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evflow.functions import scalars as S
from evflow.operators import aggregates as A
from evflow.operators import builders as B
from evflow.operators import evaluation as E
from evflow.operators import nested as N
from evflow.operators import selection as K
from evflow.plans.aggregate_queries import TRACKS, windows
from evflow.plans.catalog import query, table
from evflow.sources.collections import new_path


def items(spark, d):
    return table(spark, d, "lineitem")


@query("s11_scored_export", "SELECT 'F' AS config, l_orderkey AS k, l_partkey AS p, round(1 / (1 + exp(-(l_quantity - 25) / 10)), 6) AS score FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag <> 'N' UNION ALL SELECT 'O', l_orderkey, l_partkey, round(1 / (1 + exp(-(l_extendedprice - 40000) / 10000)), 6) FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag <> 'N'")
def s11(spark, d):
    """Scored rows of two configurations, masked, written as one table and read back."""
    kept = items(spark, d).where("l_returnflag <> 'N'")
    margins = {"F": (F.col("l_quantity") - 25) / 10, "O": (F.col("l_extendedprice") - 40000) / 10000}
    parts = [kept.where(F.col("l_linestatus") == c).select(F.lit(c).alias("config"), F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.round(S.sigmoid(m), 6).alias("score")) for c, m in margins.items()]
    path = new_path(spark, "scored")
    K.union_all(parts).write.partitionBy("config").parquet(path)
    return spark.read.parquet(path)


@query("s12_report_sink", "SELECT l_returnflag AS name, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def s12(spark, d):
    """A report written as JSON and read back."""
    path = new_path(spark, "report")
    report = items(spark, d).groupBy(F.col("l_returnflag").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))
    report.write.json(path)
    return spark.read.schema(report.schema).json(path)


@query("s13_fixed_binning", "SELECT least(floor(value / 5), 19)::INTEGER AS bin, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1")
def s13(spark, d):
    binned = table(spark, d, "events").withColumn("bin", A.even_bin(F.col("value"), 0.0, 100.0, 20)).where("bin is not null")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("n9_reference_registry", "SELECT o_orderkey, o_custkey, c_acctbal AS o_custkey_c_acctbal FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def n9(spark, d):
    N.reference("orders", "o_custkey", "customer")
    tables = {"orders": table(spark, d, "orders").select("o_orderkey", "o_custkey"), "customer": table(spark, d, "customer")}
    return N.resolve(tables, "orders", "o_custkey", [], "c_custkey", ["c_acctbal"])


@query("n17_zip_records", "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[2]::DOUBLE, 6) AS second FROM embeddings")
def n17(spark, d):
    zipped = table(spark, d, "embeddings").select("vec_id", F.arrays_zip(F.col("embedding").alias("a"), F.slice("embedding", 2, 64).alias("b")).alias("z"))
    return zipped.select("vec_id", F.round(F.col("z")[0]["a"].cast("double"), 6).alias("first"), F.round(F.col("z")[0]["b"].cast("double"), 6).alias("second"))


@query("p22_relative_to_first", "WITH f AS (SELECT o_custkey AS event, arg_min(o_totalprice, o_orderkey) AS pv FROM orders GROUP BY 1) SELECT c_custkey AS event, c_acctbal AS vtxpv_dxy, round(c_acctbal * 2 - coalesce(pv, 0), 4) AS vtxpv_dz FROM customer LEFT JOIN f ON event = c_custkey")
def p22(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("event"), F.col("c_acctbal").alias("d0"), (F.col("c_acctbal") * 2).alias("z0"))
    vertices = table(spark, d, "orders").select(F.col("o_custkey").alias("event"), F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("z0"))
    found = B.pv_relative(people, vertices, people.select("event"), ["event"])
    return found.select("event", "vtxpv_dxy", F.round("vtxpv_dz", 4).alias("vtxpv_dz"))


@query("p24_computed_features", "SELECT c_custkey, abs(c_acctbal) AS abs_eta, round(ln(greatest(c_acctbal, 1e-3)), 6) AS log_pt, c_acctbal AS eta FROM customer")
def p24(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("eta"), F.col("c_acctbal").alias("pt"))
    found = rows.select("c_custkey", *[B.feature(n) for n in ("abs_eta", "log_pt", "eta")])
    return found.withColumn("log_pt", F.round("log_pt", 6))


@query("p25_convention", "SELECT l_orderkey, l_linenumber, l_partkey, l_tax AS alpha, l_discount AS beta, -l_tax AS residual FROM lineitem")
def p25(spark, d):
    """Columns under another convention's names, with the sign of the residual turned."""
    return items(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_tax").alias("alpha"), F.col("l_discount").alias("beta"), (-F.col("l_tax")).alias("residual"))


@query("p26_order_of_configs", "WITH c AS (SELECT DISTINCT (l_partkey % 16)::INTEGER AS mask FROM lineitem) SELECT mask, (row_number() OVER (ORDER BY bit_count(mask), mask))::INTEGER AS place FROM c")
def p26(spark, d):
    masks = items(spark, d).select((F.col("l_partkey") % 16).cast("int").alias("mask")).distinct()
    return masks.withColumn("place", F.row_number().over(Window.orderBy(F.bit_count("mask"), "mask")))


@query("p19_truth_by_schema", "SELECT o_orderkey, coalesce(c_acctbal, -999) AS truth FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def p19(spark, d):
    """A direct column if the table has it, else through the reference."""
    orders = table(spark, d, "orders")
    if "o_truth" in orders.columns:
        return orders.select("o_orderkey", F.col("o_truth").alias("truth"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("place"), F.col("c_acctbal").alias("truth"))
    return N.gather(orders.select("o_orderkey", "o_custkey"), people, [], "o_custkey", "place", {"truth": -999.0}).select("o_orderkey", "truth")


@query("a12_vertex_features", f"""WITH {TRACKS}, s AS (SELECT win.event, sum(w * sin(phi) * sin(phi)) AS ss, sum(w * cos(phi) * cos(phi)) AS cc, sum(w * sin(phi) * cos(phi)) AS sc, sum(w * d0 * sin(phi)) AS ds, sum(w * d0 * cos(phi)) AS dc
 FROM win LEFT JOIN (SELECT t.*, least(pt, 30) AS w, win.event AS e FROM t JOIN win ON win.event = t.event AND z >= lo AND z < hi) x ON x.e = win.event GROUP BY 1),
 f AS (SELECT *, ss * cc - sc * sc AS det, (ss + cc) / 2 AS half FROM s), g AS (SELECT *, (half - sqrt(greatest(0, half * half - det))) / nullif(half + sqrt(greatest(0, half * half - det)), 0) > 1e-3 AS good FROM f)
SELECT event, round(coalesce(CASE WHEN good THEN (ds * cc - dc * sc) / det END, 0), 4) AS vtx_dx, round(coalesce(CASE WHEN good THEN (ds * sc - dc * ss) / det END, 0), 4) AS vtx_dy FROM g""")
def a12(spark, d):
    """Fitted vertices as features: fails if no track has an impact parameter; 0 where there is no fit."""
    points, found = windows(spark, d)
    A.guard(points, some_impact=F.max(F.abs("d0")) > 0)
    fit = A.transverse_fit(points, found.select("event", "edge_low", "edge_high"), ["event"], "z", F.least(F.col("pt"), F.lit(30.0)), "d0", "phi", least_condition=1e-3)
    return fit.select("event", F.round(F.coalesce("vx", F.lit(0.0)), 4).alias("vtx_dx"), F.round(F.coalesce("vy", F.lit(0.0)), 4).alias("vtx_dy"))


@query("b5_track_quality", "WITH x AS (SELECT *, l_partkey % 65536 AS tanl, l_orderkey % 4096 AS z0, (l_partkey % 128)::INTEGER AS hp FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN tanl >= 32768 THEN tanl - 65536 ELSE tanl END)::FLOAT AS tanl, (CASE WHEN z0 >= 2048 THEN z0 - 4096 ELSE z0 END)::FLOAT AS z0_scaled, (CASE WHEN hp = 0 THEN 0 ELSE floor(log2(hp)) - floor(log2(hp & -hp)) + 1 - bit_count(hp) END)::FLOAT AS nlaymiss_interior, (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::INTEGER AS y FROM x")
def b5(spark, d):
    rows = items(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 65536).alias("hwTanl"), (F.col("l_orderkey") % 4096).alias("hwZ0"), F.lit(0).alias("hwBendChi2"), F.lit(4).alias("nStubs"), (F.col("l_partkey") % 128).alias("hitPattern"), F.lit(0).alias("hwChi2RPhi"), F.lit(0).alias("hwChi2RZ"), (F.col("l_returnflag") == "R").alias("genuine"), F.lit(False).alias("unknown"))
    return B.track_quality(rows).select("l_orderkey", "l_linenumber", "l_partkey", "tanl", "z0_scaled", "nlaymiss_interior", "y")


@query("w4_average_ranks", "SELECT o_orderkey, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 AS r FROM orders")
def w4(spark, d):
    return E.average_ranks(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "r").select("o_orderkey", "r")


@query("w5_sliding_bins", "WITH h AS (SELECT event_type, floor(value / 5)::INTEGER AS bin, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, bin, (sum(n) OVER (PARTITION BY event_type ORDER BY bin RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING))::BIGINT AS n FROM h")
def w5(spark, d):
    filled = table(spark, d, "events").groupBy("event_type", F.floor(F.col("value") / 5).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return filled.select("event_type", "bin", F.sum("n").over(Window.partitionBy("event_type").orderBy("bin").rangeBetween(0, 2)).alias("n"))


@query("k2_top_parts", "SELECT l_partkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1 ORDER BY total DESC, l_partkey LIMIT 25")
def k2(spark, d):
    """The 25 parts that sell most: the limit is the feature."""
    totals = items(spark, d).groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"))
    return totals.orderBy(F.desc("total"), "l_partkey").limit(25)


@query("b4_charge_labels", """WITH o AS (SELECT o_custkey % 25 AS event, o_orderkey AS idx, o_totalprice / 100000 - 2.5 AS eta, (o_orderkey % 628) / 100.0 - 3.14 AS phi FROM orders),
 t AS (SELECT s_nationkey AS event, s_suppkey AS tid, s_acctbal / 2500 - 2 AS eta, (s_suppkey % 628) / 100.0 - 3.14 AS phi, (s_suppkey % 13 - 6)::INTEGER AS f FROM supplier),
 m AS (SELECT o.event, o.idx, tid, f, power(o.eta - t.eta, 2) + power(pi() - abs(pi() - abs(o.phi - t.phi)), 2) AS d FROM o JOIN t USING (event)),
 b AS (SELECT event, idx, arg_min(f, (d, tid)) AS f FROM m WHERE d < 1.44 GROUP BY 1, 2)
SELECT o.event, o.idx, (CASE WHEN abs(coalesce(f, 0)) IN (2, 4, 6) THEN 1 + sign(f) WHEN abs(coalesce(f, 0)) IN (1, 3, 5) THEN 1 - sign(f) ELSE 1 END)::INTEGER AS charge_class FROM o LEFT JOIN b USING (event, idx)""")
def b4(spark, d):
    objects = table(spark, d, "orders").select((F.col("o_custkey") % 25).alias("event"), F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") / 100000 - 2.5).alias("eta"), ((F.col("o_orderkey") % 628) / 100.0 - 3.14).alias("phi"))
    targets = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("event"), F.col("s_suppkey").alias("idx"), (F.col("s_acctbal") / 2500 - 2).alias("eta"), ((F.col("s_suppkey") % 628) / 100.0 - 3.14).alias("phi"), (F.col("s_suppkey") % 13 - 6).cast("int").alias("partonFlavour"))
    return B.label_charge(objects, targets, ["event"], 1.2)
