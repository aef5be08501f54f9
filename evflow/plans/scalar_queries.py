"""Scalar functions on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evflow.functions import scalars as S
from evflow.plans.catalog import query, table

PI = "pi()"


def wrapped(x: str) -> str:
    return f"(({x} + {PI}) - 2 * {PI} * floor(({x} + {PI}) / (2 * {PI})) - {PI})"


def orders(spark, d):
    return table(spark, d, "orders")


def items(spark, d):
    return table(spark, d, "lineitem")


@query("p1_wrap_angle", f"SELECT o_orderkey, round({wrapped('o_totalprice / 1000')}, 6) AS phi FROM orders")
def p1(spark, d):
    return orders(spark, d).select("o_orderkey", F.round(S.wrap_angle(F.col("o_totalprice") / 1000), 6).alias("phi"))


@query("p2_delta_r2", f"SELECT l_orderkey, l_linenumber, round(power(l_discount - l_tax, 2) + power({PI} - abs({PI} - abs(l_quantity / 10 - l_discount)), 2), 6) AS dr2 FROM lineitem")
def p2(spark, d):
    return items(spark, d).select("l_orderkey", "l_linenumber", F.round(S.delta_r2(F.col("l_discount"), F.col("l_quantity") / 10, F.col("l_tax"), F.col("l_discount")), 6).alias("dr2"))


@query("p3_relative_to_parent", f"SELECT l_orderkey, l_linenumber, round(l_extendedprice / o_totalprice, 6) AS pt_rel, round(ln(l_extendedprice / o_totalprice), 6) AS pt_rel_log, round(l_discount - 0.05, 6) AS deta, round({wrapped('(l_quantity - o_totalprice / 10000)')}, 6) AS dphi FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def p3(spark, d):
    joined = items(spark, d).join(orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    rel = S.relative_to({"pt": F.col("l_extendedprice"), "eta": F.col("l_discount"), "phi": F.col("l_quantity")}, {"pt": F.col("o_totalprice"), "eta": F.lit(0.05), "phi": F.col("o_totalprice") / 10000})
    return joined.select("l_orderkey", "l_linenumber", *[F.round(v, 6).alias(k) for k, v in rel.items()])


@query("p4_guarded_log", "SELECT c_custkey, round(ln(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 1 END), 6) AS a, round(ln(greatest(c_acctbal, 0.001)), 6) AS b FROM customer")
def p4(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(S.log_positive(F.col("c_acctbal")), 6).alias("a"), F.round(S.log_floor(F.col("c_acctbal")), 6).alias("b"))


_P5 = """
SELECT p_partkey,
  (CASE WHEN kind = 3 THEN 1 ELSE 0 END)::FLOAT AS isPhoton,
  (CASE WHEN kind = 1 AND q > 0 THEN 1 ELSE 0 END)::FLOAT AS isElectronPlus,
  (CASE WHEN kind = 1 AND q < 0 THEN 1 ELSE 0 END)::FLOAT AS isElectronMinus,
  (CASE WHEN kind = 4 AND q > 0 THEN 1 ELSE 0 END)::FLOAT AS isMuonPlus,
  (CASE WHEN kind = 4 AND q < 0 THEN 1 ELSE 0 END)::FLOAT AS isMuonMinus,
  (CASE WHEN kind = 2 THEN 1 ELSE 0 END)::FLOAT AS isNeutralHadron,
  (CASE WHEN kind = 0 AND q > 0 THEN 1 ELSE 0 END)::FLOAT AS isChargedHadronPlus,
  (CASE WHEN kind = 0 AND q < 0 THEN 1 ELSE 0 END)::FLOAT AS isChargedHadronMinus
FROM (SELECT p_partkey, p_partkey % 5 AS kind, p_size % 3 - 1 AS q FROM part)
"""


@query("p5_particle_flags", _P5)
def p5(spark, d):
    flags = S.particle_flags(F.col("p_partkey") % 5, F.col("p_size") % 3 - 1)
    return table(spark, d, "part").select("p_partkey", *[v.alias(k) for k, v in flags.items()])


@query("p6_p7_decode_words", "WITH x AS (SELECT o_orderkey, o_orderkey % 4096 AS w FROM orders), s AS (SELECT *, CASE WHEN w >= 2048 THEN w - 4096 ELSE w END AS v FROM x) SELECT o_orderkey, v AS signed, round((v + 0.5) * 2 * 20.46912512 / 4096, 6) AS z0 FROM s")
def p6(spark, d):
    word = F.col("o_orderkey") % 4096
    return orders(spark, d).select("o_orderkey", S.twos_complement(word, 12).alias("signed"), F.round(S.undigitise(word, 12, 2 * 20.46912512 / 4096), 6).alias("z0"))


@query("p8_bin_value", "SELECT p_partkey, (ARRAY[0.0, 0.5, 1.5, 4.0, 20.0]::DOUBLE[])[1 + p_size % 5] AS v FROM part")
def p8(spark, d):
    return table(spark, d, "part").select("p_partkey", S.bin_value(F.col("p_size") % 5, [0.0, 0.5, 1.5, 4.0, 20.0]).alias("v"))


@query("p9_interior_gaps", "WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_partkey % 128)::INTEGER AS p FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, (CASE WHEN p = 0 THEN 0 ELSE floor(log2(p)) - floor(log2(p & -p)) + 1 - bit_count(p) END)::INTEGER AS gaps FROM x")
def p9(spark, d):
    return items(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", S.interior_gaps((F.col("l_partkey") % 128)).alias("gaps"))


@query("p10_bit_flags", "SELECT l_partkey, l_orderkey, (l_partkey & 1) <> 0 AS prompt, (l_partkey & 4) <> 0 AS third FROM lineitem")
def p10(spark, d):
    return items(spark, d).select("l_partkey", "l_orderkey", S.has_flag(F.col("l_partkey"), 0).alias("prompt"), S.has_flag(F.col("l_partkey"), 2).alias("third"))


@query("p11_charge_class", "WITH x AS (SELECT p_partkey, (p_partkey % 13 - 6)::INTEGER AS f FROM part) SELECT p_partkey, f, (CASE WHEN abs(f) IN (2, 4, 6) THEN 1 + sign(f) WHEN abs(f) IN (1, 3, 5) THEN 1 - sign(f) ELSE 1 END)::INTEGER AS class FROM x")
def p11(spark, d):
    flavour = (F.col("p_partkey") % 13 - 6).cast("int")
    return table(spark, d, "part").select("p_partkey", flavour.alias("f"), S.charge_class(flavour).alias("class"))


@query("p12_clipped_response", "SELECT c_custkey, round(CASE WHEN c_acctbal > 0 THEN greatest(0.3, least(2.0, 4000 / c_acctbal)) ELSE 0 END, 6) AS r FROM customer")
def p12(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(S.clipped_response(F.lit(4000.0), F.col("c_acctbal")), 6).alias("r"))


@query("p13_sentinels", "WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN -999.0 ELSE c_acctbal / 10 END AS v FROM customer) SELECT c_custkey, round(CASE WHEN v > -900 THEN v END, 6) AS a, round(CASE WHEN v > -900 THEN v ELSE 0 END, 6) AS b FROM x")
def p13(spark, d):
    v = F.when(F.col("c_custkey") % 4 == 0, F.lit(-999.0)).otherwise(F.col("c_acctbal") / 10)
    return table(spark, d, "customer").select("c_custkey", F.round(S.null_sentinel(v), 6).alias("a"), F.round(S.zero_sentinel(v), 6).alias("b"))


@query("p14_log1p_clipped", "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS a, round(ln(1 + least(greatest(c_acctbal, 0), 5000)), 6) AS b FROM customer")
def p14(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(S.log1p_clipped(F.col("c_acctbal")), 6).alias("a"), F.round(S.log1p_clipped(F.col("c_acctbal"), 5000.0), 6).alias("b"))


@query("p15_quantisers", "SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, least(15, round_even(2 * log2(1 + l_quantity), 0)))::INTEGER AS chi2, greatest(0, least(3, floor(log2(1 + l_linenumber))))::INTEGER AS occ FROM lineitem")
def p15(spark, d):
    return items(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", S.quantise_chi2(F.col("l_quantity")).alias("chi2"), S.quantise_count(F.col("l_linenumber"), 2).alias("occ"))


@query("p16_log10_codes", "WITH x AS (SELECT o_orderkey, round_even(log10(least(greatest(o_totalprice, 1e-9), 1e9)) * 3000, 0)::SMALLINT AS code FROM orders) SELECT o_orderkey, code, round(pow(10.0, code / 3000.0), 4) AS back FROM x")
def p16(spark, d):
    code = S.quantise_log10(F.col("o_totalprice"))
    return orders(spark, d).select("o_orderkey", code.alias("code"), F.round(S.dequantise_log10(code), 4).alias("back"))


@query("p17_sigmoid", "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) AS p FROM customer")
def p17(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(S.sigmoid(F.col("c_acctbal") / 1000), 6).alias("p"))


@query("p18_deltas", "SELECT l_orderkey, l_linenumber, l_partkey, round(abs(l_extendedprice - p_retailprice * l_quantity), 4) AS delta FROM lineitem JOIN part ON p_partkey = l_partkey")
def p18(spark, d):
    parts = table(spark, d, "part")
    return items(spark, d).join(parts, F.col("p_partkey") == F.col("l_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.abs(F.col("l_extendedprice") - F.col("p_retailprice") * F.col("l_quantity")), 4).alias("delta"))


@query("p20_truth_fallback", "WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN -999.0 ELSE c_acctbal END AS a, CASE WHEN c_custkey % 3 = 0 THEN -999.0 ELSE c_acctbal * 2 END AS b FROM customer) SELECT c_custkey, round(CASE WHEN a > -900 THEN a WHEN b > -900 THEN b END, 6) AS truth, CASE WHEN a > -900 THEN 0 WHEN b > -900 THEN 1 END AS source FROM x")
def p20(spark, d):
    a = F.when(F.col("c_custkey") % 2 == 0, F.lit(-999.0)).otherwise(F.col("c_acctbal"))
    b = F.when(F.col("c_custkey") % 3 == 0, F.lit(-999.0)).otherwise(F.col("c_acctbal") * 2)
    truth, source = S.first_present(a, b)
    return table(spark, d, "customer").select("c_custkey", F.round(truth, 6).alias("truth"), source.alias("source"))


@query("p20_impact", "SELECT o_orderkey, round(0.3 * sin(o_totalprice / 1e4) - 0.1 * cos(o_totalprice / 1e4), 6) AS d0 FROM orders")
def p20b(spark, d):
    return orders(spark, d).select("o_orderkey", F.round(S.transverse_impact(F.lit(0.3), F.lit(0.1), F.col("o_totalprice") / 1e4), 6).alias("d0"))


@query("p27_cylinder_crossing", f"WITH x AS (SELECT o_orderkey, 50 * (o_orderkey % 100) / 5000.0 AS h, (o_orderkey % 6)::DOUBLE AS phi FROM orders) SELECT o_orderkey, round(CASE WHEN abs(h) <= 1 THEN {wrapped('(phi - asin(h))')} END, 6) AS phi FROM x")
def p27(spark, d):
    crossing = S.cylinder_crossing((F.col("o_orderkey") % 100) / 2500.0, (F.col("o_orderkey") % 6).cast("double"), F.lit(50.0))
    return orders(spark, d).select("o_orderkey", F.round(crossing, 6).alias("phi"))


@query("p28_range_cuts", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000")
def p28(spark, d):
    return orders(spark, d).where(S.in_range(F.col("o_totalprice"), 100000, 200000)).select("o_orderkey", "o_totalprice")


@query("p29_p30_masks_and_names", "SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::INTEGER AS positive, CASE o_orderkey % 4 WHEN 0 THEN 'signal' WHEN 1 THEN 'noise' ELSE 'unknown' END AS name FROM orders")
def p29(spark, d):
    return orders(spark, d).select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("positive"), S.name_of(F.col("o_orderkey") % 4, {0: "signal", 1: "noise"}).alias("name"))


@query("p31_one_hot", "SELECT p_partkey, (CASE WHEN p_partkey % 3 = 1 THEN 1 ELSE 0 END)::INTEGER AS middle, (p_partkey % 3)::INTEGER AS back FROM part")
def p31(spark, d):
    hot = S.one_hot((F.col("p_partkey") % 3).cast("int"), 3)
    return table(spark, d, "part").select("p_partkey", hot[1].alias("middle"), S.arg_max(hot).alias("back"))


@query("p21_origin_label", "SELECT o_orderkey, (CASE WHEN o_orderstatus = 'P' THEN 9 WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2 ELSE 0 END)::INTEGER AS label FROM orders WHERE o_orderpriority NOT LIKE '5%'")
def p21(spark, d):
    label = F.when(F.col("o_orderstatus") == "P", 9).when(F.col("o_orderpriority").startswith("1"), 1).when(F.col("o_orderpriority").startswith("2"), 2).otherwise(0)
    return orders(spark, d).where(~F.col("o_orderpriority").startswith("5")).select("o_orderkey", label.cast("int").alias("label"))


@query("k9_hash_noise", "WITH x AS (SELECT c_custkey, md5(c_custkey::VARCHAR || '|flat') AS h FROM customer) SELECT c_custkey, round((('0x' || substr(h, 1, 8))::BIGINT + 1) / 4294967296.0, 8) AS u FROM x")
def k9(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(S.hashed_uniform(F.col("c_custkey"), "flat"), 8).alias("u"))
