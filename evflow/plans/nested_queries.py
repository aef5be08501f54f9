"""Nesting, padding and cross-reference queries on orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evflow.functions import scalars as S
from evflow.operators import nested as N
from evflow.plans.catalog import query, table
from evflow.sources import collections as C

ORDER = ["slot", "part", "qty", "price"]


def lines(spark, d) -> DataFrame:
    """Lines as children of their order."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("slot"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"))


LINES = "l AS (SELECT l_orderkey AS event, l_linenumber AS slot, l_partkey AS part, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc FROM lineitem)"
NESTED = f"{LINES}, n AS (SELECT event, list(struct_pack(part := part, qty := qty, price := price) ORDER BY slot, part, qty, price) AS kids FROM l GROUP BY event)"


def nested(spark, d) -> DataFrame:
    return N.nest_links(lines(spark, d), ["event"], ORDER, ["part", "qty", "price"], "kids")


@query("flagship_constituents", f"""
WITH {LINES}, o AS (SELECT o_orderkey AS event, o_totalprice AS total FROM orders),
r AS (SELECT event, slot, part, qty, price, CASE WHEN total > 0 THEN price / total ELSE 0 END AS rel FROM l JOIN o USING (event)),
a AS (SELECT event, list(rel ORDER BY slot, part, qty, price) AS x FROM r GROUP BY event)
SELECT event, len(x)::INTEGER AS n, {", ".join(f"round(coalesce(x[{k + 1}], 0), 6) AS rel_{k}" for k in range(8))}, least(len(x), 8)::DOUBLE AS filled FROM a
""")
def flagship(spark, d):
    """Children of each order, relative to it, padded to eight with a mask."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_totalprice").alias("total"))
    rel = lines(spark, d).join(orders, "event").withColumn("rel", S.ratio_or_zero(F.col("price"), F.col("total")))
    kids = N.nest_links(rel, ["event"], ORDER, ["rel"], "kids").withColumn("x", F.col("kids.rel"))
    padded = kids.select("event", F.size("x").alias("n"), N.pad(F.col("x"), 8, F.lit(0.0)).alias("p"), N.fill_mask(F.col("x"), 8).alias("m"))
    return padded.select("event", "n", *[F.round(F.col("p")[k], 6).alias(f"rel_{k}") for k in range(8)], F.aggregate("m", F.lit(0.0), lambda a, b: a + b).alias("filled"))


@query("n1_explode_collection", "SELECT vec_id, (i - 1)::INTEGER AS idx, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, generate_series(1, 64) g(i) WHERE i <= len(embedding)")
def n1(spark, d):
    return N.explode_collection(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", "idx", F.round(F.col("embedding").cast("double"), 6).alias("value"))


@query("n2_nest_links", f"WITH {NESTED} SELECT event, len(kids)::INTEGER AS n, kids[1].part AS first_part, kids[len(kids)].part AS last_part, round(kids[1].price, 4) AS first_price FROM n")
def n2(spark, d):
    return nested(spark, d).select("event", F.size("kids").alias("n"), F.col("kids")[0]["part"].alias("first_part"), F.element_at("kids", -1)["part"].alias("last_part"), F.round(F.col("kids")[0]["price"], 4).alias("first_price"))


@query("n3_misaligned_parents", "WITH c AS (SELECT o_orderkey AS event, (o_orderkey % 7)::BIGINT AS expected FROM orders), k AS (SELECT l_orderkey AS event, count(*) AS n FROM lineitem GROUP BY 1) SELECT event, expected, coalesce(n, 0)::BIGINT AS n_links FROM c LEFT JOIN k USING (event) WHERE coalesce(n, 0) <> expected")
def n3(spark, d):
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("event"), (F.col("o_orderkey") % 7).alias("expected"))
    return N.misaligned_parents(parents, lines(spark, d), ["event"], "expected")


@query("n4_tagger_window", f"WITH {LINES} SELECT event, slot, CASE WHEN part % 5 = 0 THEN -1 ELSE part END AS idx FROM l WHERE slot < 4 AND part % 5 <> 0")
def n4(spark, d):
    links = lines(spark, d).select("event", "slot", F.when(F.col("part") % 5 == 0, -1).otherwise(F.col("part")).alias("idx"))
    return N.tagger_window(links, "slot", "idx", 4)


@query("n5_count_children", "SELECT o_orderkey AS event, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def n5(spark, d):
    return N.count_children(table(spark, d, "orders").select(F.col("o_orderkey").alias("event")), lines(spark, d), ["event"])


@query("n6_gather", "SELECT l_orderkey AS event, l_linenumber AS slot, l_partkey AS part, p_size AS size FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def n6(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").alias("size"))
    return N.gather(lines(spark, d).select("event", "slot", "part"), parts, [], "part", "idx", ["size"]).select("event", "slot", "part", "size")


@query("n7_gather_default", "WITH r AS (SELECT l_orderkey AS event, l_linenumber AS slot, CASE WHEN l_partkey % 3 = 0 THEN -1 ELSE l_partkey END AS ref FROM lineitem) SELECT event, slot, ref, coalesce(p_retailprice, -1.0) AS price FROM r LEFT JOIN part ON p_partkey = ref")
def n7(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("idx"), F.col("p_retailprice").alias("price"))
    refs = lines(spark, d).select("event", "slot", F.when(F.col("part") % 3 == 0, F.lit(-1)).otherwise(F.col("part")).alias("ref"))
    return N.gather(refs, parts, [], "ref", "idx", {"price": -1.0}).select("event", "slot", "ref", "price")


@query("n7_dangling", "SELECT l_orderkey AS event, l_partkey * 2 AS ref FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey * 2)")
def n7b(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("idx"))
    return N.dangling(lines(spark, d).select("event", (F.col("part") * 2).alias("ref")), parts, [], "ref", "idx")


@query("n8_masked_reference", "WITH r AS (SELECT l_orderkey AS event, l_linenumber AS slot, CASE WHEN l_suppkey % 4 = 0 THEN -1 ELSE l_suppkey END AS supp FROM lineitem) SELECT event, slot, supp, s_acctbal AS supp_s_acctbal FROM r LEFT JOIN supplier ON s_suppkey = supp")
def n8(spark, d):
    N.reference("line", "supp", "supplier")
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("slot"), F.when(F.col("l_suppkey") % 4 == 0, F.lit(-1)).otherwise(F.col("l_suppkey")).alias("supp"))
    return N.resolve({"line": items, "supplier": table(spark, d, "supplier")}, "line", "supp", [], "s_suppkey", ["s_acctbal"])


@query("n10_global_offset", "WITH c AS (SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT flag, status, n, (sum(n) OVER (ORDER BY flag, status) - n)::BIGINT AS \"offset\" FROM c")
def n10(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return N.offsets(counts, ["flag", "status"], "n")


@query("n11_pad_and_mask", f"WITH {NESTED} SELECT event, {', '.join(f'coalesce(kids[{k + 1}].qty, 0.0) AS q{k}' for k in range(5))}, least(len(kids), 5)::DOUBLE AS filled FROM n")
def n11(spark, d):
    kids = nested(spark, d)
    padded = kids.select("event", N.pad(F.col("kids.qty"), 5, F.lit(0.0)).alias("q"), N.fill_mask(F.col("kids"), 5).alias("m"))
    return padded.select("event", *[F.col("q")[k].alias(f"q{k}") for k in range(5)], F.aggregate("m", F.lit(0.0), lambda a, b: a + b).alias("filled"))


@query("n12_event_scalar", "SELECT l_orderkey AS event, l_linenumber AS slot, l_partkey AS part, o_totalprice AS total FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def n12(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_totalprice").alias("total"))
    return N.twin_join(lines(spark, d).select("event", "slot", "part"), orders, ["event"])


@query("n13_first_or_default", "WITH f AS (SELECT l_orderkey AS event, min(l_partkey * 100 + l_linenumber) AS x, arg_min(l_quantity, l_extendedprice) AS qty FROM lineitem GROUP BY 1) SELECT o_orderkey AS event, coalesce(qty, 0.0) AS qty FROM orders LEFT JOIN f ON event = o_orderkey")
def n13(spark, d):
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("event"))
    return N.first_or_default(lines(spark, d), ["event"], "qty", "price", parents, 0.0)


@query("n14_fallback_index", "SELECT l_orderkey AS event, l_linenumber AS slot, CASE WHEN (SELECT max(-1) FROM lineitem) >= 0 THEN -1 ELSE l_suppkey END AS idx FROM lineitem")
def n14(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("slot"), F.lit(-1).cast("long").alias("own"), F.col("l_suppkey").alias("twin"))
    return N.with_fallback_index(items, "own", "twin", "idx").select("event", "slot", "idx")


@query("n15_twin_mismatches", "WITH a AS (SELECT o_custkey AS cust, count(*) AS n_left FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), b AS (SELECT o_custkey AS cust, count(*) AS n_right FROM orders GROUP BY 1) SELECT cust, coalesce(n_left, 0)::BIGINT AS n_left, coalesce(n_right, 0)::BIGINT AS n_right FROM a FULL JOIN b USING (cust) WHERE coalesce(n_left, 0) <> coalesce(n_right, 0)")
def n15(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), "o_orderstatus")
    return N.twin_mismatches(orders.where("o_orderstatus <> 'P'"), orders, ["cust"])


@query("n16_slot_columns", f"WITH {NESTED} SELECT event, {', '.join(f'coalesce(kids[{k + 1}].qty, 0.0) AS c{k}_qty, coalesce(kids[{k + 1}].price, 0.0) AS c{k}_price' for k in range(3))} FROM n")
def n16(spark, d):
    return N.slot_columns(nested(spark, d).select("event", F.col("kids.qty").alias("qty"), F.col("kids.price").alias("price")), ["qty", "price"], 3)


@query("s1_scan_columns", "SELECT o_orderkey, o_totalprice, NULL::DOUBLE AS o_weight FROM orders")
def s1(spark, d):
    return C.scan(spark, [f"{d}/orders.parquet"], ["o_orderkey", "o_totalprice"], {"o_weight": "double"})


@query("s2_wildcard_columns", "SELECT l_orderkey, l_partkey, l_suppkey, l_tax FROM lineitem")
def s2(spark, d):
    return C.select_like(table(spark, d, "lineitem"), "l_*key", "l_tax")


@query("s3_optional_columns", "SELECT c_custkey, c_acctbal FROM customer")
def s3(spark, d):
    df = table(spark, d, "customer")
    return df.select(*C.present(df, ["c_custkey", "c_missing", "c_acctbal"]))


@query("s4_first_events", "SELECT l_orderkey AS event, l_linenumber AS slot, l_partkey AS part FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100)")
def s4(spark, d):
    events = table(spark, d, "orders").select(F.col("o_orderkey").alias("event"))
    return C.first_events(events, [lines(spark, d)], ["event"], 100)[1][0].select("event", "slot", "part")


@query("s7_unify_schema", "SELECT l_orderkey AS event, l_linenumber AS slot, round(l_discount + l_tax, 6) AS rphi FROM lineitem")
def s7(spark, d):
    split = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("slot"), F.col("l_discount").alias("x"), F.col("l_tax").alias("alpha"))
    return C.unify_sums(split, {"rphi": ("x", "alpha")}).select("event", "slot", F.round("rphi", 6).alias("rphi"))


@query("s8_s9_dump_and_load", "SELECT l_returnflag AS cell, l_linestatus AS seed, (CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END)::INTEGER AS y_true, round(l_quantity / 50, 6) AS p1, l_extendedprice AS pt FROM lineitem")
def s8(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("cell"), F.col("l_linestatus").alias("seed"), F.array(1 - F.col("l_quantity") / 50, F.col("l_quantity") / 50).alias("p"), S.one_hot((F.col("l_quantity") > 25).cast("int"), 2).alias("y"), F.col("l_extendedprice").alias("pt"))
    path = C.new_path(spark, "predictions")
    C.dump_predictions(items, path, "p", F.col("y"), ["pt"], "cell", "seed", 2)
    return C.load_predictions(spark, path).select("cell", "seed", "y_true", F.round(F.col("class_probs")[1], 6).alias("p1"), "pt")


@query("s10_dump_union", "SELECT l_returnflag AS view, 'v' || l_linestatus AS variant, l_linenumber::INTEGER AS seed, count(*) AS n FROM lineitem GROUP BY ALL")
def s10(spark, d):
    named = table(spark, d, "lineitem").select(F.concat("l_returnflag", F.lit("__v"), "l_linestatus", F.lit("__s"), "l_linenumber").alias("key"))
    return named.select(*[c.alias(k) for k, c in C.parse_cell(F.col("key")).items()]).groupBy("view", "variant", "seed").agg(F.count(F.lit(1)).alias("n"))


@query("s14_provenance", "SELECT 'orders.parquet' AS source_file, 'all' AS selection, count(*) AS n FROM orders")
def s14(spark, d):
    kept = C.with_provenance(table(spark, d, "orders").select("o_orderkey", "_metadata"), "all")
    name = F.when(F.col("source_file").startswith("part-"), F.lit("orders.parquet")).otherwise(F.col("source_file"))
    return kept.groupBy(name.alias("source_file"), "selection").agg(F.count(F.lit(1)).alias("n"))
