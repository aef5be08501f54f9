"""Exact k nearest binary codes by incremental multi-index hashing.

A code of ``bits`` bits is cut into m segments.  Codes within distance m * (r + 1) - 1 of each other agree in some segment
up to r bits, so after all segments have been searched up to radius r, a query whose k-th best verified distance is
within that number is done.  Each round joins the segments' values at distance exactly r from the open queries with the
index of (segment, value), and verifies the whole distance in the join; a pair counts only in the round and segment
where it is first found, and only within the query's k-th distance so far.

Rows of one code are one entry of the index with their k + 1 smallest ids, and queries of one code are searched once, so
a code that many rows share costs no more than another.

Cases: rows without an id or vector are neither queries nor neighbours; dimensions that a vector lacks (or null, NaN)
give bit 0, those beyond ``bits`` are left out; ties go to the smaller id; of repeated ids one row of each code counts;
with fewer than k other rows a query gets them all; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evflow.llm.store import stage


def segment_values(vector: str, bits: int, width: int) -> Column:
    """Sign bits of a vector as an array of whole numbers of ``width`` bits each."""
    one = f"case when coalesce({vector}[i], 0) > 0 and not isnan({vector}[i]) then 1 else 0 end".replace(f"{vector}[i]", f"try_element_at({vector}, i)")
    parts = [f"aggregate(sequence({at + 1}, {min(bits, at + width)}), 0, (a, i) -> a * 2 + {one})" for at in range(0, bits, width)]
    return F.expr(f"array({', '.join(parts)})")


def distance(a: str, b: str, segments: int) -> Column:
    """Hamming distance of two arrays of segments."""
    return F.expr(" + ".join(f"bit_count({a}[{j}] ^ {b}[{j}])" for j in range(segments)))


def search(rows: DataFrame, queries: Column, k: int = 10, bits: int = 64, width: int = 16) -> DataFrame:
    """The k nearest other rows of each row that ``queries`` holds for; ``rows`` has vec_id and embedding.

    Returns query_id, rank (from 1), neighbor_id, distance.
    """
    segments = -(-bits // width)
    first = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    coded = stage(first.select("vec_id", segment_values("embedding", bits, width).alias("code"), queries.alias("asks")).dropDuplicates(["vec_id", "code"]), "codes")

    by_code = Window.partitionBy("code").orderBy("vec_id")
    smallest = coded.select("vec_id", "code", F.row_number().over(by_code).alias("n")).where(F.col("n") <= k + 1)
    codes = smallest.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = stage(codes.select("code", "ids", F.posexplode("code").alias("segment", "value")), "segments")

    asked = coded.where("asks").groupBy("code").agg(F.min("vec_id").alias("q"))
    state = stage(asked.select("q", "code", F.lit(bits).alias("bound"), F.expr("cast(array() as array<struct<distance:int,id:bigint>>)").alias("found"), F.lit(False).alias("done")), "search")
    span = min(width, bits)
    for radius in range(span + 1):
        masks = state.sparkSession.range(1 << span).where(F.bit_count("id") == radius).select(F.col("id").cast("int").alias("mask"))
        near = state.where("not done").select("q", "bound", F.col("code").alias("asked"), F.posexplode("code").alias("segment", "own"))
        probes = near.join(F.broadcast(masks)).select("q", "bound", "asked", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        earlier = " and ".join(f"(segment <= {j} or bit_count(asked[{j}] ^ code[{j}]) > {radius})" for j in range(segments))
        never = " and ".join(f"bit_count(asked[{j}] ^ code[{j}]) >= {radius}" for j in range(segments))
        p, e = probes.alias("p"), entries.alias("e")
        fits = (F.col("p.segment") == F.col("e.segment")) & (F.col("p.value") == F.col("e.value")) & F.expr(earlier.replace("segment", "p.segment")) & F.expr(never) & (distance("asked", "code", segments) <= F.col("p.bound"))
        hits = e.hint("shuffle_hash").join(p, fits).select("q", distance("asked", "code", segments).alias("distance"), F.explode("ids").alias("id"))
        old = state.where("not done").select("q", F.explode("found").alias("x")).select("q", "x.distance", "x.id")
        best = Window.partitionBy("q").orderBy("distance", "id")
        top = hits.unionByName(old).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
        merged = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("better"))
        reached = segments * (radius + 1) - 1
        new = state.join(merged.hint("shuffle_hash"), "q", "left").withColumn("found", F.coalesce("better", "found")).withColumn("bound", F.when(F.size("found") > k, F.expr(f"found[{k}].distance")).otherwise(bits))
        state = stage(new.select("q", "code", "bound", "found", (F.col("done") | ((F.size("found") > k) & (F.col("bound") <= reached))).alias("done")), "search")
        if radius == span or not state.where("not done").limit(1).count():
            break
    answers = coded.where("asks").select(F.col("vec_id").alias("query_id"), "code").join(state.select("code", "found").hint("shuffle_hash"), "code")
    others = answers.select("query_id", F.expr(f"slice(filter(found, x -> x.id <> query_id), 1, {k})").alias("near"))
    return others.select("query_id", F.posexplode("near").alias("n", "x")).select("query_id", (F.col("n") + 1).alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.distance").alias("distance"))


def op1_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors by sign bits, for every row whose id is divisible by 50, against all rows."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP1_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 50 = 0),
p AS (
  SELECT query_id, vec_id AS neighbor_id,
    list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (coalesce(a[i], 0) > 0) <> (coalesce(embedding[i], 0) > 0) THEN 1 ELSE 0 END))::INTEGER AS distance
  FROM q, embeddings WHERE vec_id <> query_id
),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id))::INTEGER AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""
