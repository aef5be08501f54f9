"""Connected components of links by alternating large and small stars, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evflow.llm.store import stage


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Turn each node's neighbours (greater ones, or smaller ones and itself) towards its smallest neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        turned = both.where("v > u").join(least.hint("shuffle_hash"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least.hint("shuffle_hash"), "u")
        turned = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return turned.where("u <> v").distinct()


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node and component (its smallest node) of every node in a link (u, v)."""
    edges = stage(links.where("u <> v").select("u", "v").distinct(), "edges")
    before = None
    for _ in range(most):
        edges = stage(_stars(_stars(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not found in {most} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
