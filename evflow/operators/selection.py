"""Sorting by given orders, splits, subsamples, quotas, running sums and unions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_by_list(column: Column, order: list[object]) -> Column:
    """Place of a value in a given list; others come last."""
    return reduce(lambda rest, k: F.when(column == order[k], k).otherwise(rest), range(len(order)), F.lit(len(order)))


def hash_key(*columns: str, seed: int = 0) -> Column:
    """Text by which rows are put in a random order that engine and partitioning don't change."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def hash_bucket(keys: list[str], seed: int = 0) -> Column:
    """One of 4096 buckets of the hashes by which rows are put in order."""
    return F.substring(hash_key(*keys, seed=seed), 1, 3)


def split_in_buckets(df: DataFrame, bucket: str, columns: list[str], keys: list[str], fraction: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The two parts of an exact split of rows that have their ``bucket``: those of whole buckets, and those that are ranked."""
    sizes = dict(df.groupBy(bucket).agg(F.count(F.lit(1))).collect())
    wanted, edge, before = math.floor(sum(sizes.values()) * fraction), "g", 0  # no hash begins with g: all rows are test rows
    for name in sorted(sizes):
        if before + sizes[name] > wanted:
            edge = name
            break
        before += sizes[name]
    whole = df.where(F.col(bucket) != edge).select(*columns, (F.col(bucket) < edge).alias("is_test"))
    rank = F.row_number().over(Window.partitionBy(bucket).orderBy("_h", *keys))
    edges = df.where(F.col(bucket) == edge).withColumn("_h", hash_key(*keys, seed=seed))
    return whole, edges.select(*columns, (rank <= wanted - before).alias("is_test"))


def exact_split(df: DataFrame, keys: list[str], fraction: float, seed: int = 0) -> DataFrame:
    """``is_test`` for exactly floor(n * fraction) rows, chosen by a hash of their keys.

    Rows are counted in 4096 buckets of their hashes; only the bucket in which the wanted number is reached is ranked, all
    others are test rows or not as a whole and stay where they are.
    """
    whole, cut = split_in_buckets(df.withColumn("_b", hash_bucket(keys, seed)), "_b", df.columns, keys, fraction, seed)
    return whole.unionByName(cut)


def balanced_subsample(df: DataFrame, label: str, keys: list[str], size: int, seed: int = 0) -> DataFrame:
    """At most ``size`` rows, as many of each class."""
    classes = df.agg(F.count_distinct(label)).first()[0] or 1
    rank = F.row_number().over(Window.partitionBy(label).orderBy(hash_key(*keys, seed=seed), *keys))
    return df.withColumn("_r", rank).where(F.col("_r") <= size // classes).drop("_r")


def curate(df: DataFrame, quotas: list[tuple[str, Column, int]], keys: list[str]) -> DataFrame:
    """The first rows by key of each kind in turn; a row that one kind takes is not in another."""
    left, taken = df, []
    for name, test, n in quotas:
        chosen = left.where(test).orderBy(*keys).limit(n).withColumn("archetype", F.lit(name))
        taken.append(chosen)
        left = left.join(chosen.select(*keys), keys, "left_anti")
    return reduce(DataFrame.unionByName, taken)


def running_sum(value: str, by: list[str], order: list[str]) -> Column:
    """Sum of a value over this row and those before it."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def running_reduced_chi2(df: DataFrame, by: list[str], order: list[str], start_chi2: str, start_ndof: str, step: str, step_ndof: str) -> DataFrame:
    """chi2 per degree of freedom after each step, from a track's starting chi2 and its steps."""
    chi2 = F.col(start_chi2) * F.col(start_ndof) + running_sum(step, by, order)
    ndof = F.col(start_ndof) + running_sum(step_ndof, by, order)
    return df.withColumn("reduced_chi2", F.try_divide(chi2, ndof))


def step_change(df: DataFrame, by: list[str], order: list[str], value: str, truth: str) -> DataFrame:
    """Percent change of |value - truth| from the step before; null where that was next to nothing."""
    error = F.abs(F.col(value) - F.col(truth))
    before = F.lag(error).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("percent_change", F.when(before >= 1e-12, 100 * (error - before) / before))


def best_of(df: DataFrame, by: list[str], key: str, loss: str) -> DataFrame:
    """Key of the row with the least loss in each group, the smallest of equals."""
    best = F.min(F.struct(F.col(loss), F.col(key)))
    return df.groupBy(*by).agg(best.alias("_x")).select(*by, F.col(f"_x.{key}").alias(key), F.col(f"_x.{loss}").alias(loss))


def union_all(frames: list[DataFrame], fill: object | None = None) -> DataFrame:
    """All rows of several tables; columns that a table lacks are null, or ``fill``."""
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return joined if fill is None else joined.fillna(fill)


def dump_groups(rows: DataFrame, cell: str, seed: str) -> DataFrame:
    """Groups of a union of prediction tables, by cell and seed, with their sizes and offsets."""
    counts = rows.groupBy(cell, seed).agg(F.count(F.lit(1)).alias("n_rows"))
    up = Window.orderBy(cell, seed).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("row_offset", F.sum("n_rows").over(up) - F.col("n_rows"))
