"""Tree ensembles of any depth and number as tables of nodes, walked level by level."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "array<struct<feature:int,threshold:float,below:int,above:int,value:float>>"


def forest_of(spark: SparkSession, model: dict[str, Any]) -> DataFrame:
    """tree and its nodes, from trees given as arrays (a leaf has feature -2; the first class counts)."""
    rows = []
    for t, classes in enumerate(model["trees"]):
        tree = classes[0]
        nodes = zip(tree["feature"], tree["threshold"], tree["children_left"], tree["children_right"], tree["value"], strict=True)
        rows.append((t, [(int(f), float(c), int(a), int(b), float(v)) for f, c, a, b, v in nodes]))
    return spark.createDataFrame(rows, f"tree int, nodes {NODES}")


def forest_score(df: DataFrame, forest: DataFrame, features: list[Column], depth: int, name: str = "score", init: float = 0.0, norm: float = 1.0, convention: str = "<=", most_nodes: int = 500_000) -> DataFrame:
    """Rows with the sum of the trees' leaves, in the order of ``tree`` and in single precision, times ``norm``.

    The numbers compared are single precision, too.  A missing number goes to ``above``.  No tree has more than
    ``depth`` levels of conditions; a deeper one is an error.  Every task gets the trees, at most ``most_nodes`` nodes of
    them at a time (one tree at least): larger forests are added up in slices of their order, to the same sum.

    All trees are walked together, level by level, on Arrow batches: the same walk as one higher-order expression took
    some hundred times as long (117 s for 20,000 rows and 400 trees of six levels, in one task).
    """
    if convention not in ("<", "<="):
        raise ValueError(f"unknown splitting convention {convention!r}")
    size = F.size("nodes").cast("long")
    sliced = forest.select("tree", F.floor((F.sum(size).over(Window.orderBy("tree")) - size) / most_nodes).alias("_slice"))
    last = sliced.agg(F.max("_slice")).first()[0]
    if last is None:
        raise ValueError("the forest has no tree")
    inputs = [f"_x{k}" for k in range(len(features))]
    scored = df.withColumns({n: f.cast("float") for n, f in zip(inputs, features, strict=True)} | {"_score": F.lit(init).cast("float")})
    context = df.sparkSession.sparkContext
    for k in range(last + 1):
        own = forest.join(sliced.where(F.col("_slice") == k).hint("shuffle_hash"), "tree").orderBy("tree").select("nodes").toArrow()["nodes"].combine_chunks()
        if not len(own):  # a tree before it is as large as two slices
            continue
        nodes = own.flatten()
        arrays = {c: nodes.field(c).to_numpy(zero_copy_only=False) for c in ("feature", "threshold", "below", "above", "value")}
        roots = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())[:-1]]).astype(np.int64)
        sent = context.broadcast((arrays, roots))

        def walk(batches, sent=sent, less=convention == "<"):
            tree, roots = sent.value
            leaf, feature = tree["feature"] == -2, np.maximum(tree["feature"], 0)
            for batch in batches:
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in inputs], axis=1)
                total = batch.column("_score").to_numpy(zero_copy_only=False).astype(np.float32)
                for at in range(0, len(x), 2048):
                    part = x[at : at + 2048]
                    place = np.zeros((len(part), len(roots)), np.int64)
                    rows = np.arange(len(part))[:, None]
                    for _ in range(depth):
                        node = place + roots
                        value, cut = part[rows, feature[node]], tree["threshold"][node]
                        down = np.where(value < cut if less else value <= cut, tree["below"][node], tree["above"][node])
                        place = np.where(leaf[node], place, down)
                    node = place + roots
                    if not leaf[node].all():
                        raise ValueError(f"a tree has more levels than {depth}")
                    leaves = tree["value"][node].astype(np.float32)
                    for t in range(len(roots)):
                        total[at : at + 2048] += leaves[:, t]
                yield batch.set_column(batch.schema.get_field_index("_score"), "_score", pa.array(total))

        scored = scored.mapInArrow(walk, scored.schema)
    return scored.withColumn(name, (F.col("_score") * F.lit(norm).cast("float")).cast("float")).select(*df.columns, name)


def bagged_forests(df: DataFrame, forests: list[DataFrame], features: list[Column], depth: int, name: str = "score", **options: Any) -> DataFrame:
    """Rows with the mean of several ensembles' scores."""
    scored = df
    for k, forest in enumerate(forests):
        scored = forest_score(scored, forest, features, depth, f"_bag{k}", **options)
    bags = [F.col(f"_bag{k}").cast("double") for k in range(len(forests))]
    return scored.select(*df.columns, (sum(bags[1:], bags[0]) / len(bags)).alias(name))
