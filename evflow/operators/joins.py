"""Nearest match, grid lookup and pair joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evflow.functions.scalars import clamped_bin, delta_r2
from evflow.sources.collections import staged


def nearest_match(objects: DataFrame, targets: DataFrame, keys: list[str], place: str, target_place: str, radius: float, most: int = 4) -> DataFrame:
    """For each object the closest target of its parent within ``radius`` in (eta, phi), else -1; equals: the first.

    Both tables have eta and phi; the result has the keys, ``place``, match and dr2.  Cells are narrow at first, so that
    the fullest has about ``most`` places of targets, and twice as wide in each pass, up to ``radius``.  Every cell lists
    the targets of the 3 x 3 cells around it: an object meets one list, and is done if a target is nearer than the
    width, for no target outside the list can be.  Only the others go on to the next pass.  Targets of one parent at
    one place count once, by their first.
    """
    spots = targets.where("eta is not null and phi is not null").groupBy(*keys, "eta", "phi").agg(F.min(target_place).alias("_t"))

    def cells(width: float) -> tuple[Column, Column, int]:
        wide, turns = width * (1 + 1e-9), max(1, math.floor(2 * math.pi / width / (1 + 1e-9)))
        return F.floor(F.col("eta") / wide), F.pmod(F.floor(F.pmod(F.col("phi") / (2 * math.pi), F.lit(1.0)) * turns), F.lit(turns)), turns

    def around(cell: Column) -> Column:
        return F.sequence(cell - 1, cell + 1)

    def ring(cell: Column, turns: int) -> Column:
        return F.array_distinct(F.transform(around(cell), lambda c: F.pmod(c, F.lit(turns))))

    eta_cell, phi_cell, _ = cells(radius)
    fullest = spots.groupBy(*keys, eta_cell.alias("_e"), phi_cell.alias("_p")).count().agg(F.max("count")).first()[0] or 1
    placed = F.col("eta").isNotNull() & F.col("phi").isNotNull()
    kind = f"struct<_d:double,_t:{spots.schema['_t'].dataType.simpleString()}>"
    found = [objects.where(~placed).select(*keys, place, F.lit(None).cast(kind).alias("_b"))]
    left = objects.where(placed).select(*keys, place, "eta", "phi")
    for narrower in range(min(20, max(0, math.ceil(math.log(fullest / most, 4)))), -1, -1):
        width = radius / 2**narrower
        eta_cell, phi_cell, turns = cells(width)
        copies = spots.select(*keys, F.struct("eta", "phi", "_t").alias("_s"), F.explode(around(eta_cell)).alias("_eta_cell"), ring(phi_cell, turns).alias("_ring"))
        lists = copies.select(*keys, "_s", "_eta_cell", F.explode("_ring").alias("_phi_cell")).groupBy(*keys, "_eta_cell", "_phi_cell").agg(F.collect_list("_s").alias("_near"))
        met = left.withColumns({"_eta_cell": eta_cell, "_phi_cell": phi_cell}).join(lists.hint("merge"), [*keys, "_eta_cell", "_phi_cell"], "left")
        distances = F.transform("_near", lambda s: F.struct(delta_r2(F.col("eta"), F.col("phi"), s["eta"], s["phi"]).alias("_d"), s["_t"].alias("_t")))
        met = met.select(*keys, place, "eta", "phi", F.array_min(distances).alias("_b"))
        met = staged(met.withColumn("_b", F.when(F.col("_b._d") < width * width, F.col("_b"))), "nearest")
        found.append((met.where("_b is not null") if narrower else met).select(*keys, place, "_b"))
        left = met.where("_b is null").drop("_b")
    joined = reduce(DataFrame.unionByName, found)
    return joined.select(*keys, place, F.coalesce(F.col("_b._t"), F.lit(-1)).alias("match"), F.col("_b._d").alias("dr2"))


def grid_table(axes: dict[str, int], spark) -> DataFrame:
    """All cells of a grid with so many bins on each named axis."""
    frames = [spark.range(n).select(F.col("id").cast("int").alias(a)) for a, n in axes.items()]
    return reduce(lambda a, b: a.crossJoin(b), frames)


def grid_lookup(df: DataFrame, axes: dict[str, tuple[Column, list[float]]], cells: DataFrame, values: list[str], category: list[str] | None = None, most: int = 100_000) -> DataFrame:
    """Values of the cell that each row falls into; numbers outside an axis use its first or last bin.

    Cells go to every task as long as there are at most ``most`` of them, so that rows of a full cell stay spread.
    """
    binned = df.withColumns({a: clamped_bin(x, edges) for a, (x, edges) in axes.items()})
    by = [*axes, *(category or [])]
    return same_rows(binned, cells.select(*[F.col(c).alias(f"_of_{c}") for c in by], *values), {c: f"_of_{c}" for c in by}, most)


def pairs_in_batch(df: DataFrame, batch: str, key: str, vector: str) -> DataFrame:
    """Dot products of all pairs of a batch; a batch is small by definition."""
    a = df.select(batch, F.col(key).alias("left_key"), F.col(vector).alias("_a"))
    b = df.select(batch, F.col(key).alias("right_key"), F.col(vector).alias("_b"))
    dot = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, batch).where("left_key <> right_key").select(batch, "left_key", "right_key", dot.alias("dot"))


def pair_loss(pairs: DataFrame, batch: str, is_positive: Column, temperature: float = 0.5) -> DataFrame:
    """Contrastive loss of each left key: log of the sum over its pairs less its positive pair, at a temperature."""
    scaled = pairs.withColumn("_s", F.col("dot") / temperature).withColumn("_p", is_positive)
    sums = scaled.groupBy(batch, "left_key").agg(F.log(F.sum(F.exp("_s"))).alias("_all"), F.max(F.when(F.col("_p"), F.col("_s"))).alias("_pos"))
    return sums.select(batch, "left_key", (F.col("_all") - F.col("_pos")).alias("loss"))


def same_rows(left: DataFrame, right: DataFrame, names: dict[str, str], most: int) -> DataFrame:
    """All rows of ``left`` with the columns of the row of ``right`` that has the same values, null ones too.

    ``right`` goes to every task if it has up to ``most`` rows (they are counted), else both sides are shuffled.
    """
    few = right.limit(most + 1).count() <= most
    if not names:
        return left.crossJoin(F.broadcast(right))
    hinted = F.broadcast(right) if few else right.hint("merge")
    return left.join(hinted, [left[a].eqNullSafe(right[b]) for a, b in names.items()], "left").drop(*names.values())


def positional_twins(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two tables that have the same place within their event, in each table's own order; ``place`` counts from 0.

    Columns of the orders that aren't keys are left out of the result.
    """
    sides = []
    for df, order in ((left, left_order), (right, right_order)):
        placed = df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
        sides.append(placed.drop(*[c for c in order if c not in keys]))
    return sides[0].join(sides[1], [*keys, "place"])
