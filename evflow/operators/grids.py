"""Binned tables: lookup on several axes, merged edges, slices of a grid and envelopes of slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evflow.functions.scalars import dequantise_log10, quantise_log10
from evflow.operators.joins import same_rows
from evflow.operators.ranking import quantiles
from evflow.sources.collections import staged


def edge_index(x: str, edges: str) -> Column:
    """Bin of column ``x`` between the ascending ``edges`` (an array column), by halving; outside: the first or last bin."""
    middle = "(s.lo + s.hi) DIV 2"
    halved = f"IF(s.lo < s.hi, IF({edges}[{middle}] <= {x}, named_struct('lo', CAST({middle} + 1 AS INT), 'hi', s.hi), named_struct('lo', s.lo, 'hi', CAST({middle} AS INT))), s)"
    found = f"aggregate(sequence(0, CAST(log2(greatest(size({edges}), 1)) AS INT)), named_struct('lo', 0, 'hi', size({edges})), (s, k) -> {halved}).lo"
    return F.expr(f"IF({x} IS NULL OR {edges} IS NULL OR size({edges}) < 2, NULL, greatest(0, least({found} - 1, size({edges}) - 2)))")


def lookup(df: DataFrame, axes: dict[str, Column], edges: DataFrame, cells: DataFrame, values: list[str], category: list[str] | None = None, most: int = 100_000) -> DataFrame:
    """Rows with the ``values`` of their cell, null for a category or number that has none.

    ``edges`` has, for each category (one row without), an array of edges named like each axis.  ``cells`` has the
    category, a bin on each axis and the values.  Both go to every task up to ``most`` rows each, else they are joined.
    """
    by = category or []
    held = df.withColumns({f"_at_{a}": x.cast("double") for a, x in axes.items()})
    sides = edges.select(*[F.col(c).alias(f"_of_{c}") for c in by], *[F.col(a).alias(f"_edges_{a}") for a in axes])
    binned = same_rows(held, sides, {c: f"_of_{c}" for c in by}, most)
    binned = binned.withColumns({f"_bin_{a}": edge_index(f"_at_{a}", f"_edges_{a}") for a in axes})
    table = cells.select(*[F.col(c).alias(f"_of_{c}") for c in by], *[F.col(a).alias(f"_cell_{a}") for a in axes], *[F.col(v).alias(f"_value_{v}") for v in values])
    found = same_rows(binned, table, {c: f"_of_{c}" for c in by} | {f"_bin_{a}": f"_cell_{a}" for a in axes}, most)
    return found.select(*df.columns, *[F.col(f"_bin_{a}").alias(f"bin_{a}") for a in axes], *[F.col(f"_value_{v}").alias(v) for v in values])


def merged_edges(df: DataFrame, edges: str, tolerance: float = 1e-9, by: list[str] | None = None) -> DataFrame:
    """Ascending distinct edges of all rows; an edge goes if it is within ``tolerance`` (1 + its size) of the one before.

    Edges are dealt into ranges; the last edge of the ranges before is carried into each, so that no task has all.
    """
    by = by or []
    flat = df.select(*by, F.explode(edges).alias("edge")).select(*by, F.col("edge").cast("double").alias("edge")).where("edge IS NOT NULL").distinct()
    dealt = staged(flat.repartitionByRange(*by, "edge").withColumn("_range", F.spark_partition_id()), "edges")
    ends = dealt.groupBy(*by, "_range").agg(F.max("edge").alias("_end"))
    carried = ends.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.col("_range").alias("_of_range"), F.lag("_end").over(Window.partitionBy(*by).orderBy("_range")).alias("_carried")).where("_carried IS NOT NULL")
    within = dealt.withColumn("_before", F.lag("edge").over(Window.partitionBy(*by, "_range").orderBy("edge")))
    same = [within[c].eqNullSafe(carried[f"_of_{c}"]) for c in by] + [within["_range"] == carried["_of_range"]]
    joined = within.join(F.broadcast(carried), same, "left")  # one row a range: a group that came from the range before
    before = F.coalesce("_before", "_carried")
    return joined.where(before.isNull() | (F.col("edge") - before > tolerance * (1 + F.abs("edge")))).select(*by, "edge")


def _divided(a: Column, b: Column) -> Column:
    """A ratio of floating-point numbers, which is infinite or no number over 0."""
    over_zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, over_zero).otherwise(F.try_divide(a, b))


def grid_slice(grid: DataFrame, axes: list[str], value: str, fixed: dict[str, object] | None = None, cuts: dict[str, tuple[float, float]] | None = None, below: str | None = None, invert: bool = False, agg: str = "median") -> DataFrame:
    """Middle, 16-84 band and count of a grid's values at each place of one or two free axes.

    ``grid`` has a row a cell: its place on each axis (bin centres, or names) and values.  ``fixed`` pins axes, ``cuts``
    keeps places within bounds, both included.  With ``below`` the value is a ratio of two columns, ``invert`` turns it
    over.  Values that aren't finite are left out; a place without any has count 0.  Two free axes have no band.
    """
    if agg not in ("median", "mean") or not 1 <= len(axes) <= 2 or set(axes) & set(fixed or {}):
        raise ValueError("a slice has one or two free axes, which aren't fixed, and a median or mean")
    kept = grid
    for axis, place in (fixed or {}).items():
        kept = kept.where(F.col(axis) == F.lit(place))
    for axis, (low, high) in (cuts or {}).items():
        kept = kept.where(F.col(axis).between(low, high))
    number = F.col(value).cast("double")
    if below:
        number = _divided(number, F.col(below).cast("double"))
    if invert:
        number = _divided(F.lit(1.0), number)
    kept = kept.withColumn("_value", F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number))
    found = quantiles(kept, F.col("_value"), [0.5, 0.16, 0.84], axes)
    middle = F.col("quantiles")[0]
    if agg == "mean":
        means = kept.groupBy(*axes).agg(F.avg("_value").alias("_mean"))
        found, middle = same_rows(found, means.withColumnsRenamed({a: f"_of_{a}" for a in axes}), {a: f"_of_{a}" for a in axes}, 100_000), F.col("_mean")
    band = [F.col("quantiles")[1].alias("low"), F.col("quantiles")[2].alias("high")] if len(axes) == 1 else []
    return found.select(*axes, middle.alias("middle"), *band, "n")


def envelope(spread: DataFrame, axis: str, bias: DataFrame | None = None, ks: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """Bands of so many deviations around a bias, from two slices on the same axis; without ``bias`` around 0."""
    both = spread.select(axis, F.col("middle").alias("_sigma"))
    both = both.join(bias.select(axis, F.col("middle").alias("_bias")), axis) if bias is not None else both.withColumn("_bias", F.lit(0.0))
    bands = F.explode(F.array(*[F.lit(float(k)) for k in ks])).alias("k")
    return both.select(axis, F.col("_bias").alias("middle"), bands, "_sigma").select(axis, "middle", "k", (F.col("middle") - F.col("k") * F.col("_sigma")).alias("low"), (F.col("middle") + F.col("k") * F.col("_sigma")).alias("high"))


def encode_blocks(df: DataFrame, value: str, by: list[str] | None = None, scale: float = 3000.0, most: int = 100_000) -> DataFrame:
    """Rows with quant, code and raw: blocks of positive numbers as 16-bit logarithms, others in single precision.

    A pass over each block finds its least number and whether all are finite; one that isn't is an error.
    """
    by = by or []
    number = F.col(value).cast("double")
    odd = F.count_if(number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")))
    blocks = staged(df.groupBy(*by).agg(F.min(number).alias("_least"), odd.alias("_odd")), "blocks")
    if blocks.where("_odd > 0").limit(1).count():
        raise ValueError("a block has values that aren't finite")
    known = same_rows(df, blocks.select(*[F.col(c).alias(f"_of_{c}") for c in by], "_least"), {c: f"_of_{c}" for c in by}, most)
    positive = F.col("_least") > 0
    kind = F.when(positive, F.lit("log10_i16")).otherwise(F.lit("f32"))
    return known.select(*df.columns, kind.alias("quant"), F.when(positive, quantise_log10(number, scale)).alias("code"), F.when(~positive, number.cast("float")).alias("raw"))


def decode_blocks(df: DataFrame, name: str = "decoded", scale: float = 3000.0) -> DataFrame:
    """Rows with the number that ``quant``, ``code`` and ``raw`` stand for."""
    return df.withColumn(name, F.when(F.col("quant") == "log10_i16", dequantise_log10(F.col("code"), scale)).otherwise(F.col("raw").cast("double")))
