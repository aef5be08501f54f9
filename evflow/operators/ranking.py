"""Running sums, ranks and exact quantiles of columns that no task could hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evflow.sources.collections import staged

#: Cut points of a sketch, and how much closer the sketch is than these.
GRID, CLOSER = 512, 8


def same_keys(left: DataFrame, right: DataFrame, by: list[str]) -> list[Column]:
    """Conditions that join groups, null ones too."""
    return [left[k].eqNullSafe(right[k]) for k in by]


def join_groups(left: DataFrame, right: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """Columns of both sides by group; without groups, ``right`` is one row."""
    if not by:
        return left.crossJoin(F.broadcast(right))
    named = right.withColumnsRenamed({k: f"_of_{k}" for k in by})
    joined = left.join(named.hint("shuffle_hash"), [left[k].eqNullSafe(named[f"_of_{k}"]) for k in by], how)
    return joined.drop(*[f"_of_{k}" for k in by])


def running_sums(df: DataFrame, order: str, sums: list[str], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Rows with ``<name>_before`` for each column of ``sums``: its sum over the rows that come before in ``order``.

    Rows are dealt once, into ranges of the whole key (group and order), and written.  A range is added up by itself;
    what the ranges before it hold of the same group is carried in by a table with a row for each group and range.
    ``order`` may be of any type that sorts, and null comes first.  No two rows of a group may have the same place.
    There are ``parts`` ranges, or as many as a shuffle has.
    """
    by = by or []
    dealt = staged(df.repartitionByRange(*([parts] if parts else []), *by, order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_sum_{c}") for c in sums])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, "_range", *[F.sum(f"_sum_{c}").over(before).alias(f"_carried_{c}") for c in sums])
    # A group is carried into a range only if it began in one before: at most one group a range.
    carried = carried.where(F.coalesce(*[F.col(f"_carried_{c}") for c in sums]).isNotNull()).withColumnsRenamed({k: f"_of_{k}" for k in [*by, "_range"]})
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *[F.sum(c).over(inside).alias(f"_inside_{c}") for c in sums])
    joined = summed.join(F.broadcast(carried), [summed[k].eqNullSafe(carried[f"_of_{k}"]) for k in [*by, "_range"]], "left")
    zero = F.lit(0)
    return joined.select(*df.columns, *[(F.coalesce(f"_carried_{c}", zero) + F.coalesce(f"_inside_{c}", zero)).alias(f"{c}_before") for c in sums])


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Rank of each row's value with ties at their mean; values are counted before they are ranked.

    A null has no rank and takes none from others.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_sums(counts, column, ["_n"]).select(column, (F.col("_n_before") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, column, "left").select(*df.columns, name)


def quantiles(df: DataFrame, value: Column, levels: list[float], by: list[str] | None = None, most: int = 200_000, groups: int = 100_000) -> DataFrame:
    """``n`` and exact ``quantiles`` (an array in the order of ``levels``) of each group's values that aren't null.

    Between two values they are interpolated evenly; a group without values has null.  NaN is above all numbers.

    A group of up to ``most`` values is sorted.  In a larger one, a wanted order number is first closed in: a sketch
    (an aggregate of bounded size) gives two values around it, the rows below and between these are counted, and again
    between them, until no more than ``most`` rows are left to sort.  Counts are exact, so a sketch that misses costs a
    wider bracket and never a wrong value.  Up to ``groups`` large groups' brackets go to every task, more by a join.
    """
    by = by or []
    rows = df.select(*by, value.cast("double").alias("_v")).where("_v IS NOT NULL")
    places = [f"_k{j}" for j in range(2 * len(levels))]
    at = [f"(n - 1) * {float(p)!r}D" for p in levels]
    wanted = [F.expr(f"CAST({f}({x}) AS LONG) AS {k}") for (f, x), k in zip([(f, x) for x in at for f in ("floor", "ceil")], places, strict=True)]
    sizes = staged(df.groupBy(*by).agg(F.count(value).alias("n")).select("*", *wanted), "group-sizes")
    n_large = sizes.where(F.col("n") > most).count()
    small = rows
    found = []
    if n_large:
        few = n_large <= groups
        large = sizes.where(F.col("n") > most)
        small = _with(rows, large.select(*by), by, few, "left_anti")
        found.append(_selected(rows, large, by, places, most, few))
    if not n_large or by:
        counted = small.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
        upto = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = join_groups(counted.withColumn("_end", F.sum("_c").over(upto)), sizes.where(F.col("n") <= most), by)
        hit = [F.expr(f"max(IF({k} < _end AND {k} >= _end - _c, _v, NULL)) AS {k}") for k in places]
        found.append(placed.groupBy(*by).agg(*hit))
    values = found[0].unionByName(found[1]) if len(found) > 1 else found[0]
    joined = join_groups(sizes.select(*by, "n"), values, by)
    between = ", ".join(f"{a} + IF({a} = {b}, 0, ({b} - {a}) * ({x} - floor({x})))" for x, a, b in zip(at, places[::2], places[1::2], strict=True))
    return joined.select(*by, "n", F.expr(f"IF(n > 0, array({between}), NULL) AS quantiles"))


def _with(rows: DataFrame, groups: DataFrame, by: list[str], few: bool, how: str) -> DataFrame:
    """Rows with their group's columns; ``few`` groups go to every task."""
    if not by:
        return rows.crossJoin(F.broadcast(groups)) if how == "inner" else rows.where("false")
    named = groups.withColumnsRenamed({k: f"_of_{k}" for k in by})
    right = F.broadcast(named) if few else named.hint("merge")
    return rows.join(right, [rows[k].eqNullSafe(named[f"_of_{k}"]) for k in by], how).drop(*[f"_of_{k}" for k in by])


def _selected(rows: DataFrame, large: DataFrame, by: list[str], places: list[str], most: int, few: bool) -> DataFrame:
    """The values at the wanted order numbers of large groups.

    Of each place is known: ``value``, once it is found, else that it lies between ``lo`` and ``hi`` (null: no bound),
    with ``below`` rows up to ``lo`` and ``inside`` rows between.  Two cut points of a sketch part these rows in five.
    """
    state = large.select(*by, *places, *[F.expr(f"{_known('NULL', 'NULL', 'NULL', '0', 'n')} AS _s{k}") for k in places])
    share = f"array({', '.join(f'{i / GRID!r}D' for i in range(GRID + 1))})"
    while state.where(f"greatest(0, {', '.join(f'_s{k}.inside' for k in places)}) > {most}").limit(1).count():
        joined = _with(rows, state, by, few, "inner")
        grids = [F.expr(f"percentile_approx(IF(_s{k}.inside > {most} AND {_inside(k)}, _v, NULL), {share}, {GRID * CLOSER}) AS _g{k}") for k in places]
        sketched = join_groups(state, joined.groupBy(*by).agg(*grids), by)
        cut = staged(sketched.select(*by, *places, *[f"_s{k}" for k in places], *[F.expr(f"{_cuts(k)} AS _c{k}") for k in places]), "brackets")
        joined = _with(rows, cut, by, few, "inner")
        counts = [F.expr(f"count_if({_inside(k)} AND {test}) AS _n{k}_{name}") for k in places for name, test in _parts(k).items()]
        counted = join_groups(cut, joined.groupBy(*by).agg(*counts), by)
        state = staged(counted.select(*by, *places, *[F.expr(f"IF(_s{k}.inside > {most}, {_closer(k)}, _s{k}) AS _s{k}") for k in places]), "brackets")
    joined = _with(rows, state, by, few, "inner")
    each = ", ".join(f"IF({_inside(k)}, named_struct('j', {j}, 'k', {k}, 'below', _s{k}.below), NULL)" for j, k in enumerate(places))
    kept = joined.select(*by, "_v", F.expr(f"explode(array_compact(array({each}))) AS _x"))
    counted = kept.groupBy(*by, "_x", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*by, "_x").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = counted.withColumn("_end", F.sum("_c").over(upto) + F.col("_x.below"))
    hits = ends.where("_x.k < _end AND _x.k >= _end - _c").groupBy(*by).agg(*[F.expr(f"max(IF(_x.j = {j}, _v, NULL)) AS _f{k}") for j, k in enumerate(places)])
    return join_groups(state, hits, by).select(*by, *[F.expr(f"coalesce(_s{k}.value, _f{k}) AS {k}") for k in places])


def _known(value: str, lo: str, hi: str, below: str, inside: str) -> str:
    """What is known of a place."""
    return f"named_struct('value', CAST({value} AS DOUBLE), 'lo', CAST({lo} AS DOUBLE), 'hi', CAST({hi} AS DOUBLE), 'below', CAST({below} AS LONG), 'inside', CAST({inside} AS LONG))"


def _inside(k: str) -> str:
    """Whether a row is among those that the place is one of."""
    return f"(_s{k}.value IS NULL AND (_s{k}.lo IS NULL OR _v > _s{k}.lo) AND (_s{k}.hi IS NULL OR _v < _s{k}.hi))"


def _cuts(k: str) -> str:
    """Two values of the sketch around the place."""
    step = f"CAST(floor(try_divide(({k} - _s{k}.below) * {GRID}, _s{k}.inside)) AS INT)"
    return f"named_struct('low', get(_g{k}, greatest({step} - 1, 0)), 'high', get(_g{k}, least({step} + 2, {GRID})))"


def _parts(k: str) -> dict[str, str]:
    """The rows that are counted apart: below, at and between the cut points."""
    low, high = f"_c{k}.low", f"_c{k}.high"
    return {"below": f"_v < {low}", "low": f"_v = {low}", "middle": f"_v > {low} AND _v < {high}", "high": f"_v = {high} AND {high} > {low}"}


def _closer(k: str) -> str:
    """What is known of the place when the rows below, at, between and above the cut points are counted."""
    s, c = f"_s{k}", f"_c{k}"
    ends, end = {}, f"{s}.below"
    for name in _parts(k):
        end = f"{end} + _n{k}_{name}"
        ends[name] = f"({end})"
    return f"""CASE WHEN {k} < {ends['below']} THEN {_known('NULL', f'{s}.lo', f'{c}.low', f'{s}.below', f'_n{k}_below')}
        WHEN {k} < {ends['low']} THEN {_known(f'{c}.low', 'NULL', 'NULL', '0', '0')}
        WHEN {k} < {ends['middle']} THEN {_known('NULL', f'{c}.low', f'{c}.high', ends['low'], f'_n{k}_middle')}
        WHEN {k} < {ends['high']} THEN {_known(f'{c}.high', 'NULL', 'NULL', '0', '0')}
        ELSE {_known('NULL', f'{c}.high', f'{s}.hi', ends['high'], f'{s}.below + {s}.inside - {ends["high"]}')} END"""
