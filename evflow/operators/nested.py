"""Parent and child tables: nesting, padding, gathering and cross-references.

A collection is one child table keyed by its parent's key and a 0-based place; a reference is a nullable place in
another collection of the same parent.  Nothing relies on the order of rows in files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_collection(df: DataFrame, array: str, keep_empty: bool = False, place: str = "idx") -> DataFrame:
    """One row an element of ``array``, with its place; a struct's fields become columns."""
    others = [c for c in df.columns if c != array]
    opened = df.select(*others, (F.posexplode_outer if keep_empty else F.posexplode)(array).alias(place, "item"))
    fields = getattr(opened.schema["item"].dataType, "names", None)
    return opened.select(*others, place, *([F.col(f"item.{f}").alias(f) for f in fields] if fields else [F.col("item").alias(array)]))


def nest_links(links: DataFrame, keys: list[str], order: list[str], fields: list[str], name: str = "children") -> DataFrame:
    """Rows of each parent as an array of structs in the order of ``order``."""
    inner = F.sort_array(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))
    return links.groupBy(*keys).agg(F.transform(inner, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def misaligned_parents(parents: DataFrame, links: DataFrame, keys: list[str], expected: str) -> DataFrame:
    """Parents whose number of link rows isn't the ``expected`` column's."""
    counts = links.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_links"))
    joined = parents.join(counts, keys, "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return joined.where(F.col("n_links") != F.col(expected)).select(*keys, expected, "n_links")


def check_alignment(parents: DataFrame, links: DataFrame, keys: list[str], expected: str) -> None:
    """Raise if any parent has another number of links than it should."""
    wrong = misaligned_parents(parents, links, keys, expected).count()
    if wrong:
        raise ValueError(f"{wrong} parents have another number of links than {expected} says")


def tagger_window(links: DataFrame, slot: str, index: str, slots: int) -> DataFrame:
    """Links of the first ``slots`` slots that point at something."""
    return links.where((F.col(slot) < slots) & (F.col(index) >= 0))


def count_children(parents: DataFrame, children: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Number of children of every parent, 0 for those without."""
    counts = children.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return parents.join(counts, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def gather(df: DataFrame, values: DataFrame, keys: list[str], index: str, place: str, fields: dict[str, object] | list[str]) -> DataFrame:
    """Fields of the row of ``values`` that ``index`` points at; a dict of fields gives defaults for those without."""
    wanted = list(fields)
    target = values.select(*keys, F.col(place).alias(index), *wanted)
    joined = df.join(target, [*keys, index], "left")
    if isinstance(fields, dict):
        joined = joined.withColumns({f: F.coalesce(f, F.lit(d)) for f, d in fields.items()})
    return joined


def dangling(df: DataFrame, values: DataFrame, keys: list[str], index: str, place: str) -> DataFrame:
    """Rows whose index is not negative and points at no row of ``values``."""
    return df.where(F.col(index) >= 0).join(values.select(*keys, F.col(place).alias(index)), [*keys, index], "left_anti")


def pad(array: Column, size: int, fill: Column) -> Column:
    """Array cut or filled up to ``size``."""
    return F.slice(F.concat(array, F.array_repeat(fill, size)), 1, size)


def fill_mask(array: Column, size: int) -> Column:
    """Ones for the places that ``array`` fills, then zeros."""
    return pad(F.transform(array, lambda _: F.lit(1.0)), size, F.lit(0.0))


def first_or_default(children: DataFrame, keys: list[str], value: str, order: str, parents: DataFrame, default: float) -> DataFrame:
    """The first child's value of every parent, or ``default``."""
    first = children.groupBy(*keys).agg(F.min_by(value, order).alias(value))
    return parents.select(*keys).join(first, keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def with_fallback_index(df: DataFrame, own: str, other: str, name: str) -> DataFrame:
    """``own`` if any of its values in the whole table is 0 or more, else ``other``."""
    used = df.agg(F.coalesce(F.max(F.col(own) >= 0), F.lit(False)).alias("_used"))
    return df.crossJoin(F.broadcast(used)).withColumn(name, F.when(F.col("_used"), F.col(own)).otherwise(F.col(other))).drop("_used")


def twin_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two tables that stand for the same objects."""
    return left.join(right, keys)


def twin_mismatches(left: DataFrame, right: DataFrame, parent: list[str]) -> DataFrame:
    """Parents with another number of rows in the one table than in the other."""
    a = left.groupBy(*parent).agg(F.count(F.lit(1)).alias("n_left"))
    b = right.groupBy(*parent).agg(F.count(F.lit(1)).alias("n_right"))
    both = a.join(b, parent, "full").fillna(0, ["n_left", "n_right"])
    return both.where("n_left <> n_right")


def offsets(counts: DataFrame, order: list[str], size: str, name: str = "offset") -> DataFrame:
    """Rows of all earlier groups, for each group; for tables of groups."""
    running = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn(name, F.sum(size).over(running) - F.col(size))


def slot_columns(df: DataFrame, arrays: list[str], slots: int, fill: float = 0.0) -> DataFrame:
    """Arrays as one column a slot and feature, slot by slot."""
    others = [c for c in df.columns if c not in arrays]
    return df.select(*others, *[F.coalesce(F.get(a, F.lit(s)), F.lit(fill)).alias(f"c{s}_{a}") for s in range(slots) for a in arrays])


#: Index columns and the collections that they point into.
REFERENCES: dict[tuple[str, str], str] = {}


def reference(table: str, column: str, target: str) -> None:
    """Make a cross-reference known by name."""
    REFERENCES[table, column] = target


def resolve(tables: dict[str, DataFrame], table: str, column: str, keys: list[str], place: str, fields: list[str]) -> DataFrame:
    """Fields of what a known cross-reference points at; a negative index gives nulls."""
    target = tables[REFERENCES[table, column]].select(*keys, F.col(place).alias(column), *[F.col(f).alias(f"{column}_{f}") for f in fields])
    return tables[table].join(target, [*keys, column], "left")
