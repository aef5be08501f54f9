"""Residual maps of growing sets of files by Structured Streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evflow.operators.aggregates import residual_map
from evflow.operators.ranking import join_groups, quantiles


def stream_cells(spark: SparkSession, path: str, schema: str, a: str, b: str, value: str, files_per_batch: int = 1) -> DataFrame:
    """Count, sum and sum of squares of each cell over the files of a folder, as a stream; sums alone are kept as state."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.groupBy(a, b).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"))


def start_map(cells: DataFrame, checkpoint: str, store: str) -> StreamingQuery:
    """Run the stream over what is there; each batch writes the cells that it changed to a folder of its own in ``store``."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return cells.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_map(spark: SparkSession, store: str, keys: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """The cells as the last batch that changed each one left them."""
    batches = spark.read.parquet(store)
    values = [c for c in batches.columns if c not in (*keys, "batch")]
    last = batches.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"))
    return last.select(*keys, *[f"_last.{c}" for c in values])


def start_exact_map(spark: SparkSession, path: str, schema: str, store: str, checkpoint: str, a: str, b: str, value: str, files_per_batch: int = 1, levels: tuple[float, ...] = (0.16, 0.5, 0.84), most_cells: int = 10_000) -> StreamingQuery:
    """Keep counts, sums and exact quantiles of each cell up to date: a batch reads again the cells that it touches alone.

    The rows go to ``store``/rows, parted by cell; what a batch finds goes to ``store``/map, for :func:`current_map`.  A
    repeated batch writes its folders again.  A batch that touches more than ``most_cells`` cells joins them instead of
    naming them, and which folders are read is settled as it runs.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b, value).write.mode("overwrite").partitionBy(a, b).parquet(f"{store}/rows/batch={number}")
        written = spark.read.parquet(f"{store}/rows")
        touched = written.where(F.col("batch") == number).select(a, b).distinct()
        named = touched.limit(most_cells + 1).collect()
        if not named:
            return
        if len(named) <= most_cells:
            by_a: dict[int, list[int]] = {}
            for row in named:
                by_a.setdefault(row[0], []).append(row[1])
            rows = written.where(reduce(Column.__or__, [(F.col(a) == x) & F.col(b).isin(ys) for x, ys in by_a.items()]))
        else:
            rows = written.join(touched.hint("shuffle_hash"), [a, b])
        rows = rows.where(F.col("batch") <= number)
        sums = rows.groupBy(a, b).agg(F.sum(value).alias("total"), F.sum(F.col(value) * F.col(value)).alias("squares"))
        found = join_groups(quantiles(rows, F.col(value), list(levels), [a, b]), sums, [a, b])
        found.write.mode("overwrite").parquet(f"{store}/map/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refresh_exact(spark: SparkSession, path: str, schema: str, store: str, checkpoint: str, a: str, b: str, value: str) -> StreamingQuery:
    """Put each new file's rows into a store parted by the first axis; maps of exact percentiles are read from it.

    A batch has a folder of its own that a repeated batch writes again, so each row is there once.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.select(a, b, value).write.mode("overwrite").partitionBy(a).parquet(f"{store}/batch={number}")

    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exact_map(spark: SparkSession, store: str, a: str, b: str, value: str, bins_a: int, bins_b: int, cells: list[int] | None = None) -> DataFrame:
    """The residual map of the store, or of the rows of some bins of the first axis alone (only these are read)."""
    rows = spark.read.parquet(store)
    return residual_map(rows if cells is None else rows.where(F.col(a).isin(cells)), a, b, value, bins_a, bins_b)
