"""Tables written in the folder that driver and executors share.

A written table cuts the lineage: what it holds is not computed again when an executor is lost.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='evflow-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/evflow/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_at = path
    return table


def drop(table: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(table.staged_at)
    where.delete_dir(path)


def remove(uri: str) -> None:
    """Delete a folder of the shared folder with all that is in it, if it is there."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.delete_dir_contents(path, missing_dir_ok=True)


def rename(uri: str, to: str) -> None:
    """Give a file that was written whole its final name, in place of one that is there."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.move(path, fs.FileSystem.from_uri(to)[1])


def open_file(uri: str, mode: str):
    """Open a file of the shared folder within a task; ``mode`` is ``rb`` or ``wb``."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        where.create_dir(path.rpartition("/")[0], recursive=True)
        return where.open_output_stream(path)
    return where.open_input_file(path)
