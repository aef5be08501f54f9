"""Reading collections of events from Parquet, checking what is there, and writing tables of predictions."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evflow.functions.scalars import arg_max


def scan(spark: SparkSession, paths: list[str] | str, columns: list[str] | None = None, optional: dict[str, str] | None = None) -> DataFrame:
    """Some columns of all files; optional ones (name to type) are null where the files lack them."""
    df = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    if columns is None:
        return df
    extra = [F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (optional or {}).items()]
    return df.select(*columns, *extra)


def present(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that the table has."""
    return [c for c in columns if c in df.columns]


def select_like(df: DataFrame, *patterns: str) -> DataFrame:
    """Columns that match any of the patterns, where * stands for anything."""
    tests = [re.compile(re.escape(p).replace(r"\*", ".*")) for p in patterns]
    return df.select(*[c for c in df.columns if any(t.fullmatch(c) for t in tests)])


def first_events(events: DataFrame, children: list[DataFrame], keys: list[str], n: int) -> tuple[DataFrame, list[DataFrame]]:
    """The first n events by key, and the children of these."""
    kept = events.orderBy(*keys).limit(n)
    ids = kept.select(*keys)
    return kept, [c.join(ids, keys, "left_semi") for c in children]


def inventory(df: DataFrame) -> DataFrame:
    """Columns of a table grouped by what stands before their first underscore."""
    kind = T.StructType([T.StructField("prefix", T.StringType()), T.StructField("column", T.StringType())])
    rows = [(c.partition("_")[0], c) for c in df.columns]
    found = df.sparkSession.createDataFrame(rows, kind)
    return found.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("column")).alias("columns"))


def check_references(tables: dict[str, DataFrame], references: dict[tuple[str, str], str]) -> list[tuple[str, str, str, str]]:
    """(source, column, target, what is missing) of references that can't be followed; a missing source is no fault."""
    out = []
    for (source, column), target in references.items():
        if source in tables:
            if column not in tables[source].columns:
                out.append((source, column, target, "no index column"))
            elif target not in tables:
                out.append((source, column, target, "no target table"))
    return out


def unify_sums(df: DataFrame, sums: dict[str, tuple[str, str]]) -> DataFrame:
    """Columns under their joint names, whether files have these or the two parts of each; neither is an error."""
    for name, parts in sums.items():
        split = all(p in df.columns for p in parts)
        if not split and name not in df.columns:
            raise ValueError(f"neither {name} nor {' and '.join(parts)} is there")
        both = F.col(parts[0]) + F.col(parts[1]) if split else None
        own = F.col(name) if name in df.columns else None
        df = df.withColumn(name, F.coalesce(own, both) if split and own is not None else both if split else own)
    return df


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='evflow-')}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder of spark.checkpoint.dir, which all executors share.

    Where that is unset, a local session takes a temporary folder and any other fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/evflow/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, and its lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dump_predictions(df: DataFrame, path: str, probabilities: str, truth: Column, kinematics: list[str], cell: str, seed: str, classes: int) -> None:
    """Write probabilities, labels (an array is a one-hot label) and kinematics, parted by cell and seed."""
    label = arg_max(truth) if isinstance(df.select(truth).schema[0].dataType, T.ArrayType) else truth.cast("int")
    wrong = df.where(F.size(probabilities) != classes).limit(1).count()
    if wrong:
        raise ValueError(f"probabilities don't have {classes} classes")
    df.select(F.col(probabilities).alias("class_probs"), label.alias("y_true"), *kinematics, cell, seed).write.partitionBy(cell, seed).parquet(path)


def union_dumps(spark: SparkSession, folder: str, classes: list[str], charges: list[str], kinematics: list[str], views: list[str], variants: list[str]) -> tuple[DataFrame, DataFrame]:
    """All prediction tables ``<view>__<variant>__s<seed>.parquet`` of a folder as one, and its groups.

    Rows: group, row (its number in the whole), prob_<class>, prob_<charge class>, label, charge_label and the kinematics
    in single precision; what a table lacks is -1.  Groups: id, cell, view, variant, seed, has_charge, n_rows and
    row_offset, in the given orders of views and variants (others last), then by seed and cell.  A table whose number of
    classes, or whose class_labels, aren't those asked for is an error.  Rows are numbered by their places in the files,
    without a sort: only files are put in order.
    """
    read = spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true").parquet(folder)
    key = F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)__s(\d+)\.parquet(/|$)", 0)
    kinds = {"class_probs": "array<float>", "charge_probs": "array<float>", "y_true": "float", "charge_true": "float", "class_labels": "array<string>"}
    own = [(F.col(c) if c in read.columns else F.lit(None)).cast(kinds.get(c, "float")).alias(c) for c in (*kinds, *kinematics)]
    rows = read.select(*own, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"), key.alias("_key")).where("_key <> ''")
    names = {"cell": F.regexp_extract("_key", r"/(.+)__s\d+", 1), "seed": F.regexp_extract("_key", r"__s(\d+)\.parquet", 1).cast("int")}
    wrong = F.count_if((F.size("class_probs") != len(classes)) | (F.size("charge_probs") != len(charges)))
    labels = F.array(*map(F.lit, classes))
    other = F.count_if(F.col("class_labels") != labels)
    files = rows.groupBy("_file", "_key").agg(F.count(F.lit(1)).alias("_n"), wrong.alias("_wrong"), other.alias("_other"), F.max(F.col("charge_probs").isNotNull()).alias("_charge"))
    files = staged(files.withColumns(names), "files")
    if bad := files.where("_wrong > 0 OR _other > 0").limit(1).collect():
        raise ValueError(f"{bad[0]['_file']}: its classes aren't those asked for")
    files = files.withColumns({"view": F.substring_index("cell", "__", 1), "variant": F.regexp_replace("cell", "^.*?__", "")})
    order = [F.coalesce(F.array_position(F.array(*map(F.lit, given)), F.col(c)), F.lit(0)) for given, c in ((views, "view"), (variants, "variant"))]
    placed = files.withColumns({f"_{k}": F.when(o == 0, len(given) + 1).otherwise(o) for k, o, given in zip("vw", order, (views, variants), strict=True)})
    upto = Window.orderBy("_v", "_w", "seed", "cell", "_file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumns({"_offset": F.sum("_n").over(upto) - F.col("_n"), "group": F.concat("cell", F.lit("__s"), "seed")})
    groups = placed.groupBy(F.col("group").alias("id"), "cell", "view", "variant", "seed").agg(F.max("_charge").alias("has_charge"), F.sum("_n").alias("n_rows"), F.min("_offset").alias("row_offset"))
    numbered = rows.join(F.broadcast(placed.select("_file", "group", "_offset")), "_file")
    probs = [F.coalesce(F.get(F.col(c), F.lit(k)).cast("float"), F.lit(-1.0).cast("float")).alias(f"prob_{n}") for c, given in (("class_probs", classes), ("charge_probs", charges)) for k, n in enumerate(given)]
    rest = [F.coalesce(F.col(c).cast("float"), F.lit(-1.0).cast("float")).alias(n) for c, n in (("y_true", "label"), ("charge_true", "charge_label"), *((k, k) for k in kinematics))]
    return numbered.select("group", (F.col("_offset") + F.col("_at")).alias("row"), *probs, *rest), groups


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of all cells and seeds, with these as columns."""
    return spark.read.parquet(path)


def parse_cell(key: Column) -> dict[str, Column]:
    """View, variant and seed of a name like ``view__variant__s3``."""
    pattern = r"^(.+?)__(.+)__s(\d+)$"
    return {"view": F.regexp_extract(key, pattern, 1), "variant": F.regexp_extract(key, pattern, 2), "seed": F.regexp_extract(key, pattern, 3).try_cast("int")}


def with_provenance(df: DataFrame, note: str) -> DataFrame:
    """Rows with the file that each came from and a note; ``df`` is read from files."""
    return df.withColumns({"source_file": F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), "selection": F.lit(note)})
