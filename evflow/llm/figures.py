"""Held-out figures of the trained models: ``python -m evflow.llm.figures SF_DIR`` prints a JSON line a model."""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evflow.llm import linear, pitman_yor, quality, toxicity
from evflow.llm.store import stage
from evflow.llm.text import text_view


def area(rows: DataFrame, score: str, positive) -> float | None:
    """Area under the ROC curve of a bounded number of labelled rows, by ranks with ties at their mean."""
    import pandas as pd

    found = rows.select(F.col(score).alias("s"), positive.cast("int").alias("y")).limit(linear.SAMPLE_ROWS).toPandas()
    ranks, n = found["s"].rank(), int(found["y"].sum())
    rest = len(found) - n
    return float((ranks[found["y"] == 1].sum() - n * (n + 1) / 2) / (n * rest)) if n and rest else None


def language_model(spark: SparkSession, sf_dir: str) -> dict:
    """-log10 of probability a token, of the model and of its base, on held-out and on training documents."""
    scored = stage(pitman_yor.op5_pitman_yor(spark, sf_dir), "figures")
    sums = scored.groupBy("held_out").agg(*[(-F.sum(c) / F.sum("n_tokens")).alias(c) for c in ("score", "base_score")]).collect()
    return {f"{'held out' if r.held_out else 'training'}, {name}": round(r[c], 4) for r in sums for c, name in (("score", "model"), ("base_score", "base"))}


def toxicity_model(spark: SparkSession, sf_dir: str) -> dict:
    """Area, recall and false positives at 0.7 on held-out labelled documents, and the features that the fit used."""
    docs = text_view(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where("toxic IS NOT NULL")
    held_out = stage(docs.join(labels, "doc_id").where(linear.fold_of("doc_id", 3) == 1).select("doc_id", "text", "toxic"), "figures")
    model = toxicity.fit(docs, toxicity.train_labels(spark, sf_dir))
    scored = stage(toxicity.score(held_out, model).join(held_out.select("doc_id", "toxic"), "doc_id"), "figures")
    flagged = F.col("score") >= 0.7
    row = scored.agg(F.avg(F.when(F.col("toxic") == 1, flagged.cast("double"))), F.count_if((F.col("toxic") == 0) & flagged), F.count_if(F.col("toxic") == 0)).first()
    return {"features": len(model.features), "of at most": linear.MAX_FEATURES, "area": area(scored, "score", F.col("toxic") == 1), "recall": row[0], "false positives": row[1], "of": row[2]}


def quality_model(spark: SparkSession, sf_dir: str) -> dict:
    """Fitted on half of the labels: area of a grade of 1 or more, share of right decisions and mean grades on the other half."""
    docs, grades = text_view(spark.read.parquet(f"{sf_dir}/documents.parquet")), quality.graded(spark, sf_dir)
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = quality.fit(docs, grades.where(half))
    rest = docs.join(grades.where(~half), "doc_id")
    scored = stage(quality.score(rest.select("doc_id", "text"), model).join(grades, "doc_id"), "figures")
    right = F.avg(((F.col("tail_probability") >= 0.5) == (F.col("grade") >= 1)).cast("double"))
    means = {str(r.grade): round(r.m, 3) for r in scored.groupBy("grade").agg(F.avg("expected_grade").alias("m")).collect()}
    return {"area": area(scored, "tail_probability", F.col("grade") >= 1), "right": scored.agg(right).first()[0], "mean expected grade": dict(sorted(means.items()))}


def main() -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "16").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for figures in (toxicity_model, quality_model, language_model):
        print(json.dumps({figures.__name__: figures(spark, sys.argv[1])}), flush=True)


if __name__ == "__main__":
    main()
