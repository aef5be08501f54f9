"""Corpus pipeline: documents without toxic, poor, repeated or contaminated ones, packed for training.

Each stage takes what its predecessor kept, written and read again, and its decisions take effect:

1. toxicity: rows with a toxicity score of 0.7 or more go.
2. quality: rows whose grade is likelier below 1 than not go.
3. near_duplicates: of each class of near-duplicates one row with the smallest doc_id stays; rows without words all stay.
4. decontamination: rows that hold a benchmark item within its edit budget go.
5. packing: the rest is packed into windows of up to 4096 tokens; one row a piece.

Cases: null texts count as empty ones; rows without a doc_id, and repeated doc_ids, are rows like others: the third
stage goes by text; other columns stay up to the last stage; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evflow.llm import decontaminate, jaccard, packing, quality, toxicity
from evflow.llm.store import stage
from evflow.llm.text import keep_rows, text_view


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity classifier doesn't reject."""
    model = toxicity.fit(text_view(docs), toxicity.train_labels(spark, sf_dir))
    return keep_rows(docs, lambda part: toxicity.document_scores(part.column("text"), model) < 0.7)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose quality is good rather than not."""
    model = quality.fit(text_view(docs), quality.graded(spark, sf_dir))
    return keep_rows(docs, lambda part: quality.rate(part.column("text"), model, 1)[1] >= 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates."""
    return jaccard.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in their windows."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the models, the token ids and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
