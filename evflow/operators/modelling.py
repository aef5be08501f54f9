"""Boosted trees and baselines with Spark ML, and scoring of tree arrays as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evflow.operators.evaluation import auc, fake_rates, paired_deltas
from evflow.operators.selection import exact_split, hash_bucket, split_in_buckets
from evflow.sources.collections import staged


def class_weights(df: DataFrame, label: str, times: str | None = None) -> DataFrame:
    """Rows with a weight that gives both classes the same sum; a row counts as often as its column ``times`` says."""
    counts = df.groupBy(label).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_all_of"))
    total = counts.agg(F.sum("_all_of").alias("_all"), F.count(F.lit(1)).alias("_k"))
    weights = counts.crossJoin(total).select(label, (F.col("_all") / (F.col("_k") * F.col("_all_of"))).alias("weight"))
    return df.join(F.broadcast(weights), label)


def merged_rows(df: DataFrame, columns: list[str], most: int = 100_000, times: str | None = None) -> DataFrame:
    """Distinct rows of some columns with their number ``_n``, written once and dealt over partitions of about ``most``.

    A row counts as often as its column ``times`` says.
    """
    rows = staged(df.groupBy(*columns).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_n")), "merged")
    return rows.repartition(max(1, -(-rows.count() // most)), *columns)


#: Bins of a feature; trees see no more of it.
BINS = 32


def bin_names(features: list[str]) -> list[str]:
    """Columns of the features' bins."""
    return [f"_bin_{f}" for f in features]


def feature_bins(df: DataFrame, features: list[str]) -> Bucketizer:
    """The step that tells each feature's bin: bins in order, of about as many rows each; nulls and NaN have the last.

    Bounds are values of the rows, whose ranks are off by one in 10,000 at most.  All rows count, none are sampled.
    """
    values = [F.col(f).cast("double") for f in features]
    levels = [k / BINS for k in range(1, BINS)]
    found = df.agg(*[F.percentile_approx(F.when(~F.isnan(x), x), levels, 10_000) for x in values]).first()
    inner = [sorted({x for x in of or [] if math.isfinite(x)} or {0.0}) for of in found]
    return Bucketizer(inputCols=features, outputCols=bin_names(features), splitsArray=[[-math.inf, *of, math.inf] for of in inner], handleInvalid="keep")


def with_bins(bins: Bucketizer, df: DataFrame) -> DataFrame:
    """Rows with their features' bins; nulls have the one of NaN."""
    last = {name: float(len(splits) - 1) for name, splits in zip(bins.getOutputCols(), bins.getSplitsArray(), strict=True)}
    return bins.transform(df).fillna(last)


def best_round(losses: list[float], patience: int) -> int:
    """Number of rounds up to the least loss before ``patience`` rounds without a lesser one."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def fit_binned(rows: DataFrame, features: list[str], label: str = "y", rounds: int = 20, depth: int = 3, step: float = 0.1, validation: str | None = None, patience: int = 15, seed: int = 0) -> PipelineModel:
    """Boosted trees on merged rows of features' bins; see :func:`fit_trees`."""
    weighted = class_weights(rows, label, "_n").withColumn("weight", F.col("weight") * F.col("_n"))
    gather = VectorAssembler(inputCols=bin_names(features), outputCol="_x", handleInvalid="keep")
    weighted = gather.transform(weighted).select("_x", label, "weight", *([validation] if validation else [])).persist()
    trees = GBTClassifier(featuresCol="_x", labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=step, maxBins=BINS + 1, seed=seed)
    fitted, held = (weighted.where(~F.col(validation)), weighted.where(F.col(validation))) if validation else (weighted, None)
    model = trees.fit(fitted)
    if held is not None and not held.isEmpty():
        best = best_round(model.evaluateEachIteration(held), patience)
        model = model if best == rounds else trees.setMaxIter(best).fit(fitted)  # the same trees, up to the best round
    weighted.unpersist()
    return PipelineModel(stages=[gather, model])


def fit_trees(df: DataFrame, features: list[str], label: str = "y", validation: str | None = None, **options: Any) -> PipelineModel:
    """Boosted trees on weighted rows; ``validation`` names a boolean column of rows that aren't fitted but stop the rounds.

    Trees see the bins of the features, of which there are 32 (as many as Spark's own trees tell apart, but counted over
    all rows).  Rows that are alike in all that the trees see are one row of their joint weight.  Rounds end at the least
    loss of the ``validation`` rows, once ``patience`` further rounds have none that is less.
    """
    kept = [label, *([validation] if validation else [])]
    bins = feature_bins(df.where(~F.col(validation)) if validation else df, features)
    rows = merged_rows(with_bins(bins, df.withColumn(label, F.col(label).cast("double"))), [*bin_names(features), *kept])
    return PipelineModel(stages=[bins, *fit_binned(rows, features, label, validation=validation, **options).stages])


def fit_baseline(df: DataFrame, features: list[str], label: str = "y", hidden: list[int] | None = None, seed: int = 0) -> PipelineModel:
    """Logistic regression, or a perceptron with hidden layers, on standardised features."""
    stages: list[Any] = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    if hidden:
        stages.append(MultilayerPerceptronClassifier(featuresCol="_x", labelCol=label, layers=[len(features), *hidden, 2], seed=seed, maxIter=60))
    else:
        stages.append(LogisticRegression(featuresCol="_x", labelCol=label, maxIter=60))
    return Pipeline(stages=stages).fit(df.withColumn(label, F.col(label).cast("double")))


def with_score(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Rows with the probability of class 1."""
    scored = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*df.columns, name)


def in_parallel(spark: SparkSession, jobs: list[Callable[[], Any]], workers: int = 4) -> list[Any]:
    """Results of several jobs in their order; up to ``workers`` of them run at a time, each in a scheduler pool of its own.

    Small fits leave most of a cluster idle one after the other.  The pools share it evenly where the scheduler is FAIR.
    """

    def run(k: int, job: Callable[[], Any]) -> Any:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{k % workers}")
        return job()

    with ThreadPoolExecutor(max_workers=max(1, min(workers, len(jobs)))) as pool:
        waiting = [pool.submit(inheritable_thread_target(spark)(run), k, job) for k, job in enumerate(jobs)]
        return [w.result() for w in waiting]


def with_stop(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``_stop``: the tenth of them, by a hash of their keys, that ends the rounds of boosting."""
    return df.withColumn("_stop", F.crc32(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])) % 10 == 0)


def report_on_split(split: DataFrame, features: list[str], label: str = "y", seed: int = 0, **options: Any) -> dict[str, Any]:
    """Fit and test one cell on rows with is_test and _stop: the model, its AUC, fake rates at fixed efficiencies and row counts."""
    model = fit_trees(split.where("not is_test"), features, label, validation="_stop", seed=seed, **options)
    scored = staged(with_score(model, split.where("is_test")).select(label, "score"), "scores")
    positive = F.col(label) == 1
    area = auc(scored, "score", positive).first()
    rates = {r["efficiency"]: r["fake_rate"] for r in fake_rates(scored, "score", positive).collect()}
    gains = dict(zip(features, model.stages[-1].featureImportances.toArray().tolist(), strict=True))
    return {"model": model, "auc": area["auc"], "n_pos": area["n_pos"], "n_neg": area["n_neg"], "fake_rates": rates, "gains": gains}


def train_and_report(df: DataFrame, features: list[str], keys: list[str], label: str = "y", fraction: float = 0.25, seed: int = 0, **options: Any) -> dict[str, Any]:
    """Split, fit and test one cell."""
    split = with_stop(exact_split(df, keys, fraction, seed), keys)
    return report_on_split(split, features, label, seed, **options)


def shared_splits(df: DataFrame, keys: list[str], seeds: list[int], fraction: float = 0.25, workers: int = 4) -> dict[int, DataFrame]:
    """The split of each seed over one table, which is written once with its rows' buckets.

    A row is hashed once a seed; a split of its own is written only of the rows of the one bucket that is ranked.
    """
    table = staged(df.withColumns({f"_bucket_{seed}": hash_bucket(keys, seed) for seed in seeds}), "cells")

    def split(seed: int) -> DataFrame:
        whole, cut = split_in_buckets(table, f"_bucket_{seed}", df.columns, keys, fraction, seed)
        return whole.unionByName(staged(cut, "split"))

    return dict(zip(seeds, in_parallel(df.sparkSession, [partial(split, seed) for seed in seeds], workers), strict=True))


def binned_split(split: DataFrame, features: list[str], label: str, validation: str | None = None) -> tuple[Bucketizer, DataFrame]:
    """Bins of the features by the rows that are fitted of a split, and all its merged rows."""
    bins = feature_bins(split.where("not is_test").where(~F.col(validation) if validation else F.lit(True)), features)
    kept = [label, "is_test", *([validation] if validation else [])]
    return bins, merged_rows(with_bins(bins, split.withColumn(label, F.col(label).cast("double"))), [*bin_names(features), *kept])


def ablation(df: DataFrame, sets: dict[str, list[str]], keys: list[str], seeds: list[int], base: str, label: str = "y", fraction: float = 0.25, workers: int = 4, **options: Any) -> DataFrame:
    """AUC of several feature sets over the same splits, as differences from a base set.

    ``df`` is computed once and binned once a seed; its cells, one a set and seed, are fitted ``workers`` at a time.
    """
    wanted = list(dict.fromkeys(f for own in sets.values() for f in own))
    splits = shared_splits(with_stop(df.select(*dict.fromkeys([*keys, label, *wanted])), keys), keys, seeds, fraction, workers)
    binned = dict(zip(seeds, in_parallel(df.sparkSession, [partial(binned_split, splits[seed], wanted, label, "_stop") for seed in seeds], workers), strict=True))

    def area(name: str, seed: int) -> float:
        rows = merged_rows(binned[seed][1], [*bin_names(sets[name]), label, "is_test", "_stop"], times="_n")
        model = fit_binned(rows.where("not is_test"), sets[name], label, validation="_stop", seed=seed, **options)
        return auc(with_score(model, rows.where("is_test")), "score", F.col(label) == 1, times="_n").first()["auc"]

    cells = [(name, seed) for name in sets for seed in seeds]
    areas = in_parallel(df.sparkSession, [partial(area, name, seed) for name, seed in cells], workers)
    rows = [(name, seed, found) for (name, seed), found in zip(cells, areas, strict=True)]
    scores = df.sparkSession.createDataFrame(rows, "name string, seed int, auc double")
    return paired_deltas(scores, "name", "seed", "auc", base)


def model_matrix(cells: dict[tuple[str, str], tuple[DataFrame, list[str]]], keys: list[str], label: str = "y", shared: str = "A", fraction: float = 0.25, seed: int = 0, workers: int = 4, **options: Any) -> DataFrame:
    """AUC and fake rates of each (tier, config) cell of feature tables with their features' names.

    A config whose tables are absent is not among the cells.  The ``shared`` tier doesn't depend on the config: it is
    fitted once, on the first config's table, and reported as config ``*``.  A table that several cells have is split and
    written once; cells are fitted ``workers`` at a time.
    """
    wanted, splits = [], {}
    for (tier, config), (table, features) in cells.items():
        if tier == shared and any(t == shared for t, _, _, _ in wanted):
            continue
        if id(table) not in splits:
            splits[id(table)] = shared_splits(with_stop(table, keys), keys, [seed], fraction)[seed]
        wanted.append((tier, "*" if tier == shared else config, splits[id(table)], features))
    spark = next(iter(cells.values()))[0].sparkSession
    reports = in_parallel(spark, [partial(report_on_split, split, features, label, seed, **options) for _, _, split, features in wanted], workers)
    rows = [(tier, config, len(features), r["n_pos"], r["n_neg"], r["auc"], {str(k): v for k, v in r["fake_rates"].items()}) for (tier, config, _, features), r in zip(wanted, reports, strict=True)]
    return spark.createDataFrame(rows, "tier string, config string, n_features int, n_pos long, n_neg long, auc double, fake_rates map<string,double>")


def log_loss(df: DataFrame, score: str, label: str, times: str | None = None) -> float:
    """Mean negative log-likelihood of labels of 0 and 1; scores are kept 1e-15 off both ends.

    A row counts as often as its column ``times`` says.
    """
    kept = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(score)))
    loss = -F.ln(F.when(F.col(label) == 1, kept).otherwise(1 - kept))
    return df.agg(F.try_divide(F.sum(loss * F.col(times)), F.sum(times)) if times else F.avg(loss)).first()[0]


def best_seed(df: DataFrame, features: list[str], keys: list[str], seeds: list[int], label: str = "y", fraction: float = 0.25, workers: int = 4, **options: Any) -> tuple[PipelineModel, DataFrame]:
    """One model a seed on its own split: the model with the least loss on its test rows, and all seeds' losses."""
    splits = shared_splits(df.select(*dict.fromkeys([*keys, label, *features])), keys, seeds, fraction, workers)

    def run(seed: int) -> tuple[float, int, PipelineModel]:
        bins, rows = binned_split(splits[seed], features, label)
        model = fit_binned(rows.where("not is_test"), features, label, seed=seed, **options)
        loss = log_loss(with_score(model, rows.where("is_test"), "_p"), "_p", label, "_n")
        return loss, seed, PipelineModel(stages=[bins, *model.stages])

    runs = in_parallel(df.sparkSession, [partial(run, seed) for seed in seeds], workers)
    least = min(runs, key=lambda run: run[:2])
    table = df.sparkSession.createDataFrame([(seed, loss, seed == least[1]) for loss, seed, _ in runs], "seed int, loss double, best boolean")
    return least[2], table


def stacked_scores(df: DataFrame, features: list[str], columns: dict[str, Column], consumers: dict[str, list[str]], keys: list[str], label: str = "y", fraction: float = 0.25, seed: int = 0, **options: Any) -> DataFrame:
    """AUC on the test rows of models that see a first model's score and some coded columns.

    The scorer takes ``features`` and is fitted on the training rows alone; each consumer takes ``score`` and the named
    ``columns``, fitted on the same rows.  The split and the scored rows are written once.
    """
    split = staged(exact_split(df, keys, fraction, seed), "split")
    scorer = fit_trees(split.where("not is_test"), features, label, seed=seed, **options)
    scored = with_score(scorer, split).select("is_test", label, "score", *[c.cast("double").alias(n) for n, c in columns.items()])
    scored = staged(scored, "scored")
    rows = []
    for name, wanted in consumers.items():
        consumer = fit_trees(scored.where("not is_test"), ["score", *wanted], label, seed=seed, **options)
        area = auc(with_score(consumer, scored.where("is_test"), "_p"), "_p", F.col(label) == 1).first()
        rows.append((name, 1 + len(wanted), area["n_pos"], area["n_neg"], area["auc"]))
    return df.sparkSession.createDataFrame(rows, "consumer string, n_inputs int, n_pos long, n_neg long, auc double")


def tree_score(model: dict[str, Any], features: list[Column]) -> Column:
    """Score of trees given as arrays, summed in their order in single precision.

    ``model`` has splitting_convention (< or <=), init_predict, norm and trees; a tree lists, for each node, feature
    (-2: leaf), threshold, children_left, children_right and value.  Shallow trees become nested conditions.
    """
    below = model.get("splitting_convention", "<=")
    if below not in ("<", "<="):
        raise ValueError(f"unknown splitting convention {below!r}")

    def node(tree: dict[str, list], k: int) -> Column:
        if tree["feature"][k] == -2:
            return F.lit(float(tree["value"][k])).cast("float")
        x, cut = features[tree["feature"][k]].cast("float"), F.lit(float(tree["threshold"][k])).cast("float")
        return F.when(x < cut if below == "<" else x <= cut, node(tree, tree["children_left"][k])).otherwise(node(tree, tree["children_right"][k]))

    total = F.lit(float(model["init_predict"][0])).cast("float")
    for classes in model["trees"]:
        total = (total + node(classes[0], 0)).cast("float")
    return (total * F.lit(float(model["norm"])).cast("float")).cast("float")


def bagged(scores: list[Column]) -> Column:
    """Mean of several scores."""
    return sum(scores[1:], scores[0]) / len(scores)


def parity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Largest difference of two scores, and how many rows agree to the bit."""
    return df.agg(F.max(F.abs(F.col(a) - F.col(b))).alias("largest"), F.count_if(F.col(a) == F.col(b)).alias("equal"), F.count(F.lit(1)).alias("n"))
