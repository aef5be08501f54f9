"""Ranking and curve metrics as aggregates: rows are grouped by score before anything is ranked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evflow.functions.scalars import clamped_bin, edge_bin, log_softmax, normal_cdf, sigmoid, softmax
from evflow.operators.ranking import average_ranks, join_groups, quantiles, running_sums  # noqa: F401
from evflow.operators.selection import exact_split
from evflow.sources.collections import staged


def auc(df: DataFrame, score: str, positive: Column, by: list[str] | None = None, times: str | None = None) -> DataFrame:
    """Area under the ROC curve by average ranks, with class counts; null if a class is empty.

    A row counts as often as its column ``times`` says.
    """
    by, each = by or [], F.col(times) if times else F.lit(1)
    ties = df.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(each).alias("n"), F.sum(positive.cast("long") * each).alias("p"))
    ranked = running_sums(ties, score, ["n"], by).withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(*by).agg(F.sum("p").alias("n_pos"), (F.sum("n") - F.sum("p")).alias("n_neg"), F.sum(F.col("p") * F.col("rank")).alias("r"))
    area = F.try_divide(F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, F.col("n_pos") * F.col("n_neg"))
    return sums.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), area).alias("auc"))


def fake_rates(df: DataFrame, score: str, positive: Column, efficiencies: tuple[float, ...] = (0.95, 0.97, 0.99)) -> DataFrame:
    """Share of negatives at or above the score that keeps each share of positives."""
    tagged = df.withColumn("_pos", positive)
    cuts = quantiles(tagged, F.when(F.col("_pos"), F.col(score)), [1 - e for e in efficiencies]).select(F.col("quantiles").alias("_c"))
    rows = cuts.select(F.explode(F.arrays_zip(F.array(*map(F.lit, efficiencies)).alias("efficiency"), F.col("_c").alias("threshold"))).alias("x")).select("x.*")
    crossed = tagged.where(~F.col("_pos")).crossJoin(F.broadcast(rows))
    return crossed.groupBy("efficiency", "threshold").agg(F.avg((F.col(score) >= F.col("threshold")).cast("double")).alias("fake_rate"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of each pair of classes and their share of the true class."""
    counts = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(truth)))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Share of right rows, and its mean over the true classes."""
    per = df.groupBy(truth).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(truth) == F.col(predicted)).cast("long")).alias("hit"))
    return per.agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.avg(F.col("hit") / F.col("n")).alias("balanced_accuracy"))


def confusable_pairs(matrix: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Half the sum of both shares of each pair of classes that are taken for each other."""
    off = matrix.where(F.col(truth) != F.col(predicted))
    sides = off.select(F.least(truth, predicted).alias("class_a"), F.greatest(truth, predicted).alias("class_b"), "share")
    return sides.groupBy("class_a", "class_b").agg((F.sum("share") / 2).alias("confusion"))


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean absolute and squared error, bias, R2, and median and half 16-84 width of the response."""
    error = F.col(predicted) - F.col(truth)
    response = F.try_divide(F.col(predicted), F.col(truth))
    sums = df.agg(F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"), F.var_pop(truth).alias("_v"))
    sums = sums.crossJoin(F.broadcast(quantiles(df, response, [0.16, 0.5, 0.84]).select(F.col("quantiles").alias("_q"))))
    return sums.select("mae", "rmse", "bias", (1 - F.col("rmse") * F.col("rmse") / F.col("_v")).alias("r2"), F.col("_q")[1].alias("response_median"), ((F.col("_q")[2] - F.col("_q")[0]) / 2).alias("response_width"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks, over the rows that have both values.

    Rows are counted by pair of values first; ranks are taken from their mean, which is known, before they are multiplied.
    """
    both = df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).where("_a IS NOT NULL AND _b IS NOT NULL")
    pairs = staged(both.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")), "pairs")
    for side in ("_a", "_b"):
        counts = pairs.groupBy(side).agg(F.sum("_n").alias("_m"))
        ranks = running_sums(counts, side, ["_m"]).select(side, (F.col("_m_before") + (F.col("_m") + 1) / 2).alias(f"_r{side}"))
        pairs = pairs.join(ranks.hint("merge"), side)
    middle = pairs.agg(((F.sum("_n") + 1) / 2).alias("_middle"))
    x, y = F.col("_r_a") - F.col("_middle"), F.col("_r_b") - F.col("_middle")
    sums = pairs.crossJoin(F.broadcast(middle)).agg(*[F.sum(F.col("_n") * t).alias(c) for c, t in (("xy", x * y), ("xx", x * x), ("yy", y * y))])
    return sums.select(F.try_divide("xy", F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))


def ks_two_sample(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Largest distance of two samples' distributions, and its asymptotic p-value."""
    both = left.select(value, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(right.select(value, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    counts = both.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    upto = running_sums(counts, value, ["_a", "_b"]).select((F.col("_a_before") + F.col("_a")).alias("_fa"), (F.col("_b_before") + F.col("_b")).alias("_fb"))
    steps = upto.crossJoin(F.broadcast(upto.agg(F.max("_fa").alias("n_left"), F.max("_fb").alias("n_right"))))
    d = steps.groupBy("n_left", "n_right").agg(F.max(F.abs(F.col("_fa") / F.col("n_left") - F.col("_fb") / F.col("n_right"))).alias("ks"))
    x = F.sqrt(F.col("n_left") * F.col("n_right") / (F.col("n_left") + F.col("n_right"))) * F.col("ks")
    terms = [(2 if k % 2 else -2) * F.exp(-2.0 * k * k * x * x) for k in range(1, 51)]
    return d.withColumn("p_value", F.least(F.lit(1.0), F.greatest(F.lit(0.0), sum(terms[1:], terms[0]))))


def two_sample_report(left: DataFrame, right: DataFrame, value: str, levels: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Both samples' counts, means, population deviations and quantiles in one row, with their KS distance and p-value."""
    sides = []
    for df, side in ((left, "left"), (right, "right")):
        moments = df.where(F.col(value).isNotNull()).agg(F.avg(value).alias(f"mean_{side}"), F.stddev_pop(value).alias(f"std_{side}"))
        sides.append(moments.crossJoin(F.broadcast(quantiles(df, F.col(value), list(levels)).select(F.col("quantiles").alias(f"quantiles_{side}")))))
    return ks_two_sample(left, right, value).crossJoin(F.broadcast(sides[0])).crossJoin(F.broadcast(sides[1]))


def _ks(df: DataFrame, value: str, cdf: Column) -> DataFrame:
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_sums(counts, value, ["_n"])
    steps = upto.crossJoin(F.broadcast(upto.agg(F.max(F.col("_n_before") + F.col("_n")).alias("n"))))
    under = cdf - F.col("_n_before") / F.col("n")
    above = (F.col("_n_before") + F.col("_n")) / F.col("n") - cdf
    return steps.groupBy("n").agg(F.max(F.greatest(above, under)).alias("ks"))


def ks_uniform(df: DataFrame, value: str) -> DataFrame:
    """Largest distance of a sample's distribution from the even one on [0, 1]."""
    return _ks(df, value, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(value))))


def ks_normal(df: DataFrame, value: str) -> DataFrame:
    """Largest distance of a sample's distribution from the standard normal one."""
    return _ks(df, value, normal_cdf(F.col(value)))


def one_vs_rest(df: DataFrame, truth: str, scores: dict[object, str]) -> DataFrame:
    """AUC of each class's score against all other classes, and their mean over the classes that have one."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), F.col(c).cast("double").alias("score")) for k, c in scores.items()]))
    areas = auc(df.select(truth, each.alias("_x")).select("_x.*", (F.col(truth) == F.col("_x.class")).alias("_pos")), "score", F.col("_pos"), ["class"])
    return areas.withColumn("macro", F.avg("auc").over(Window.partitionBy()))


def auc_over_seeds(df: DataFrame, score: str, positive: Column, keys: list[str], fraction: float, seeds: list[int]) -> DataFrame:
    """Mean and population deviation of the AUC over the test rows of several splits."""
    tests = [exact_split(df, keys, fraction, seed).where("is_test").withColumn("seed", F.lit(seed)) for seed in seeds]
    areas = auc(reduce(DataFrame.unionByName, tests), score, positive, ["seed"])
    return areas.agg(F.count("auc").alias("n_seeds"), F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"))


def binned_stats(df: DataFrame, x: Column, value: str, edges: list[float]) -> DataFrame:
    """Mean, median, 16-84 band and count of a value in bins of x."""
    binned = df.withColumn("bin", edge_bin(x, edges)).where("bin is not null")
    means = binned.groupBy("bin").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    found = join_groups(means, quantiles(binned, F.col(value), [0.16, 0.5, 0.84], ["bin"]).select("bin", F.col("quantiles").alias("_q")), ["bin"])
    return found.select("bin", "n", "mean", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q16"), F.col("_q")[2].alias("q84"))


def binned_efficiency(df: DataFrame, x: Column, score: str, positive: Column, cut: float, edges: list[float]) -> DataFrame:
    """Share of positives, and of negatives, above a cut in bins of x."""
    hit = (F.col(score) > cut).cast("double")
    binned = df.withColumn("bin", edge_bin(x, edges)).withColumn("_p", positive).where("bin is not null")
    return binned.groupBy("bin").agg(F.avg(F.when(F.col("_p"), hit)).alias("efficiency"), F.avg(F.when(~F.col("_p"), hit)).alias("mistag"), F.count(F.lit(1)).alias("n"))


def binned_auc(df: DataFrame, x: Column, score: str, positive: Column, edges: list[float]) -> DataFrame:
    """Area under the ROC curve in bins of x."""
    return auc(df.withColumn("bin", edge_bin(x, edges)).where("bin is not null"), score, positive, ["bin"])


def binned_auc_of_all(df: DataFrame, x: Column, score: str, positive: Column, edges: list[float]) -> DataFrame:
    """As ``binned_auc``, with open first and last bins: every row that has x is in one."""
    return auc(df.withColumn("bin", clamped_bin(x, edges)).where(x.isNotNull()), score, positive, ["bin"])


def histogram(df: DataFrame, x: Column, edges: list[float]) -> DataFrame:
    """Count and density of x in bins; the last edge belongs to the last bin."""
    counts = df.withColumn("bin", edge_bin(x, edges)).where("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    widths = F.array(*[F.lit(float(b - a)) for a, b in zip(edges, edges[1:], strict=False)])
    return counts.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy()) / F.get(widths, F.col("bin")))


def combine_curves(curves: DataFrame, x: str, value: str) -> DataFrame:
    """Mean, least, greatest and number of several curves at each point; missing values are left out."""
    kept = F.when(~F.isnan(value), F.col(value))
    return curves.groupBy(x).agg(F.avg(kept).alias("mean"), F.min(kept).alias("low"), F.max(kept).alias("high"), F.count(kept).alias("n_curves"))


def paired_deltas(scores: DataFrame, name: str, seed: str, value: str, base: str) -> DataFrame:
    """Differences from a base run over the same seeds."""
    ref = scores.where(F.col(name) == base).select(seed, F.col(value).alias("_base"))
    delta = F.col(value) - F.col("_base")
    joined = scores.where(F.col(name) != base).join(ref, seed)
    return joined.groupBy(name).agg(F.avg(delta).alias("mean_delta"), F.stddev_pop(delta).alias("std_delta"), F.min(delta).alias("min_delta"), F.max(delta).alias("max_delta"), F.count_if(delta > 0).alias("improved"))


def mutual_information(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Mutual information of two binned columns, in nats."""
    joint = df.select(a.alias("_a"), b.alias("_b")).where("_a is not null and _b is not null").groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("n"))
    na, nb, n = (F.sum("n").over(Window.partitionBy(*c)) for c in (["_a"], ["_b"], []))
    terms = joint.select((F.col("n") / n * F.ln(F.col("n") * n / (na * nb))).alias("t"))
    return terms.agg(F.sum("t").alias("mutual_information"))


def rows_that_differ(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """For each column, how many keys have another value in the other run, or are in one run alone."""
    values = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*values).alias("_a"))
    b = right.select(*keys, F.struct(*values).alias("_b"))
    joined = a.join(b, keys, "full")
    counts = joined.agg(*[F.count_if(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) | F.col("_a").isNull() | F.col("_b").isNull()).alias(c) for c in values])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_differ")) for c in values])).alias("x")).select("x.*")


def acceptance(df: DataFrame, value: str, expected: str, tolerance: str) -> DataFrame:
    """Whether each value is within its tolerance of what is expected."""
    return df.withColumn("passed", F.abs(F.col(value) - F.col(expected)) <= F.col(tolerance))


def _dot(a: Column, b: Column) -> Column:
    """Sum of the products of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def head_loss(df: DataFrame, truth: str, predicted: str, loss: str = "categorical_crossentropy", from_logits: bool = True, by: list[str] | None = None) -> DataFrame:
    """Mean loss of a model's output: cross-entropy of arrays (one-hot truth; logits, or shares that are brought to a sum
    of one and kept 1e-7 off both ends), or mse, mae and logcosh of numbers."""
    y, p = F.col(truth), F.col(predicted)
    if loss == "categorical_crossentropy":
        total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x.cast("double"))
        shares = F.transform(p, lambda x: F.ln(F.least(F.greatest(x / total, F.lit(1e-7)), F.lit(1 - 1e-7))))
        each = -_dot(y, log_softmax(p) if from_logits else shares)
    elif loss == "mse":
        each = (p - y) * (p - y)
    elif loss == "mae":
        each = F.abs(p - y)
    elif loss == "logcosh":
        x = F.abs(p - y)
        each = x + F.log1p(F.exp(-2 * x)) - F.ln(F.lit(2.0))
    else:
        raise ValueError(f"unknown loss {loss!r}")
    return df.groupBy(*(by or [])).agg(F.avg(each).alias("loss"))


def pt_bias(df: DataFrame, truth: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Size of the mean of predicted / true - 1; rows with a true value of 0 are left out."""
    return df.groupBy(*(by or [])).agg(F.abs(F.avg(F.try_divide(F.col(predicted).cast("double"), F.col(truth)) - 1)).alias("pt_bias"))


def soft_efficiency(df: DataFrame, truth: str, logits: str, selected: list[int], scored: list[int], threshold: float = 0.5, temperature: float = 0.05) -> DataFrame:
    """Mean, over the rows of the selected true classes (one-hot), of a sigmoid of the scored classes' share above a threshold."""
    shares = softmax(F.col(logits))
    share = sum((F.get(shares, F.lit(k)) for k in scored[1:]), F.get(shares, F.lit(scored[0])))
    chosen = sum((F.get(F.col(truth), F.lit(k)) for k in selected[1:]), F.get(F.col(truth), F.lit(selected[0]))).cast("double")
    soft = sigmoid((share - threshold) / temperature)
    return df.agg((F.sum(soft * chosen) / (F.sum(chosen) + 1e-7)).alias("soft_efficiency"))


def compare_vertices(df: DataFrame, true: str, stock: str | None, new: str | None, window: float = 0.15) -> DataFrame:
    """Mean and population deviation of the old and the new position's residuals, their share within a window, and the
    deviation of one from the other."""
    out = []
    for name, column in (("stock", stock), ("new", new)):
        if column:
            residual = F.col(column) - F.col(true)
            out += [F.avg(residual).alias(f"{name}_res_mean"), F.stddev_pop(residual).alias(f"{name}_res_std"), F.avg((F.abs(residual) < window).cast("double")).alias(f"{name}_efficiency")]
    if stock and new:
        out.append(F.stddev_pop(F.col(stock) - F.col(new)).alias("stock_vs_new_std"))
    return df.agg(*out)


def association_auc(df: DataFrame, truth: str, predicted: str, mask: str | None = None) -> DataFrame:
    """Area under the ROC curve of the association of tracks, over those that ``mask`` (above 0) keeps."""
    return auc(df.where(F.col(mask) > 0) if mask else df, predicted, F.col(truth) > 0)


def pick_quality(df: DataFrame, found: str, first: str, second: str, ratio: str, width: float, by: list[str] | None = None) -> DataFrame:
    """Of picks between two true positions: share that lies between them, share that isn't at the harder one, and residuals.

    The second is the harder one where ``ratio`` is above 1.  Between is half a width off both, right within 1.5 widths.
    """
    hard = F.when(F.col(ratio) > 1, F.col(second)).otherwise(F.col(first))
    rows = df.withColumn("_res", F.col(found) - hard)
    between = (F.col(found) > F.least(first, second) + 0.5 * width) & (F.col(found) < F.greatest(first, second) - 0.5 * width)
    shares = rows.groupBy(*(by or [])).agg(F.avg(between.cast("double")).alias("midpoint_rate"), F.avg((F.abs("_res") >= 1.5 * width).cast("double")).alias("wrong_rate"), F.avg("_res").alias("res_mean"), F.stddev_pop("_res").alias("res_std"))
    q68 = quantiles(rows, F.abs("_res"), [0.68], by).select(*(by or []), F.col("quantiles")[0].alias("res_q68"))
    return join_groups(shares, q68, by or [])
