"""Aggregations over children: track sums, jet charge, weighted-histogram peaks, vertex fits and residual maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evflow.functions.scalars import null_sentinel
from evflow.operators.evaluation import auc
from evflow.operators.ranking import join_groups, quantiles


def hit_sums(hits: DataFrame, tracks: DataFrame, keys: list[str], gate_all: bool = False) -> DataFrame:
    """Sums of each track's hits, with zeros for tracks without.

    Hits have pull_x, pull_y, res_x, res_y, pull_alpha, pull_beta, sig_alpha, sig_beta, has_alpha and has_beta.  Missing
    numbers of the first four count as they are, unless ``gate_all``; those of the angles never do.
    """

    def gated(name: str) -> Column:
        return null_sentinel(F.col(name)) if gate_all else F.col(name)

    def angle(name: str) -> Column:
        return F.when(F.col(f"has_{name}"), null_sentinel(F.col(f"pull_{name}")))

    sums = [F.count(F.lit(1)).alias("n_hits"), *(F.sum(gated(f"pull_{c}") * gated(f"pull_{c}")).alias(f"sum_pull2_{c}") for c in "xy"), *(F.greatest(F.lit(0.0), F.max(F.abs(gated(f"res_{c}")))).alias(f"max_abs_res_{c}") for c in "xy")]
    for name in ("alpha", "beta"):
        sums += [F.sum(angle(name) * angle(name)).alias(f"sum_pull2_{name}"), F.count(angle(name)).alias(f"n_{name}"), F.avg(null_sentinel(F.col(f"sig_{name}"))).alias(f"mean_sig_{name}")]
    found = hits.groupBy(*keys).agg(*sums)
    names = [c for c in found.columns if c not in keys]
    return tracks.select(*keys).join(found, keys, "left").fillna(0, names)


def sum_clipped_chi2(hits: DataFrame, tracks: DataFrame, keys: list[str], name: str = "sum_chi2_rphi") -> DataFrame:
    """Sum of each track's hits' r-phi increments of chi2, each 0 at least; 0 for tracks without hits."""
    sums = hits.groupBy(*keys).agg(F.sum(F.greatest(F.col("chi2IncRPhi").cast("double"), F.lit(0.0))).alias(name))
    return tracks.join(sums, keys, "left").select(*tracks.columns, F.coalesce(name, F.lit(0.0)).alias(name))


def layer_columns(hits: DataFrame, keys: list[str], layer: str, layers: list[int], values: list[str]) -> DataFrame:
    """First value of each layer as a column, with a flag for layers that have a hit."""
    wide = hits.groupBy(*keys).pivot(layer, layers).agg(*[F.min(v).alias(v) for v in values], F.count(F.lit(1)).alias("crossed"))
    flags = {f"{n}_crossed": F.coalesce(F.col(f"{n}_crossed"), F.lit(0)) > 0 for n in layers}
    renamed = wide.withColumns(flags)
    return renamed.select(*keys, *[F.col(f"{n}_{v}").alias(f"{v}_L{n}") for n in layers for v in [*values, "crossed"]])


def jet_charge(children: DataFrame, parents: DataFrame, keys: list[str], charge: str, pt: str, kappa: float, by_total: bool = True) -> DataFrame:
    """Charge of each parent: sum of q * pt^kappa over (sum pt)^kappa, or over the sum of pt^kappa; 0 if empty."""
    weighed = F.sum(F.col(charge) * F.pow(F.col(pt), F.lit(kappa)))
    whole = F.pow(F.sum(pt), F.lit(kappa)) if by_total else F.sum(F.pow(F.col(pt), F.lit(kappa)))
    found = children.groupBy(*keys).agg(F.try_divide(weighed, whole).alias("jet_charge"))
    return parents.select(*keys).join(found, keys, "left").withColumn("jet_charge", F.coalesce("jet_charge", F.lit(0.0)))


def charge_benchmark(df: DataFrame, charge: str, klass: str) -> DataFrame:
    """Rows and mean charge of each charge class, with the AUC of the charge between classes 2 (positive) and 0."""
    classes = df.groupBy(klass).agg(F.count(F.lit(1)).alias("n"), F.avg(charge).alias("mean_charge"))
    area = auc(df.where(F.col(klass).isin(0, 2)), charge, F.col(klass) == 2).select(F.col("auc").alias("auc_charged"))
    return classes.crossJoin(F.broadcast(area))


def balance_weights(df: DataFrame, label: str, bin_: str | None, reference: object = 0) -> DataFrame:
    """Weight of each class (in each bin): rows of the reference class over its own; 1 where either is missing."""
    by = [bin_] if bin_ else []
    counts = df.groupBy(label, *by).agg(F.count(F.lit(1)).alias("n"))
    base = counts.where(F.col(label) == reference).select(*by, F.col("n").alias("_ref"))
    joined = counts.join(base, by, "left") if by else counts.crossJoin(base)
    return joined.select(label, *by, "n", F.coalesce(F.col("_ref") / F.col("n"), F.lit(1.0)).alias("weight"))


def even_edges(low: float, high: float, bins: int) -> list[float]:
    """``bins`` equal bins' edges."""
    return [low + (high - low) * k / bins for k in range(bins + 1)]


def even_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin of ``x`` among equal ones, from 0; the upper end belongs to the last; null outside.

    The quotient is a guess that the neighbouring edges correct, so that a number on an edge is in the bin above it.
    """
    step = (high - low) / bins
    guess = F.floor((x - low) / step).cast("int")

    def edge(k: Column) -> Column:
        return F.lit(low) + F.lit(high - low) * k / bins

    fixed = F.when(x < edge(guess), guess - 1).when(x >= edge(guess + 1), guess + 1).otherwise(guess)
    return F.when((x >= low) & (x <= high), F.least(fixed, F.lit(bins - 1))).cast("int")


def kernel_weights(kind: str, width: int, sigma: float = 1.0) -> list[float]:
    """Weights of a window of ``width`` bins: flat, triangular, epanechnikov or gaussian."""
    middle = (width - 1) / 2
    if kind == "flat":
        return [1.0] * width
    if kind == "triangular":
        return [1 - abs(k - middle) / (middle + 1) for k in range(width)]
    if kind == "epanechnikov":
        return [1 - ((k - middle) / (middle + 1)) ** 2 for k in range(width)]
    if kind == "gaussian":
        return [math.exp(-0.5 * ((k - middle) / sigma) ** 2) for k in range(width)]
    raise ValueError(f"unknown kernel {kind!r}")


def dealt(points: DataFrame, keys: list[str], most: int = 250_000) -> DataFrame:
    """The points dealt out by event, to so many partitions that each has about ``most``; they are counted for it.

    Histograms, windows and sums of an event are then made where its points are, in memory that doesn't grow with the
    table.  Adaptive execution doesn't join these partitions, nor split that of an event of very many points.
    """
    usual = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.repartition(max(usual, -(-points.count() // most)), *keys)


def weighted_histogram(points: DataFrame, keys: list[str], x: str, weight: Column, low: float, high: float, bins: int) -> DataFrame:
    """Sum of the weights in each filled bin of each event."""
    return points.withColumn("bin", even_bin(F.col(x), low, high, bins)).where("bin is not null").groupBy(*keys, "bin").agg(F.sum(weight).alias("w"))


def peak_window(filled: DataFrame, events: DataFrame, keys: list[str], kernel: list[float], bins: int) -> DataFrame:
    """First start of the window with the largest kernel-weighted sum, 0 for events without weight.

    Each filled bin looks at its neighbours and gives the best of the windows that cover it; empty bins are never made.
    Sums are rounded so that the order of adding doesn't decide between equal windows.
    """
    width = len(kernel)
    near = Window.partitionBy(*keys).orderBy("bin").rangeBetween(1 - width, width - 1)
    weights = F.array(*[F.lit(float(c)) for c in kernel])

    def value(start: Column) -> Column:
        covered = F.filter("_near", lambda x: (x["bin"] >= start) & (x["bin"] < start + width))
        return F.round(F.aggregate(covered, F.lit(0.0), lambda s, x: s + x["w"] * F.get(weights, x["bin"] - start)), 9)

    starts = F.sequence(F.greatest(F.lit(0), F.col("bin") - (width - 1)), F.least(F.col("bin"), F.lit(bins - width)))
    valued = F.transform(starts, lambda k: F.struct(value(k).alias("v"), (-k).alias("k")))
    rows = filled.where("w > 0").select(*keys, "bin", F.collect_list(F.struct("bin", F.col("w").cast("double").alias("w"))).over(near).alias("_near"))
    best = rows.where(F.greatest(F.lit(0), F.col("bin") - (width - 1)) <= F.least(F.col("bin"), F.lit(bins - width))).select(*keys, F.array_max(valued).alias("_best"))
    best = best.groupBy(*keys).agg((-F.max("_best")["k"]).alias("start"))
    return events.select(*keys).join(best.hint("merge"), keys, "left").withColumn("start", F.coalesce("start", F.lit(0)))


def window_centroid(points: DataFrame, windows: DataFrame, keys: list[str], x: str, weight: Column, low: float, high: float, bins: int, width: int) -> DataFrame:
    """Weighted mean of the points in [lower edge, upper edge) of each event's window; its middle if there are none."""
    step = F.lit((high - low) / bins)
    edged = windows.withColumns({"edge_low": F.lit(low) + F.col("start") * step, "edge_high": F.lit(low) + (F.col("start") + width) * step})
    inside = (F.col(x) >= F.col("edge_low")) & (F.col(x) < F.col("edge_high"))
    joined = edged.join(points.hint("merge"), keys, "left").withColumn("_w", F.when(inside, weight))
    sums = joined.groupBy(*keys, "start", "edge_low", "edge_high").agg(F.sum(F.col("_w") * F.col(x)).alias("_s"), F.sum("_w").alias("_n"))
    return sums.select(*keys, "start", "edge_low", "edge_high", F.coalesce(F.try_divide("_s", "_n"), (F.col("edge_low") + F.col("edge_high")) / 2).alias("z0"))


def transverse_fit(points: DataFrame, windows: DataFrame, keys: list[str], x: str, weight: Column, d0: str, phi: str, gate: float | None = None, least_condition: float = 1e-6) -> DataFrame:
    """Least-squares vertex (vx, vy) of ``d0 = vx sin(phi) - vy cos(phi)`` over the points in each event's window.

    ``gate`` keeps small |d0| for these sums alone.  Null where the sums don't determine both numbers.
    """
    inside = (F.col(x) >= F.col("edge_low")) & (F.col(x) < F.col("edge_high"))
    if gate is not None:
        inside = inside & (F.abs(F.col(d0)) < gate)
    joined = windows.join(points.hint("merge"), keys, "left").withColumn("_w", F.when(inside, weight))
    s, c, w, d = F.sin(phi), F.cos(phi), F.col("_w"), F.col(d0)
    sums = joined.groupBy(*keys).agg(F.count("_w").alias("n_window"), F.sum(w).alias("sum_w"), F.sum(w * s * s).alias("ss"), F.sum(w * c * c).alias("cc"), F.sum(w * s * c).alias("sc"), F.sum(w * d * s).alias("ds"), F.sum(w * d * c).alias("dc"), F.sum(w * d * d).alias("dd"))
    det = F.col("ss") * F.col("cc") - F.col("sc") * F.col("sc")
    half = (F.col("ss") + F.col("cc")) / 2
    gap = F.sqrt(F.greatest(F.lit(0.0), half * half - det))
    condition = F.try_divide(half - gap, half + gap)
    good = condition > least_condition
    vx = F.when(good, F.try_divide(F.col("ds") * F.col("cc") - F.col("dc") * F.col("sc"), det))
    vy = F.when(good, F.try_divide(F.col("ds") * F.col("sc") - F.col("dc") * F.col("ss"), det))
    fitted = sums.withColumns({"vx": vx, "vy": vy, "condition": condition})
    chi2 = F.col("dd") - F.col("vx") * F.col("ds") + F.col("vy") * F.col("dc")
    scatter = F.sqrt(F.greatest(F.lit(0.0), chi2) / F.col("sum_w"))
    return fitted.withColumns({"scatter": scatter, "sigma_vx": F.when(good, F.sqrt(F.try_divide(F.col("cc"), det))), "sigma_vy": F.when(good, F.sqrt(F.try_divide(F.col("ss"), det)))}).drop("ss", "cc", "sc", "ds", "dc", "dd")


def vertex_estimate(points: DataFrame, windows: DataFrame, keys: list[str], x: str, weight: Column, d0: str, phi: str, gate: float | None = None, isotropic: bool = False, least_condition: float = 1e-6) -> DataFrame:
    """Vertex (vx, vy) of each event's window with its deviations, significances and the scatter of d0 about it.

    ``gate`` gives no weight to tracks whose |d0| is above it.  The condition is the determinant of the normal matrix
    over the product of its diagonal.  Least squares need two tracks of some weight and ``least_condition``; the
    ``isotropic`` estimate takes angles as evenly spread and needs weight alone.  Deviations need three tracks.  What
    can't be had is null, as is a significance whose deviation is 0.
    """
    inside = (F.col(x) >= F.col("edge_low")) & (F.col(x) < F.col("edge_high"))
    heavy = weight if gate is None else F.when(F.abs(F.col(d0)) <= gate, weight).otherwise(F.lit(0.0))
    joined = windows.join(points.hint("merge"), keys, "left").withColumn("_w", F.when(inside, heavy))
    s, c, w, d = F.sin(phi), F.cos(phi), F.col("_w"), F.col(d0)
    products = {"sum_w": w, "_ss": w * s * s, "_cc": w * c * c, "_sc": w * s * c, "_ds": w * d * s, "_dc": w * d * c, "_dd": w * d * d}
    sums = joined.groupBy(*keys).agg(F.count_if(w > 0).alias("n_window"), *[F.coalesce(F.sum(v), F.lit(0.0)).alias(n) for n, v in products.items()])
    total, ss, cc, sc, ds, dc, dd = (F.col(n) for n in products)
    weighty = total > 0
    sums = sums.withColumn("condition", F.when(weighty, F.when((ss > 0) & (cc > 0), F.try_divide(ss * cc - sc * sc, ss * cc)).otherwise(F.lit(0.0))))
    if isotropic:
        solved = weighty
        vx, vy, xx, yy = F.try_divide(2 * ds, total), F.try_divide(-2 * dc, total), F.try_divide(F.lit(2.0), total), F.try_divide(F.lit(2.0), total)
    else:
        det = ss * cc - sc * sc
        solved = weighty & (F.col("n_window") >= 2) & (det > 0) & (F.col("condition") >= least_condition)
        vx, vy, xx, yy = F.try_divide(cc * ds - sc * dc, det), F.try_divide(sc * ds - ss * dc, det), F.try_divide(cc, det), F.try_divide(ss, det)
    found = sums.withColumns({"vx": F.when(solved, vx), "vy": F.when(solved, vy), "_xx": xx, "_yy": yy})
    vx, vy = F.col("vx"), F.col("vy")
    rest = F.greatest(F.lit(0.0), dd - 2 * vx * ds + 2 * vy * dc + vx * vx * ss + vy * vy * cc - 2 * vx * vy * sc)
    found = found.withColumn("_rest", F.when(vx.isNotNull(), rest))
    variance = F.when(F.col("n_window") >= 3, F.col("_rest") / (F.col("n_window") - 2))
    found = found.withColumns({"scatter": F.sqrt(F.try_divide("_rest", "sum_w")), "sigma_vx": F.sqrt(variance * F.col("_xx")), "sigma_vy": F.sqrt(variance * F.col("_yy"))})
    found = found.withColumns({"vx_sig": F.try_divide("vx", "sigma_vx"), "vy_sig": F.try_divide("vy", "sigma_vy")})
    return found.select(*keys, "n_window", "sum_w", "condition", "vx", "vy", "scatter", "sigma_vx", "sigma_vy", "vx_sig", "vy_sig")


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, population deviation, median and 16-84 band of the finite values."""
    kept = F.when(~F.isnan(value) & (F.abs(F.col(value)) < float("inf")), F.col(value))
    by = by or []
    moments = df.groupBy(*by).agg(F.count(kept).alias("n"), F.avg(kept).alias("mean"), F.stddev_pop(kept).alias("std"))
    found = join_groups(moments, quantiles(df, kept, [0.16, 0.5, 0.84], by).select(*by, F.col("quantiles").alias("_q")), by)
    return found.select(*by, "n", "mean", "std", F.col("_q")[1].alias("median"), F.col("_q")[0].alias("q16"), F.col("_q")[2].alias("q84"))


def residual_map(df: DataFrame, a: str, b: str, value: str, bins_a: int, bins_b: int, least: int = 25, floor: float = 1e-4) -> DataFrame:
    """Median and half 16-84 width of a residual in each cell of a grid; cells with few rows take the whole sample's."""
    levels = [0.16, 0.5, 0.84]
    spread = F.greatest(F.lit(floor), (F.col("quantiles")[2] - F.col("quantiles")[0]) / 2)
    cells = quantiles(df, F.col(value), levels, [a, b]).select(a, b, "n", F.col("quantiles")[1].alias("_bias"), spread.alias("_sigma"))
    pooled = quantiles(df, F.col(value), levels).select(F.col("quantiles")[1].alias("_all_bias"), spread.alias("_all_sigma"))
    spark = df.sparkSession
    grid = spark.range(bins_a).select(F.col("id").cast("int").alias(a)).crossJoin(spark.range(bins_b).select(F.col("id").cast("int").alias(b)))
    full = grid.join(cells.hint("shuffle_hash"), [a, b], "left").crossJoin(F.broadcast(pooled)).withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= least
    return full.select(a, b, "n", F.when(enough, F.col("_bias")).otherwise(F.col("_all_bias")).alias("bias"), F.when(enough, F.col("_sigma")).otherwise(F.col("_all_sigma")).alias("sigma"))


def outside_share(df: DataFrame, axes: dict[str, tuple[float, float]]) -> DataFrame:
    """Share of rows that lie outside each axis."""
    return df.agg(*[F.avg((~F.col(c).between(low, high)).cast("double")).alias(c) for c, (low, high) in axes.items()])


def sign_check(df: DataFrame, truth: str, predicted: str, residual: str) -> DataFrame:
    """Median distance of the stored residual from truth - predicted, and from its opposite; the first must be the less."""
    diff = F.col(truth) - F.col(predicted)
    both = [quantiles(df, F.abs(x), [0.5]).select(F.col("quantiles")[0].alias(c)) for c, x in (("as_is", diff - F.col(residual)), ("flipped", diff + F.col(residual)))]
    return both[0].crossJoin(F.broadcast(both[1]))


def tail_report(df: DataFrame, value: str, threshold: float) -> DataFrame:
    """Largest value, number above a threshold, and upper percentiles."""
    tops = quantiles(df, F.col(value), [0.99, 0.999]).select(F.col("quantiles")[0].alias("q99"), F.col("quantiles")[1].alias("q999"))
    return df.agg(F.max(value).alias("largest"), F.count_if(F.col(value) > threshold).alias("n_above")).crossJoin(F.broadcast(tops))


def multiplicity(df: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys have each number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_keys"))


def guard(df: DataFrame, **tests: Column) -> None:
    """Raise with the names of tests that don't hold for the whole table."""
    found = df.agg(*[t.alias(k) for k, t in tests.items()]).first().asDict()
    if failed := [k for k, ok in found.items() if not ok]:
        raise ValueError(f"table fails: {', '.join(failed)}")


def resolution_table(df: DataFrame, configs: dict[str, str], truth: str, scale: float = 1e4) -> DataFrame:
    """Median |value - truth| times ``scale`` of each named column, over rows that have a truth."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("config"), F.col(c).cast("double").alias("value")) for k, c in configs.items()]))
    long = df.where(F.col(truth).isNotNull()).select(truth, pairs.alias("x")).where("x.value is not null")
    found = quantiles(long.select("x.config", F.abs(F.col("x.value") - F.col(truth)).alias("_error")), F.col("_error"), [0.5], ["config"])
    return found.select("config", (F.col("quantiles")[0] * scale).alias("median_error"), "n")
