"""What a refit did to each track, step by step, from recorded columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def refit_trajectory(tracks: DataFrame, hits: DataFrame, keys: list[str], config: Column, angles: bool = True) -> DataFrame:
    """One row a track and step: the fit without the new layers first, then each layer that the refit was fed.

    ``tracks`` have the keys, idx, chi2ZRed, nStubs, refitPerformed, d0, z0, refit_d0, refit_z0, tpD0, tpZ0 (null where no
    particle is matched), phi0 and the event's GenVtx_x, GenVtx_y and GenVtx_z.  ``hits`` have the keys, trackIdx, hit
    (their order), layer, hitAccepted, chi2IncRPhi and chi2IncRZ.  ``config`` is a column of ``tracks`` such as '1100':
    which layers are read out.  Of several accepted hits of a layer the last counts.

    The anchor's chi2 is chi2ZRed times 2 n - 5 (n: stubs, three at least), one degree of freedom at least.  A layer adds
    its r-z increment and one degree, two with ``angles``; the r-phi increments are shown and summed, not folded in.
    Errors are those of d0 and z0 at the first and the last step, against the matched particle or else the event's vertex;
    ``change`` is the percent that the refit moved the error, null where there was next to none.  A track that wasn't
    refit has the first step alone.
    """
    phi = F.col("phi0")
    prompt = F.col("GenVtx_x") * F.sin(phi) - F.col("GenVtx_y") * F.cos(phi)
    degrees = F.greatest(2 * F.greatest(F.col("nStubs"), F.lit(3)) - 5, F.lit(1))
    own = tracks.select(
        *keys, F.col("idx").alias("trackIdx"), config.alias("_config"), "refitPerformed", degrees.alias("_ndof"), (F.col("chi2ZRed") * degrees).alias("_chi2"),
        F.col("d0").alias("_seed_d0"), F.col("z0").alias("_seed_z0"), "refit_d0", "refit_z0",
        F.coalesce("tpD0", prompt).alias("_d0"), F.coalesce("tpZ0", "GenVtx_z").alias("_z0"), F.col("tpD0").isNull().alias("prompt_only"),
    )
    accepted = hits.where("hitAccepted").groupBy(*keys, "trackIdx", "layer").agg(F.max_by(F.struct("chi2IncRPhi", "chi2IncRZ"), "hit").alias("_h"))
    fed = own.where("refitPerformed").join(accepted, [*keys, "trackIdx"]).where(F.substring(F.col("_config"), F.col("layer"), F.lit(1)) == "1")
    steps = fed.select(*own.columns, F.col("layer").cast("int").alias("layer"), F.col("_h.chi2IncRPhi").alias("chi2_rphi"), F.col("_h.chi2IncRZ").alias("chi2_rz"), F.lit(2 if angles else 1).alias("_more"))
    anchors = own.select("*", F.lit(0).alias("layer"), F.lit(0.0).alias("chi2_rphi"), F.lit(0.0).alias("chi2_rz"), F.lit(0).alias("_more"))
    by_track = Window.partitionBy(*keys, "trackIdx").orderBy("layer")
    upto = by_track.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ndof = F.col("_ndof") + F.sum("_more").over(upto)
    rows = anchors.unionByName(steps).withColumns({"step": F.row_number().over(by_track) - 1, "_last": F.count(F.lit(1)).over(Window.partitionBy(*keys, "trackIdx")) - 1})
    rows = rows.withColumns({"ndof": ndof, "cum_rphi": F.sum("chi2_rphi").over(upto), "cum_rz": F.sum("chi2_rz").over(upto)})
    rows = rows.withColumn("reduced_chi2", (F.col("_chi2") + F.col("cum_rz")) / F.col("ndof"))
    moved = (F.col("step") == F.col("_last")) & F.col("refitPerformed")

    def error(name: str) -> Column:
        seed, refit = F.col(f"_seed_{name}") - F.col(f"_{name}"), F.col(f"refit_{name}") - F.col(f"_{name}")
        return F.when(moved & (F.col("step") > 0), refit).when(F.col("step") == 0, seed)

    def change(name: str) -> Column:
        before, after = F.abs(F.col(f"_seed_{name}") - F.col(f"_{name}")), F.abs(F.col(f"refit_{name}") - F.col(f"_{name}"))
        return F.when(moved & (F.col("step") > 0) & (before >= 1e-12), 100 * (after - before) / before)

    label = F.when(F.col("layer") == 0, F.lit("OT L1Track")).otherwise(F.concat(F.lit("after L"), F.col("layer").cast("string")))
    values = {f"{what}_{name}": f(name) for name in ("d0", "z0") for what, f in (("error", error), ("change", change))}
    return rows.select(*keys, "trackIdx", "step", label.alias("label"), "chi2_rphi", "chi2_rz", "cum_rphi", "cum_rz", "ndof", "reduced_chi2", *[c.alias(n) for n, c in values.items()], "prompt_only")
