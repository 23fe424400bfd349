"""Dose-effect curve fits by grid refinement, one fit per dataset in parallel."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.functions.responses import sigmoid_emax, signif, um_to_mgl
from studyframe.operators.grouping import join_on
from studyframe.operators.summaries import nearest_to
from studyframe.session import cut_lineage

# Full effect (percent), half effect and the bounds of hill and sigma.
EMAX, HALF_EFFECT = 100.0, 50.0
UPPER = 9.0
COARSE_STEP, COARSE_POINTS = 0.1, 90
REFINE = 10  # points each side of the best one in every finer pass


def ec50_nearest(points: DataFrame, keys: list[str]) -> DataFrame:
    """Concentration whose effect is nearest to half (3 digits; the lowest of ties)."""
    return (nearest_to(points, keys, "Eff", HALF_EFFECT).groupBy(*keys)
            .agg(signif(F.min("Conc"), 3).alias("ec50")))


def _scores(collapsed: DataFrame, keys: list[str]) -> DataFrame:
    """-2 log-likelihood at each hill of the grid, with sigma at its best value."""
    resid = F.col("_y") - sigmoid_emax(F.col("Conc"), EMAX, F.col("ec50"), F.col("hill"))
    rss = (collapsed.groupBy(*keys, "ec50", "hill")
           .agg(F.sum(F.col("_c") * (F.col("_var") + resid * resid)).alias("rss"),
                F.sum("_c").alias("n")))
    sigma = F.least(F.sqrt(F.col("rss") / F.col("n")), F.lit(UPPER))
    m2ll = (F.col("n") * F.ln(2 * math.pi * F.col("sigma") * F.col("sigma"))
            + F.col("rss") / (F.col("sigma") * F.col("sigma")))
    return rss.withColumn("sigma", sigma).withColumn("m2ll", m2ll)


def _best(scored: DataFrame, keys: list[str]) -> DataFrame:
    # a perfect fit has no likelihood (log of zero): least squares decides then
    rank = F.struct(F.coalesce(F.col("m2ll"), F.lit(float("-inf"))), F.col("rss"), F.col("hill"))
    row = F.struct("ec50", "hill", "sigma", "m2ll", "n")
    return scored.groupBy(*keys).agg(F.min_by(row, rank).alias("_b")).select(*keys, "_b.*")


def without_half_point(points: DataFrame, keys: list[str]) -> DataFrame:
    """Join EC50 and drop the points at the concentration nearest to it."""
    joined = join_on(points, ec50_nearest(points, keys), keys)
    return nearest_to(joined, keys, "Conc", F.col("ec50"), complement=True)


def hill_profile(points: DataFrame, keys: list[str]) -> DataFrame:
    """Objective over the coarse hill grid (every dataset x grid point)."""
    return _profile(_collapsed(points, keys), keys)


def _profile(collapsed: DataFrame, keys: list[str]) -> DataFrame:
    gridded = collapsed.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(COARSE_POINTS))))
    return _scores(gridded.withColumn("hill", F.col("_k") * F.lit(COARSE_STEP)), keys)


def _collapsed(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row per concentration: the grids multiply this, not the raw points."""
    return (without_half_point(points, keys)
            .filter(F.col("Conc").isNotNull() & F.col("Eff").isNotNull())
            .groupBy(*keys, "ec50", "Conc")
            .agg(F.count(F.lit(1)).alias("_c"), F.avg("Eff").alias("_y"),
                 F.var_pop("Eff").alias("_var")))


def fit_hill(points: DataFrame, keys: list[str], passes: int = 3) -> DataFrame:
    """Per dataset: ec50, hill (3 digits), sigma and -2 log-likelihood.

    A coarse grid over [0, 9] is refined around its best point, ten times finer in every
    pass.
    """
    # read in every pass: written once
    data = cut_lineage(_collapsed(points, keys))
    best = _best(_profile(data, keys), keys)
    step = COARSE_STEP
    for _ in range(passes):
        step = step / REFINE
        offsets = F.array(*[F.lit(i * step) for i in range(-REFINE, REFINE + 1)])
        near = (join_on(data, best.select(*keys, F.col("hill").alias("_mid")), keys)
                # clamping may repeat a bound; repeated points would be counted twice
                .withColumn("hill", F.explode(F.array_distinct(F.transform(
                    offsets, lambda o: F.least(F.greatest(F.col("_mid") + o, F.lit(0.0)),
                                               F.lit(UPPER)))))))
        best = cut_lineage(_best(_scores(near.drop("_mid"), keys), keys))
    return best.withColumn("hill", signif(F.round("hill", 6), 3))


def predict_curve(fits: DataFrame, grid: DataFrame) -> DataFrame:
    """Fitted effect of every dataset over a short concentration grid, also in mg/L."""
    steps = (grid.agg(F.sort_array(F.collect_list(F.struct("k", "Conc"))).alias("_grid"))
             .withColumn("_one", F.lit(1)))
    # one row, joined on a constant key: the grid is the caller's short list
    return (fits.withColumn("_one", F.lit(1)).join(F.broadcast(steps), "_one").drop("_one")
            .withColumn("_g", F.explode("_grid"))
            .withColumns({"k": F.col("_g.k"), "Conc": F.col("_g.Conc")})
            .withColumns({"Eff": sigmoid_emax(F.col("Conc"), EMAX, F.col("ec50"), F.col("hill")),
                          "conc_mgl": um_to_mgl(F.col("Conc"))})
            .drop("_g", "_grid"))
