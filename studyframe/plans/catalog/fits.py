"""Queries of the dose-effect curve fits."""

from __future__ import annotations

from pyspark.sql import functions as F


from studyframe.operators import fitting, grids
from studyframe.plans.catalog.reference_sql import query
from studyframe.sources import fixtures as fx


def ec50(spark, d):
    return fitting.ec50_nearest(fx.points(spark, d), ["dataset"]).select(
        "dataset", F.round("ec50", 6).alias("ec50"))


def hill_profile(spark, d):
    out = fitting.hill_profile(fx.points(spark, d), ["dataset"])
    return out.select("dataset", F.round("ec50", 6).alias("ec50"),
                      F.round("hill", 6).alias("hill"), "n", F.round("sigma", 6).alias("sigma"),
                      F.round("m2ll", 6).alias("m2ll"))


def fit_hill(spark, d):
    out = fitting.fit_hill(fx.points(spark, d), ["dataset"])
    return out.select("dataset", F.round("ec50", 6).alias("ec50"),
                      F.round("hill", 6).alias("hill"), "n", F.round("sigma", 5).alias("sigma"),
                      F.round("m2ll", 4).alias("m2ll"))


def predicted_curve(spark, d):
    """Fitted curves over the logarithmic grid."""
    fits = fitting.fit_hill(fx.points(spark, d), ["dataset"])
    out = fitting.predict_curve(fits.select("dataset", "ec50", "hill"), grids.log_grid(spark))
    return out.select("dataset", "k", F.round("Conc", 6).alias("Conc"),
                      F.round("conc_mgl", 6).alias("conc_mgl"), F.round("Eff", 6).alias("Eff"))


def log_grid_effect(spark, d):
    """Typical curve of every dataset's EC50 over the grid (Hill 1)."""
    mids = fitting.ec50_nearest(fx.points(spark, d), ["dataset"]).withColumn("hill", F.lit(1.0))
    out = fitting.predict_curve(mids, grids.log_grid(spark))
    return out.select("dataset", "k", F.round("conc_mgl", 6).alias("conc_mgl"),
                      F.round("Eff", 6).alias("Eff"))


QUERIES = {"ec50": ec50, "hill_profile": hill_profile, "fit_hill": fit_hill,
           "predicted_curve": predicted_curve, "log_grid_effect": log_grid_effect}

_EC50 = """
SELECT dataset, round(c / power(10, floor(log10(c)) - 2)) * power(10, floor(log10(c)) - 2) AS ec50
FROM (SELECT dataset, min(Conc) AS c FROM (SELECT * FROM fx_points QUALIFY abs(Eff - 50) = min(abs(Eff - 50)) OVER (PARTITION BY dataset)) GROUP BY dataset)"""
_REST = """
SELECT p.dataset, e.ec50, Conc, Eff FROM fx_points p JOIN ec e USING (dataset)
QUALIFY abs(Conc - e.ec50) <> min(abs(Conc - e.ec50)) OVER (PARTITION BY p.dataset)"""


def _score(source: str) -> str:
    return f"""
SELECT *, n * ln(2 * pi() * sigma * sigma) + rss / (sigma * sigma) AS m2ll FROM (SELECT *, least(sqrt(rss / n), 9) AS sigma FROM (
  SELECT dataset, ec50, hill, count(*) AS n, sum((Eff - 100 / (1 + power(ec50 / Conc, hill))) ** 2) AS rss
  FROM {source} GROUP BY dataset, ec50, hill))"""


_COARSE = _score("(SELECT rest.*, k * 0.1::DOUBLE AS hill FROM rest CROSS JOIN range(91) g(k))")
_FINE = _score("""(SELECT rest.*, least(greatest(top + (k - 1111) * 0.0001::DOUBLE, 0), 9) AS hill
  FROM rest JOIN (SELECT dataset, arg_min(hill, m2ll) AS top FROM coarse GROUP BY dataset) USING (dataset) CROSS JOIN range(2223) g(k))""")
_BEST = """
SELECT dataset, ec50, round(round(h, 6) * power(10, 2 - floor(log10(h)))) / power(10, 2 - floor(log10(h))) AS hill, n, sigma, m2ll
FROM (SELECT *, hill AS h FROM fine) QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY m2ll, h) = 1"""

ORACLES = {
    "ec50": query("SELECT dataset, round(ec50, 6) AS ec50 FROM ec", "fx_points", ec=_EC50),
    "hill_profile": query("""
SELECT dataset, round(ec50, 6) AS ec50, round(hill, 6) AS hill, n, round(sigma, 6) AS sigma, round(m2ll, 6) AS m2ll FROM coarse""", "fx_points",
                          ec=_EC50, rest=_REST, coarse=_COARSE),
    "fit_hill": query("""
SELECT dataset, round(ec50, 6) AS ec50, round(hill, 6) AS hill, n, round(sigma, 5) AS sigma, round(m2ll, 4) AS m2ll FROM best""", "fx_points",
                      ec=_EC50, rest=_REST, coarse=_COARSE, fine=_FINE, best=_BEST),
    "predicted_curve": query("""
SELECT dataset, k, round(c, 6) AS Conc, round(c * 0.19419, 6) AS conc_mgl, round(100 / (1 + power(ec50 / c, hill)), 6) AS Eff
FROM best CROSS JOIN (SELECT k, power(10, k / 8.0 - 0.65) AS c FROM range(33) g(k))""", "fx_points",
                             ec=_EC50, rest=_REST, coarse=_COARSE, fine=_FINE, best=_BEST),
    "log_grid_effect": query("""
SELECT dataset, k, round(c * 0.19419, 6) AS conc_mgl, round(100 * c / (ec50 + c), 6) AS Eff
FROM ec CROSS JOIN (SELECT k, power(10, k / 8.0 - 0.65) AS c FROM range(33) g(k))""", "fx_points", ec=_EC50),
}
