"""Queries of the percentile tables, distribution summaries and likelihood terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyframe.operators import summaries, vpc
from studyframe.operators.quantiles import exact_quantiles
from studyframe.plans.catalog.reference_sql import query
from studyframe.sources import fixtures as fx

CUTS = vpc.TIME_CUTS


def rounded(df, keys, digits=10):
    """Keys and whole numbers as they are, everything else rounded."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in keys
                       else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c)
                       for c, t in df.dtypes])


def vpc_percentile_bands(spark, d):
    return rounded(vpc.percentile_bands(fx.simulated(spark, d), "P", "time", "TRT", CUTS),
                   ["TRT", "bin"])


def vpc_replicate(spark, d):
    sim = fx.simulated(spark, d).withColumn("bin", vpc.bin_code("time", CUTS))
    return rounded(vpc.vpc_replicate(sim, ["SIM", "TRT", "bin"], "P"), ["SIM", "TRT", "bin"])


def vpc_bands_90(spark, d):
    """Bands of per-hour replicate medians at the 90% level."""
    sim = fx.simulated(spark, d).withColumn("hour", F.floor("time"))
    replicates = vpc.vpc_replicate(sim, ["SIM", "TRT", "hour"], "P")
    return rounded(vpc.vpc_bands(replicates, ["TRT", "hour"], {"med": "median"}, 0.90),
                   ["TRT", "hour"])


def urine_bands(spark, d):
    """Replicate statistics by collection duration instead of clock bins."""
    sim = fx.simulated(spark, d).withColumn("dTIME", F.col("OBS") % 12 + 1)
    replicates = vpc.vpc_replicate(sim, ["SIM", "dTIME", "TRT"], "P")
    return rounded(vpc.vpc_bands(replicates, ["dTIME", "TRT"],
                                 {"med": "median", "p05": "lo90", "p95": "hi90"}),
                   ["dTIME", "TRT"])


def observed_percentiles(spark, d):
    obs = fx.observed(spark, d).withColumn("bin", vpc.bin_code("time", CUTS))
    return rounded(vpc.observed_percentiles(obs, ["TRT", "bin"], "CALAMT"), ["TRT", "bin"])


def plasma_percentile_check(spark, d):
    """Bands and observed percentiles side by side, at each bin's mean time."""
    out = vpc.percentile_check(fx.observed(spark, d), fx.simulated(spark, d), "CALAMT", "P", "time", "TRT", CUTS)
    return rounded(out, ["TRT", "bin"], 9)


def quantile_intervals(spark, d):
    probs = {"lo95": .025, "lo90": .05, "median": .5, "hi90": .95, "hi95": .975}
    return rounded(exact_quantiles(fx.observed(spark, d), ["TRT"], "CALAMT", probs), ["TRT"])


def sim_percentiles(spark, d):
    sim = fx.simulated(spark, d).withColumn("Q", F.col("P") / 2 + F.col("time"))
    return rounded(vpc.sim_percentiles(sim, {"Caffeine": "P", "Paraxanthine": "Q"}),
                   ["SIM", "time", "analyte"])


def long_reshape(spark, d):
    sim = fx.simulated(spark, d)
    long = (sim.select("SIM", "OBS", F.col("P").alias("calcium"), F.col("time").alias("clock"))
            .unpivot(["SIM", "OBS"], ["calcium", "clock"], "analyte", "value"))
    return long.select("SIM", "OBS", "analyte", F.round("value", 6).alias("value"))


def count_by_arm(spark, d):
    return vpc.count_by_arm(fx.observed(spark, d), "TRT", "ID")


def mean_at_time(spark, d):
    return rounded(vpc.mean_at(fx.simulated(spark, d), "time", 12.5, "P", "tick"), [], 6)


def bin_means(spark, d):
    out = vpc.bin_means(fx.observed(spark, d), "time", vpc.TIME_CUTS)
    labels = vpc.bin_means(out, "time", vpc.TIME_CUTS, "label", round_label=True)
    return labels.select("OBS", F.round("bin_mean", 6).alias("bin_mean"),
                         F.round("label", 6).alias("label"))


def nearest_to_half(spark, d):
    return summaries.nearest_to(fx.points(spark, d), ["dataset"], "Eff", 50.0).select(
        "dataset", "Conc", F.round("Eff", 6).alias("Eff"))


def all_but_nearest(spark, d):
    out = summaries.nearest_to(fx.points(spark, d), ["dataset"], "Conc", 30.0, complement=True)
    return out.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"),
                                      F.round(F.sum("Conc"), 6).alias("sum_conc"))


def gaussian_m2ll(spark, d):
    rows = fx.observed(spark, d).join(fx.predicted(spark, d).select("OBS", "P_PRED"), "OBS")
    y, f = F.col("CALAMT"), F.col("P_PRED")
    return rows.groupBy("TRT").agg(
        F.round(summaries.gaussian_m2ll(y, f, 30.0), 6).alias("m2ll"),
        F.round(summaries.log_gaussian_m2ll(y, f, 0.76), 6).alias("log_m2ll"))


def box_stats(spark, d):
    return rounded(summaries.box_stats(fx.observed(spark, d), ["TRT"], "CALAMT"), ["TRT"])


def box_stats_log10(spark, d):
    return rounded(summaries.box_stats(fx.observed(spark, d), ["TRT"], "CALAMT", log10=True),
                   ["TRT"], 9)


def dot_counts(spark, d):
    return rounded(summaries.dot_counts(fx.observed(spark, d), ["TRT"], "CALAMT"), ["TRT"], 6)


QUERIES = {
    "vpc_percentile_bands": vpc_percentile_bands, "vpc_replicate": vpc_replicate,
    "vpc_bands_90": vpc_bands_90, "urine_bands": urine_bands,
    "observed_percentiles": observed_percentiles, "quantile_intervals": quantile_intervals,
    "sim_percentiles": sim_percentiles, "long_reshape": long_reshape,
    "count_by_arm": count_by_arm, "mean_at_time": mean_at_time, "bin_means": bin_means,
    "nearest_to_half": nearest_to_half, "all_but_nearest": all_but_nearest,
    "gaussian_m2ll": gaussian_m2ll, "box_stats": box_stats, "box_stats_log10": box_stats_log10,
    "dot_counts": dot_counts, "plasma_percentile_check": plasma_percentile_check,
}

_BIN = """CASE WHEN time < 2 THEN 1 WHEN time < 5 THEN 2 WHEN time < 8 THEN 3 WHEN time < 12 THEN 4
  WHEN time < 26 THEN 5 WHEN time < 29 THEN 6 WHEN time < 32 THEN 7 WHEN time < 35 THEN 8 ELSE 9 END::BIGINT"""


def _three(value: str) -> str:
    return (f"quantile_cont({value}, 0.5) AS median, quantile_cont({value}, 0.05) AS lo90, "
            f"quantile_cont({value}, 0.95) AS hi90, count({value}) AS n")


_ROUND_THREE = "round(median, 10) AS median, round(lo90, 10) AS lo90, round(hi90, 10) AS hi90, n"


def _band(prefix: str, column: str, tail: float) -> str:
    return ", ".join(f"round(quantile_cont({column}, {p}), 10) AS {prefix}_{part}"
                     for part, p in (("mid", 0.5), ("lo", tail), ("hi", 1 - tail)))


def _box(value: str, where: str, digits: int) -> str:
    return f"""
SELECT q.TRT, round(any_value(q1), {digits}) AS q1, round(any_value(median), {digits}) AS median, round(any_value(q3), {digits}) AS q3, any_value(n) AS n,
  round(min(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), {digits}) AS whisker_lo,
  round(max(CASE WHEN v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN v END), {digits}) AS whisker_hi,
  count(*) FILTER (WHERE v NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM (SELECT TRT, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, count(*) AS n FROM x GROUP BY TRT) q
JOIN x ON x.TRT = q.TRT GROUP BY q.TRT"""


ORACLES = {
    "vpc_percentile_bands": query(f"""
SELECT TRT, bin, {_band('med', 'median', 0.025)}, {_band('p05', 'lo90', 0.025)}, {_band('p95', 'hi90', 0.025)}, count(*) AS n_sim
FROM (SELECT SIM, TRT, bin, {_three('P')} FROM (SELECT *, {_BIN} AS bin FROM fx_sim) GROUP BY SIM, TRT, bin) GROUP BY TRT, bin""", "fx_sim"),
    "vpc_replicate": query(f"""
SELECT SIM, TRT, bin, {_ROUND_THREE} FROM (SELECT SIM, TRT, bin, {_three('P')} FROM (SELECT *, {_BIN} AS bin FROM fx_sim) GROUP BY SIM, TRT, bin)""", "fx_sim"),
    "vpc_bands_90": query(f"""
SELECT TRT, hour, {_band('med', 'median', 0.05)}, count(*) AS n_sim
FROM (SELECT SIM, TRT, floor(time)::BIGINT AS hour, {_three('P')} FROM fx_sim GROUP BY SIM, TRT, floor(time)::BIGINT) GROUP BY TRT, hour""", "fx_sim"),
    "urine_bands": query(f"""
SELECT dTIME, TRT, {_band('med', 'median', 0.025)}, {_band('p05', 'lo90', 0.025)}, {_band('p95', 'hi90', 0.025)}, count(*) AS n_sim
FROM (SELECT SIM, OBS % 12 + 1 AS dTIME, TRT, {_three('P')} FROM fx_sim GROUP BY SIM, OBS % 12 + 1, TRT) GROUP BY dTIME, TRT""", "fx_sim"),
    "observed_percentiles": query(f"""
SELECT TRT, bin, {_ROUND_THREE} FROM (SELECT TRT, bin, {_three('CALAMT')} FROM (SELECT *, {_BIN} AS bin FROM fx_obs) GROUP BY TRT, bin)""", "fx_obs"),
    "plasma_percentile_check": query(f"""
SELECT TRT, bin, {_band('med', 'median', 0.025)}, {_band('p05', 'lo90', 0.025)}, {_band('p95', 'hi90', 0.025)}, count(*) AS n_sim,
  any_value(o.obs_median) AS obs_median, any_value(o.obs_p05) AS obs_p05, any_value(o.obs_p95) AS obs_p95, any_value(o.n_obs) AS n_obs, any_value(t.bin_time) AS bin_time
FROM (SELECT SIM, TRT, bin, {_three('P')} FROM (SELECT *, {_BIN} AS bin FROM fx_sim) GROUP BY SIM, TRT, bin)
JOIN (SELECT TRT, bin, round(median, 9) AS obs_median, round(lo90, 9) AS obs_p05, round(hi90, 9) AS obs_p95, n AS n_obs
  FROM (SELECT TRT, bin, {_three('CALAMT')} FROM (SELECT *, {_BIN} AS bin FROM fx_obs) GROUP BY TRT, bin)) o USING (TRT, bin)
JOIN (SELECT bin, round(avg(time), 9) AS bin_time FROM (SELECT *, {_BIN} AS bin FROM fx_obs) GROUP BY bin) t USING (bin) GROUP BY TRT, bin""".replace(", 10)", ", 9)"), "fx_sim", "fx_obs"),
    "quantile_intervals": query("SELECT TRT, " + ", ".join(
        f"round(quantile_cont(CALAMT, {p}), 10) AS {n}" for n, p in
        (("lo95", .025), ("lo90", .05), ("median", .5), ("hi90", .95), ("hi95", .975)))
        + ", count(CALAMT) AS n FROM fx_obs GROUP BY TRT", "fx_obs"),
    "sim_percentiles": query(f"""
SELECT SIM, time, analyte, {_ROUND_THREE} FROM (SELECT SIM, time, analyte, {_three('v')} FROM (
  SELECT SIM, time, 'Caffeine' AS analyte, P AS v FROM fx_sim UNION ALL SELECT SIM, time, 'Paraxanthine', P / 2 + time FROM fx_sim)
GROUP BY SIM, time, analyte)""", "fx_sim"),
    "long_reshape": query("""
SELECT SIM, OBS, 'calcium' AS analyte, round(P, 6) AS value FROM fx_sim
UNION ALL SELECT SIM, OBS, 'clock', round(time, 6) FROM fx_sim""", "fx_sim"),
    "count_by_arm": query(
        "SELECT TRT, count(*) AS n_rows, count(DISTINCT ID) AS n_subjects FROM fx_obs GROUP BY TRT",
        "fx_obs"),
    "mean_at_time": query("""
SELECT round(avg(P), 6) AS mean_P, round(avg(tick), 6) AS mean_tick FROM fx_sim WHERE time = 12.5""", "fx_sim"),
    "bin_means": query(f"""
SELECT OBS, round(m, 6) AS bin_mean, round(CASE WHEN m = 0 THEN 0 ELSE round(m / power(10, floor(log10(m)) - 2)) * power(10, floor(log10(m)) - 2) END, 6) AS label
FROM (SELECT OBS, avg(time) OVER (PARTITION BY {_BIN}) AS m FROM fx_obs)""", "fx_obs"),
    "nearest_to_half": query("""
SELECT dataset, Conc, round(Eff, 6) AS Eff FROM fx_points
QUALIFY abs(Eff - 50) = min(abs(Eff - 50)) OVER (PARTITION BY dataset)""", "fx_points"),
    "all_but_nearest": query("""
SELECT dataset, count(*) AS n, round(sum(Conc), 6) AS sum_conc FROM (SELECT * FROM fx_points
QUALIFY abs(Conc - 30) <> min(abs(Conc - 30)) OVER (PARTITION BY dataset)) GROUP BY dataset""", "fx_points"),
    "gaussian_m2ll": query("""
SELECT TRT, round(-2 * sum(-0.5 * ln(2 * pi()) - ln(30) - (CALAMT - P_PRED) ** 2 / (2 * 30.0 ** 2)), 6) AS m2ll,
  round(-2 * sum(CASE WHEN CALAMT > 0 THEN -0.5 * ln(2 * pi()) - ln(0.76) - (ln(CASE WHEN CALAMT > 0 THEN CALAMT END) - ln(P_PRED)) ** 2 / (2 * 0.76 ** 2) END), 6) AS log_m2ll
FROM fx_obs JOIN fx_pred USING (OBS) GROUP BY TRT""", "fx_obs", "fx_pred"),
    "box_stats": query(_box("CALAMT", "TRUE", 10), "fx_obs",
                       x="SELECT TRT, CALAMT AS v FROM fx_obs WHERE CALAMT IS NOT NULL"),
    "box_stats_log10": query(
        _box("CALAMT", "TRUE", 9), "fx_obs",
        x="SELECT TRT, log10(CASE WHEN CALAMT > 0 THEN CALAMT END) AS v FROM fx_obs WHERE CALAMT > 0"),
    "dot_counts": query("""
SELECT TRT, b AS bin, round(lo + (b + 0.5) * w, 6) AS center, count(*) AS n
FROM (SELECT TRT, lo, (hi - lo) / 30 AS w, least(floor((CALAMT - lo) / ((hi - lo) / 30)), 29)::BIGINT AS b
      FROM fx_obs CROSS JOIN (SELECT min(CALAMT) AS lo, max(CALAMT) AS hi FROM fx_obs)) GROUP BY TRT, b, lo, w""", "fx_obs"),
}
