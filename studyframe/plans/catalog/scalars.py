"""Queries of the scalar functions: covariates, responses, parameters, residuals."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyframe.functions import covariates, models, responses
from studyframe.operators import population
from studyframe.operators.grouping import attach_few, first_place
from studyframe.operators.summaries import apply_scale_limits
from studyframe.plans.catalog.reference_sql import query
from studyframe.sources import fixtures as fx


def fixed_etas(ids, count):
    """ETAs as a fixed function of the id, so that any engine can compute them."""
    return ids.withColumns({f"ETA{n}": ((F.col("ID") * (7 + n)) % 41 - 20) / 50.0
                            for n in range(1, count + 1)})


def eta_sql(n: int) -> str:
    return f"((ID * {7 + n}) % 41 - 20) / 50.0"


def body_size(spark, d):
    s = fx.subjects(spark, d)
    c = F.col
    return s.select(
        "ID", F.round(covariates.ckdepi(c("secr"), c("age"), c("sex"), c("black")), 6).alias("egfr"),
        F.round(covariates.ckdepi(c("secr") / 88.4, c("age"), c("sex"), c("black"), mgdl=True), 6)
        .alias("egfr_mgdl"),
        F.round(covariates.bmi(c("wt"), c("ht")), 6).alias("bmi"),
        F.round(covariates.bsa(c("wt"), c("ht")), 6).alias("bsa"))


def emax_effects(spark, d):
    conc = F.col("Conc")
    return fx.points(spark, d).select(
        "dataset", "Conc", F.round("Eff", 6).alias("Eff"),
        F.round(responses.sigmoid_emax(conc, 100, 30, 1.2), 6).alias("sigmoid"),
        F.round(responses.emax_inhibition(conc, 0.446), 6).alias("left"),
        F.round(responses.um_to_mgl(conc), 9).alias("mgl"),
        F.round(responses.ug_to_pmol(conc), 6).alias("pmol"),
        F.round(responses.gfr_to_ml_min(conc), 6).alias("ml_min"),
        F.round(responses.gfr_to_l_h(conc), 6).alias("l_h"))


def significant_digits(spark, d):
    value = F.col("value") * 1.2345678 * F.pow(F.lit(10.0), F.col("event_id") % 7 - 3)
    return fx.table(spark, d, "events").select(
        "event_id", F.round(responses.signif(value, 3), 9).alias("signif3"))


def params_oral(spark, d):
    people = fixed_etas(fx.subjects(spark, d).select("ID"), 11)
    out = population.individual_params(people, models.ORAL_ABSTINENT)
    return out.select("ID", *[F.round(p, 6).alias(p) for p in models.ORAL_ABSTINENT.typical])


def params_inhaled(spark, d):
    people = fixed_etas(fx.subjects(spark, d).select("ID"), 6)
    out = population.individual_params(people, models.INHALED)
    return out.select("ID", *[F.round(p, 8).alias(p) for p in models.INHALED.typical])


def initial_amounts(spark, d):
    people = fixed_etas(fx.subjects(spark, d).select("ID"), 11)
    full = population.initial_amounts(people, models.ORAL_HABITUAL)
    empty = population.initial_amounts(full.withColumnsRenamed(
        {f"{c}_0": f"{c}_init" for c in models.ORAL_HABITUAL.initial}), models.GUM, empty=True)
    return empty.select("ID", *[F.round(f"{c}_{k}", 6).alias(f"{c}_{k}")
                                for c in models.ORAL_HABITUAL.initial for k in ("init", "0")])


def residual_errors(spark, d):
    eps = (F.col("OBS") % 19 - 9) / 20.0
    pred = F.col("CALAMT")
    return fx.observed(spark, d).select(
        "OBS", F.round(responses.proportional_error(pred, eps, 0.05), 6).alias("DVCA"),
        F.round(responses.exponential_error(pred, eps), 6).alias("DVEX"))


def derived_responses(spark, d):
    """Percent of the subject's first value, concentrations, ratios and totals."""
    rows = fx.simulated(spark, d)
    based = attach_few(rows, ["SIM", "ID"], P_0=F.min_by("P", first_place("tick", "OBS")))
    return based.select(
        "SIM", "OBS", F.round(responses.percent_of(F.col("P"), F.col("P_0")), 8).alias("CAchange"),
        F.round(responses.concentration(F.col("P"), F.lit(responses.PLASMA_VOLUME_L)), 9).alias("CaC"),
        F.round(responses.pm_to_pgml(F.col("P") / 14), 9).alias("PTHc"),
        F.round(F.col("P") / F.nullif(F.col("P_0"), F.lit(0.0)), 9).alias("OCfrac"),
        F.round(F.col("P") + F.col("P_0"), 9).alias("OBtot"))


def residuals(spark, d):
    joined = fx.observed(spark, d).join(fx.predicted(spark, d).select("OBS", "P_PRED"), "OBS")
    y, f = F.col("CALAMT"), F.col("P_PRED")
    return joined.select("OBS", "TRT", F.round(responses.residual(y, f), 6).alias("RES"),
                         F.round(responses.log_residual(y, f), 6).alias("logRES"))


def prediction_corrected(spark, d):
    pred = fx.predicted(spark, d).select("OBS", "P_PRED")
    joined = fx.simulated(spark, d).join(pred, "OBS")
    pred_or_zero = F.when(F.col("OBS") % 50 == 0, 0.0).otherwise(F.col("P_PRED"))
    return joined.select("OBS", "SIM", F.round(
        responses.prediction_correct(F.col("P"), 19.7364519 + 0.4371293 * F.col("time"),
                                     pred_or_zero), 6)
        .alias("pcY"))


def scale_limits(spark, d):
    joined = fx.observed(spark, d).join(fx.predicted(spark, d).select("OBS", "P_PRED"), "OBS")
    rows = joined.withColumn("RES", F.col("CALAMT") - F.col("P_PRED"))
    kept = apply_scale_limits(rows, "RES", -5, 5).select("OBS", F.lit("RES").alias("axis"),
                                                        F.col("RES").alias("v"))
    logged = apply_scale_limits(rows, "CALAMT", 1, 100, log10=True).select(
        "OBS", F.lit("CALAMT").alias("axis"), F.col("CALAMT").alias("v"))
    return kept.unionByName(logged).select("OBS", "axis", F.round("v", 6).alias("v"))


QUERIES = {
    "body_size": body_size, "emax_effects": emax_effects,
    "significant_digits": significant_digits, "params_oral": params_oral,
    "params_inhaled": params_inhaled, "initial_amounts": initial_amounts,
    "residual_errors": residual_errors, "derived_responses": derived_responses,
    "residuals": residuals, "prediction_corrected": prediction_corrected,
    "scale_limits": scale_limits,
}

_ORAL = [("KA", 3.65, 1), ("K12", 1.71, 2), ("K21", 2.02, 3), ("V1", 31.2, 4), ("V2", 24.4, 5),
         ("TLAG", 0.15, 6), ("CLCAPX", 2.73, 7), ("CLCAO", 4.86, 8), ("CLPX", 3.81, 9)]
_EGFR = """round(141 * power(least({s} / k, 1), a) * power(greatest({s} / k, 1), -1.209) * power(0.993, age)
  * power(1.018, 1 - sex) * power(1.159, black), 6)"""

ORACLES = {
    "body_size": query(f"""
SELECT ID, {_EGFR.format(s='(secr / 88.4)')} AS egfr, {_EGFR.format(s='(secr / 88.4)')} AS egfr_mgdl,
  round(wt / ((ht / 100) * (ht / 100)), 6) AS bmi, round(0.007184 * power(ht, 0.725) * power(wt, 0.425), 6) AS bsa
FROM (SELECT *, CASE sex WHEN 1 THEN 0.9 ELSE 0.7 END::DOUBLE AS k, CASE sex WHEN 1 THEN -0.411 ELSE -0.329 END::DOUBLE AS a FROM fx_subject)""", "fx_subject"),
    "emax_effects": query("""
SELECT dataset, Conc, round(Eff, 6) AS Eff, round(100 / (1 + power(30 / Conc, 1.2)), 6) AS sigmoid,
  round(1 - 0.446 * Conc / (Conc + 5.8257), 6) AS "left", round(Conc * 0.19419, 9) AS mgl, round(Conc * 1e6 / 4117.8, 6) AS pmol,
  round(Conc * 16.667, 6) AS ml_min, round(Conc / 16.667, 6) AS l_h FROM fx_points""", "fx_points"),
    "significant_digits": """
SELECT event_id, round(CASE WHEN v = 0 THEN 0.0 ELSE round(v / power(10, e)) * power(10, e) END, 9) AS signif3
FROM (SELECT event_id, v, CASE WHEN v = 0 THEN 0 ELSE floor(log10(abs(nullif(v, 0)))) - 2 END AS e
      FROM (SELECT event_id, value * 1.2345678::DOUBLE * power(10, event_id % 7 - 3) AS v FROM events))""",
    "params_oral": query("SELECT ID, " + ", ".join(
        f"round({tv} * exp({eta_sql(n)}), 6) AS {p}" for p, tv, n in _ORAL) + " FROM fx_subject",
        "fx_subject"),
    "params_inhaled": query(f"""
SELECT ID, round(3.55 * exp({eta_sql(1)}), 8) AS KA, round(0.6 * 76.2 * exp({eta_sql(2)}), 8) AS V1, round(0.6 * 8.37 * exp({eta_sql(3)}), 8) AS CL,
  round(0.6 * 214, 8)::DOUBLE AS V2, round(0.6 * 9.74, 8)::DOUBLE AS Q, round(0.0288 * exp({eta_sql(4)}), 8) AS FPX, 0.308::DOUBLE AS KPX,
  round(0.00342 * exp({eta_sql(5)}), 8) AS FTP, 0.313::DOUBLE AS KTP, round(0.00537 * exp({eta_sql(6)}), 8) AS FTB, 0.117::DOUBLE AS KTB
FROM fx_subject""", "fx_subject"),
    "initial_amounts": query(f"""
SELECT ID, 1.18::DOUBLE AS GUT_init, 0.0::DOUBLE AS GUT_0, round(3.40 * exp({eta_sql(10)}), 6) AS CENT_init, 0.0::DOUBLE AS CENT_0,
  1.21::DOUBLE AS PERI_init, 0.0::DOUBLE AS PERI_0, round(6.93 * exp({eta_sql(11)}), 6) AS PARA_init, 0.0::DOUBLE AS PARA_0 FROM fx_subject""", "fx_subject"),
    "residual_errors": query("""
SELECT OBS, round(CALAMT * (1 + (OBS % 19 - 9) / 20.0) + 0.05, 6) AS DVCA, round(CALAMT * exp((OBS % 19 - 9) / 20.0), 6) AS DVEX FROM fx_obs""", "fx_obs"),
    "derived_responses": query("""
SELECT SIM, OBS, round(100 * P / nullif(P_0, 0), 8) AS CAchange, round(P / 14, 9) AS CaC, round(P / 14 * 9.4, 9) AS PTHc,
  round(P / nullif(P_0, 0), 9) AS OCfrac, round(P + P_0, 9) AS OBtot
FROM (SELECT *, first_value(P) OVER (PARTITION BY SIM, ID ORDER BY tick, OBS) AS P_0 FROM fx_sim)""", "fx_sim"),
    "residuals": query("""
SELECT OBS, TRT, round(CALAMT - P_PRED, 6) AS RES, round(CASE WHEN CALAMT > 0 THEN ln(CASE WHEN CALAMT > 0 THEN CALAMT END) - ln(P_PRED) END, 6) AS logRES
FROM fx_obs JOIN fx_pred USING (OBS)""", "fx_obs", "fx_pred"),
    "prediction_corrected": query("""
SELECT OBS, SIM, round(s.P * (19.7364519 + 0.4371293 * s.time) / nullif(CASE WHEN OBS % 50 = 0 THEN 0 ELSE P_PRED END, 0), 6) AS pcY
FROM fx_sim s JOIN fx_pred USING (OBS)""", "fx_sim", "fx_pred"),
    "scale_limits": query("""
SELECT OBS, 'RES' AS axis, round(CALAMT - P_PRED, 6) AS v FROM fx_obs JOIN fx_pred USING (OBS) WHERE CALAMT - P_PRED BETWEEN -5 AND 5
UNION ALL SELECT OBS, 'CALAMT', round(log10(CASE WHEN CALAMT > 0 THEN CALAMT END), 6) FROM fx_obs WHERE CALAMT BETWEEN 1 AND 100""", "fx_obs", "fx_pred"),
}
