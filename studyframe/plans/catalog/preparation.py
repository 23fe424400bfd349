"""Queries of the event-table work: sources, grids, corrections, keys, joins, sorts."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyframe.functions.clock import minus_months
from studyframe.operators import attach, events, grids
from studyframe.operators.grouping import attach_group, first_per
from studyframe.operators.quantiles import exact_quantiles
from studyframe.operators.vpc import MEDIAN_90
from studyframe.plans import study_events
from studyframe.plans.catalog.reference_sql import query
from studyframe.session import scratch_path
from studyframe.sources import fixtures as fx
from studyframe.sources import study

NSIM = 4


def _obs(spark, d):
    return study_events.observations(fx.study(spark, d))


def _events(spark, d):
    return study_events.build_event_table(fx.study(spark, d), ordered=False)


EVENT_COLUMNS = ["ID", "ID_ORIG", "TRT", "MAT", "SAMPLE", "cmt", "evid", "rate", "time", "amt",
                 "TIMEEND", "dTIME", "CALAMT", "GFR_0", "P_0"]


def event_columns(df, columns=EVENT_COLUMNS):
    """Shared output form of event rows: long codes and rounded hours and amounts."""
    out = []
    for c in columns:
        if c in ("ID", "ID_ORIG", "SAMPLE", "cmt", "evid", "rate", "SIM", "pair", "cycle"):
            out.append(F.col(c).cast("long").alias(c))
        elif c in ("TRT", "MAT", "scenario"):
            out.append(F.col(c))
        else:
            out.append(F.round(F.col(c).cast("double"), 10).alias(c))
    return df.select(*out)


def event_sql(columns=EVENT_COLUMNS):
    out = []
    for c in columns:
        if c in ("ID", "ID_ORIG", "SAMPLE", "cmt", "evid", "rate", "SIM", "pair", "cycle"):
            out.append(f"{c}::BIGINT AS {c}")
        elif c in ("TRT", "MAT", "scenario"):
            out.append(c)
        else:
            out.append(f"round({c}::DOUBLE, 10) AS {c}")
    return ", ".join(out)


def study_sheet(spark, d):
    """Write the sheet as CSV with its missing token, read it back with the fixed schema."""
    path = scratch_path(spark, "sheet")
    sheet = fx.study(spark, d).withColumnRenamed("ID_ORIG", "ID").select(
        *[F.coalesce(F.col(f.name).cast("string"), F.lit(study.MISSING)).alias(f.name)
          for f in study.STUDY_SCHEMA])
    sheet.write.option("header", True).csv(path)
    back = study.read_study(spark, path)
    return back.groupBy("TRT", "MAT").agg(
        F.count(F.lit(1)).alias("n"), F.count("DATST").alias("n_datst"),
        F.count("VOL").alias("n_vol"), F.count("CAL").alias("n_cal"),
        F.count("CRCL").alias("n_crcl"), F.round(F.sum("CAL"), 6).alias("sum_cal"),
        F.round(F.sum("SAMPLE"), 6).alias("sum_sample"), F.max("DATEN").alias("last_end"))


def dose_points(spark, d):
    path = scratch_path(spark, "points")
    fx.points(spark, d).select("Conc", "Eff").write.csv(path)
    return study.read_points(spark, path).groupBy("Conc").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("Eff"), 6).alias("mean_eff"))


def result_handoff(spark, d):
    """Persist replicate statistics by SIM; a later job reads them."""
    path = scratch_path(spark, "replicates")
    stats = exact_quantiles(fx.simulated(spark, d), ["SIM", "TRT"], "P", MEDIAN_90)
    study.write_result(stats, path)
    return (study.read_result(spark, path)
            .select(F.col("SIM").cast("long").alias("SIM"), "TRT",
                    *[F.round(c, 10).alias(c) for c in MEDIAN_90], "n"))


def time_grid(spark, d):
    return event_columns(grids.time_grid(fx.subjects(spark, d).select("ID"), 0, 48, 0.5),
                         ["ID", "time", "amt", "evid", "rate", "cmt"])


def regimen_grid(spark, d):
    grid = grids.regimen_grid(fx.subjects(spark, d).select("ID"),
                              [0, 0.5, 1, 1.5, 2, 4, 6, 8, 10, 24], [0, 24], 100, 25, 30)
    return event_columns(grid, ["ID", "time", "amt", "evid", "rate", "cmt", "SIM"])


def expand_doses(spark, d):
    out = grids.expand_doses(fx.subjects(spark, d).select("ID"), [20, 40], 24, 10)
    return out.select("ID", "amt", "dose_no", "time", F.col("evid").cast("long").alias("evid"))


def replicate_study(spark, d):
    obs = _obs(spark, d)
    n = fx.study(spark, d).select("ID_ORIG").distinct().count()
    return event_columns(grids.replicate_subjects(obs, NSIM, n),
                         ["ID", "ID_ORIG", "SIM", "SAMPLE", "time", "CALAMT"])


def month_correction(spark, d):
    raw = fx.study(spark, d)
    wrong = (F.col("ID_ORIG") % 3 == 0) & (F.col("SAMPLE") % 5 == 0)
    out = events.correct_where(raw, wrong, "DATST", minus_months(F.col("DATST"), 1))
    return out.select("ID_ORIG", "SAMPLE", "DATST")


def subject_clock(spark, d):
    out = events.subject_clock(fx.study(spark, d), "ID_ORIG")
    return event_columns(out, ["ID_ORIG", "SAMPLE", "time", "TIMEEND", "dTIME"])


def event_codes(spark, d):
    out = events.recode_arm(events.with_amounts(events.code_events(fx.study(spark, d))))
    back = events.label_arm(out.withColumn("ARM", F.col("TRT")), "ARM")
    return back.select("SAMPLE", F.col("TRT").cast("long").alias("TRT"), "ARM",
                       F.col("cmt").cast("long").alias("cmt"), "amt",
                       F.col("evid").cast("long").alias("evid"),
                       F.col("rate").cast("long").alias("rate"),
                       F.round("CALAMT", 10).alias("CALAMT"))


def blank_and_set(spark, d):
    out = events.blank_columns(fx.study(spark, d), ["VOL", "CAL", "DATEN"])
    out = events.set_columns(out, ["SOD", "NACL"], 1.5)
    return out.select("SAMPLE", "VOL", "CAL", "DATEN", "SOD", "NACL", "CACL")


def rename_pattern(spark, d):
    raw = fx.subjects(spark, d).select("ID", F.col("wt").alias("V1_eta"),
                                       F.col("ht").alias("V2_eta"), F.col("age").alias("V10_eta"))
    return events.rename_pattern(raw, "ETA", {"ETA10": "CENT_0"})


def filter_plasma(spark, d):
    return event_columns(events.where_plasma(_events(spark, d)), ["ID", "SAMPLE", "time", "CALAMT"])


def filter_urine_ends(spark, d):
    return event_columns(events.where_urine(_events(spark, d), ended=True),
                         ["ID", "SAMPLE", "time", "CALAMT"])


def filter_arm_not_negative(spark, d):
    sim = fx.simulated(spark, d).withColumn("pcY", F.col("P") - 1)
    kept = events.where_not_negative(events.where_arm(sim, "Caffeine"), "pcY")
    return kept.groupBy("SIM").agg(F.count(F.lit(1)).alias("n"),
                                   F.round(F.sum("pcY"), 6).alias("total"))


def select_rename(spark, d):
    out = events.select_rename(fx.predicted(spark, d), "ID_ORIG", "OBS", PRED="P_PRED",
                               TIME="time")
    return out.withColumn("PRED", F.round("PRED", 10))


def capped_gfr(spark, d):
    return fx.study(spark, d).groupBy("ID_ORIG").agg(
        F.round(events.capped_mean("CRCL", events.GFR_CAP), 9).alias("GFR_0"))


def first_per_subject(spark, d):
    out = first_per(fx.study(spark, d), ["ID_ORIG"],
                    [F.asc_nulls_last("DATST"), F.asc_nulls_last("SAMPLE")])
    return out.select("ID_ORIG", "TRT", "SAMPLE", "DATST")


def baseline_first(spark, d):
    out = events.baseline_first(events.with_amounts(fx.study(spark, d)), "ID_ORIG")
    return out.select("ID_ORIG", F.round("P_0", 9).alias("P_0"))


def rekey(spark, d):
    out = events.rekey(fx.study(spark, d), "ID_ORIG")
    return out.select("ID_ORIG", "SAMPLE", "ID")


def cycle_index(spark, d):
    ends = events.urine_ends(_obs(spark, d))
    out = attach.cycle_index(ends, ["ID"], ["time", "SAMPLE"], 2)
    return event_columns(out, ["ID", "SAMPLE", "cycle"])


def block_numbers(spark, d):
    return fx.subjects(spark, d).select(
        "ID", attach.block_index(F.col("ID") + 1, 30).alias("SIM"))


def group_scalars(spark, d):
    raw = events.with_amounts(fx.study(spark, d))
    out = events.baselines(attach_group(raw, ["ID_ORIG"], first_start=F.min("DATST")), "ID_ORIG")
    return out.select("ID_ORIG", "SAMPLE", "first_start", F.round("GFR_0", 9).alias("GFR_0"),
                      F.round("P_0", 9).alias("P_0"))


def sort_events(spark, d):
    """The globally sorted rows, each with its place in study order within its subject."""
    tie = [F.asc_nulls_last("cmt"), F.asc_nulls_last("SAMPLE"), F.asc("evid")]
    rows = events.study_order(_events(spark, d), "pair", tie)
    return event_columns(events.sort_study(rows, tie),
                         ["ID", "time", "amt", "cmt", "SAMPLE", "evid", "pair"])


def union_rows(spark, d):
    obs = fx.observed(spark, d).select("ID", "TRT", "time", "CALAMT")
    pred = fx.predicted(spark, d).select(F.col("ID_ORIG").alias("ID"), "time", "P_PRED")
    return events.union_rows(obs, pred).withColumn("P_PRED", F.round("P_PRED", 10))


def arm_summary(spark, d):
    """Arms are a grouping key instead of two tables."""
    return fx.simulated(spark, d).groupBy("TRT", "SIM").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("P"), 6).alias("mean_p"))


def event_table(spark, d):
    return event_columns(study_events.build_event_table(fx.study(spark, d)))


def arm_codes(spark, d):
    out = study_events.arm_table(_events(spark, d))
    return out.select("ID_ORIG", F.col("TRT").cast("long").alias("TRT"))


def sim_input(spark, d):
    out = study_events.build_sim_input(_events(spark, d))
    return event_columns(out, ["ID", "time", "amt", "evid", "rate", "cmt"])


def _attributes(spark, d):
    return first_per(_obs(spark, d), ["ID"], [F.asc_nulls_last("DATST"), F.asc("SAMPLE")]).select(
        "ID", "ID_ORIG", "TRT", "P_0", "GFR_0")


def _subject_count(spark, d):
    return fx.study(spark, d).select("ID_ORIG").distinct().count()


def attach_attributes(spark, d):
    attrs = _attributes(spark, d)
    keys = attach.simulation_keys(attrs, NSIM, _subject_count(spark, d))
    out = attach.attach_attributes(keys, attrs.select("ID_ORIG", "P_0", "GFR_0"), "ID_ORIG")
    return event_columns(out, ["ID", "ID_ORIG", "TRT", "SIM", "P_0", "GFR_0"])


def merge_by_subject(spark, d):
    attrs = _attributes(spark, d)
    population = fx.subjects(spark, d).withColumn("ID", F.col("ID") + 1)
    out = attach.merge_sorted(attrs.select("ID", "P_0"), population.select("ID", "wt"), "ID")
    return event_columns(out, ["ID", "P_0", "wt"])


def label_simulated(spark, d):
    n = _subject_count(spark, d)
    keys = attach.simulation_keys(_attributes(spark, d), fx.REPLICATES, n)
    output = fx.simulated(spark, d).select(
        ((F.col("SIM") - 1) * n + F.col("ID") + 1).alias("ID"), "OBS", "P")
    out = attach.label_simulated(output, keys)
    return out.groupBy("SIM", "TRT", "ID_ORIG").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("P"), 6).alias("sum_p"))


def override_scenarios(spark, d):
    attrs = _attributes(spark, d)
    out = attach.override_params(attrs.select("ID", "TRT"), attrs, "ID")
    return event_columns(out, ["ID", "TRT", "scenario", "P_0", "GFR_0", "PDEMAX"])


def prediction_join_time(spark, d):
    sim = fx.simulated(spark, d).select("ID_ORIG", "OBS", "SIM", "time", "P")
    out = attach.attach_predictions(sim, fx.predicted(spark, d), ["ID_ORIG"], "time",
                                    ["P_PRED"], dedupe=["OBS"])
    return out.select("ID_ORIG", "OBS", "SIM", F.round("P", 6).alias("P"),
                      F.round("P_PRED", 6).alias("P_PRED"))


def prediction_join_day(spark, d):
    """Predictions keyed by subject, time since collection start, and collection day."""
    window = _window(spark, d, True).select("ID", "REC", "DAY", "dTIME", "dUCA")
    pred = (window.select("ID", "DAY", "dTIME", F.col("dUCA").alias("UCA_PRED"), "REC"))
    strict = _window(spark, d, False).select("ID", "REC", "DAY", "dTIME")
    out = attach.attach_predictions(strict, pred, ["ID", "DAY"], "dTIME", ["UCA_PRED"],
                                    dedupe=["REC"])
    return out.select("ID", "REC", F.col("DAY").cast("long").alias("DAY"),
                      F.round("dTIME", 6).alias("dTIME"), F.round("UCA_PRED", 6).alias("UCA_PRED"))


def _window(spark, d, inclusive):
    rows = fx.regimen_events(spark, d).withColumn("time", F.col("tick") / 3600.0)
    return attach.collection_window(rows, ["ID"], F.col("evid") == 1, "time", "UCA",
                                    ["tick", "REC"], inclusive)


def _window_query(inclusive):
    def build(spark, d):
        return _window(spark, d, inclusive).select(
            "ID", "REC", F.col("DAY").cast("long").alias("DAY"),
            F.round("dTIME", 6).alias("dTIME"), F.round("dUCA", 6).alias("dUCA"))
    return build


def zip_columns(spark, d):
    """Pair the k-th plasma sample with the k-th urine sample of each subject; what is over stays."""
    obs = events.with_amounts(fx.study(spark, d)).withColumn("_missing",
                                                             F.col("DATST").isNull().cast("int"))
    plasma = obs.filter("MAT = 'Plasma'").select("ID_ORIG", "SAMPLE", "CALAMT")
    urine = obs.filter("MAT = 'Urine'").select("ID_ORIG", F.col("SAMPLE").alias("U_SAMPLE"),
                                               F.col("CALAMT").alias("U_CALAMT"))
    out = attach.zip_columns(plasma, urine, ["ID_ORIG"], ["SAMPLE"], ["U_SAMPLE"])
    return out.select("ID_ORIG", "SAMPLE", "U_SAMPLE", F.round("CALAMT", 10).alias("CALAMT"),
                      F.round("U_CALAMT", 10).alias("U_CALAMT"))


def paired_difference(spark, d):
    rows = events.union_rows(_obs(spark, d).filter("cmt = 31"),
                             events.urine_ends(_obs(spark, d))).filter("time is not null")
    rows = rows.withColumn("UCA", F.col("CALAMT") * (1 + F.col("evid")))
    out = attach.paired_difference(rows, ["ID"], "evid", ["time", "SAMPLE"],
                                   {"dUCA": "UCA", "dTIME": "time"}, carry=["CALAMT"])
    return event_columns(out, ["ID", "pair", "dUCA", "dTIME", "CALAMT"])


def paired_residuals(spark, d):
    """Plasma residuals against predictions matched by subject and ordinal."""
    obs = fx.observed(spark, d).select("ID_ORIG", "OBS", "TRT", "time", "CALAMT")
    pred = fx.predicted(spark, d).select("ID_ORIG", F.col("OBS").alias("P_OBS"), "P_PRED")
    out = attach.zip_columns(obs, pred, ["ID_ORIG"], ["OBS"], ["P_OBS"],
                             unpaired="fail")
    return out.select("ID_ORIG", "OBS", "TRT",
                      F.round(F.col("CALAMT") - F.col("P_PRED"), 6).alias("RES"))


QUERIES = {
    "study_sheet_csv": study_sheet, "dose_points_csv": dose_points,
    "result_handoff": result_handoff, "time_grid": time_grid, "regimen_grid": regimen_grid,
    "expand_doses": expand_doses, "replicate_study": replicate_study,
    "month_correction": month_correction, "subject_clock": subject_clock,
    "event_codes": event_codes, "blank_and_set": blank_and_set,
    "rename_pattern": rename_pattern, "filter_plasma": filter_plasma,
    "filter_urine_ends": filter_urine_ends, "filter_arm_not_negative": filter_arm_not_negative,
    "select_rename": select_rename, "capped_gfr": capped_gfr,
    "first_per_subject": first_per_subject, "baseline_first": baseline_first, "rekey": rekey,
    "cycle_index": cycle_index, "block_numbers": block_numbers, "group_scalars": group_scalars,
    "sort_events": sort_events, "union_rows": union_rows, "arm_summary": arm_summary,
    "event_table": event_table, "arm_codes": arm_codes, "sim_input": sim_input,
    "attach_attributes": attach_attributes, "merge_by_subject": merge_by_subject,
    "label_simulated": label_simulated, "override_scenarios": override_scenarios,
    "prediction_join_time": prediction_join_time, "prediction_join_day": prediction_join_day,
    "collection_window_inclusive": _window_query(True),
    "collection_window_strict": _window_query(False),
    "zip_columns": zip_columns, "paired_difference": paired_difference,
    "paired_residuals": paired_residuals,
}

_DOSED = "(VALUES (0.0::DOUBLE), (0.5), (1.0), (1.5), (2.0), (4.0), (6.0), (8.0), (10.0), (24.0)) t(time)"
def _keys(nsim: int) -> str:
    return f"""
SELECT s * (SELECT count(DISTINCT ID) FROM obs) + ID AS ID, ID_ORIG, TRT, s + 1 AS SIM
FROM (SELECT DISTINCT ID, ID_ORIG, TRT FROM obs) CROSS JOIN range({nsim}) r(s)"""



_ATTRS = "SELECT DISTINCT ID, ID_ORIG, TRT, P_0, GFR_0 FROM obs"
_STARTS = """
SELECT ID, tick / 3600.0 AS t, UCA AS v, row_number() OVER s AS k, lead(tick / 3600.0) OVER s AS u
FROM fx_event WHERE evid = 1 WINDOW s AS (PARTITION BY ID ORDER BY tick, REC)"""


def _window_sql(op: str) -> str:
    return f"""
SELECT e.ID, e.REC, a.k::BIGINT AS DAY, e.tick / 3600.0 - a.t AS dTIME, e.UCA - a.v AS dUCA
FROM fx_event e JOIN starts a ON a.ID = e.ID
WHERE e.tick / 3600.0 {op} a.t AND (a.u IS NULL OR e.tick / 3600.0 < a.u)"""


_WINDOW_OUT = "SELECT ID, REC, DAY, round(dTIME, 6) AS dTIME, round(dUCA, 6) AS dUCA FROM w"

ORACLES = {
    "study_sheet_csv": query("""
SELECT TRT, MAT, count(*) AS n, count(DATST) AS n_datst, count(VOL) AS n_vol, count(CAL) AS n_cal, count(CRCL) AS n_crcl,
  round(sum(CAL), 6) AS sum_cal, round(sum(SAMPLE)::DOUBLE, 6) AS sum_sample, max(DATEN) AS last_end
FROM fx_study GROUP BY TRT, MAT""", "fx_study"),
    "dose_points_csv": query(
        "SELECT Conc, count(*) AS n, round(avg(Eff), 6) AS mean_eff FROM fx_points GROUP BY Conc",
        "fx_points"),
    "result_handoff": query("""
SELECT SIM, TRT, round(quantile_cont(P, 0.5), 10) AS median, round(quantile_cont(P, 0.05), 10) AS lo90,
  round(quantile_cont(P, 0.95), 10) AS hi90, count(P) AS n FROM fx_sim GROUP BY SIM, TRT""", "fx_sim"),
    "time_grid": query("""
SELECT ID, k * 0.5::DOUBLE AS time, 0.0::DOUBLE AS amt, 0::BIGINT AS evid, 0::BIGINT AS rate, 1::BIGINT AS cmt
FROM fx_subject CROSS JOIN range(97) g(k)""", "fx_subject"),
    "regimen_grid": query(f"""
SELECT ID, time, CASE WHEN time IN (0, 24) THEN 100.0 ELSE 0.0 END::DOUBLE AS amt, CASE WHEN time IN (0, 24) THEN 1 ELSE 0 END::BIGINT AS evid,
  0::BIGINT AS rate, 25::BIGINT AS cmt, CAST(floor((ID - 1) / 30.0) + 1 AS BIGINT) AS SIM FROM fx_subject CROSS JOIN {_DOSED}""", "fx_subject"),
    "expand_doses": query("""
SELECT ID, amt, k AS dose_no, k * 24.0::DOUBLE AS time, 1::BIGINT AS evid
FROM fx_subject CROSS JOIN (VALUES (20.0::DOUBLE), (40.0)) a(amt) CROSS JOIN range(11) g(k)""", "fx_subject"),
    "replicate_study": query(f"""
SELECT (s * (SELECT count(DISTINCT ID) FROM obs) + ID)::BIGINT AS ID, ID_ORIG, (s + 1)::BIGINT AS SIM, SAMPLE, round(time, 10) AS time, round(CALAMT, 10) AS CALAMT
FROM obs CROSS JOIN range({NSIM}) r(s)""", "obs"),
    "month_correction": query("""
SELECT ID_ORIG, SAMPLE, CASE WHEN ID_ORIG % 3 = 0 AND SAMPLE % 5 = 0
  THEN CASE WHEN day(DATST - INTERVAL 1 MONTH) = day(DATST) THEN DATST - INTERVAL 1 MONTH END ELSE DATST END AS DATST
FROM fx_study""", "fx_study"),
    "subject_clock": query(
        f"SELECT {event_sql(['ID_ORIG', 'SAMPLE', 'time', 'TIMEEND', 'dTIME'])} FROM obs", "obs"),
    "event_codes": query("""
SELECT SAMPLE, CASE WHEN TRT = 'Caffeine' THEN 1 ELSE 0 END::BIGINT AS TRT, TRT AS ARM, cmt::BIGINT AS cmt, amt, evid::BIGINT AS evid,
  rate::BIGINT AS rate, round(CALAMT, 10) AS CALAMT FROM obs""", "obs"),
    "blank_and_set": query("""
SELECT SAMPLE, NULL::DOUBLE AS VOL, NULL::DOUBLE AS CAL, NULL::TIMESTAMP AS DATEN, 1.5::DOUBLE AS SOD, 1.5::DOUBLE AS NACL, CACL FROM fx_study""", "fx_study"),
    "rename_pattern": query('SELECT ID, wt AS ETA1, ht AS ETA2, age AS CENT_0 FROM fx_subject',
                            "fx_subject"),
    "filter_plasma": query(f"""
SELECT {event_sql(['ID', 'SAMPLE', 'time', 'CALAMT'])} FROM event_table WHERE cmt = 6 AND time IS NOT NULL""", "event_table"),
    "filter_urine_ends": query(f"""
SELECT {event_sql(['ID', 'SAMPLE', 'time', 'CALAMT'])} FROM event_table WHERE cmt = 31 AND evid = 1""", "event_table"),
    "filter_arm_not_negative": query("""
SELECT SIM, count(*) AS n, round(sum(P - 1), 6) AS total FROM fx_sim WHERE TRT = 'Caffeine' AND P - 1 >= 0 GROUP BY SIM""", "fx_sim"),
    "select_rename": query("SELECT ID_ORIG, OBS, round(P_PRED, 10) AS PRED, time AS TIME FROM fx_pred", "fx_pred"),
    "capped_gfr": query("""
SELECT ID_ORIG, round(CASE WHEN avg(CRCL) > 7.2 THEN 7.2 ELSE avg(CRCL) END, 9) AS GFR_0 FROM fx_study GROUP BY ID_ORIG""", "fx_study"),
    "first_per_subject": query("""
SELECT ID_ORIG, TRT, SAMPLE, DATST FROM fx_study
QUALIFY row_number() OVER (PARTITION BY ID_ORIG ORDER BY DATST NULLS LAST, SAMPLE) = 1""", "fx_study"),
    "baseline_first": query("""
SELECT ID_ORIG, round(CAL * coalesce(VOL, 14), 9) AS P_0 FROM fx_study WHERE MAT = 'Plasma'
QUALIFY row_number() OVER (PARTITION BY ID_ORIG ORDER BY DATST NULLS LAST, SAMPLE) = 1""", "fx_study"),
    "rekey": query("SELECT ID_ORIG, SAMPLE, dense_rank() OVER (ORDER BY ID_ORIG) AS ID FROM fx_study",
                   "fx_study"),
    "cycle_index": query("""
SELECT ID::BIGINT AS ID, SAMPLE, ((row_number() OVER (PARTITION BY ID ORDER BY TIMEEND, SAMPLE) - 1) % 2 + 1)::BIGINT AS cycle
FROM obs WHERE TIMEEND IS NOT NULL""", "obs"),
    "block_numbers": query("SELECT ID, CAST(floor(ID / 30.0) + 1 AS BIGINT) AS SIM FROM fx_subject",
                           "fx_subject"),
    "group_scalars": query("""
SELECT ID_ORIG, SAMPLE, min(DATST) OVER (PARTITION BY ID_ORIG) AS first_start, round(GFR_0, 9) AS GFR_0, round(P_0, 9) AS P_0 FROM obs""", "obs"),
    "sort_events": query(f"""
SELECT {event_sql(['ID', 'time', 'amt', 'cmt', 'SAMPLE', 'evid', 'pair'])} FROM (SELECT *, row_number() OVER (
  PARTITION BY ID ORDER BY time NULLS LAST, amt DESC NULLS LAST, cmt NULLS LAST, SAMPLE NULLS LAST, evid NULLS FIRST) AS pair FROM event_table)""", "event_table"),
    "union_rows": query("""
SELECT ID, TRT, time, CALAMT, NULL::DOUBLE AS P_PRED FROM fx_obs UNION ALL SELECT ID_ORIG, NULL, time, NULL, round(P_PRED, 10) FROM fx_pred""", "fx_pred"),
    "arm_summary": query(
        "SELECT TRT, SIM, count(*) AS n, round(avg(P), 6) AS mean_p FROM fx_sim GROUP BY TRT, SIM", "fx_sim"),
    "event_table": query(f"SELECT {event_sql()} FROM event_table", "event_table"),
    "arm_codes": query("""
SELECT DISTINCT ID_ORIG, CASE WHEN TRT = 'Caffeine' THEN 1 ELSE 0 END::BIGINT AS TRT FROM fx_study""", "fx_study"),
    "sim_input": query(f"""
SELECT {event_sql(['ID', 'time', 'amt', 'evid', 'rate', 'cmt'])} FROM event_table WHERE time IS NOT NULL
UNION ALL
SELECT ID::BIGINT, k * 0.5::DOUBLE, 0.0::DOUBLE, 0::BIGINT, 0::BIGINT, 1::BIGINT FROM (SELECT DISTINCT ID FROM obs) CROSS JOIN range(97) g(k)""", "event_table"),
    "attach_attributes": query("""
SELECT k.ID::BIGINT AS ID, k.ID_ORIG, k.TRT, k.SIM::BIGINT AS SIM, round(P_0, 10) AS P_0, round(GFR_0, 10) AS GFR_0
FROM keys k JOIN attrs a USING (ID_ORIG)""", "obs", keys=_keys(NSIM), attrs=_ATTRS),
    "merge_by_subject": query("""
SELECT a.ID::BIGINT AS ID, round(P_0, 10) AS P_0, wt FROM attrs a JOIN fx_subject s ON s.ID + 1 = a.ID""", "obs", "fx_subject", attrs=_ATTRS),
    "label_simulated": query(f"""
SELECT k.SIM::BIGINT AS SIM, k.TRT, k.ID_ORIG, count(*) AS n, round(sum(P), 6) AS sum_p
FROM fx_sim s JOIN keys k ON k.ID = (s.SIM - 1) * (SELECT count(DISTINCT ID) FROM obs) + s.ID + 1
GROUP BY 1, 2, 3""", "obs", "fx_sim", keys=_keys(fx.REPLICATES)),
    "override_scenarios": query("""
SELECT ID::BIGINT AS ID, TRT, scenario,
  round(CASE scenario WHEN 'common_p0' THEN 33.32 WHEN 'own_p0' THEN P_0 WHEN 'own_both_emax' THEN P_0 END, 10) AS P_0,
  round(CASE WHEN scenario IN ('own_gfr', 'own_both_emax') THEN GFR_0 END, 10) AS GFR_0,
  CASE WHEN scenario = 'own_both_emax' THEN 0.446 END::DOUBLE AS PDEMAX
FROM attrs CROSS JOIN (VALUES ('none'), ('common_p0'), ('own_p0'), ('own_gfr'), ('own_both_emax')) v(scenario)""", "obs", attrs=_ATTRS),
    "prediction_join_time": query("""
SELECT s.ID_ORIG, s.OBS, s.SIM, round(s.P, 6) AS P, round(p.P_PRED, 6) AS P_PRED
FROM fx_sim s JOIN (SELECT * FROM fx_pred QUALIFY row_number() OVER (PARTITION BY ID_ORIG, tick ORDER BY OBS) = 1) p
  ON p.ID_ORIG = s.ID_ORIG AND p.tick = s.tick""", "fx_sim", "fx_pred"),
    "prediction_join_day": query("""
SELECT s.ID, s.REC, s.DAY, round(s.dTIME, 6) AS dTIME, round(p.dUCA, 6) AS UCA_PRED
FROM ws s JOIN (SELECT *, round(dTIME * 3600) AS sec FROM wi QUALIFY row_number() OVER (PARTITION BY ID, DAY, round(dTIME * 3600) ORDER BY REC) = 1) p
  ON p.ID = s.ID AND p.DAY = s.DAY AND p.sec = round(s.dTIME * 3600)""", "fx_event",
                                 starts=_STARTS, wi=_window_sql(">="), ws=_window_sql(">")),
    "collection_window_inclusive": query(_WINDOW_OUT, "fx_event", starts=_STARTS,
                                         w=_window_sql(">=")),
    "collection_window_strict": query(_WINDOW_OUT, "fx_event", starts=_STARTS, w=_window_sql(">")),
    "zip_columns": query("""
SELECT coalesce(p.ID_ORIG, u.ID_ORIG) AS ID_ORIG, p.SAMPLE, u.SAMPLE AS U_SAMPLE, round(p.CALAMT, 10) AS CALAMT, round(u.CALAMT, 10) AS U_CALAMT
FROM (SELECT *, row_number() OVER (PARTITION BY ID_ORIG ORDER BY SAMPLE) AS k FROM obs WHERE MAT = 'Plasma') p
FULL JOIN (SELECT *, row_number() OVER (PARTITION BY ID_ORIG ORDER BY SAMPLE) AS k FROM obs WHERE MAT = 'Urine') u
  ON u.ID_ORIG = p.ID_ORIG AND u.k = p.k""", "obs"),
    "paired_difference": query("""
SELECT s.ID::BIGINT AS ID, s.k::BIGINT AS pair, round(e.CALAMT * 2 - s.CALAMT, 10) AS dUCA, round(e.TIMEEND - s.time, 10) AS dTIME, round(e.CALAMT, 10) AS CALAMT
FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY time, SAMPLE) AS k FROM obs WHERE cmt = 31 AND time IS NOT NULL) s
JOIN (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY TIMEEND, SAMPLE) AS k FROM obs WHERE TIMEEND IS NOT NULL) e
  ON e.ID = s.ID AND e.k = s.k""", "obs"),
    "paired_residuals": query("""
SELECT o.ID_ORIG, o.OBS, o.TRT, round(o.CALAMT - p.P_PRED, 6) AS RES FROM fx_obs o JOIN fx_pred p USING (OBS)""", "fx_obs", "fx_pred"),
}
