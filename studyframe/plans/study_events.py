"""Event-table jobs: study sheet to event table, and event table to simulator input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyframe.functions.clock import day_origin, hours_between, minus_months
from studyframe.operators import events, grids
from studyframe.operators.grouping import join_on

GRID_HOURS = (0.0, 48.0, 0.5)  # Fixed values: observation grid of the simulator input


def subject_table(raw: DataFrame, key: str) -> DataFrame:
    """One row per subject: first start, capped GFR, plasma baseline.

    All three come from a single aggregate with map-side combine, so a subject holding a
    large share of the rows costs no more than any other.
    """
    plasma = F.col("MAT") == "Plasma"
    order = [F.when(plasma, 0).otherwise(1).alias("p"), F.col("DATST").isNull().alias("n"),
             F.col("DATST").alias("t"), F.col("SAMPLE").alias("s")]
    return raw.groupBy(key).agg(
        F.min("DATST").alias("_first"),
        events.capped_mean("CRCL", events.GFR_CAP).alias("GFR_0"),
        events.first_value(F.when(plasma, F.col("CALAMT")), order).alias("P_0"))


def observations(raw: DataFrame, key: str = "ID_ORIG",
                 corrections: list[tuple[Column, int]] | None = None) -> DataFrame:
    """Clean observation rows with clock, codes, amounts, baselines and new subject numbers."""
    out = raw
    for condition, months in corrections or []:
        out = events.correct_where(out, condition, "DATST",
                                   minus_months(F.col("DATST"), months))
    out = events.with_amounts(events.code_events(out))
    subjects = events.rekey(subject_table(out, key), key)
    joined = join_on(out, subjects, [key], "left")
    origin = day_origin(F.col("_first"))
    return (joined.withColumns({
        "time": hours_between(F.col("DATST"), origin),
        "TIMEEND": hours_between(F.col("DATEN"), origin)})
        .withColumn("dTIME", F.col("TIMEEND") - F.col("time")).drop("_first"))


def build_event_table(raw: DataFrame, key: str = "ID_ORIG",
                      corrections: list[tuple[Column, int]] | None = None,
                      ordered: bool = True) -> DataFrame:
    """Observations, dose rows and urine-end rows of every subject, in study order."""
    obs = observations(raw, key, corrections)
    table = events.union_rows(obs, events.dose_rows(obs), events.urine_ends(obs))
    return events.sort_study(table) if ordered else table


def arm_table(event_table: DataFrame) -> DataFrame:
    """Arm code (1 caffeine, 0 other) per original subject."""
    first = event_table.groupBy("ID_ORIG").agg(F.min("TRT").alias("TRT"))
    return events.recode_arm(first)


def build_sim_input(event_table: DataFrame, carry: list[str] | None = None,
                    ordered: bool = True) -> DataFrame:
    """Timed events plus the regular grid of every subject, in simulator order."""
    keep = ["ID", "time", "amt", "evid", "rate", "cmt", *(carry or [])]
    ids = event_table.select("ID", *(carry or [])).distinct()
    grid = grids.time_grid(ids, *GRID_HOURS)
    timed = event_table.filter("time is not null").select(*keep)
    table = events.union_rows(timed, grid.select(*keep))
    return events.sort_sim_input(table) if ordered else table
