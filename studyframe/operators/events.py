"""Event-table preparation: corrections, clocks, codes, baselines, keys and order."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from studyframe.functions.clock import day_origin, hours_between
from studyframe.functions.responses import conc_to_amount
from studyframe.operators.grids import repeat_rows
from studyframe.operators.grouping import (
    attach_group, first_per, join_on, ordinal)

# Compartment codes, dose schedule and limits of the study.
PLASMA_CMT, URINE_CMT, DOSE_CMT = 6, 31, 25
DOSE_TIMES = [2.0, 4.0, 6.0, 8.0, 26.0, 28.0, 30.0, 32.0]
DOSE_AMOUNT = 200.0
GFR_CAP = 7.2
DOSE_BLANKS = ["SAMPLE", "DATST", "DATEN", "VOL", "SOD", "SECR", "CAL", "NACL", "CRCL",
               "CACL", "TIMEEND", "CALAMT"]


def correct_where(df: DataFrame, condition: Column, column: str, value: Column) -> DataFrame:
    """Replace a column where the condition holds (null conditions leave it alone)."""
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def subject_clock(df: DataFrame, key: str) -> DataFrame:
    """``time``/``TIMEEND`` in hours since 23:00 of the subject's first day, and ``dTIME``."""
    timed = attach_group(df, [key], _first=F.min("DATST"))
    origin = day_origin(F.col("_first"))
    return (timed.withColumns({"time": hours_between(F.col("DATST"), origin),
                               "TIMEEND": hours_between(F.col("DATEN"), origin)})
            .withColumn("dTIME", F.col("TIMEEND") - F.col("time")).drop("_first"))


def code_events(df: DataFrame) -> DataFrame:
    """Compartment from the sample matrix, and the zero dose columns of an observation."""
    return df.withColumns({
        "cmt": F.when(F.col("MAT") == "Plasma", PLASMA_CMT)
        .when(F.col("MAT").isNotNull(), URINE_CMT),
        "amt": F.lit(0.0), "evid": F.lit(0), "rate": F.lit(0)})


def recode_arm(df: DataFrame, column: str = "TRT") -> DataFrame:
    """Arm name to 1 (caffeine) / 0 (other)."""
    return df.withColumn(column, F.when(F.col(column) == "Caffeine", 1)
                         .when(F.col(column).isNotNull(), 0))


def label_arm(df: DataFrame, column: str = "TRT") -> DataFrame:
    """1 / 0 back to the arm name."""
    return df.withColumn(column, F.when(F.col(column) == 1, "Caffeine")
                         .when(F.col(column).isNotNull(), "Placebo"))


def set_columns(df: DataFrame, columns: list[str], value) -> DataFrame:
    return df.withColumns({c: F.lit(value).cast(df.schema[c].dataType) for c in columns})


def blank_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return set_columns(df, columns, None)


def rename_pattern(df: DataFrame, prefix: str, renames: dict[str, str] | None = None) -> DataFrame:
    """Columns whose name holds a number become prefix + number; then targeted renames."""
    found = {c: re.search(r"\d+", c) for c in df.columns}
    numbered = df.withColumnsRenamed(
        {c: f"{prefix}{m.group()}" for c, m in found.items() if m})
    return numbered.withColumnsRenamed(renames or {})


def select_rename(df: DataFrame, *keep: str, **renamed: str) -> DataFrame:
    """Prune to ``keep`` plus ``new_name=old_name``."""
    return df.select(*keep, *[F.col(old).alias(new) for new, old in renamed.items()])


def where_plasma(df: DataFrame) -> DataFrame:
    return df.filter((F.col("cmt") == PLASMA_CMT) & F.col("time").isNotNull())


def where_urine(df: DataFrame, ended: bool) -> DataFrame:
    """Starts (evid 0) or ends (evid 1) of timed collections."""
    return df.filter((F.col("cmt") == URINE_CMT) & (F.col("evid") == int(ended)))


def where_arm(df: DataFrame, arm: str) -> DataFrame:
    return df.filter(F.col("TRT") == arm)


def where_not_negative(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) >= 0)


def capped_mean(column: str, cap: float) -> Column:
    """Group mean, replaced by the cap when above it; all-missing stays missing."""
    mean = F.avg(column)
    return F.when(mean > cap, cap).otherwise(mean)


def first_value(value: Column, order: list[Column]) -> Column:
    """First value in order, kept even when it is null (hence the struct wrapper)."""
    return F.min_by(F.struct(value.alias("v")), F.struct(*order))["v"]


def baselines(df: DataFrame, key: str) -> DataFrame:
    """``GFR_0`` (capped mean) and ``P_0`` (first plasma amount by time) on every row.

    One aggregate per subject: the plasma restriction sits inside the ordering struct, so
    subjects without plasma keep a null baseline.
    """
    plasma = F.col("MAT") == "Plasma"
    amount = F.when(plasma, F.col("CALAMT"))
    order = [F.when(plasma, 0).otherwise(1).alias("p"), F.col("DATST").isNull().alias("n"),
             F.col("DATST").alias("t"), F.col("SAMPLE").alias("s")]
    return attach_group(df, [key], GFR_0=capped_mean("CRCL", GFR_CAP),
                        P_0=first_value(amount, order))


def baseline_first(df: DataFrame, key: str) -> DataFrame:
    """First plasma amount per subject (one row per subject with plasma)."""
    order = [F.col("DATST").isNull(), F.col("DATST"), F.col("SAMPLE")]
    return (df.filter(F.col("MAT") == "Plasma").groupBy(key)
            .agg(first_value(F.col("CALAMT"), order).alias("P_0")))


def rekey(df: DataFrame, key: str, out: str = "ID") -> DataFrame:
    """Consecutive subject numbers in key order.

    Only the distinct keys are ranked; beyond the hot limit their order is cut into
    chunks, so no single task ranks an unbounded set.
    """
    keys = df.select(key).distinct().withColumn("_all", F.lit(1))
    ranked = ordinal(keys, ["_all"], [key], out).drop("_all")
    return join_on(df, ranked, [key], "left")


def study_order(df: DataFrame, out: str, tie: list[Column] | None = None) -> DataFrame:
    """Place of every row in study order within its ``ID``, from 1."""
    w = Window.partitionBy("ID").orderBy(F.asc_nulls_last("time"), F.desc_nulls_last("amt"),
                                         *(tie or []))
    return df.withColumn(out, F.row_number().over(w))


def sort_study(df: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """``ID, time, amt desc`` with missing values last."""
    return df.orderBy(F.asc_nulls_last("ID"), F.asc_nulls_last("time"),
                      F.desc_nulls_last("amt"), *(tie or []))


def sort_sim_input(df: DataFrame, tie: list[str] | None = None) -> DataFrame:
    """``ID, time, evid desc`` with missing values last."""
    return df.orderBy(F.asc_nulls_last("ID"), F.asc_nulls_last("time"),
                      F.desc_nulls_last("evid"), *(tie or []))


def union_rows(*tables: DataFrame) -> DataFrame:
    """Stack tables by name; absent columns become null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def urine_ends(df: DataFrame) -> DataFrame:
    """Rows with an end time again, at that time and flagged."""
    return (df.filter("TIMEEND is not null")
            .withColumns({"time": F.col("TIMEEND"), "evid": F.lit(1)}))


def dose_rows(df: DataFrame, key: str = "ID") -> DataFrame:
    """First row per subject, blanked and repeated at the dose times."""
    order = [F.asc_nulls_last("DATST"), F.asc_nulls_last("SAMPLE")]
    blank = blank_columns(first_per(df, [key], order), DOSE_BLANKS)
    return repeat_rows(blank, DOSE_TIMES, "time").withColumns({
        "MAT": F.lit("Dose"), "cmt": F.lit(DOSE_CMT), "evid": F.lit(1), "rate": F.lit(0),
        "amt": F.when(F.col("TRT") == "Caffeine", DOSE_AMOUNT).otherwise(0.0)})


def with_amounts(df: DataFrame) -> DataFrame:
    return df.withColumn("CALAMT", conc_to_amount(F.col("CAL"), F.col("VOL")))
