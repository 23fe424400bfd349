"""Dose superposition: compartment amounts from all earlier doses of a subject."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.functions.kernel import (
    LinearModel, coefficient, evaluate, from_initial, response, with_rates)
from studyframe.operators.grouping import join_on, largest_group, running_sums

# Exponent span of a time block: exp(SPAN) and its inverse stay inside double range, and
# what decays over more than CARRY_BLOCKS blocks underflows to zero.
SPAN = 300.0
CARRY_BLOCKS = 3


def _subject_terms(params: DataFrame, model: LinearModel, initial: dict[str, str]) -> DataFrame:
    """One row per subject: the exponentials with their shares in every compartment.

    The aggregate keeps the optimizer from rewriting the derivation into later filters; it
    partitions by ID, as the join that follows does.
    """
    wide = with_rates(params, model)
    names = [c for c in wide.columns if c.startswith("_")] + list((initial or {}).values())
    rated = wide.groupBy("ID").agg(*[F.first(c).alias(c) for c in names])
    dosed = response(model, "GUT")
    present = from_initial(model, {c: F.col(column) for c, column in initial.items()})
    slots = [F.struct(F.lit(i).alias("slot"), F.col(rate).alias("rate"),
                      *[coefficient(dosed[c], rate).alias(f"dose_{c}")
                        for c in model.compartments],
                      *[coefficient(present[c], rate).alias(f"init_{c}")
                        for c in model.compartments])
             for i, rate in enumerate(model.rates)]
    return rated.select("ID", "_lag", F.array(*slots).alias("_slots"))


def dose_superposition(obs: DataFrame, doses: DataFrame, params: DataFrame, model: LinearModel,
                       row_key: str = "REC", initial: dict[str, str] | None = None,
                       group_rows: int | None = None) -> DataFrame:
    """Amount in every compartment at each observation, summed over the earlier doses.

    ``obs``: ID, row_key, time. ``doses``: ID, time, amt. ``params``: one row per subject
    with the model's parameters and the initial amounts (``{compartment: column}``).

    An exponential response is memoryless, so instead of pairing observations with doses
    (quadratic in a subject's rows) each exponential needs one running sum of
    ``amt * exp(rate * t)`` along time. Time is cut into blocks of SPAN / rate so that the
    exponent stays in range, and block totals are carried into the next blocks. Work is
    linear in the rows, and one busy subject is spread over its blocks.
    """
    if group_rows is None:  # a subject's rows bound every group below
        group_rows = largest_group(obs.select("ID").unionByName(doses.select("ID")), ["ID"])
    subjects = _subject_terms(params, model, initial or {})
    marks = obs.select("ID", row_key, F.col("time").cast("double"),
                       F.lit(None).cast("double").alias("amt"), F.lit(2).alias("_kind"))
    given = doses.filter("amt <> 0").select(
        "ID", F.lit(None).cast(obs.schema[row_key].dataType).alias(row_key),
        F.col("time").cast("double"), F.col("amt").cast("double"), F.lit(1).alias("_kind"))
    slotted = (join_on(marks.unionByName(given), subjects, ["ID"])
               .withColumn("_s", F.explode_outer("_slots"))
               .withColumn("_at", F.when(F.col("_kind") == 1, F.col("time") + F.col("_lag"))
                           .otherwise(F.col("time")))
               .withColumn("_block", F.floor(F.col("_at") * F.col("_s.rate") / SPAN)))
    inside = F.col("_at") * F.col("_s.rate") - F.col("_block") * SPAN
    scaled = slotted.withColumn(
        "_x", F.when(F.col("_kind") == 1, F.col("amt") * F.exp(inside)).otherwise(0.0))
    rows = scaled.select("ID", row_key, F.col("time"), "_at", "_kind", "_block", "_x",
                         F.col("_s.slot").alias("_slot"), F.col("_s").alias("_s"))

    totals = (rows.filter("_kind = 1").groupBy("ID", "_slot", "_block")
              .agg(F.sum("_x").alias("_x"), F.max("_s.rate").alias("_rate")))
    shift = F.explode(F.array(*[F.lit(m) for m in range(1, CARRY_BLOCKS + 1)]))
    decay = F.lit(1.0)
    for m in range(1, CARRY_BLOCKS + 1):  # repeated factors: exp(-900) alone would be zero
        decay = F.when(F.col("_m") >= m, decay * F.exp(F.lit(-SPAN))).otherwise(decay)
    carried = (totals.withColumn("_m", shift)
               .withColumn("_block", F.col("_block") + F.col("_m"))
               .select("ID", "_slot", "_block", (F.col("_x") * decay).alias("_x"),
                       (F.col("_block") * SPAN / F.col("_rate")).alias("_at"),
                       F.lit(0).alias("_kind")))
    stacked = (rows.unionByName(carried, allowMissingColumns=True)
               .withColumn("_late", (F.col("_kind") > 0).cast("int"))
               .withColumn("_at", F.when(F.col("_kind") == 0, F.lit(float("-inf")))
                           .otherwise(F.col("_at"))))
    summed = running_sums(stacked, ["ID", "_slot", "_block"], ["_at", "_kind", row_key],
                          {"_cum": "_x"}, group_rows + CARRY_BLOCKS).filter("_kind = 2")
    left = F.col("_cum") * F.exp(-(F.col("_at") * F.col("_s.rate") - F.col("_block") * SPAN))
    since_zero = F.exp(-F.col("_s.rate") * F.col("time"))
    return summed.groupBy("ID", row_key).agg(
        F.max("time").alias("time"),
        *[F.sum(F.col(f"_s.dose_{c}") * left + F.col(f"_s.init_{c}") * since_zero).alias(c)
          for c in model.compartments])


def regimen_response(df: DataFrame, model: LinearModel, dose_times: list[float], amount: float,
                     initial: dict[str, str]) -> DataFrame:
    """The same amounts when all rows share a short fixed dose list: a pure projection.

    ``df`` carries the individual parameters and ``time``; no join, no shuffle.
    """
    rated = with_rates(df, model)
    time = F.col("time")
    unit = response(model, "GUT")
    present = from_initial(model, {c: F.col(column) for c, column in initial.items()})
    amounts = {}
    for c in model.compartments:
        total = evaluate(present[c], time)
        for t in dose_times:
            since = time - (F.lit(float(t)) + F.col("_lag"))
            total = total + F.when(since >= 0, amount * evaluate(unit[c], since)).otherwise(0.0)
        amounts[c] = total
    out = rated.withColumns(amounts)
    return out.drop(*[c for c in out.columns if c.startswith("_")])
