"""Joins that replace row-position pairing by keys, and interval assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from studyframe.functions.clock import TICKS_PER_HOUR, tick
from studyframe.operators.grids import replicate_subjects
from studyframe.operators.grouping import first_per, join_on, ordinal, running_max, running_sums

# The common baseline, and the fitted maximum inhibition.
COMMON_P_0 = 33.32
FITTED_EMAX = 0.446
SCENARIOS = ["none", "common_p0", "own_p0", "own_gfr", "own_both_emax"]


def attach_attributes(population: DataFrame, attributes: DataFrame, key: str) -> DataFrame:
    """Inner join of subject attributes. Adaptive execution broadcasts them if they are small."""
    return population.join(attributes, key, "inner")


def merge_sorted(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join ordered by its key."""
    return left.join(right, key, "inner").orderBy(key)


def simulation_keys(subjects: DataFrame, nsim: int, n_subjects: int) -> DataFrame:
    """ID, ID_ORIG, TRT, SIM of every simulated individual."""
    return replicate_subjects(subjects.select("ID", "ID_ORIG", "TRT"), nsim, n_subjects)


def label_simulated(output: DataFrame, keys: DataFrame) -> DataFrame:
    """Attach original id, arm and replicate to simulated output by ID."""
    return output.join(keys, "ID", "inner")


def attach_predictions(df: DataFrame, predictions: DataFrame, keys: list[str], time: str,
                       values: list[str], dedupe: list[str] | None = None,
                       per_hour: int = TICKS_PER_HOUR) -> DataFrame:
    """Join predictions on keys and a floating-point time, via an integer tick.

    ``dedupe`` lists order columns: the first prediction per key and tick then wins.
    """
    pred = predictions.withColumn("_tick", tick(F.col(time), per_hour))
    if dedupe:
        pred = first_per(pred, [*keys, "_tick"], [F.asc_nulls_last(c) for c in dedupe])
    pred = pred.select(*keys, "_tick", *values)
    return (df.withColumn("_tick", tick(F.col(time), per_hour))
            .join(pred, [*keys, "_tick"], "inner").drop("_tick"))


def zip_columns(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str],
                right_order: list[str], unpaired: str = "keep") -> DataFrame:
    """Pair the k-th rows of two tables within each key (a keyed column bind).

    Where one table has more rows of a key, the rest is kept with nulls in the other's
    columns (``unpaired="keep"``), is an error (``"fail"``) or is left out (``"drop"``).
    """
    if unpaired not in ("keep", "fail", "drop"):
        raise ValueError("unpaired must be keep, fail or drop")
    a = ordinal(left, keys, left_order, "_k").withColumn("_a", F.lit(True))
    b = ordinal(right, keys, right_order, "_k").withColumnsRenamed(
        {k: f"__{k}" for k in [*keys, "_k"]}).withColumn("_b", F.lit(True))
    same = F.lit(True)
    for k in [*keys, "_k"]:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = a.join(b, same, "inner" if unpaired == "drop" else "full")
    out = out.withColumns({k: F.coalesce(k, f"__{k}") for k in keys})
    if unpaired == "fail":
        missing = F.col("_a").isNull() | F.col("_b").isNull()
        out = out.filter(F.when(missing, F.raise_error(F.lit("a row has no partner")).cast("boolean"))
                         .otherwise(True))
    return out.drop("_a", "_b", "_k", *[f"__{k}" for k in [*keys, "_k"]])


def paired_difference(df: DataFrame, keys: list[str], flag: str, order: list[str],
                      values: dict[str, str], carry: list[str] | None = None) -> DataFrame:
    """End (flag 1) minus start (flag 0) of the k-th collection of each subject.

    ``values`` maps output to input column; ``carry`` columns come from the end row.
    Only complete pairs are returned.
    """
    numbered = ordinal(df, [*keys, flag], order, "pair")
    end, start = F.col(flag) == 1, F.col(flag) == 0
    differences = [(F.max(F.when(end, F.col(c))) - F.max(F.when(start, F.col(c)))).alias(out)
                   for out, c in values.items()]
    kept = [F.max(F.when(end, F.col(c))).alias(c) for c in carry or []]
    return (numbered.groupBy(*keys, "pair")
            .agg(*differences, *kept, F.count_if(end).alias("_ends"), F.count_if(start).alias("_starts"))
            .filter("_ends > 0 AND _starts > 0").drop("_ends", "_starts"))


def cycle_index(df: DataFrame, keys: list[str], order: list[str], length: int,
                out: str = "cycle") -> DataFrame:
    """Repeating 1..length along the order of each subject."""
    return (ordinal(df, keys, order, "_k")
            .withColumn(out, F.pmod(F.col("_k") - 1, F.lit(length)) + 1).drop("_k"))


def block_index(number: Column, size: int) -> Column:
    """1-based block of a 1-based number."""
    return (F.floor((number - 1) / size) + 1).cast("long")


def collection_window(df: DataFrame, keys: list[str], is_start: Column, time: str, value: str,
                      order: list[str], inclusive: bool) -> DataFrame:
    """Assign each row to the latest collection start of its subject.

    Adds ``DAY`` (the number of the start), ``dTIME`` and ``dUCA`` relative to it. A subject
    may have any number of starts; the last day is open ended. Rows before the first start
    have no day and are left out, as are rows at the very time of a start unless
    ``inclusive``. The rows are one sequence along ``order``, which begins with ``time``: starts
    are numbered by a running count, and each row takes the last start at or before its time,
    so the work is linear in the rows of a subject.
    """
    rows = df.filter(F.col(time).isNotNull()).withColumn("_one", F.when(is_start, 1).otherwise(0))
    numbered = running_sums(rows, keys, order, {"_day": "_one"})
    start = F.when(F.col("_one") == 1, F.struct(F.col("_day").cast("int").alias("day"), F.col(time).alias("t"), F.col(value).alias("v")))
    found = running_max(numbered, keys, time, start, "_last").filter("_last IS NOT NULL")
    if not inclusive:
        found = found.filter(F.col(time) > F.col("_last.t"))
    return found.withColumns({
        "DAY": F.col("_last.day"), "dTIME": F.col(time) - F.col("_last.t"),
        "dUCA": F.col(value) - F.col("_last.v")}).drop("_one", "_day", "_last")


def override_params(population: DataFrame, attributes: DataFrame, key: str,
                    scenarios: list[str] | None = None) -> DataFrame:
    """One copy of the population per scenario, with its P_0 / GFR_0 / PDEMAX overrides.

    Null means that the model's default stays in force.
    """
    names = F.array(*[F.lit(s) for s in scenarios or SCENARIOS])
    joined = population.join(
        attributes.select(key, F.col("P_0").alias("_p0"), F.col("GFR_0").alias("_gfr")), key)
    out = joined.withColumn("scenario", F.explode(names))
    s = F.col("scenario")
    return out.withColumns({
        "P_0": F.when(s == "common_p0", F.lit(COMMON_P_0))
        .when(s.isin("own_p0", "own_both_emax"), F.col("_p0")),
        "GFR_0": F.when(s.isin("own_gfr", "own_both_emax"), F.col("_gfr")),
        "PDEMAX": F.when(s == "own_both_emax", F.lit(FITTED_EMAX))}).drop("_p0", "_gfr")
