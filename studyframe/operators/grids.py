"""Time grids, regimens and replication: narrow explodes, no cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRID_CMT = 1


def spread(scan: DataFrame) -> DataFrame:
    """Rebalance a scan that has fewer splits than the cluster has cores.

    For small files ahead of an explode that multiplies their rows; a scan with enough
    splits is returned as it is. Use on scans only: asking a plan that shuffles for its
    partitions would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def _steps(last: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))


def time_grid(ids: DataFrame, start: float, stop: float, by: float,
              cmt: int = GRID_CMT) -> DataFrame:
    """Every subject at ``start, start+by, .., stop`` (integer steps, then scaled)."""
    last = int((stop - start) / by + 1e-9)
    return ids.select(*ids.columns, _steps(last).alias("_k")).select(
        *ids.columns, (F.lit(float(start)) + F.col("_k") * float(by)).alias("time"),
        F.lit(0.0).alias("amt"), F.lit(0).alias("evid"), F.lit(0).alias("rate"),
        F.lit(cmt).alias("cmt"))


def regimen_grid(ids: DataFrame, obs_times: list[float], dose_times: list[float],
                 dose_amt: float, cmt: int, per_sim: int) -> DataFrame:
    """Subject x listed times; dosed where the time is a dose time; SIM is the id block."""
    dosed = F.col("time").isin([float(t) for t in dose_times])
    times = F.array(*[F.lit(float(t)) for t in obs_times])
    return (ids.withColumn("time", F.explode(times))
            .withColumns({
                "amt": F.when(dosed, float(dose_amt)).otherwise(0.0),
                "cmt": F.lit(cmt), "rate": F.lit(0),
                "SIM": (F.floor((F.col("ID") - 1) / per_sim) + 1).cast("long")})
            .withColumn("evid", (F.col("amt") != 0).cast("int")))


def expand_doses(ids: DataFrame, amts: list[float], ii: float, addl: int) -> DataFrame:
    """Each subject on each amount, repeated every ``ii`` hours ``addl`` more times."""
    return (ids.withColumn("amt", F.explode(F.array(*[F.lit(float(a)) for a in amts])))
            .select("*", _steps(addl).alias("dose_no"))
            .withColumns({"time": F.col("dose_no") * float(ii), "evid": F.lit(1)}))


def log_grid(spark: SparkSession, last: int = 32, per_decade: int = 8,
             offset: float = 0.65) -> DataFrame:
    """``10 ** (k / per_decade - offset)`` for k = 0..last."""
    return spark.range(last + 1).select(
        F.col("id").alias("k"),
        F.pow(F.lit(10.0), F.col("id") / per_decade - offset).alias("Conc"))


def repeat_rows(df: DataFrame, values: list[float], name: str) -> DataFrame:
    """One copy of each row per value."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def replicate_subjects(df: DataFrame, nsim: int, n_subjects: int) -> DataFrame:
    """Whole study per replicate; ``ID = sim * n_subjects + ID`` with SIM from 1."""
    return (df.select("*", _steps(nsim - 1).alias("_sim"))
            .withColumns({"ID": F.col("_sim") * n_subjects + F.col("ID"),
                          "SIM": F.col("_sim") + 1})
            .drop("_sim"))
