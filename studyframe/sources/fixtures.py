"""Study-shaped views over the shared test tables (all narrow projections of scans)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studyframe.operators.grids import spread

REPLICATES = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw study sheet; urine rows carry an end time and a volume."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS ID_ORIG",
        "CASE WHEN user_id % 2 = 0 THEN 'Caffeine' ELSE 'Placebo' END AS TRT",
        "CASE WHEN event_type IN ('view','click','error') THEN 'Plasma' ELSE 'Urine' END AS MAT",
        "event_id AS SAMPLE",
        "CASE WHEN event_id % 53 = 0 THEN NULL ELSE ts END AS DATST",
        "CASE WHEN event_type IN ('purchase','signup') THEN ts + INTERVAL '2' HOUR END AS DATEN",
        "CASE WHEN event_type IN ('purchase','signup') "
        "THEN CAST(0.1 + 0.001 * (event_id % 900) AS DOUBLE) END AS VOL",
        "CAST(130 + event_id % 17 AS DOUBLE) AS SOD",
        "CAST(60 + event_id % 60 AS DOUBLE) AS SECR",
        "CASE WHEN event_id % 29 = 0 THEN NULL ELSE 2.0D + value / 1000 END AS CAL",
        "CAST(100 + event_id % 11 AS DOUBLE) AS NACL",
        "CASE WHEN event_id % 7 = 0 OR user_id % 31 = 0 THEN NULL "
        "ELSE CAST(5 + (event_id % 40) / 8.0D AS DOUBLE) END AS CRCL",
        "CAST(1 + event_id % 5 AS DOUBLE) AS CACL")


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations folded onto a 48 h clock; ``tick`` counts minutes."""
    tick = ("CAST((extract(DAY FROM ts) % 2) * 1440 + extract(HOUR FROM ts) * 60 "
            "+ extract(MINUTE FROM ts) AS BIGINT)")
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS ID", "user_id AS ID_ORIG", "event_id AS OBS",
        "CASE WHEN user_id % 2 = 0 THEN 'Caffeine' ELSE 'Placebo' END AS TRT",
        f"{tick} AS tick", f"CAST({tick} AS DOUBLE) / 60 AS time", "value AS CALAMT")


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prediction per observation."""
    return observed(spark, sf_dir).selectExpr(
        "ID_ORIG", "OBS", "tick", "time", "20 + 0.5D * time + 0.01D * (OBS % 100) AS P_PRED")


def simulated(spark: SparkSession, sf_dir: str, replicates: int = REPLICATES) -> DataFrame:
    """``replicates`` simulated copies of every observation."""
    sims = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long")))
    return (spread(observed(spark, sf_dir)).withColumn("SIM", sims)
            .selectExpr("ID", "ID_ORIG", "OBS", "TRT", "tick", "time", "SIM",
                        "CALAMT * (0.8D + 0.02D * ((OBS * 7 + SIM * 13) % 21)) AS P"))


def regimen_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doses and observations over 30 days; ``tick`` counts seconds."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS ID", "event_id AS REC",
        "CAST((extract(DAY FROM ts) - 1) * 86400 + extract(HOUR FROM ts) * 3600 "
        "+ extract(MINUTE FROM ts) * 60 AS BIGINT) AS tick",
        "CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS evid",
        "CASE WHEN event_type = 'signup' THEN CAST(100 + user_id % 5 * 25 AS DOUBLE) "
        "ELSE CAST(0 AS DOUBLE) END AS amt",
        "CASE WHEN event_type = 'signup' THEN 25 ELSE 26 END AS cmt", "0 AS rate",
        "value AS UCA")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration-effect points, one dataset per brand."""
    conc = "CAST(1 + p_partkey % 400 AS DOUBLE) / 4"
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand AS dataset", f"{conc} AS Conc",
        f"100 * ({conc}) / (30 + {conc}) + ((p_partkey * 37) % 11 - 5) AS Eff")


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariates per subject."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS ID", "CAST(60 + c_custkey % 60 AS DOUBLE) AS secr",
        "CAST(20 + c_custkey % 60 AS DOUBLE) AS age", "c_custkey % 2 AS sex",
        "CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS black",
        "CAST(50 + c_custkey % 60 AS DOUBLE) AS wt",
        "CAST(150 + c_custkey % 45 AS DOUBLE) AS ht", "c_mktsegment AS grp")
