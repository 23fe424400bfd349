"""Typed readers for study input and a Parquet hand-off for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "NR"  # Fixed value: the study sheet's token for "not recorded"

STUDY_SCHEMA = T.StructType(
    [T.StructField("ID", T.DoubleType()), T.StructField("TRT", T.StringType()),
     T.StructField("MAT", T.StringType()), T.StructField("SAMPLE", T.DoubleType()),
     T.StructField("DATST", T.TimestampNTZType()), T.StructField("DATEN", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType())
       for c in ("VOL", "SOD", "SECR", "CAL", "NACL", "CRCL", "CACL")])

POINT_SCHEMA = T.StructType([T.StructField("Conc", T.DoubleType()),
                             T.StructField("Eff", T.DoubleType())])


def read_study(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Study sheet with fixed names and types; the file's own header is skipped."""
    if fmt == "csv":
        return (spark.read.schema(STUDY_SCHEMA)
                .options(header=True, enforceSchema=True, nullValue=MISSING).csv(path))
    raw = spark.read.format(fmt).load(path)
    return raw.select(*[F.col(f.name).cast(f.dataType) for f in STUDY_SCHEMA])


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Header-less two-column dose-effect points."""
    return spark.read.schema(POINT_SCHEMA).csv(path)


def write_result(df: DataFrame, path: str, partition: str | None = "SIM",
                 mode: str = "overwrite") -> None:
    """Persist a result; partitioned by replicate so that later jobs prune directories.

    Rows are dealt by replicate and rebalanced by size: adaptive execution splits a large
    replicate into several files and lets small ones share a task, so the number of files
    follows the data.
    """
    if partition:
        df.hint("rebalance", F.col(partition)).write.mode(mode).partitionBy(partition).parquet(path)
    else:
        df.write.mode(mode).parquet(path)


def read_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
