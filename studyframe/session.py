"""Session settings the operators are designed for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "studyframe", **settings: str) -> SparkSession:
    """Session with adaptive execution, skew-join splitting and a UTC clock.

    The master and the number of shuffle partitions come from the cluster (or
    from ``settings``); nothing here assumes a machine size.
    """
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local: list[str] = []  # the folder of a local session


def shared_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Without one, a session whose executors are its own process (local tests) gets a temporary
    folder; on a cluster that is an error, since other machines could not see such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="studyframe-"))
    return _local[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a hand-off table."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` below the shared folder and read it again.

    Used between the stages of long jobs, so that a lost executor costs one stage and not the
    whole chain. Tables stay until ``drop_written``.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Delete the hand-off tables of this process, once the results that read them have been used; returns how many."""
    context = spark.sparkContext
    gone = 0
    while _written:
        path = context._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return gone
