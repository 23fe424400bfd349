"""Small things the operators share: splits by id, hand-off tables, input guards."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studyframe.session import scratch_path, shared_folder

#: Rows of texts or sets that are handed to a Python worker together.
BATCH_ROWS = 1000


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def handed_off(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and read it again, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go(df: DataFrame) -> None:
    """Delete the hand-off tables that ``df`` reads, once nothing reads them any more; disk holds what is still needed."""
    context = df.sparkSession.sparkContext
    root = shared_folder(df.sparkSession).rstrip("/")
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root.split(":", 1)[-1].lstrip("/") in path:
            gone = context._jvm.org.apache.hadoop.fs.Path(path)
            gone.getFileSystem(context._jsc.hadoopConfiguration()).delete(gone, True)


@contextmanager
def _meanwhile(spark: SparkSession, name: str, value: str, default: str) -> Iterator[None]:
    before = spark.conf.get(name, default)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_let_go(spark: SparkSession) -> AbstractContextManager[None]:
    """Meanwhile, the shuffle files of a query go when it ends, not whenever the driver collects its garbage. For steps that only hand off tables."""
    return _meanwhile(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true", "false")


def small_batches(spark: SparkSession) -> AbstractContextManager[None]:
    """Meanwhile, rows go to Python BATCH_ROWS at a time at most, so that neither side of the pipe holds more. For steps that only hand off tables."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    return _meanwhile(spark, name, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS), str(now))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
