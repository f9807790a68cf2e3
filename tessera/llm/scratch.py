"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` and reading it back, so
a lost executor costs a re-read and never a recomputation of a Python stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.shared import shared_dir

#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = 1000


def _filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    target, system = _filesystem(spark, path)
    system.deleteOnExit(target)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path of ``fresh_path`` that nothing reads any more."""
    target, system = _filesystem(spark, path)
    system.delete(target, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Python workers get at most so many rows at a time from what runs inside: whole texts are rows, so batches weigh megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    if 0 < before <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, str(before))


def materialise(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it (exact size statistics)."""
    spark = df.sparkSession
    path = path or fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    """Partitions for an explicit repartition by key: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
