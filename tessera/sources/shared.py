"""Intermediate tables in the folder that the cluster shares.

A table that several results need is written once under ``spark.checkpoint.dir`` (unset: below the
warehouse) and read back: lineage ends there, and a lost executor costs a re-read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share; an error where only a folder of one machine is known to a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera_scratch"
    if not spark.sparkContext.master.startswith("local") and base.split(":", 1)[0] in ("file", base):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base


#: For rows of many kilobytes: scans and writers hold thousands of rows of a file at once, so a file has few. Without
#: dictionaries, as those hide from the writer how large the shredded numbers of a document are once they are read.
WIDE = {"maxRecordsPerFile": "200", "parquet.block.size": str(4 << 20), "parquet.enable.dictionary": "false"}


def written_once(df: DataFrame, tag: str, wide: bool = False) -> DataFrame:
    """A scan of ``df`` written to the shared folder; deleted when the driver ends.

    Joins with it are merged: by its compressed size Spark would broadcast tables of many millions of rows through the driver. ``wide``: rows hold whole documents.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    df.write.options(**(WIDE if wide else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")
