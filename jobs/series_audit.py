"""Audit of numbered series as they arrive: holes, repeated numbers and streaks of every series.

Frames of a recording or turns of a conversation come in files, late and in pieces. Every run takes the files that
are new since the last one (a file stream with ``availableNow``; its checkpoint is the mark), stores their numbers
without the texts by part of the id range and batch, and audits the parts that the batch touched again from all their stored
numbers. Both writes overwrite partitions dynamically, so a batch that is replayed after a failure gives the same tables.

    spark-submit jobs/series_audit.py --source TURNS --out FOLDER --checkpoint FOLDER --config jobs/series_audit.json

Output: ``FOLDER/numbers`` (part, batch) and ``FOLDER/audit`` (part), both Parquet.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import command_line, log  # noqa: E402
from tessera.operators import tracks  # noqa: E402

AUDIT = (
    "series bigint, n_rows bigint, n_unnumbered bigint, n_numbers bigint, first_number bigint, last_number bigint, n_missing bigint, "
    "n_repeated bigint, n_runs bigint, n_streaks bigint, n_bytes bigint, whole boolean, part bigint"
)
NUMBERS = "series bigint, number bigint, kind string, n_rows bigint, n_bytes bigint, part bigint, batch bigint"


@dataclass(frozen=True)
class Config:
    """Columns of the source; ids of a part; numbers of a block (a group of the run search); first number that a series should have."""

    series: str = "conv_id"
    number: str = "turn"
    kind: str = "role"
    text: str = "text"
    ids_each_part: int = 100_000
    numbers_each_block: int = 4096
    first_number: int = 0
    files_each_batch: int = 1000


def numbers_of(rows: DataFrame, config: Config) -> DataFrame:
    """(part, series, number, kind, n_rows, n_bytes): rows without their texts, equal ones counted; ids without a part are in part -1."""
    part = F.coalesce(F.floor(F.col(config.series) / config.ids_each_part), F.lit(-1)).cast("long")
    picked = rows.select(part.alias("part"), F.col(config.series).cast("long").alias("series"), F.col(config.number).cast("long").alias("number"), F.col(config.kind).cast("string").alias("kind"), F.octet_length(config.text).alias("b"))
    grouped = picked.groupBy("part", "series", "number", "kind")
    return grouped.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce("b", F.lit(0)).cast("long")).alias("n_bytes"))


def _runs(frames: DataFrame, block: int) -> DataFrame:
    """(series, n) maximal runs of numbers of each label, found block by block so that no group grows with a series.

    A run that starts at a block's first number and follows one that ends just before is that one's continuation.
    """
    blocks = frames.select(F.col("series").alias("seq"), F.struct("kind", F.floor(F.col("number") / block).alias("block")).alias("label"), F.col("number").alias("frame"))
    found = tracks.runs(blocks).select("seq", F.col("label.kind").alias("kind"), "begin", "end")
    ends = found.select(F.col("seq").alias("s"), F.col("kind").alias("k"), (F.col("end") + 1).alias("next"))
    starts = found.filter(F.pmod(F.col("begin"), F.lit(block)) == 0)
    same = F.col("seq").eqNullSafe(F.col("s")) & F.col("kind").eqNullSafe(F.col("k")) & (F.col("begin") == F.col("next"))
    again = starts.join(ends, same, "left_semi").select("seq", F.lit(-1).alias("n"))
    return found.select("seq", F.lit(1).alias("n")).unionByName(again).groupBy(F.col("seq").alias("series")).agg(F.sum("n").alias("n"))


def audit(numbers: DataFrame, config: Config = Config()) -> DataFrame:
    """One row per series of rows like ``numbers_of``, whatever the batches they came in.

    Rows without a number count in ``n_unnumbered`` alone; a null series is a series. Holes count from ``first_number`` (or an
    earlier first one) to the last; ``n_repeated`` are rows beyond one a number; runs are maximal without a hole, streaks maximal
    of one kind (null is a kind) without a hole. ``whole``: no hole, no repetition, nothing unnumbered.
    """
    per_number = numbers.filter("number is not null").groupBy("part", "series", "number").agg(F.sum("n_rows").alias("n_rows"))
    runs = _runs(per_number.select("series", "number", F.lit(None).cast("string").alias("kind")), config.numbers_each_block)
    streaks = _runs(numbers.filter("number is not null").select("series", "number", "kind").distinct(), config.numbers_each_block)
    distinct = per_number.groupBy("series").agg(F.count(F.lit(1)).alias("n_numbers"))
    totals = numbers.groupBy("part", "series").agg(F.sum("n_rows").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("number").isNull(), F.col("n_rows"))), F.lit(0)).alias("n_unnumbered"), F.min("number").alias("first_number"), F.max("number").alias("last_number"), F.sum("n_bytes").alias("n_bytes"))
    out = totals
    for side, name in ((distinct, "n_numbers"), (runs.withColumnRenamed("n", "n_runs"), "n_runs"), (streaks.withColumnRenamed("n", "n_streaks"), "n_streaks")):
        side = side.withColumnRenamed("series", "s")
        out = out.join(side, F.col("series").eqNullSafe(F.col("s")), "left").drop("s").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))
    first = F.least("first_number", F.lit(config.first_number))
    out = out.withColumn("n_missing", F.coalesce(F.col("last_number") - first + 1 - F.col("n_numbers"), F.lit(0)))
    out = out.withColumn("n_repeated", F.col("n_rows") - F.col("n_unnumbered") - F.col("n_numbers"))
    whole = (F.col("n_missing") == 0) & (F.col("n_repeated") == 0) & (F.col("n_unnumbered") == 0)
    return out.withColumn("whole", whole).select(*[c.split()[0] for c in AUDIT.split(", ")])


def read_audit(spark: SparkSession, out: str) -> DataFrame:
    """The audit as it stands."""
    return spark.read.schema(AUDIT).parquet(f"{out}/audit")


def run(spark: SparkSession, source: str, out: str, checkpoint: str, config: Config = Config()) -> int:
    """Take what is new in ``source`` (a Parquet file, folder or pattern) and bring the audit up to date; the number of new rows."""
    taken = 0

    def take(rows: DataFrame, batch: int) -> None:
        nonlocal taken
        session = rows.sparkSession
        fresh = numbers_of(rows, config).withColumn("batch", F.lit(batch).cast("long"))
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(f"{out}/numbers")
        stored = session.read.schema(NUMBERS).parquet(f"{out}/numbers")
        new = stored.filter(F.col("batch") == batch)
        touched = new.select("part").distinct()
        result = audit(stored.join(touched, "part", "left_semi"), config)
        result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{out}/audit")
        read, series = new.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0], read_audit(session, out).join(touched, "part", "left_semi").count()
        taken += read
        log.info("batch %d: %d rows read from %s, %d series written to %s/audit", batch, read, source, series, out)

    for name, columns, by in (("numbers", NUMBERS, ["part", "batch"]), ("audit", AUDIT, ["part"])):  # there even if nothing comes
        spark.createDataFrame([], columns).write.mode("append").partitionBy(*by).parquet(f"{out}/{name}")
    columns = spark.read.parquet(source).schema
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", config.files_each_batch).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    log.info("%d new rows; the audit is in %s/audit", taken, out)
    return taken


if __name__ == "__main__":
    command_line(__doc__, {"source": "Parquet table of numbered rows", "out": "folder of the output", "checkpoint": "folder of the stream's checkpoint"}, run, Config)
