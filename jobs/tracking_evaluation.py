"""Evaluation of tracking results against ground truth, by sequence.

Reads the pixel tables of truth and result (seq, frame, y, x, label), optionally outlines, and both track tables
(seq, label, begin, end, parent), diagnoses every sequence and writes one long table partitioned by sequence: counts of
every kind of failure by frame, and a few numbers of the sequence. A sequence that can't be judged (only one side has it, or
no frame is common) is a row that says so and never stops the others. Partitions are overwritten dynamically and every judged
sequence has rows, so that a rerun replaces what it wrote before; ``sequences`` restricts a run to those that changed.

    spark-submit jobs/tracking_evaluation.py --truth PIXELS --result PIXELS --truth_tracks TRACKS --result_tracks TRACKS --out FOLDER

Output: ``FOLDER`` (seq), Parquet.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from jobs.common import command_line, log  # noqa: E402
from tessera.operators import failures, tracks  # noqa: E402
from tessera.sources.shared import written_once  # noqa: E402

EVALUATION = "level string, frame int, measure string, n bigint, seq string"
KEY = ["seq", "frame"]


@dataclass(frozen=True)
class Config:
    """Limits of the diagnosis, and the sequences of this run (none: all)."""

    coverage: float = 0.5
    iou: float = 0.5
    split: float = 0.2
    jump: float = 50.0
    jump_factor: float = 5.0
    sequences: list[str] = field(default_factory=list)

    def limits(self) -> failures.Limits:
        return failures.Limits(self.coverage, self.iou, self.split, self.jump, self.jump_factor)


def status(frames: DataFrame) -> DataFrame:
    """(seq, status) of every sequence that either side has: ok, no result, no truth or no common frame."""
    some = frames.groupBy("seq").agg(F.max("result").alias("r"), F.max(F.col("marked") | F.col("outlined")).alias("t"), F.max("common").alias("common"))
    return some.select("seq", F.when(~F.col("r"), "no result").when(~F.col("t"), "no truth").when(~F.col("common"), "no common frame").otherwise("ok").alias("status"))


def evaluation(gt: DataFrame, res: DataFrame, gt_tracks: DataFrame, res_tracks: DataFrame, seg: DataFrame | None = None, limits: failures.Limits = failures.Limits()) -> DataFrame:
    """Rows (level, frame, measure, n, seq): 'frame' rows count failures by kind, 'sequence' rows hold the status (n: 1) and totals.

    Pixels are read and shuffled once; status, totals and events come from their counts by labels in place, written once.
    """
    counts = written_once(failures.pixel_counts(gt, res, seg), "counts")
    for name, side in zip(("truth", "result", "outlines"), ("a", "b", "c"), strict=True):
        if side in counts.columns:
            read = counts.filter(F.col(side).isNotNull()).agg(F.coalesce(F.sum("n"), F.lit(0)), F.countDistinct(F.struct("seq", "frame", side))).first()
            log.info("%s: %d pixels read, %d labels in frames", name, *read)
    frames = failures.seen_frames(counts)
    state = written_once(status(frames), "status")
    good = state.filter("status = 'ok'").select("seq")
    gt_tracks, res_tracks = (x.join(good, "seq", "left_semi") for x in (gt_tracks, res_tracks))
    events = failures.counted_events(counts, gt_tracks, res_tracks, limits, frames)
    by_frame = failures.by_frame(events).select(F.lit("frame").alias("level"), "frame", F.col("event_type").alias("measure"), F.col("count").alias("n"), "seq")
    none = F.lit(None).cast("int").alias("frame")

    def total(df: DataFrame, measure: str) -> DataFrame:
        return df.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).select(F.lit("sequence").alias("level"), none, F.lit(measure).alias("measure"), "n", "seq")

    seen, seen_res = (counts.filter(F.col(side).isNotNull()).select("seq", F.col(side).alias("label"), "frame").distinct() for side in ("a", "b"))
    common = frames.filter("common").select(*KEY)
    states = state.select(F.lit("sequence").alias("level"), none, F.concat(F.lit("status: "), F.col("status")).alias("measure"), F.lit(1).cast("bigint").alias("n"), "seq")
    totals = (
        total(common, "common frames"),
        total(seen.join(common, KEY, "left_semi"), "truth objects"),
        total(seen_res.join(common, KEY, "left_semi"), "result objects"),
        total(tracks.runs(seen_res), "result runs"),
    )
    out = by_frame.unionByName(states)
    for t in totals:
        out = out.unionByName(t)
    return out


def read_evaluation(spark: SparkSession, out: str) -> DataFrame:
    """The evaluation as it stands."""
    return spark.read.schema(EVALUATION).parquet(out)


def run(spark: SparkSession, truth: str, result: str, truth_tracks: str, result_tracks: str, out: str, outlines: str | None = None, config: Config = Config()) -> int:
    """Evaluate the sequences of one run into ``out``; the number of rows written."""
    paths = {"truth": truth, "result": result, "truth tracks": truth_tracks, "result tracks": result_tracks, "outlines": outlines}
    tables = {}
    for name, path in paths.items():
        if path:
            rows = spark.read.parquet(path)
            rows = rows.withColumn("seq", F.col("seq").cast("string"))
            tables[name] = rows.filter(F.col("seq").isin(config.sequences)) if config.sequences else rows
            log.info("reading %s from %s", name, path)
    rows = evaluation(tables["truth"], tables["result"], tables["truth tracks"], tables["result tracks"], tables.get("outlines"), config.limits())
    rows = written_once(rows, "evaluation")
    written = rows.count()
    # a file for each sequence, not one from every task; the number keeps few megabytes of many files from becoming few tasks
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(pieces, "seq").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("seq").parquet(out)
    bad = read_evaluation(spark, out).filter("measure like 'status: %' and measure <> 'status: ok'").count()
    log.info("%d rows written to %s; sequences there that could not be judged: %d", written, out, bad)
    return written


if __name__ == "__main__":
    inputs = {"truth": "pixels of the ground truth", "result": "pixels of the result", "truth_tracks": "tracks of the ground truth", "result_tracks": "tracks of the result", "out": "folder of the output", "outlines": "optional: pixels of the annotated outlines"}
    command_line(__doc__, inputs, run, Config)
