"""The jobs as named queries: each runs twice into one new folder, and the output is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans.queries import SQL_BASE, Masks
from tessera.sources.shared import shared_dir

from . import series_audit, tracking_evaluation


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_tracking_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks derived from ``lineitem`` are written as tables, evaluated twice and read back."""
    folder, m = _folder(spark, "job1"), Masks(spark, sf_dir)
    tables = {"truth": "gt", "result": "res", "outlines": "seg", "truth_tracks": "gt_tracks", "result_tracks": "res_tracks"}
    for name, made in tables.items():
        df = getattr(m, made)
        df.write.parquet(f"{folder}/{name}")
        m.__dict__[made] = spark.read.schema(df.schema).parquet(f"{folder}/{name}")  # the tracks come from the written masks
    for _ in range(2):
        tracking_evaluation.run(spark, **{n: f"{folder}/{n}" for n in tables}, out=f"{folder}/evaluation")
    return tracking_evaluation.read_evaluation(spark, f"{folder}/evaluation")


def job2_series_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations through the file stream; the second run finds nothing new."""
    folder = _folder(spark, "job2")
    for _ in range(2):
        series_audit.run(spark, f"{sf_dir}/conversations.parquet*", f"{folder}/out", f"{folder}/checkpoint")
    return series_audit.read_audit(spark, f"{folder}/out")


#: The derived masks' sequences all have common frames, so each has one status row.
SQL_1 = f"""{SQL_BASE}, common AS (
  SELECT DISTINCT g.seq, g.frame FROM gto g JOIN reso r ON g.seq = r.seq AND g.frame = r.frame
)
SELECT 'frame' AS level, frame, event_type AS measure, count(*) AS n, seq FROM ev GROUP BY seq, frame, event_type
UNION ALL SELECT 'sequence', NULL, 'status: ok', 1, seq FROM common GROUP BY seq
UNION ALL SELECT 'sequence', NULL, 'common frames', count(*), seq FROM common GROUP BY seq
UNION ALL SELECT 'sequence', NULL, 'truth objects', count(*), seq FROM gto JOIN common USING (seq, frame) GROUP BY seq
UNION ALL SELECT 'sequence', NULL, 'result objects', count(*), seq FROM reso JOIN common USING (seq, frame) GROUP BY seq
UNION ALL SELECT 'sequence', NULL, 'result runs', count(*), seq FROM runs GROUP BY seq"""

SQL_2 = """WITH numbered AS (
  SELECT conv_id, turn, role FROM conversations WHERE turn IS NOT NULL
), turns AS (
  SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM numbered) t
), streaks AS (
  SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id, role ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn, role FROM numbered) t
), a AS (
  SELECT conv_id, count(*) AS n_rows, count(*) - count(turn) AS n_unnumbered, min(turn) AS first_number, max(turn) AS last_number, count(DISTINCT turn) AS n_numbers, CAST(sum(coalesce(octet_length(encode(text)), 0)) AS BIGINT) AS n_bytes
  FROM conversations GROUP BY conv_id
), r AS (
  SELECT conv_id, count(*) AS n_runs FROM turns WHERE before IS NULL OR before < turn - 1 GROUP BY conv_id
), s AS (
  SELECT conv_id, count(*) AS n_streaks FROM streaks WHERE before IS NULL OR before < turn - 1 GROUP BY conv_id
), b AS (
  SELECT conv_id AS series, n_rows, n_unnumbered, n_numbers, first_number, last_number, coalesce(last_number - least(first_number, 0) + 1 - n_numbers, 0) AS n_missing,
    n_rows - n_unnumbered - n_numbers AS n_repeated, coalesce(n_runs, 0) AS n_runs, coalesce(n_streaks, 0) AS n_streaks, n_bytes, coalesce(conv_id // 100000, -1) AS part
  FROM a LEFT JOIN r USING (conv_id) LEFT JOIN s USING (conv_id)
)
SELECT series, n_rows, n_unnumbered, n_numbers, first_number, last_number, n_missing, n_repeated, n_runs, n_streaks, n_bytes, n_missing = 0 AND n_repeated = 0 AND n_unnumbered = 0 AS whole, part FROM b"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_tracking_evaluation": job1_tracking_evaluation, "job2_series_audit": job2_series_audit}


def oracle_sql() -> dict[str, str]:
    return {"job1_tracking_evaluation": SQL_1, "job2_series_audit": SQL_2}
