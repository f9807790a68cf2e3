"""Seconds of the headline queries, as one JSON line.

$BENCH_SF_DIR: tables (default /root/testdata/sf0.1); $BENCH_CPUS: local cores (default 8). Each query
runs over its whole tables and is written to a sink that keeps nothing; masks are made with 200
sequences, so that their size follows the scale factor.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from tessera.plans.queries import _QUERIES, Masks  # noqa: E402

HEADLINE = (
    "object_areas",
    "best_overlap_gt",
    "iou_pairs",
    "id_switches",
    "failures_by_track",
    "failure_cube",
    "track_export",
    "temporal_downsample_tracks",
    "split_discontinuous",
    "violations_all",
    "contacts",
    "parent_inference",
    "rescue_confidence",
    "open3",
    "lineage_layout",
    "strict_tracker",
    "division_normalisation",
    "event_sessions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs = {name: (lambda f=_QUERIES[name][0]: f(Masks(spark, sf_dir, sequences=200))) for name in HEADLINE}
    try:
        from tessera.llm import registry
    except ImportError:
        registry = None
    if registry is not None:
        runs |= {name: (lambda f=f: f(spark, sf_dir)) for name, f in registry.queries().items()}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    for name, run in runs.items():
        began = time.time()
        run().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf[1]) if sf else None, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
