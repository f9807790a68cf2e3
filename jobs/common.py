"""What both jobs share: configuration, a session for the command line, the log."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any, TypeVar

from pyspark.sql import SparkSession

log = logging.getLogger("tessera.jobs")
C = TypeVar("C")


def read_config(spark: SparkSession, path: str | None, kind: type[C]) -> C:
    """A JSON object of settings; what it leaves out keeps its default, what the job doesn't know is an error.

    A path with a scheme is read by Spark, any other is a file beside the command line: executors needn't see it.
    """
    if not path:
        return kind()
    text = spark.read.text(path, wholetext=True).first()[0] if "://" in path else Path(path).read_text(encoding="utf-8")
    found = json.loads(text)
    unknown = set(found) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return kind(**{k: v for k, v in found.items() if v is not None})


def command_line(doc: str, paths: dict[str, str], run: Callable[..., Any], kind: type) -> None:
    """Parse plain path arguments, make a session, run the job in it and stop it."""
    parser = argparse.ArgumentParser(description=doc)
    for name, what in paths.items():
        parser.add_argument(f"--{name}", required=not what.startswith("optional"), help=what)
    parser.add_argument("--config", help="JSON file of settings")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(Path(sys.argv[0]).stem).getOrCreate()
    try:
        run(spark, **{n: getattr(args, n) for n in paths}, config=read_config(spark, args.config, kind))
    finally:
        spark.stop()
