"""Track files, manifests and log lines as tables, and back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value) of text files; line numbers count from 0 within a file."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value"))
    return whole


@dataclass(frozen=True)
class Strictness:
    """What a reader of track files asks of a line.

    ``tokens``: 'four' integers or 'at least four'. ``labels`` and ``ranges``: the label, and begin, end and
    parent, must be possible. ``known_parents``: parents must be labels of the file. ``duplicates``: 'report'
    them, or 'last' keeps the last line. ``parents_only``: the rest of a line is not kept.
    """

    tokens: str = "four"
    labels: bool = True
    ranges: bool = True
    known_parents: bool = False
    duplicates: str = "report"
    parents_only: bool = False


#: The six readers of track files, by what they are part of.
STRICTNESS = {
    "validator": Strictness(),
    "subsetter": Strictness(labels=False),
    "downsampler": Strictness(labels=False, ranges=False, duplicates="last"),
    "rebuilder": Strictness(labels=False, ranges=False, duplicates="last", parents_only=True),
    "viewer": Strictness(tokens="at least four", labels=False, ranges=False, known_parents=True),
    "failures": Strictness(tokens="at least four", labels=False, ranges=False, duplicates="last"),
}


def parse_tracks(lines: DataFrame, level: str | Strictness = "validator") -> tuple[DataFrame, DataFrame]:
    """(tracks, problems) of 'L B E P' lines at one of six levels of strictness [O-10, V-05 … V-09].

    Blank lines are skipped. ``lines``: (line_no, value), with ``seq`` where there are several files. A
    table without lines gives no tracks. At level 'rebuilder' tracks have label and parent alone.
    """
    rule = STRICTNESS[level] if isinstance(level, str) else level
    by = ["seq"] if "seq" in lines.columns else []
    rows = lines.filter(F.trim("value") != "").withColumn("t", F.split(F.trim("value"), r"\s+"))
    numbers = [F.expr(f"try_cast(get(t, {i}) AS INT)") for i in range(4)]
    size_ok = F.size("t") == 4 if rule.tokens == "four" else F.size("t") >= 4
    rows = rows.select(*by, "line_no", "value", size_ok.alias("four"), *[n.alias(c) for n, c in zip(numbers, ("label", "begin", "end", "parent"), strict=True)])
    whole = F.col("four") & F.col("label").isNotNull() & F.col("begin").isNotNull() & F.col("end").isNotNull() & F.col("parent").isNotNull()
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, "label"))
    problem = F.when(~whole, "V-05")
    if rule.labels:
        problem = problem.when((F.col("label") <= 0) | (F.col("label") > 65535), "V-06")
    if rule.ranges:
        problem = problem.when((F.col("begin") < 0) | (F.col("begin") > F.col("end")), "V-07").when((F.col("parent") < 0) | (F.lit(rule.labels) & (F.col("parent") == F.col("label"))), "V-08")
    if rule.known_parents:
        known = rows.select(*by, F.col("label").alias("parent"), F.lit(True).alias("known")).distinct()
        rows = rows.join(known, [*by, "parent"], "left")
        problem = problem.when((F.col("parent") != 0) & (F.col("known").isNull() | (F.col("parent") == F.col("label"))), "V-08")
    if rule.duplicates == "report":
        problem = problem.when(n > 1, "V-09")
    checked = rows.withColumn("problem", problem)
    good = checked.filter("problem is null")
    if rule.duplicates == "last":
        good = good.groupBy(*by, "label").agg(F.max_by(F.struct("begin", "end", "parent"), "line_no").alias("r")).select(*by, "label", "r.*")
    kept = ["label", "parent"] if rule.parents_only else ["label", "begin", "end", "parent"]
    return good.select(*by, *kept), checked.filter("problem is not null").select(*by, "line_no", "value", "problem")


def track_lines(tracks: DataFrame) -> DataFrame:
    """'L B E P' lines in label order, with ``seq`` where the tracks have one [O-21]."""
    by = ["seq"] if "seq" in tracks.columns else []
    return tracks.orderBy(*by, "label").select(*by, F.concat_ws(" ", "label", "begin", "end", "parent").alias("value"))


def write_tracks(tracks: DataFrame, path: str, overwrite: bool = False) -> None:
    """One text file of track lines; an existing folder is an error unless ``overwrite`` [O-21, O-26]."""
    track_lines(tracks.drop("seq")).coalesce(1).write.mode("overwrite" if overwrite else "error").text(path)


def parse_manifest(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, value) settings and (place, name) files of a manifest, with its ``path`` where the lines have one [O-20, Q23]."""
    by = ["path"] if "path" in lines.columns else []
    pairs = lines.filter(F.col("value").rlike(r"^[^\s=]+=")).select(*by, F.regexp_extract("value", "^([^=]+)=", 1).alias("key"), F.regexp_extract("value", "^[^=]+=(.*)$", 1).alias("value"))
    # the names of one manifest are gathered in order: no window over the lines of all
    names = lines.filter(F.col("value").rlike(r"^\s+\S")).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("line_no", F.trim("value").alias("name")))).alias("n"))
    files = names.select(*by, F.posexplode("n.name").alias("place", "name"))
    return pairs, files


def manifest_lines(settings: dict[str, str], names: list[str]) -> list[str]:
    """Lines of a manifest [O-28]."""
    return [f"{k}={v}" for k, v in settings.items()] + ["mask_files:"] + [f"  {n}" for n in names]


def write_lines(spark: SparkSession, lines: list[str], path: str, overwrite: bool = False) -> None:
    """A small text file, such as a manifest [O-26, O-28]."""
    spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "n int, value string").coalesce(1).sortWithinPartitions("n").select("value").write.mode("overwrite" if overwrite else "error").text(path)


def backup_path(spark: SparkSession, path: str) -> str | None:
    """Move what stands at ``path`` to the first free of path.bak, path.bak1, … and say where; None if nothing stands there [O-27]."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(hadoop(path)):
        return None
    names = (f"{path}.bak{n or ''}" for n in range(1 << 30))
    to = next(x for x in names if not system.exists(hadoop(x)))
    system.rename(hadoop(path), hadoop(to))
    return to


#: Columns of the report files, in order.
REPORTS = {
    "failure_events": ("sequence", "frame", "event_type", "gt_id", "res_id", "score", "details"),
    "failure_summary_by_frame": ("sequence", "frame", "event_type", "count"),
    "failure_summary_by_track": ("sequence", "track", "event_type", "count"),
    "penalty_counts": ("sequence", "metric", "official_score", "penalty_type", "penalty_label", "penalty", "count", "weighted_penalty", "log_path"),
    "SEG_low_jaccard_objects": ("sequence", "official_score", "t", "z", "gt_label", "jaccard", "threshold", "log_path"),
    "SEG_summary": ("sequence", "metric", "official_score", "objects", "low_jaccard_objects", "zero_jaccard_objects", "min_jaccard", "threshold", "log_path"),
    "metrics_summary": ("metric", "score", "stdout_log", "ctc_log"),
    "subset_frame_mapping": ("kind", "source_frame", "output_frame", "source_path", "output_path", "status"),
}


def write_report(table: DataFrame, kind: str, path: str, overwrite: bool = False) -> None:
    """One CSV file with the columns that reports of this kind have, in their order [O-23, O-24]."""
    write_csv(table.select(*REPORTS[kind]), path, overwrite)


def write_csv(table: DataFrame, path: str, overwrite: bool = False) -> None:
    """A header and rows in one CSV file, for reports [O-23, O-24]."""
    table.coalesce(1).write.mode("overwrite" if overwrite else "error").option("header", True).csv(path)
