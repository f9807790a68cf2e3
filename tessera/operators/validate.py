"""Integrity of a result: every rule gives violations (rule, seq, item, details) instead of one error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import written_once

from .tracks import CAPACITY, label_frames, spans

KEY = ["seq", "frame"]


def _row(df: DataFrame, rule: str, item: Column, details: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), "seq", item.cast("string").alias("item"), details.cast("string").alias("details"))


def frame_reconcile(source: DataFrame, result: DataFrame) -> DataFrame:
    """Frames that only one side has: 'missing' in the result or 'extra' [O-62, V-04]."""
    a, b = source.select(*KEY).distinct().withColumn("a", F.lit(1)), result.select(*KEY).distinct().withColumn("b", F.lit(1))
    j = a.join(b, KEY, "full_outer").filter("a is null or b is null")
    return j.select(*KEY, F.when(F.col("b").isNull(), "missing").otherwise("extra").alias("what"))


def label_track_reconcile(pixels: DataFrame, tracks: DataFrame) -> DataFrame:
    """Labels without a track row and track rows without pixels [O-63, V-12]."""
    a = pixels.select("seq", "label").distinct().withColumn("a", F.lit(1))
    b = tracks.select("seq", "label").distinct().withColumn("b", F.lit(1))
    j = a.join(b, ["seq", "label"], "full_outer").filter("a is null or b is null")
    return j.select("seq", "label", F.when(F.col("b").isNull(), "no track row").otherwise("no pixels").alias("what"))


def inactive_labels(pixels: DataFrame, tracks: DataFrame) -> DataFrame:
    """Labels seen in frames outside their track's range [O-64, V-18]."""
    j = label_frames(pixels).join(tracks, ["seq", "label"])
    return j.filter(~F.col("frame").between(F.col("begin"), F.col("end"))).select(*KEY, "label")


def missing_frames(frames: DataFrame, first: int | None = None) -> DataFrame:
    """Holes between the first (or a given) and the last frame of every sequence [O-108, V-03]."""
    ends = frames.groupBy("seq").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    lo = F.lit(first) if first is not None else F.col("lo")
    return ends.select("seq", F.explode(F.sequence(lo, "hi")).alias("frame")).join(frames.select(*KEY).distinct(), KEY, "left_anti")


def parent_violations(tracks: DataFrame) -> DataFrame:
    """Parents that don't exist or don't end before the child begins [O-65, V-16, Q20]."""
    p = tracks.select("seq", F.col("label").alias("parent"), F.col("end").alias("parent_end"))
    j = tracks.filter("parent <> 0").join(p, ["seq", "parent"], "left").filter("parent_end is null or parent_end >= begin")
    return j.select("seq", "label", "parent", F.when(F.col("parent_end").isNull(), "unknown parent").otherwise("parent too long").alias("what"))


def violations(pixels: DataFrame, tracks: DataFrame, source_frames: DataFrame | None = None, meta: DataFrame | None = None, dtype: str = "uint16") -> DataFrame:
    """All violations of a result's masks and track table [V-03 … V-16].

    ``source_frames``: (seq, frame) of the images; ``meta``: (seq, frame, height, width, dtype); masks of another type
    than ``dtype`` are violations. Pixels are read once: every rule works on the labels of each frame, which are written out.
    """
    return _violations(written_once(label_frames(pixels), "label-frames"), tracks, source_frames, meta, dtype)


def _violations(pixels: DataFrame, tracks: DataFrame, source_frames: DataFrame | None, meta: DataFrame | None, dtype: str = "uint16") -> DataFrame:
    """``violations`` of the labels of each frame."""
    out = [
        _row(missing_frames(pixels), "V-03", F.col("frame"), F.lit("missing frame")),
        _row(tracks.filter((F.col("label") <= 0) | (F.col("label") > CAPACITY)), "V-06", F.col("label"), F.lit("label out of range")),
        _row(tracks.filter("begin < 0 or begin > end"), "V-07", F.col("label"), F.concat_ws("-", "begin", "end")),
        _row(tracks.filter("parent < 0 or parent = label"), "V-08", F.col("label"), F.col("parent")),
        _row(tracks.groupBy("seq", "label").count().filter("count > 1"), "V-09", F.col("label"), F.col("count")),
        _row(pixels.filter((F.col("label") < 0) | (F.col("label") > CAPACITY)).select("seq", "frame", "label").distinct(), "V-10", F.col("frame"), F.col("label")),
        _row(label_track_reconcile(pixels, tracks), "V-12", F.col("label"), F.col("what")),
    ]
    last = pixels.groupBy("seq").agg(F.max("frame").alias("last"))
    out.append(_row(tracks.join(last, "seq").filter(F.col("end") > F.col("last")), "V-13", F.col("label"), F.col("end")))
    seen = spans(pixels).select("seq", "label", F.col("begin").alias("b"), F.col("end").alias("e"), "has_gap")
    both = tracks.join(seen, ["seq", "label"])
    out.append(_row(both.filter("begin <> b or end <> e"), "V-14", F.col("label"), F.concat_ws("-", "b", "e")))
    out.append(_row(both.filter("has_gap"), "V-15", F.col("label"), F.lit("gap")))
    out.append(_row(parent_violations(tracks), "V-16", F.col("label"), F.col("what")))
    if source_frames is not None:
        out.append(_row(frame_reconcile(source_frames, pixels), "V-04", F.col("frame"), F.col("what")))
    if meta is not None:
        shapes = meta.groupBy("seq").agg(F.countDistinct("height", "width").alias("n")).filter("n > 1")
        out.append(_row(shapes, "V-11", F.lit(""), F.col("n")))
        if "dtype" in meta.columns:
            out.append(_row(meta.filter(F.col("dtype") != dtype), "V-10", F.col("frame"), F.col("dtype")))
    all_rows = out[0]
    for part in out[1:]:
        all_rows = all_rows.unionByName(part)
    return all_rows


def audit(pixels: DataFrame, tracks: DataFrame, source_frames: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    """One row per sequence: frames, labels, max_label, tracks, with_parent, n_violations, rules, passed [O-96, O-97, V-03 … V-16].

    Numbers and rules come from one pass over the pixels, whose labels by frame are written out. ``rules`` says how often each
    rule is broken ('V-03=2, V-14=1'). A sequence that only one side has is a row too, with zeros for what it lacks.
    """
    seen = written_once(label_frames(pixels), "label-frames")
    broken = _violations(seen, tracks, source_frames, meta).groupBy("seq", "rule").agg(F.count(F.lit(1)).alias("n"))
    told = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rule", "n"))), lambda r: F.concat(r["rule"], F.lit("="), r["n"].cast("string"))), ", ")
    broken = broken.groupBy("seq").agg(F.sum("n").alias("n_violations"), told.alias("rules"))
    p = seen.groupBy("seq").agg(F.countDistinct("frame").alias("frames"), F.countDistinct("label").alias("labels"), F.max("label").alias("max_label"))
    t = tracks.groupBy("seq").agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("parent") != 0).alias("with_parent"))
    out = p.join(t, "seq", "full_outer").join(broken, "seq", "left")
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("frames", "labels", "max_label", "tracks", "with_parent", "n_violations")]
    return out.select("seq", *zeros, F.coalesce("rules", F.lit("")).alias("rules"), F.col("n_violations").isNull().alias("passed"))


def of_passed(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """``rows`` of the sequences that passed: a run goes on with these, and the others stay rows of the audit."""
    return rows.join(audited.filter("passed").select("seq"), "seq", "left_semi")


def enforced(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """``rows``, with an error inside the plan as soon as one belongs to a sequence that didn't pass (null: not audited, an error too)."""
    said = audited.select("seq", F.when(~F.col("passed"), F.concat(F.lit("sequence "), F.col("seq"), F.lit(" breaks "), F.col("rules"))).otherwise(F.lit("")).alias("vl_said"))
    j = rows.join(said, "seq", "left")
    ok = F.when(F.col("vl_said") == "", F.lit(True)).otherwise(F.raise_error(F.coalesce("vl_said", F.lit("a sequence was not audited"))).cast("boolean"))
    return j.filter(ok).select(*rows.columns)


def missing_folders(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """Sequences whose result folder is not there [V-01]; both sides have (seq)."""
    return _row(wanted.select("seq").distinct().join(found.select("seq").distinct(), "seq", "left_anti"), "V-01", F.col("seq"), F.lit("no result folder"))


def export_violations(pixels: DataFrame, tracks: DataFrame, frames: int) -> DataFrame:
    """What an exporter checks of its own rows: ranges within the frames, the masks' labels, valid parents [V-17].

    Weaker than ``violations``: begin and end need not be the first and last frame with pixels, nor the range
    without holes, and a parent only has to exist and to be another track.
    """
    ids = tracks.select("seq", F.col("label").alias("parent"), F.lit(True).alias("known")).distinct()
    wrong = tracks.join(ids, ["seq", "parent"], "left").filter("parent <> 0 and (known is null or parent = label)")
    parts = [
        _row(tracks.filter((F.col("begin") < 0) | (F.col("begin") > F.col("end")) | (F.col("end") >= frames)), "V-17", F.col("label"), F.concat_ws("-", "begin", "end")),
        _row(label_track_reconcile(pixels, tracks), "V-17", F.col("label"), F.col("what")),
        _row(wrong, "V-17", F.col("label"), F.concat(F.lit("parent "), F.col("parent").cast("string"))),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def preview(items: DataFrame, by: list[str], item: str, n: int = 20) -> DataFrame:
    """The first n items of each group [O-98, O-121]."""
    return items.groupBy(*by).agg(F.slice(F.sort_array(F.collect_set(item)), 1, n).alias("preview"), F.count(F.lit(1)).alias("n"))


def check_parameters(factor: int = 1, offset: int = 0, scale: float = 1.0, alpha: float = 0.5, cooldown: int = 0, digits: int | None = None) -> None:
    """Parameter rules [V-19]: the first that fails is an error."""
    rules = (
        (factor >= 1, "factor must be positive"),
        (0 <= offset < max(factor, 1), "offset must lie below the factor"),
        (scale > 0, "scale must be positive"),
        (0 <= alpha <= 1, "alpha must lie in [0, 1]"),
        (cooldown >= 0, "cooldown can't be negative"),
        (digits is None or digits > 0, "digits must be positive"),
    )
    for ok, what in rules:
        if not ok:
            raise ValueError(what)
