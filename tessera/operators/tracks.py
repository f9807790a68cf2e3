"""Operators on track tables: tracks(seq, label, begin, end, parent) and presence by frame.

Windows are always partitioned by sequence or finer, so no operator sorts a whole table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 65535


def label_frames(pixels: DataFrame) -> DataFrame:
    """Distinct (seq, label, frame) [O-82]."""
    return pixels.select("seq", "label", "frame").distinct()


def frame_lists(pixels: DataFrame) -> DataFrame:
    """Sorted frames of every label [O-82]."""
    return pixels.groupBy("seq", "label").agg(F.sort_array(F.collect_set("frame")).alias("frames"))


def spans(pixels: DataFrame) -> DataFrame:
    """First and last frame of every label, and whether it has a gap [O-81, O-83, O-109]."""
    g = label_frames(pixels).groupBy("seq", "label").agg(F.min("frame").alias("begin"), F.max("frame").alias("end"), F.count(F.lit(1)).alias("n"))
    return g.select("seq", "label", "begin", "end", (F.col("end") - F.col("begin") + 1 != F.col("n")).alias("has_gap"))


def runs(frames: DataFrame) -> DataFrame:
    """Maximal runs of consecutive frames of every label [O-99]."""
    w = Window.partitionBy("seq", "label").orderBy("frame")
    island = frames.withColumn("island", F.col("frame") - F.row_number().over(w))
    return island.groupBy("seq", "label", "island").agg(F.min("frame").alias("begin"), F.max("frame").alias("end")).drop("island")


def numbered_runs(run_table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """New labels 1, 2, … for runs in order of (old label, begin), with ``fits`` for the label capacity [O-100, V-20]."""
    w = Window.partitionBy("seq").orderBy("label", "begin")
    out = run_table.select("seq", F.col("label").alias("old_label"), "begin", "end", F.row_number().over(w).alias("new_label"))
    return out.withColumn("fits", F.col("new_label") <= capacity)


def asof_parents(numbered: DataFrame, parents: DataFrame) -> DataFrame:
    """Parent of each run: the latest run of the parent's old label that ended before it begins [O-66].

    Only an old label's first frame keeps its parent: runs that begin at frame 0 have none.
    ``parents``: (seq, label, parent). The range join is bounded by the runs of one label.
    """
    c = numbered.alias("c").join(parents.filter("parent <> 0").alias("p"), (F.col("c.seq") == F.col("p.seq")) & (F.col("c.old_label") == F.col("p.label")), "left")
    m = numbered.select(F.col("seq").alias("m_seq"), F.col("old_label").alias("m_label"), F.col("end").alias("m_end"), F.col("new_label").alias("m_new"))
    fits = (F.col("c.seq") == F.col("m_seq")) & (F.col("p.parent") == F.col("m_label")) & (F.col("m_end") < F.col("c.begin")) & (F.col("c.begin") > 0)
    joined = c.join(m, fits, "left").groupBy(F.col("c.seq").alias("seq"), F.col("c.new_label").alias("label"), F.col("c.begin").alias("begin"), F.col("c.end").alias("end"))
    return joined.agg(F.coalesce(F.max_by("m_new", F.struct("m_end", "m_new")), F.lit(0)).alias("parent"))


def export_tracks(pixels: DataFrame, parents: DataFrame) -> DataFrame:
    """Track table of a result: runs, new labels, as-of parents [O-150]."""
    return asof_parents(numbered_runs(runs(label_frames(pixels))), parents)


def build_track_rows(span_table: DataFrame, parent_map: DataFrame) -> DataFrame:
    """Track rows from spans and a parent map (seq, label, parent); begin 0 has no parent [O-48, O-149]."""
    j = span_table.join(parent_map.select("seq", "label", "parent"), ["seq", "label"], "left")
    return j.select("seq", "label", "begin", "end", F.when(F.col("begin") == 0, F.lit(0)).otherwise(F.coalesce("parent", F.lit(0))).alias("parent"))


def clip_rebase(tracks: DataFrame, start: int, end: int) -> DataFrame:
    """Tracks inside [start, end], counted from start; a parent stays if it ends before its child begins [O-67, O-152]."""
    kept = tracks.filter((F.col("begin") <= end) & (F.col("end") >= start))
    kept = kept.select("seq", "label", (F.greatest("begin", F.lit(start)) - start).alias("begin"), (F.least("end", F.lit(end)) - start).alias("end"), "parent")
    return valid_parents(kept)


def valid_parents(tracks: DataFrame) -> DataFrame:
    """Keep a parent only if it exists, is another track and ends before its child begins [O-65, O-67, O-68]."""
    p = tracks.select("seq", F.col("label").alias("parent"), F.col("end").alias("parent_end"))
    j = tracks.join(p, ["seq", "parent"], "left")
    ok = F.col("parent_end").isNotNull() & (F.col("parent") != F.col("label")) & (F.col("parent_end") < F.col("begin")) & (F.col("begin") > 0)
    return j.select("seq", "label", "begin", "end", F.when(ok, F.col("parent")).otherwise(F.lit(0)).alias("parent"))


def rebuild(pixels: DataFrame, existing: DataFrame) -> DataFrame:
    """Track table recomputed from masks with the old parents where valid; ``gap`` marks tracks the file form can't hold [O-68, O-153]."""
    s = spans(pixels)
    rows = s.join(existing.select("seq", "label", "parent"), ["seq", "label"], "left").withColumn("parent", F.coalesce("parent", F.lit(0)))
    p = s.select("seq", F.col("label").alias("parent"), F.col("end").alias("parent_end"))
    j = rows.join(p, ["seq", "parent"], "left")
    ok = F.col("parent_end").isNotNull() & (F.col("parent") != F.col("label")) & (F.col("parent_end") < F.col("begin"))
    return j.select("seq", "label", "begin", "end", F.when(ok, F.col("parent")).otherwise(F.lit(0)).alias("parent"), "has_gap", ((F.col("parent") != 0) & ~ok).alias("parent_dropped"))


def sample_frames(pixels: DataFrame, factor: int, offset: int = 0) -> DataFrame:
    """Every ``factor``-th frame from ``offset``, renumbered from 0 [O-40]."""
    return pixels.filter((F.col("frame") >= offset) & ((F.col("frame") - offset) % factor == 0)).withColumn("frame", ((F.col("frame") - offset) / factor).cast("int"))


def downsample_tracks(pixels: DataFrame, parents: DataFrame, factor: int, offset: int = 0) -> DataFrame:
    """Tracks of the sampled frames: runs, new labels, as-of parents [O-151]."""
    return export_tracks(sample_frames(pixels, factor, offset), parents)


def downsample_pixels(pixels: DataFrame, factor: int, offset: int = 0) -> DataFrame:
    """Sampled masks under the new labels of their runs [O-70, O-151]."""
    from .raster import relabel

    sampled = sample_frames(pixels, factor, offset)
    table = numbered_runs(runs(label_frames(sampled)))
    return relabel(sampled, table)


def downsample_result(
    pixels: DataFrame,
    parents: DataFrame,
    frames: int,
    factor: int,
    offset: int = 0,
    from_shape: tuple[int, int] | None = None,
    to_shape: tuple[int, int] | None = None,
    pad_missing: bool = False,
    meta: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """A whole result at a lower rate and size: output frame i is source frame offset + i * factor [O-151].

    'frames': (seq, frame, source_frame, missing) of every output frame; 'pixels': the frames' masks under the labels of their runs,
    resized to ``to_shape`` if given; 'tracks': their track table. ``meta`` (seq, frame) names the frames that there are
    (else those with pixels). A missing one is an error that names the first twenty, unless it is padded: then it is a blank mask.
    """
    from .raster import relabel, resize_nearest
    from .validate import check_parameters

    check_parameters(factor=factor)
    if offset < 0 or frames < 1:
        raise ValueError("offset can't be negative, and one frame is the least")
    have = (pixels if meta is None else meta).select("seq", F.col("frame").alias("source_frame")).distinct()
    wanted = have.select("seq").distinct().select("seq", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame"))
    wanted = wanted.withColumn("source_frame", F.lit(offset) + F.col("frame") * factor)
    listing = wanted.join(have.withColumn("there", F.lit(True)), ["seq", "source_frame"], "left").select("seq", "frame", "source_frame", F.col("there").isNull().alias("missing"))
    if not pad_missing:
        lost = listing.filter("missing").orderBy("seq", "frame").limit(20).collect()
        if lost:
            raise ValueError("frames are missing: " + ", ".join(f"{r.seq}/{r.source_frame}" for r in lost))
    sampled = sample_frames(pixels, factor, offset).filter(F.col("frame") < frames)
    table = numbered_runs(runs(label_frames(sampled)))
    out = relabel(sampled, table)
    if to_shape is not None:
        out = resize_nearest(out, from_shape, to_shape)
    return {"frames": listing, "pixels": out, "tracks": asof_parents(table, parents)}


def pad_missing(pixels: DataFrame, frames: int) -> DataFrame:
    """Every frame 0 … frames - 1 of each sequence with its pixel count, 0 for blank padding [O-108, O-115]."""
    want = pixels.select("seq").distinct().select("seq", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))).alias("frame"))
    have = pixels.groupBy("seq", "frame").agg(F.count(F.lit(1)).alias("n"))
    return want.join(have, ["seq", "frame"], "left").select("seq", "frame", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


def pad_frames(pixels: DataFrame, start: int, end: int, mode: str = "edge") -> DataFrame:
    """Temporal padding: frames shift by ``start``; 'edge' repeats the first and last frame, 'blank' adds none [O-114]."""
    shifted = pixels.withColumn("frame", F.col("frame") + start)
    if mode == "blank":
        return shifted
    ends = pixels.groupBy("seq").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    both = pixels.join(ends, "seq")
    head = both.filter("frame = first").withColumn("frame", F.explode(F.sequence(F.col("first"), F.col("first") + start - 1))) if start else None
    tail = both.filter("frame = last").withColumn("frame", F.explode(F.sequence(F.col("last") + start + 1, F.col("last") + start + end))) if end else None
    out = shifted
    for part in (head, tail):
        if part is not None:
            out = out.unionByName(part.select(*pixels.columns))
    return out


def compact_labels(pixels: DataFrame) -> DataFrame:
    """Old label to dense ascending id per sequence [O-103]."""
    w = Window.partitionBy("seq").orderBy("label")
    return pixels.select("seq", "label").distinct().select("seq", "label", F.row_number().over(w).alias("compact"))


def survivors(pixels: DataFrame, min_frames: int) -> DataFrame:
    """Labels in at least ``min_frames`` frames, renumbered in order [O-102]."""
    n = label_frames(pixels).groupBy("seq", "label").agg(F.count(F.lit(1)).alias("n_frames")).filter(F.col("n_frames") >= min_frames)
    return n.withColumn("new_label", F.row_number().over(Window.partitionBy("seq").orderBy("label")))


def split_discontinuous(frames: DataFrame, threshold: int, table_rows: DataFrame | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Split labels at gaps: (seq, old_label, begin, end, new_label, outcome) for every run [O-101].

    The first run keeps its label. A later run shorter than ``threshold`` is dropped ('short'); others
    take, in order of (label, begin), the lowest free ids up to the table's size, then ids after
    it; beyond ``capacity`` they are dropped. ``table_rows``: (seq, rows), by default the largest label.
    """
    r = runs(frames)
    w = Window.partitionBy("seq", "label").orderBy("begin")
    r = r.withColumns({"rn": F.row_number().over(w), "length": F.col("end") - F.col("begin") + 1})
    if table_rows is None:
        table_rows = frames.groupBy("seq").agg(F.max("label").alias("rows"))
    used = frames.select("seq", "label").distinct()
    slots = table_rows.select("seq", "rows", F.explode(F.sequence(F.lit(1), "rows")).alias("label")).join(used, ["seq", "label"], "left_anti")
    free = slots.withColumn("k", F.row_number().over(Window.partitionBy("seq").orderBy("label"))).select("seq", "k", F.col("label").alias("free_id"))
    n_free = table_rows.join(free.groupBy("seq").agg(F.count(F.lit(1)).alias("free")), "seq", "left").select("seq", "rows", F.coalesce("free", F.lit(0)).alias("free"))
    moving = r.filter((F.col("rn") > 1) & (F.col("length") >= threshold))
    moving = moving.withColumn("k", F.row_number().over(Window.partitionBy("seq").orderBy("label", "begin")))
    moving = moving.join(free, ["seq", "k"], "left").join(n_free, "seq")
    new = F.coalesce("free_id", (F.col("rows") + F.col("k") - F.col("free")).cast("int"))
    moved = moving.select("seq", "label", "begin", "end", F.when(new <= capacity, new).alias("new_label"), F.when(new <= capacity, F.lit("moved")).otherwise(F.lit("capacity")).alias("outcome"))
    first = r.filter("rn = 1").select("seq", "label", "begin", "end", F.col("label").alias("new_label"), F.lit("kept").alias("outcome"))
    short = r.filter((F.col("rn") > 1) & (F.col("length") < threshold)).select("seq", "label", "begin", "end", F.lit(None).cast("int").alias("new_label"), F.lit("short").alias("outcome"))
    return first.unionByName(moved).unionByName(short).withColumnRenamed("label", "old_label")


def overlaps_range(begin: Column, end: Column, start: int, stop: int) -> Column:
    """Whether [begin, end] meets [start, stop] [O-38]."""
    return (begin <= stop) & (end >= start)


def report(pixels: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per sequence: frames, labels, tracks, largest label, tracks with a parent [O-96, O-97]."""
    p = pixels.groupBy("seq").agg(F.countDistinct("frame").alias("frames"), F.countDistinct("label").alias("labels"), F.max("label").alias("max_label"))
    t = tracks.groupBy("seq").agg(F.count(F.lit(1)).alias("tracks"), F.count_if(F.col("parent") != 0).alias("with_parent"))
    return p.join(t, "seq")
