"""Diagnosis of a tracking result against ground truth: twelve kinds of events and their summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import written_once

from . import raster

KEY = ["seq", "frame"]


@dataclass(frozen=True)
class Limits:
    """Thresholds: least coverage and IoU, share that counts as a split part, jump distance and factor."""

    coverage: float = 0.5
    iou: float = 0.5
    split: float = 0.2
    jump: float = 50.0
    jump_factor: float = 5.0


def matches(gt: DataFrame, res: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Best result per ground-truth object; ``matched`` where its coverage reaches the limit [O-51, O-53, Q10]."""
    best = raster.best_overlap(gt, res).select(*KEY, F.col("a").alias("gt"), F.col("best").alias("res"), "n", "coverage")
    return best.withColumn("matched", (F.col("res") > 0) & (F.col("coverage") >= limits.coverage))


def common_frames(gt: DataFrame, res: DataFrame, seg: DataFrame | None = None) -> DataFrame:
    """Frames that truth and result both have; where markers and result share none in a sequence, those of ``seg`` [O-54, O-122]."""
    r = res.select(*KEY).distinct()
    both = gt.select(*KEY).distinct().join(r, KEY, "left_semi")
    if seg is None:
        return both
    rest = seg.select(*KEY).distinct().join(r, KEY, "left_semi").join(both.select("seq").distinct(), "seq", "left_anti")
    return both.unionByName(rest)


def require_common_frames(gt: DataFrame, res: DataFrame, seg: DataFrame | None = None) -> None:
    """An error where truth and result share no frame at all, so that nothing could be judged [O-54]."""
    if common_frames(gt, res, seg).isEmpty():
        raise ValueError("truth and result have no frame in common")


def choose_truth(tra: DataFrame, seg: DataFrame) -> DataFrame:
    """Pixels of the markers in every frame that has any, else of the segmentation [O-55]."""
    return tra.unionByName(seg.join(tra.select(*KEY).distinct(), KEY, "left_anti").select(*tra.columns))


def merges(matched: DataFrame) -> DataFrame:
    """Results matched by more than one ground-truth object, with the sorted id list [O-91]."""
    g = matched.filter("matched").groupBy(*KEY, "res").agg(F.sort_array(F.collect_list("gt")).alias("ids"))
    return g.filter(F.size("ids") > 1).select(*KEY, "res", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("gt_ids"))


def splits(gt: DataFrame, res: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Ground-truth objects of which two or more results each cover a part [O-92]."""
    o = raster.overlaps(gt, res).filter(F.col("inter") / F.col("a_area") >= limits.split)
    g = o.groupBy(*KEY, F.col("a").alias("gt")).agg(F.sort_array(F.collect_list("b")).alias("ids"))
    return g.filter(F.size("ids") > 1).select(*KEY, "gt", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("res_ids"))


def id_switches(matched: DataFrame) -> DataFrame:
    """Consecutive matched frames of a ground-truth object under different results [O-104]."""
    w = Window.partitionBy("seq", "gt").orderBy("frame")
    m = matched.filter("matched").withColumns({"before": F.lag("res").over(w), "last": F.lag("frame").over(w)})
    return m.filter((F.col("last") == F.col("frame") - 1) & (F.col("before") != F.col("res"))).select(*KEY, "gt", F.col("before").alias("res_before"), "res")


def fragmented(matched: DataFrame) -> DataFrame:
    """Ground-truth tracks matched by several results, at their first matched frame [O-93]."""
    g = matched.filter("matched").groupBy("seq", "gt").agg(F.min("frame").alias("frame"), F.countDistinct("res").alias("n_results"))
    return g.filter("n_results > 1")


def steps(objects: DataFrame) -> DataFrame:
    """Centroid distance between consecutive frames of a track; gaps give none [O-105]."""
    w = Window.partitionBy("seq", "label").orderBy("frame")
    o = objects.withColumns({"py": F.lag("cy").over(w), "px": F.lag("cx").over(w), "pf": F.lag("frame").over(w)})
    return o.filter(F.col("pf") == F.col("frame") - 1).select(*KEY, "label", F.hypot(F.col("cy") - F.col("py"), F.col("cx") - F.col("px")).alias("step"))


def median_step(step_table: DataFrame) -> DataFrame:
    """Median of the positive steps of every result track, 0 if none [O-89, Q26]."""
    return step_table.groupBy("seq", "label").agg(F.coalesce(F.median(F.when(F.col("step") > 0, F.col("step"))), F.lit(0.0)).alias("median"))


def jumps(step_table: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Steps longer than both the fixed distance and a multiple of their track's median [O-106]."""
    limit = F.greatest(F.lit(limits.jump), F.col("median") * limits.jump_factor)
    j = step_table.join(median_step(step_table), ["seq", "label"]).withColumn("threshold", limit)
    return j.filter(F.col("step") > F.col("threshold")).select(*KEY, "label", "step", "median", "threshold")


def divisions(gt_tracks: DataFrame, matched: DataFrame, res_tracks: DataFrame) -> DataFrame:
    """Mapped child and parent of every ground-truth division and the parent that the result has [O-69]."""
    m = matched.filter("matched").select(*KEY, "gt", "res")
    child = gt_tracks.filter("parent > 0").select("seq", F.col("label").alias("child"), F.col("begin").alias("frame"), "parent")
    p = gt_tracks.select("seq", F.col("label").alias("parent"), F.col("end").alias("parent_end"))
    j = child.join(p, ["seq", "parent"])
    j = j.join(m.select("seq", "frame", F.col("gt").alias("child"), F.col("res").alias("res_child")), ["seq", "frame", "child"], "left")
    j = j.join(m.select("seq", F.col("frame").alias("parent_end"), F.col("gt").alias("parent"), F.col("res").alias("res_parent")), ["seq", "parent_end", "parent"], "left")
    r = res_tracks.select("seq", F.col("label").alias("res_child"), F.col("parent").alias("found_parent"))
    j = j.join(r, ["seq", "res_child"], "left")
    unmapped = F.col("res_child").isNull() | F.col("res_parent").isNull()
    what = F.when(unmapped, "division_missing_result_mapping").when(~F.col("found_parent").eqNullSafe(F.col("res_parent")), "wrong_division_parent").otherwise("ok")
    return j.select("seq", "frame", "child", "parent", "res_child", "res_parent", "found_parent", what.alias("outcome"))


def pixel_counts(gt: DataFrame, res: DataFrame, seg: DataFrame | None = None) -> DataFrame:
    """(seq, frame, a, b, n, sy, sx): pixels of every pair of labels in place, null where one side has none [O-51 … O-53].

    With ``seg`` also c, its labels. One shuffle by frame; all areas, every overlap and both sides' centroids come from this
    table, whose size goes with the objects.
    """
    sides = {"a": gt, "b": res} | ({} if seg is None else {"c": seg})
    none, rows = F.lit(None).cast("int"), None
    for own, x in sides.items():
        part = x.select(*raster.PIXEL, *[(F.col("label") if k == own else none).alias(k) for k in sides])
        rows = part if rows is None else rows.unionByName(part)
    cells = rows.repartition(*KEY).groupBy(*raster.PIXEL).agg(*[F.max(k).alias(k) for k in sides])
    return cells.groupBy(*KEY, *sides).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"), F.sum("x").alias("sx"))


def seen_frames(counts: DataFrame) -> DataFrame:
    """(seq, frame, truth, result, outlined, common) of ``pixel_counts``: which sides a frame has, and whether it is common.

    Written once. Outlines count where no frame of the sequence has both markers and results, as in ``common_frames``; ``truth`` then
    says so by 'c', else 'a'. A frame without a sequence's name is never common.
    """
    outlines = F.max(F.col("c").isNotNull()) if "c" in counts.columns else F.lit(False)
    frames = counts.groupBy(*KEY).agg(F.max(F.col("a").isNotNull()).alias("marked"), F.max(F.col("b").isNotNull()).alias("result"), outlines.alias("outlined"))
    by = frames.groupBy(F.col("seq").alias("of")).agg(F.max(F.col("marked") & F.col("result")).alias("by_markers"))
    known = F.when(F.col("by_markers"), F.col("marked")).otherwise(F.col("outlined"))
    out = frames.join(by.hint("merge"), F.col("seq").eqNullSafe(F.col("of")))
    out = out.select(*KEY, "marked", "result", "outlined", F.when(F.col("by_markers"), "a").otherwise("c").alias("truth"), (F.col("seq").isNotNull() & F.col("result") & known).alias("common"))
    return written_once(out, "frames")


class Pairs:
    """What ``pixel_counts`` says of frames that both sides have; written once, since every kind of event reads it."""

    def __init__(self, counts: DataFrame):
        frame = Window.partitionBy(*KEY)
        both = counts.withColumns({"in_a": F.count("a").over(frame), "in_b": F.count("b").over(frame)}).filter("in_a > 0 and in_b > 0")
        areas = {"a_area": F.sum("n").over(Window.partitionBy(*KEY, "a")), "b_area": F.sum("n").over(Window.partitionBy(*KEY, "b"))}
        self.table = written_once(both.withColumns(areas), "pixel-counts")

    @classmethod
    def of(cls, counts: DataFrame, side: Column) -> Pairs:
        """One side of three against the results."""
        two = counts.withColumn("a", side).filter("a is not null or b is not null")
        return cls(two.groupBy(*KEY, "a", "b").agg(*[F.sum(k).alias(k) for k in ("n", "sy", "sx")]))

    def best(self, own: str, other: str) -> DataFrame:
        """Best cover of every label of one side, as ``raster.best_overlap``: (seq, frame, own, best, n, coverage)."""
        n = F.when(F.col(other).isNull(), F.lit(-1)).otherwise(F.col("n"))
        g = self.table.filter(F.col(own).isNotNull()).groupBy(*KEY, own).agg(F.max_by(F.struct(F.coalesce(other, F.lit(0)).alias("best"), F.greatest(n, F.lit(0)).alias("n")), F.struct(n, -F.coalesce(other, F.lit(0)))).alias("m"), F.sum("n").alias("area"))
        return g.select(*KEY, own, "m.best", "m.n", (F.col("m.n") / F.col("area")).alias("coverage"))

    def best_iou(self, own: str) -> DataFrame:
        iou = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("n") / (F.col("a_area") + F.col("b_area") - F.col("n")))
        return self.table.filter(F.col(own).isNotNull()).groupBy(*KEY, F.col(own).alias("label")).agg(F.coalesce(F.max(iou), F.lit(0.0)).alias("iou"))

    def parts(self, share: float) -> DataFrame:
        """Pairs in which the result covers at least ``share`` of the truth's object."""
        return self.table.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("n") / F.col("a_area") >= share))

    def result_objects(self) -> DataFrame:
        g = self.table.filter("b is not null").groupBy(*KEY, F.col("b").alias("label")).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("sx").alias("sx"))
        return g.select(*KEY, "label", (F.col("sy") / F.col("n")).alias("cy"), (F.col("sx") / F.col("n")).alias("cx"))


#: Sentences of a report's details; {} takes the next value, and an absent one reads None.
DETAILS = {
    "extra": "Marker-based check; confirm visually if GT TRA markers are sparse.",
    "merge": "{} GT labels matched one result label.",
    "split": "{} result labels cover one GT marker/segment.",
    "iou": "Computed against GT SEG frame.",
    "switch": "Previous result label was {} at frame {}.",
    "fragments": "GT track matched {} result IDs over time.",
    "jump": "Threshold=%.2f; median_step=%.2f.",
    "parent": "Expected result parent {}, observed {}.",
    "mapping": "GT parent={}; res_child={}; res_parent={}.",
}


def _filled(sentence: str, *values: Column) -> Column:
    return F.format_string(DETAILS[sentence].replace("{}", "%s"), *[F.coalesce(v.cast("string"), F.lit("None")) for v in values])


def _event(df: DataFrame, kind: str | Column, gt: str, res: str, score: Column, details: Column, *place: int | str) -> DataFrame:
    """Event rows; ``place`` orders them as a run over the frames meets them."""

    def side(x):
        return F.lit(x) if x == "" else F.coalesce(F.col(x).cast("string"), F.lit(""))

    order = F.struct(*[(F.lit(p) if isinstance(p, int) else F.col(p).cast("int")).alias(f"p{i}") for i, p in enumerate(place)])
    return df.select("seq", "frame", (F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"), side(gt).alias("gt_id"), side(res).alias("res_id"), score.cast("double").alias("score"), details.alias("details"), order.alias("place"))


def events(gt: DataFrame, res: DataFrame, gt_tracks: DataFrame, res_tracks: DataFrame, limits: Limits = Limits(), seg: DataFrame | None = None) -> DataFrame:
    """All twelve kinds of events: (seq, frame, event_type, gt_id, res_id, score, details, place) [O-124].

    ``gt`` are markers. ``seg`` are full outlines, where annotated: IoU events come from the frames that
    it has; None: nothing is annotated, so there are no IoU events. A sequence whose markers share no frame with the result
    is judged by ``seg`` alone. Scores stay numeric; text formatting is the sink's.
    """
    counts = pixel_counts(gt, res, seg)
    return counted_events(counts if seg is None else written_once(counts, "counts"), gt_tracks, res_tracks, limits)


def counted_events(counts: DataFrame, gt_tracks: DataFrame, res_tracks: DataFrame, limits: Limits = Limits(), frames: DataFrame | None = None) -> DataFrame:
    """``events`` from ``pixel_counts``, which with outlines are read several times; ``frames``: their ``seen_frames``, where known."""
    outlines = None
    if "c" in counts.columns:
        frames = seen_frames(counts) if frames is None else frames
        judged = counts.join(frames.filter("common").select(*KEY, "truth"), KEY)
        outlines = Pairs.of(judged, F.col("c"))
        pairs = Pairs.of(judged, F.when(F.col("truth") == "a", F.col("a")).otherwise(F.col("c")))
    else:
        pairs = Pairs(counts)
    m = pairs.best("a", "b").withColumnsRenamed({"a": "gt", "best": "res"}).withColumn("matched", (F.col("res") > 0) & (F.col("coverage") >= limits.coverage))
    m = written_once(m, "matches")
    good = m.filter("matched")
    none, empty, zero, says = F.lit(None), F.lit(""), F.lit(0.0), DETAILS
    split = pairs.parts(limits.split).groupBy(*KEY, F.col("a").alias("gt")).agg(F.sort_array(F.collect_list("b")).alias("ids")).filter(F.size("ids") > 1)
    fragments = good.groupBy("seq", "gt").agg(F.min("frame").alias("frame"), F.sort_array(F.collect_set("res")).alias("ids")).filter(F.size("ids") > 1)
    merged = good.groupBy(*KEY, "res").agg(F.sort_array(F.collect_list("gt")).alias("ids")).filter(F.size("ids") > 1)
    joined = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    d = divisions(gt_tracks, m, res_tracks).filter("outcome <> 'ok'").withColumn("res_id", F.when(F.col("outcome") == "wrong_division_parent", F.col("res_child")))
    mapping = F.when(F.col("outcome") == "wrong_division_parent", _filled("parent", F.col("res_parent"), F.col("found_parent"))).otherwise(_filled("mapping", F.col("parent"), F.col("res_child"), F.col("res_parent")))
    parts = [
        _event(m.filter("res = 0"), "missed_gt_object", "gt", "", zero, empty, 0, "frame", 0),
        _event(m.filter(f"res > 0 and coverage < {limits.coverage}"), "low_gt_marker_coverage", "gt", "res", F.col("coverage"), empty, 0, "frame", 0),
        _event(pairs.best("b", "a").filter("best = 0"), "extra_result_no_gt_marker", "", "b", zero, F.lit(says["extra"]), 0, "frame", 1),
        _event(merged.withColumn("gt_ids", joined), "many_gt_to_one_result_merge", "gt_ids", "res", none, _filled("merge", F.size("ids")), 0, "frame", 2),
        _event(split.withColumn("res_ids", joined), "one_gt_to_many_results_split", "gt", "res_ids", none, _filled("split", F.size("ids")), 0, "frame", 3),
        _event(id_switches(m), "id_switch", "gt", "res", none, _filled("switch", F.col("res_before"), F.col("frame") - 1), 1, "gt", "frame"),
        _event(fragments.withColumn("res_ids", joined), "fragmented_gt_track", "gt", "res_ids", none, _filled("fragments", F.size("ids")), 1, "gt", 1 << 30),
        _event(jumps(steps(pairs.result_objects()), limits), "suspicious_centroid_jump", "", "label", F.col("step"), F.format_string(says["jump"], "threshold", "median"), 2, "label", "frame"),
        _event(d, F.col("outcome"), "child", "res_id", none, mapping, 3, "child", 0),
    ]
    if outlines is not None:
        against = F.lit(says["iou"])
        parts.append(_event(outlines.best_iou("a").filter(F.col("iou") < limits.iou), "low_segmentation_iou", "label", "", F.col("iou"), against, 0, "frame", 4))
        parts.append(_event(outlines.best_iou("b").filter(F.col("iou") < limits.iou), "extra_or_low_iou_result_object", "", "label", F.col("iou"), against, 0, "frame", 5))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_frame(event_table: DataFrame) -> DataFrame:
    """Counts by frame and kind [O-86]."""
    return event_table.groupBy("seq", "frame", "event_type").agg(F.count(F.lit(1)).alias("count"))


def by_track(event_table: DataFrame) -> DataFrame:
    """Counts by track and kind; events without a ground-truth id count under 'res:' and the result's id [O-87, Q11, Q12]."""
    track = F.coalesce(F.nullif("gt_id", F.lit("")), F.concat(F.lit("res:"), F.coalesce("res_id", F.lit(""))))
    return event_table.groupBy("seq", track.alias("track"), "event_type").agg(F.count(F.lit(1)).alias("count"))


def cube(event_table: DataFrame) -> DataFrame:
    """Counts by kind, by frame and kind, and in all, from one aggregation over grouping sets."""
    c = event_table.groupingSets([["seq", "frame", "event_type"], ["seq", "event_type"], ["seq"], []], "seq", "frame", "event_type")
    return c.agg(F.count(F.lit(1)).alias("n"))


def top_frames(event_table: DataFrame, k: int = 25) -> DataFrame:
    """The k frames of every sequence with most events; ties to the frame whose first event a run meets first [O-117, O-121]."""
    n = event_table.groupBy("seq", "frame").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    rank = F.row_number().over(Window.partitionBy("seq").orderBy(F.desc("n"), "first"))
    return n.withColumn("place", rank).filter(F.col("place") <= k).select("seq", "frame", "n", "place")


def title(event_table: DataFrame, width: int = 160) -> DataFrame:
    """'kind=count, …' of every sequence, cut to a width [O-88]."""
    n = event_table.groupBy("seq", "event_type").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.sort_array(F.collect_list(F.concat("event_type", F.lit("="), F.col("n").cast("string"))))
    return n.groupBy("seq").agg(F.substring(F.array_join(pairs, ", "), 1, width).alias("title"))
