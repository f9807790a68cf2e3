"""Operators on label pixels: pixels(seq, frame, y, x, label), background left out.

"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["seq", "frame"]
PIXEL = [*KEY, "y", "x"]
#: The 3 x 3 neighbourhood.
OFFSETS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def foreground(raster: DataFrame) -> DataFrame:
    """Pixels that belong to an object [O-34]."""
    return raster.filter("label <> 0")


def objects(pixels: DataFrame) -> DataFrame:
    """One row per object and frame: area, centroid and half-open box [O-35, O-76, O-77, O-78]."""
    return pixels.groupBy(*KEY, "label").agg(
        F.count(F.lit(1)).alias("area"),
        F.avg("y").alias("cy"),
        F.avg("x").alias("cx"),
        F.min("y").alias("y0"),
        F.min("x").alias("x0"),
        (F.max("y") + 1).alias("y1"),
        (F.max("x") + 1).alias("x1"),
    )


def frame_labels(pixels: DataFrame) -> DataFrame:
    """Sorted distinct labels of every frame [O-75]."""
    return pixels.groupBy(*KEY).agg(F.sort_array(F.collect_set("label")).alias("labels"))


def presence(pixels: DataFrame) -> DataFrame:
    """Pixel counts per label and frame, the sparse form of the presence matrix [O-76]."""
    return pixels.groupBy("seq", "label", "frame").agg(F.count(F.lit(1)).alias("n"))


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Shared pixels of every pair of touching-in-place labels of one frame [O-51, O-52, O-53].

    One equi-join on the pixel; both areas come from one aggregation each.
    """
    left, right = a.select(*PIXEL, F.col("label").alias("a")), b.select(*PIXEL, F.col("label").alias("b"))
    inter = left.join(right, PIXEL).groupBy(*KEY, "a", "b").agg(F.count(F.lit(1)).alias("inter"))
    a_area = left.groupBy(*KEY, "a").agg(F.count(F.lit(1)).alias("a_area"))
    b_area = right.groupBy(*KEY, "b").agg(F.count(F.lit(1)).alias("b_area"))
    return inter.join(a_area, [*KEY, "a"]).join(b_area, [*KEY, "b"]).select(*KEY, "a", "b", "inter", "a_area", "b_area")


def best_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each label of ``a`` the label of ``b`` that covers most of it; ties go to the least label.

    (best 0, n 0, coverage 0.0) where nothing covers it [O-51, Q1].
    """
    left, right = a.select(*PIXEL, F.col("label").alias("a")), b.select(*PIXEL, F.col("label").alias("b"))
    counts = left.join(right, PIXEL, "left").groupBy(*KEY, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    order = F.struct(F.when(F.col("b").isNull(), F.lit(-1)).otherwise(F.col("n")), -F.coalesce("b", F.lit(0)))
    best = counts.groupBy(*KEY, "a").agg(F.max_by(F.struct("b", "n"), order).alias("m"), F.sum("n").alias("area"))
    n = F.when(F.col("m.b").isNull(), F.lit(0)).otherwise(F.col("m.n"))
    return best.select(*KEY, "a", F.coalesce("m.b", F.lit(0)).alias("best"), n.cast("long").alias("n"), (n / F.col("area")).alias("coverage"))


def iou_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersection over union of every overlapping pair [O-52]."""
    return overlaps(a, b).withColumn("iou", F.col("inter") / (F.col("a_area") + F.col("b_area") - F.col("inter")))


def best_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """Best IoU of each label of ``a``, 0.0 without overlap [O-94]."""
    top = iou_pairs(a, b).groupBy(*KEY, F.col("a").alias("label")).agg(F.max("iou").alias("iou"))
    return a.select(*KEY, "label").distinct().join(top, [*KEY, "label"], "left").withColumn("iou", F.coalesce("iou", F.lit(0.0)))


def modal_label(a: DataFrame, b: DataFrame) -> DataFrame:
    """Most frequent label of ``b`` below each label of ``a``; ties go to the least [O-79]."""
    joined = a.select(*PIXEL, F.col("label").alias("a")).join(b.select(*PIXEL, F.col("label").alias("b")), PIXEL)
    return joined.groupBy(*KEY, "a").agg(F.mode("b", True).alias("modal"))


def overlap_fraction(a: DataFrame, b: DataFrame) -> DataFrame:
    """Share of each candidate among the covered pixels of a label [O-80]."""
    o = overlaps(a, b)
    w = Window.partitionBy(*KEY, "a")
    return o.select(*KEY, "a", "b", (F.col("inter") / F.sum("inter").over(w)).alias("fraction"))


def lag_overlap(pixels: DataFrame, lag: int = 1) -> DataFrame:
    """Overlap of objects of frame f - lag with objects of frame f [O-56; O-57 with lag 2]."""
    before = pixels.select("seq", (F.col("frame") + lag).alias("frame"), "y", "x", F.col("label").alias("prev_label"))
    return before.join(pixels.withColumnRenamed("label", "curr_label"), PIXEL).groupBy(*KEY, "prev_label", "curr_label").agg(F.count(F.lit(1)).alias("inter"))


def dilate(pixels: DataFrame, meta: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """Pixels within one step (3 x 3) of the given ones, clipped to the image [O-128].

    Each pixel is dealt to its nine neighbours and met by equality: no range join.
    """
    by = by or ["label"]
    steps = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in OFFSETS]))
    out = pixels.withColumn("s", steps).select(*KEY, *by, (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).distinct()
    out = out.filter("y >= 0 and x >= 0")
    if meta is not None:
        out = out.join(meta.select(*KEY, "height", "width"), KEY).filter("y < height and x < width").drop("height", "width")
    return out


def erode(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels whose whole neighbourhood inside the image has their label."""
    near = pixels.withColumn("s", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in OFFSETS])))
    votes = near.select(*KEY, "label", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x")).groupBy(*KEY, "label", "y", "x").agg(F.count(F.lit(1)).alias("votes"))
    rows = 3 - (F.col("y") == 0).cast("int") - (F.col("y") == height - 1).cast("int")
    cols = 3 - (F.col("x") == 0).cast("int") - (F.col("x") == width - 1).cast("int")
    return pixels.join(votes, [*PIXEL, "label"]).filter(F.col("votes") == rows * cols).select(*PIXEL, "label")


def open_labels(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """3 x 3 opening of every label; neighbours outside the image are ignored [O-129]."""
    from .frame_tables import Places, dealt

    def run(group: pd.DataFrame) -> pd.DataFrame:
        p = Places(group)
        kept = p.opened(height, width)
        return pd.DataFrame({"seq": group["seq"].iloc[0], "frame": p.frame[kept], "y": p.y[kept], "x": p.x[kept], "label": p.label[kept]})

    return dealt(pixels, 0).groupBy("seq", "part").applyInPandas(run, "seq string, frame int, y int, x int, label int")


def contacts(pixels: DataFrame) -> DataFrame:
    """Distinct pixels of frame f - 1 within one step of an object of frame f [O-58].

    touch_prev counts previous pixels under the dilated current object, touch_curr current pixels
    under the dilated previous object.
    """
    from .frame_tables import meetings

    met = meetings(pixels).filter("kind in ('touched', 'touching')").select(*KEY, "kind", "label", "n", F.explode("others").alias("other"))
    before = F.col("kind") == "touching"  # the label is that of the frame before
    return met.groupBy(*KEY, F.when(before, F.col("label")).otherwise(F.col("other")).alias("prev_label"), F.when(before, F.col("other")).otherwise(F.col("label")).alias("curr_label")).agg(
        F.sum(F.when(before, F.col("n"))).alias("touch_prev"), F.sum(F.when(~before, F.col("n"))).alias("touch_curr")
    )


def self_continuity(pixels: DataFrame, min_pixels: int = 10, min_ratio: float = 0.05) -> DataFrame:
    """Whether an object goes on from its own pixels of the frame before [O-59]."""
    same = contacts(pixels).filter("prev_label = curr_label").select(*KEY, F.col("curr_label").alias("label"), F.col("touch_curr").alias("touch"))
    areas = pixels.groupBy(*KEY, "label").agg(F.count(F.lit(1)).alias("area"))
    joined = areas.join(same, [*KEY, "label"], "left").withColumn("touch", F.coalesce("touch", F.lit(0)))
    return joined.withColumn("continues", (F.col("touch") >= min_pixels) & (F.col("touch") / F.col("area") >= min_ratio))


def infer_parents(pixels: DataFrame, min_pixels: int = 10, min_ratio: float = 0.05) -> DataFrame:
    """Mother of each object by contact with other labels of the frame before: most touched pixels, then least label [O-118, O-145]."""
    areas = pixels.groupBy(*KEY, F.col("label").alias("curr_label")).agg(F.count(F.lit(1)).alias("area"))
    c = contacts(pixels).filter("prev_label <> curr_label").join(areas, [*KEY, "curr_label"])
    c = c.filter((F.col("touch_prev") >= min_pixels) & (F.col("touch_prev") / F.col("area") >= min_ratio))
    w = Window.partitionBy(*KEY, "curr_label").orderBy(F.desc("touch_prev"), "prev_label")
    return c.withColumn("rank", F.row_number().over(w)).filter("rank = 1").select(*KEY, F.col("curr_label").alias("child"), F.col("prev_label").alias("parent"), F.col("touch_prev").alias("touch"))


def rescue_confidence(pixels: DataFrame, max_distance: float = 50.0, cooldown: bool = False) -> DataFrame:
    """Confidence that an object goes on from one of the frame before under another label [O-146].

    .35 contact + .30 IoU + .20 nearness + .15 size ratio; 1.15 times that, 1 at most, in cooldown.
    """
    o = objects(pixels)
    prev = o.select("seq", (F.col("frame") + 1).alias("frame"), F.col("label").alias("prev_label"), F.col("area").alias("pa"), F.col("cy").alias("py"), F.col("cx").alias("px"))
    curr = o.select(*KEY, F.col("label").alias("curr_label"), F.col("area").alias("ca"), F.col("cy").alias("qy"), F.col("cx").alias("qx"))
    inter = lag_overlap(pixels)
    pairs = contacts(pixels).join(prev, [*KEY, "prev_label"]).join(curr, [*KEY, "curr_label"]).join(inter, [*KEY, "prev_label", "curr_label"], "left")
    n = F.coalesce("inter", F.lit(0))
    touch = F.least(F.col("touch_prev") / F.greatest("pa", "ca"), F.lit(1.0))
    iou = n / (F.col("pa") + F.col("ca") - n)
    near = F.greatest(F.lit(0.0), 1 - F.hypot(F.col("py") - F.col("qy"), F.col("px") - F.col("qx")) / max_distance)
    size = F.least("pa", "ca") / F.greatest("pa", "ca")
    score = 0.35 * touch + 0.30 * iou + 0.20 * near + 0.15 * size
    if cooldown:
        score = F.least(F.lit(1.0), score * 1.15)
    return pairs.select(*KEY, "prev_label", "curr_label", score.alias("confidence"))


def ranked_candidates(scores: DataFrame, threshold: float = 0.3, ambiguity: float = 0.8) -> DataFrame:
    """Best and second candidate of each previous label, and whether the best is accepted [O-119, O-147]."""
    w = Window.partitionBy(*KEY, "prev_label").orderBy(F.desc("confidence"), "curr_label")
    r = scores.withColumn("rank", F.row_number().over(w)).filter("rank <= 2")
    best = r.groupBy(*KEY, "prev_label").agg(
        F.max(F.when(F.col("rank") == 1, F.col("curr_label"))).alias("best"),
        F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("first"),
        F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("confidence"))), F.lit(0.0)).alias("second"),
    )
    unclear = (F.col("second") >= F.col("first") * ambiguity) & (F.col("second") >= threshold)
    return best.withColumn("accepted", (F.col("first") >= threshold) & ~unclear)


def resize_nearest(pixels: DataFrame, from_shape: tuple[int, int], to_shape: tuple[int, int]) -> DataFrame:
    """Order-0 resize: output pixel i takes input rint((i + .5) * in / out - .5), clipped [O-134, O-135]."""
    spark = pixels.sparkSession

    def axis(n_in: int, n_out: int, name: str) -> DataFrame:
        i = F.col("id")
        source = F.least(F.greatest(F.rint((i + 0.5) * n_in / n_out - 0.5), F.lit(0.0)), F.lit(n_in - 1.0)).cast("int")
        return spark.range(n_out).select(source.alias(name), i.cast("int").alias(f"{name}_new"))

    # the two axes have as many rows as the image has lines and columns
    rows, cols = F.broadcast(axis(from_shape[0], to_shape[0], "y")), F.broadcast(axis(from_shape[1], to_shape[1], "x"))
    out = pixels.join(rows, "y").join(cols, "x")
    return out.select(*KEY, F.col("y_new").alias("y"), F.col("x_new").alias("x"), "label")


def transpose(pixels: DataFrame) -> DataFrame:
    """Swap the image axes [O-136]."""
    return pixels.select(*KEY, F.col("x").alias("y"), F.col("y").alias("x"), "label")


def pad_align(pixels: DataFrame, height: int, width: int, align: int = 64) -> DataFrame:
    """Shift pixels into an image padded on both sides to a multiple of ``align`` [O-137]."""
    top, left = (-height % align) // 2, (-width % align) // 2
    return pixels.withColumns({"y": F.col("y") + top, "x": F.col("x") + left})


def crop_back(pixels: DataFrame, height: int, width: int, align: int = 64) -> DataFrame:
    """Undo ``pad_align``: pixels of the image's own part, at their old places [O-137]."""
    top, left = (-height % align) // 2, (-width % align) // 2
    moved = pixels.withColumns({"y": F.col("y") - top, "x": F.col("x") - left})
    return moved.filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def merge_patches(pieces: DataFrame, patch_height: int, patch_width: int) -> DataFrame:
    """Undo ``patches``: pixels at their place in the image [O-137]."""
    y, x = (F.col("py") * patch_height + F.col("y")).cast("int"), (F.col("px") * patch_width + F.col("x")).cast("int")
    return pieces.select(*KEY, y.alias("y"), x.alias("x"), "label")


def patches(pixels: DataFrame, patch_height: int, patch_width: int) -> DataFrame:
    """Patch and position inside it of every pixel [O-137]."""
    y, x = F.col("y"), F.col("x")
    return pixels.select(*KEY, F.floor(y / patch_height).cast("int").alias("py"), F.floor(x / patch_width).cast("int").alias("px"), (y % patch_height).alias("y"), (x % patch_width).alias("x"), "label")


def label_loss(before: DataFrame, after: DataFrame, scale: float) -> DataFrame:
    """Labels lost and gained by rescaling, and the foreground against what the scale predicts [O-90, O-123]."""
    a = before.groupBy(*KEY).agg(F.sort_array(F.collect_set("label")).alias("labels"), F.count(F.lit(1)).alias("fg"))
    b = after.groupBy(*KEY).agg(F.sort_array(F.collect_set("label")).alias("new"), F.count(F.lit(1)).alias("new_fg"))
    j = a.join(b, KEY, "left")
    new, fg = F.coalesce("new", F.array().cast("array<int>")), F.coalesce("new_fg", F.lit(0))
    expected = F.col("fg") * scale * scale
    return j.select(
        *KEY,
        F.array_except("labels", new).alias("lost"),
        F.array_except(new, "labels").alias("gained"),
        F.when(expected > 0, fg / expected).otherwise(F.lit(1.0)).alias("ratio"),
    )


def newborn_and_vanished(pixels: DataFrame) -> DataFrame:
    """Labels absent from the frame before (born) or from the frame after (gone), inside the sequence [O-61, O-123, O-126]."""
    now = pixels.select(*KEY, "label").distinct()
    span = now.groupBy("seq").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    before = now.withColumn("frame", F.col("frame") + 1)
    after = now.withColumn("frame", F.col("frame") - 1)
    born = now.join(before, [*KEY, "label"], "left_anti").join(span, "seq").filter("frame > first").select(*KEY, "label", F.lit("born").alias("what"))
    gone = now.join(after, [*KEY, "label"], "left_anti").join(span, "seq").filter("frame < last").select(*KEY, "label", F.lit("gone").alias("what"))
    return born.unionByName(gone)


def relabel(pixels: DataFrame, table: DataFrame) -> DataFrame:
    """Pixels under their new labels; a label without an entry for its frame becomes background [O-70, Q21]."""
    hit = (F.col("p.seq") == F.col("r.seq")) & (F.col("p.label") == F.col("r.old_label")) & F.col("p.frame").between(F.col("r.begin"), F.col("r.end"))
    return pixels.alias("p").join(table.alias("r"), hit).select("p.seq", "p.frame", "p.y", "p.x", F.col("r.new_label").alias("label")).filter("label <> 0")


def overlay(pixels: DataFrame, alpha: float = 0.5) -> DataFrame:
    """RGBA of every labelled pixel: hue by the golden ratio, saturation .85, value 1 [O-46, O-47]."""
    from tessera.functions.naming import track_color

    return pixels.select(*PIXEL, "label", *[c.alias(n) for n, c in zip(("r", "g", "b"), track_color(F.col("label")), strict=True)], F.lit(alpha).alias("a"))
