"""Frame files: listing, indexing by name, contiguity and pairing."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.naming import natural_key

#: Mask suffixes in the order in which they are tried, and image extensions.
MASK_SUFFIXES = ("_cp_masks.tif", "_omni5_masks.tif", "_ART_masks.tif", "_masks.tif")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff")


def list_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(path, name) of files, by Spark's own listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path")
    return files.withColumn("name", F.element_at(F.split("path", "/"), -1))


def index_frames(files: DataFrame, prefix: str, digits: int | None = None, mode: str = "strict") -> DataFrame:
    """(path, name, frame, digits, problem): frame numbers from names [O-01, O-02, O-03, O-04].

    A good name is prefix, digits (exactly ``digits`` of them if given), .tif or .tiff, in any case. Mode
    'strict' marks other names that share the prefix ('name') and repeated numbers ('duplicate');
    'lenient' ignores other names; 'silent' also keeps only the last file of a number. With a column ``seq``
    every sequence is indexed on its own.
    """
    width = f"{{{digits}}}" if digits else "+"
    number = F.regexp_extract("name", rf"(?i)^{re.escape(prefix)}(\d{width})\.tiff?$", 1)
    by = ["seq"] if "seq" in files.columns else []
    f = files.filter(F.lower("name").startswith(prefix.lower())).withColumn("number", number)
    f = f.select(*by, "path", "name", F.when(F.col("number") != "", F.col("number").cast("int")).alias("frame"), F.when(F.col("number") != "", F.length("number")).alias("digits"))
    if mode != "strict":
        f = f.filter("frame is not null")
    if mode == "silent":
        f = f.groupBy(*by, "frame").agg(F.max_by(F.struct("path", "name", "digits"), "name").alias("f")).select(*by, "f.path", "f.name", "frame", "f.digits")
        return f.withColumn("problem", F.lit(None).cast("string"))
    n = F.count("frame").over(Window.partitionBy(*by, "frame"))
    return f.withColumn("problem", F.when(F.col("frame").isNull(), "name").when(n > 1, "duplicate"))


def first_source(candidates: list[DataFrame]) -> DataFrame:
    """Frame files of every sequence from the first of the candidates that has any: images, markers, segmentation [O-19].

    Each candidate: (seq, frame, digits, …) of one kind of file, in order of preference.
    """
    out = candidates[0].withColumn("rank", F.lit(0))
    for i, c in enumerate(candidates[1:], 1):
        out = out.unionByName(c.withColumn("rank", F.lit(i)), allowMissingColumns=True)
    best = out.groupBy("seq").agg(F.min("rank").alias("rank"))
    return out.join(best, ["seq", "rank"], "left_semi")


def infer_frames(candidates: list[DataFrame]) -> DataFrame:
    """(seq, kind, first, frames, digits, contiguous) of every sequence, from the first kind of files that it has [O-19].

    Numbers must run without a hole, from any start; ``digits`` is null where widths differ.
    """
    g = first_source(candidates).groupBy("seq").agg(F.min("rank").alias("kind"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.countDistinct("frame").alias("frames"), F.min("digits").alias("low"), F.max("digits").alias("high"))
    return g.select("seq", "kind", "first", "frames", F.when(F.col("low") == F.col("high"), F.col("low")).alias("digits"), (F.col("last") - F.col("first") + 1 == F.col("frames")).alias("contiguous"))


def infer_shape(metas: list[DataFrame]) -> DataFrame:
    """(seq, height, width) of the first frame of the first kind of masks that a sequence has: markers, segmentation [O-19]."""
    first = first_source(metas).groupBy("seq").agg(F.min_by(F.struct("height", "width"), "frame").alias("s"))
    return first.select("seq", "s.height", "s.width")


def select_frames(frames: DataFrame, every: int = 1, most: int | None = None) -> DataFrame:
    """Every ``every``-th frame of a sequence by place, then the first ``most`` of these [O-41]."""
    place = F.row_number().over(Window.partitionBy("seq").orderBy("frame")) - 1
    out = frames.withColumn("place", place).filter(F.col("place") % every == 0)
    return (out if most is None else out.filter(F.col("place") < every * most)).drop("place")


def pair_by_place(images: DataFrame, masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, problems) of image and mask files (seq, name, height, width) by their place in natural order [O-71].

    A sequence with more of one kind is paired up to the smaller number ('count'); pairs of different shapes are
    problems ('shape') and are no pairs.
    """
    w = Window.partitionBy("seq").orderBy(natural_key(F.col("name")), "name")
    a = images.select("seq", (F.row_number().over(w) - 1).alias("frame"), F.struct("name", "height", "width").alias("image"))
    b = masks.select("seq", (F.row_number().over(w) - 1).alias("frame"), F.struct("name", "height", "width").alias("mask"))
    j = a.join(b, ["seq", "frame"], "full_outer")
    same = (F.col("image.height") == F.col("mask.height")) & (F.col("image.width") == F.col("mask.width"))
    what = F.when(F.col("image").isNull() | F.col("mask").isNull(), "count").when(~same, "shape")
    j = j.select("seq", "frame", F.col("image.name").alias("image"), F.col("mask.name").alias("mask"), what.alias("problem"))
    return j.filter("problem is null").drop("problem"), j.filter("problem is not null")


def time_axis(shape: tuple[int, ...], wanted: str = "auto") -> int:
    """Axis of a stack that frames lie along [O-136].

    'first', 'last', a number (negative from the end), or 'auto': the smallest axis (the first of equals) if it is at most half of both
    others, else the last of three.
    """
    if wanted != "auto":
        places = {str(i - n): i for n in (0, len(shape)) for i in range(len(shape))} | {"first": 0, "last": len(shape) - 1}
        if wanted not in places:
            raise ValueError(f"{wanted} is no axis of {len(shape)}")
        return places[wanted]
    if len(shape) != 3:
        raise ValueError(f"a stack has three axes, not {len(shape)}")
    least = min(range(3), key=lambda i: (shape[i], i))
    return least if all(2 * shape[least] <= n for i, n in enumerate(shape) if i != least) else 2


def widths(indexed: DataFrame) -> DataFrame:
    """Digit widths in use [O-02]."""
    return indexed.filter("digits is not null").select("digits").distinct()


def by_position(files: DataFrame, by: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """Frames by place in natural order of names, counted within each group of ``by`` [O-06, O-07, O-71, O-116, Q8]."""
    for x in exclude:
        files = files.filter(~F.col("name").contains(x))
    w = Window.partitionBy(*by).orderBy(natural_key(F.col("name")), "name")
    return files.withColumn("frame", F.row_number().over(w) - 1)


def mask_files(files: DataFrame, suffixes: tuple[str, ...] = MASK_SUFFIXES, pattern: str | None = None, required: bool = False) -> DataFrame:
    """Mask files: those whose name fits a glob ``pattern``, else those of the first suffix that has any [O-06, O-16].

    With a column ``seq`` every sequence has a suffix of its own. ``required``: no file at all is an error.
    """
    if pattern is not None:
        out = files.filter(F.col("name").rlike("^" + fnmatch.translate(pattern).removesuffix(r"\Z") + "$"))
    else:
        rank = F.lit(None).cast("int")
        for i, s in reversed(list(enumerate(suffixes))):
            rank = F.when(F.col("name").endswith(s), F.lit(i)).otherwise(rank)
        ranked = files.withColumn("rank", rank).filter("rank is not null")
        by = ["seq"] if "seq" in files.columns else []
        out = ranked.join(ranked.groupBy(*by).agg(F.min("rank").alias("rank")), [*by, "rank"], "left_semi").drop("rank").select(*files.columns)
    if required and out.isEmpty():
        raise FileNotFoundError(f"no mask files: {pattern or ', '.join('*' + s for s in suffixes)}")
    return out


def image_files(files: DataFrame) -> DataFrame:
    """Image files that aren't masks [O-17]."""
    low = F.lower("name")
    return files.filter(low.rlike(r"\.(" + "|".join(IMAGE_EXTENSIONS) + ")$") & ~low.rlike(r"_cp_masks\.tiff?$"))


def result_dirs(folders: DataFrame) -> DataFrame:
    """Sequences of '<seq>_RES' folders [O-14]."""
    return folders.filter(F.col("name").endswith("_RES")).withColumn("seq", F.regexp_replace("name", "_RES$", ""))


def sequence_dirs(folders: DataFrame) -> DataFrame:
    """Folders named by digits, normalised, once each, in order [O-15]."""
    from tessera.functions.naming import normalise_sequence

    return folders.filter(F.col("name").rlike("^[0-9]+$")).select(normalise_sequence(F.col("name")).alias("seq")).distinct().orderBy("seq")


def subset_mapping(indexed: DataFrame, start: int, end: int, kind: str, suffix: str, digits: int) -> DataFrame:
    """Source and output of every frame in [start, end], with status 'copied' or 'missing' [O-25, O-33]."""
    by = ["seq"] if "seq" in indexed.columns else []
    frames = F.explode(F.sequence(F.lit(start), F.lit(end))).alias("frame")
    want = indexed.select("seq").distinct().select("seq", frames) if by else indexed.sparkSession.range(1).select(frames)
    j = want.join(indexed.select(*by, "frame", "path"), [*by, "frame"], "left")
    out = F.format_string(f"%s%0{digits}d%s", F.lit(kind), F.col("frame") - start, F.lit(suffix))
    return j.select(*by, F.lit(kind).alias("kind"), F.col("frame").alias("source_frame"), (F.col("frame") - start).alias("output_frame"), F.col("path").alias("source_path"), out.alias("output_path"), F.when(F.col("path").isNull(), "missing").otherwise("copied").alias("status"))
