"""Queries over shapes and images: skeletons, wide and turned elements, resampling, the loose tracker, number formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import naming
from tessera.operators import divide, loose_tracker, morphology, raster, resample, tracker, tracks, validate
from tessera.sources import nested, tiff
from tessera.sources.shared import shared_dir
from tessera.streaming import tracking

from .queries import _DOWN, _VIOLATIONS, HEIGHT, WIDTH, Masks, query, r6

K = ["seq", "frame"]


@query()
def loose_tracks(m: Masks) -> DataFrame:
    """[O-141]"""
    return loose_tracker.loose_tracks(m.res, HEIGHT, WIDTH)


@query()
def skeleton_points(m: Masks) -> DataFrame:
    """[O-132]"""
    return morphology.neighbour_counts(morphology.skeletons(m.gt))


@query()
def branch_labels(m: Masks) -> DataFrame:
    """[O-127]"""
    whole = m.gt.withColumn("label", F.lit(1))
    out = morphology.new_branch_labels(whole, m.res.withColumn("label", F.lit(1)), m.gt)
    return out.select(*K, F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


_ON_SQL = """FROM res r JOIN {turn} r2 USING (seq, frame, label) CROSS JOIN (SELECT unnest(range(-{r}, {r} + 1)) AS dy) a CROSS JOIN (SELECT unnest(range(-{r}, {r} + 1)) AS dx) b
  WHERE floor(cos(angle) * dy + sin(angle) * dx + 0.5) = 0 AND abs(cos(angle) * dx - sin(angle) * dy) <= {r} + 1e-9"""


@query(f""", turn AS (
  SELECT seq, frame, label, atan2(2 * (n * yx - sy * sx), (n * yy - sy * sy) - (n * xx - sx * sx)) / 2 AS angle
  FROM (SELECT seq, frame, label, count(*) AS n, sum(y) AS sy, sum(x) AS sx, sum(y * y) AS yy, sum(x * x) AS xx, sum(y * x) AS yx FROM res GROUP BY seq, frame, label) t)
SELECT DISTINCT r.seq, r.frame, r.label, CAST(r.y + dy AS INTEGER) AS y, CAST(r.x + dx AS INTEGER) AS x {_ON_SQL.format(turn="turn", r=40)}
  AND r.y + dy BETWEEN 0 AND {HEIGHT - 1} AND r.x + dx BETWEEN 0 AND {WIDTH - 1}""")
def line_dilation(m: Masks) -> DataFrame:
    """[O-130]"""
    return morphology.line_dilation(m.res, morphology.orientation(m.res), 81, HEIGHT, WIDTH).select(*K, "label", "y", "x")


def _box_sql(k: int) -> str:
    r = k // 2
    return f"""SELECT DISTINCT seq, frame, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM gt CROSS JOIN (SELECT unnest(range(-{r}, {r} + 1)) AS dy) a CROSS JOIN (SELECT unnest(range(-{r}, {r} + 1)) AS dx) b
  WHERE y + dy BETWEEN 0 AND {HEIGHT - 1} AND x + dx BETWEEN 0 AND {WIDTH - 1}"""


@query(_box_sql(27))
def box_dilate27(m: Masks) -> DataFrame:
    """[O-130]"""
    return morphology.box_morphology(m.gt, HEIGHT, WIDTH, 27)


def _along_sql(source: str, by: str, along: str, n: int) -> str:
    """Places of which all within four along one axis, inside the image, are there."""
    window = f"count(*) OVER (PARTITION BY seq, frame, {by} ORDER BY {along} RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)"
    return f"SELECT seq, frame, y, x FROM {source} QUALIFY {window} = least({along} + 4, {n - 1}) - greatest({along} - 4, 0) + 1"


@query(f", wide AS ({_box_sql(27)}), lines AS ({_along_sql('wide', 'y', 'x', WIDTH)}) {_along_sql('lines', 'x', 'y', HEIGHT)}")
def box_erode9(m: Masks) -> DataFrame:
    """[O-130]"""
    return morphology.box_chain(m.gt, HEIGHT, WIDTH, [(27, "dilate"), (9, "erode")])


def _axis_sql(name: str, n: int) -> str:
    """Halving with two taps behind a Gaussian of sigma 1/2, mirrored at the ends."""
    place = f"CASE WHEN p < 0 THEN -p WHEN p > {n - 1} THEN {2 * (n - 1)} - p ELSE p END"
    return f"""{name}w AS (SELECT new, {place} AS old, sum(0.5 * g) AS w FROM (SELECT i AS new, 2 * i + t + d AS p, exp(-2.0 * d * d) / (1 + 2 * exp(-2.0) + 2 * exp(-8.0)) AS g
  FROM (SELECT unnest(range({n // 2})) AS i) a CROSS JOIN (SELECT unnest([0, 1]) AS t) b CROSS JOIN (SELECT unnest([-2, -1, 0, 1, 2]) AS d) c) q GROUP BY new, {place})"""


@query(f""", {_axis_sql('y', HEIGHT)}, {_axis_sql('x', WIDTH)}
SELECT seq, frame, CAST(yw.new AS INTEGER) AS y, CAST(xw.new AS INTEGER) AS x, round(sum(label * 10 * yw.w * xw.w), 6) AS value FROM gt JOIN yw ON y = yw.old JOIN xw ON x = xw.old GROUP BY seq, frame, yw.new, xw.new""")
def image_resample(m: Masks) -> DataFrame:
    """[O-135]"""
    image = m.gt.select(*K, "y", "x", (F.col("label") * 10).alias("value"))
    return resample.resample(image, (HEIGHT, WIDTH), (HEIGHT // 2, WIDTH // 2)).select(*K, "y", "x", r6("value"))


@query("""SELECT l_orderkey, l_linenumber, e, format('{:.12g}', l_extendedprice * pow(10.0, e)) AS short FROM (SELECT *, (l_orderkey * 7 + l_linenumber) % 41 - 20 AS e FROM lineitem) t""")
def short_numbers(m: Masks) -> DataFrame:
    """[O-37]"""
    rows = m.table("lineitem").withColumn("e", (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 41 - 20)
    return rows.select("l_orderkey", "l_linenumber", "e", naming.short_number(F.col("l_extendedprice") * F.pow(F.lit(10.0), F.col("e"))).alias("short"))


@query()
def streamed_tracker(m: Masks) -> DataFrame:
    """The strict tracker on a stream that replays the masks, frames of a file in any order [O-157]."""
    table = tracker.opened_overlaps(m.res, HEIGHT, WIDTH)
    folder = f"{shared_dir(m.spark)}/tessera-stream-{uuid.uuid4().hex}"
    table.repartition(4, F.xxhash64("frame")).write.parquet(f"{folder}/frames")
    tracking.track_files(m.spark, f"{folder}/frames", f"{folder}/tracked", f"{folder}/checkpoint", table.schema, files_each_batch=2)
    return m.spark.read.schema(tracker.ASSIGNED).parquet(f"{folder}/tracked")


@query("SELECT seq, frame, y, x, label FROM res")
def mask_file_round_trip(m: Masks) -> DataFrame:
    """Every frame as a compressed mask file, and its pixels read back [O-08, O-22]."""
    files = tiff.mask_images(m.res, HEIGHT, WIDTH, deflate=True).select(F.concat_ws("/", "seq", "frame").alias("path"), "content")
    at = F.split("path", "/")
    return tiff.read_pages(files).select(at[0].alias("seq"), at[1].cast("int").alias("frame"), "y", "x", "label")


@query("SELECT seq, frame, y, x, label FROM gt")
def pad_crop_back(m: Masks) -> DataFrame:
    """[O-137]"""
    return raster.crop_back(raster.pad_align(m.gt, HEIGHT, WIDTH), HEIGHT, WIDTH).select(*K, "y", "x", "label")


@query("SELECT seq, frame, y, x, label FROM gt")
def patches_merged(m: Masks) -> DataFrame:
    """[O-137]"""
    return raster.merge_patches(raster.patches(m.gt, 16, 32), 16, 32)


@query(_DOWN + """SELECT r.seq, CAST(r.frame / 3 AS INTEGER) AS frame, CAST(r.y // 2 AS INTEGER) AS y, CAST(r.x // 2 AS INTEGER) AS x, n.new_label AS label FROM res r
  JOIN sn n ON r.seq = n.seq AND r.label = n.label AND r.frame / 3 BETWEEN n.b AND n.e WHERE r.frame % 3 = 0 AND r.y % 2 = 0 AND r.x % 2 = 0""")
def downsample_resized(m: Masks) -> DataFrame:
    """[O-151]"""
    out = tracks.downsample_result(m.res, m.res_parents, 7, 3, 0, (HEIGHT, WIDTH), (HEIGHT // 2, WIDTH // 2), pad_missing=True)
    return out["pixels"].select(*K, "y", "x", "label")


@query("""SELECT s.seq, CAST(i AS INTEGER) AS frame, CAST(3 * i AS INTEGER) AS source_frame, NOT EXISTS (SELECT 1 FROM res r WHERE r.seq = s.seq AND r.frame = 3 * i) AS missing
  FROM (SELECT DISTINCT seq FROM res) s CROSS JOIN (SELECT unnest(range(10)) AS i) t""")
def downsample_frames(m: Masks) -> DataFrame:
    """[O-151]"""
    return tracks.downsample_result(m.res, m.res_parents, 10, 3, pad_missing=True)["frames"]


@query()
def division_legacy(m: Masks) -> DataFrame:
    """[O-144]"""
    return divide.normalise_divisions(m.res, rule="legacy")


@query("""SELECT 'V-11' AS rule, seq, '' AS item, CAST(count(DISTINCT 80 + label % 2) AS VARCHAR) AS details FROM gt WHERE frame < label GROUP BY seq HAVING count(DISTINCT 80 + label % 2) > 1
  UNION ALL SELECT 'V-10', seq, CAST(frame AS VARCHAR), 'uint8' FROM gt WHERE frame < label AND label % 5 = 0""")
def shape_violations(m: Masks) -> DataFrame:
    """[V-10, V-11, O-82]"""
    kind = F.when(F.col("label") % 5 == 0, "uint8").otherwise("uint16")
    meta = m.gt.filter("frame < label").select(*K, (80 + F.col("label") % 2).alias("height"), F.lit(128).alias("width"), kind.alias("dtype"))
    return validate.violations(m.gt, m.gt_tracks, meta=meta).filter("rule = 'V-11' or (rule = 'V-10' and details = 'uint8')")


@query("SELECT seq, frame, '$.Result[1].MASKS' AS key, y, x, label FROM gt")
def nested_stack(m: Masks) -> DataFrame:
    """Every frame as a nested document with its mask some levels down [O-05]."""
    masks = m.gt.groupBy(*K).agg(F.sort_array(F.collect_list(F.struct("y", "x", "label"))).alias("at"))
    zeros = lambda n: F.repeat(F.lit("0,"), n)
    blanks = lambda n: F.repeat(F.lit("[" + "0," * WIDTH + "],"), n)

    def piece(p, i):
        """What lies between a pixel and the one before it, and the pixel."""
        before = F.get("at", i - 1)
        y, x = F.coalesce(before.y, F.lit(0)), F.coalesce(before.x, F.lit(-1))
        below = F.concat(zeros(WIDTH - 1 - x), F.lit("],"), blanks(p.y - y - 1), F.lit("["), zeros(p.x))
        return F.concat(F.when(p.y == y, zeros(p.x - x - 1)).otherwise(below), p.label.cast("string"), F.lit(","))

    last = F.element_at("at", -1)
    stack = F.concat(F.lit("[["), F.array_join(F.transform("at", piece), ""), zeros(WIDTH - 1 - last.x), F.lit("],"), blanks(HEIGHT - 1 - last.y), F.lit("]"))
    meta = F.struct(F.lit("none").alias("labels"), F.array(F.lit(HEIGHT), F.lit(WIDTH)).alias("shape"))
    # the items of the list differ in form, so they are put in as text; the mask is, as most of it is runs of zeros
    body = F.concat(F.lit('{"meta":'), F.to_json(meta), F.lit(',"Result":[{"x":1},{"MASKS":'), F.replace(stack, F.lit(",]"), F.lit("]")), F.lit("}]}"))
    out = nested.nested_stacks(masks.select(F.concat_ws("/", *K).alias("path"), body.alias("body")))
    at = F.split("path", "/")
    return out.select(at[0].alias("seq"), at[1].cast("int").alias("frame"), "key", "y", "x", "label")


@query(f""", bad AS ({_VIOLATIONS}), told AS (SELECT seq, sum(n)::BIGINT AS n, string_agg(rule || '=' || n, ', ' ORDER BY rule) AS rules FROM (SELECT seq, rule, count(*) AS n FROM bad GROUP BY seq, rule) t GROUP BY seq),
  p AS (SELECT seq, count(DISTINCT frame) AS frames, count(DISTINCT label) AS labels, max(label) AS max_label FROM res GROUP BY seq),
  q AS (SELECT seq, count(*) AS tracks, count(*) FILTER (parent <> 0) AS with_parent FROM gtt GROUP BY seq)
SELECT seq, coalesce(frames, 0) AS frames, coalesce(labels, 0) AS labels, coalesce(max_label, 0) AS max_label, coalesce(tracks, 0) AS tracks, coalesce(with_parent, 0) AS with_parent,
  coalesce(n, 0) AS n_violations, coalesce(rules, '') AS rules, n IS NULL AS passed FROM p FULL JOIN q USING (seq) LEFT JOIN told USING (seq)""")
def sequence_audit(m: Masks) -> DataFrame:
    """[O-96, O-97, V-03 … V-16]"""
    return validate.audit(m.res, m.gt_tracks, m.gt.withColumn("frame", F.col("frame") + 1))


@query("""SELECT l_orderkey, l_linenumber, round_even((least(1.0, greatest(0.0, l_quantity / 50)) + least(1.0, greatest(0.0, l_discount / 0.08)) + least(1.0, greatest(0.0, l_tax / 0.05))) / 3 * 65535, 0) AS grey FROM lineitem""")
def image_grey(m: Masks) -> DataFrame:
    """[O-43, O-44]"""
    channels = naming.three_channels([naming.to_unit(F.col(c), high) for c, high in (("l_quantity", 50.0), ("l_discount", 0.08), ("l_tax", 0.05), ("l_quantity", 1.0))])
    return m.table("lineitem").select("l_orderkey", "l_linenumber", naming.from_unit(naming.grey(channels), 65535.0).alias("grey"))
