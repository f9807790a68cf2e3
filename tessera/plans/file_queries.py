"""Named queries over file names and text lines, written from the masks' frames and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import naming
from tessera.operators import logs, raster
from tessera.sources import frames, text

from .queries import Masks, query, r6

_FILES = """, files AS (
  SELECT DISTINCT seq, CASE WHEN frame % 6 = 5 THEN 'mask' || frame || '.tif' WHEN frame % 4 = 3 THEN 'MASK' || lpad(CAST(frame - 1 AS VARCHAR), 3, '0') || '.tiff'
              WHEN frame = 0 THEN 'other000.tif' ELSE 'mask' || lpad(CAST(frame AS VARCHAR), 3, '0') || '.tif' END AS name FROM gt),
numbered AS (SELECT seq, name, TRY_CAST(nullif(regexp_extract(name, '(?i)^mask(\\d{3})\\.tiff?$', 1), '') AS INTEGER) AS frame FROM files WHERE starts_with(lower(name), 'mask')) """


def _files(m: Masks) -> DataFrame:
    f = F.col("frame")
    three = lambda c: F.lpad(c.cast("string"), 3, "0")
    name = (
        F.when(f % 6 == 5, F.concat(F.lit("mask"), f.cast("string"), F.lit(".tif")))
        .when(f % 4 == 3, F.concat(F.lit("MASK"), three(f - 1), F.lit(".tiff")))
        .when(f == 0, F.lit("other000.tif"))
        .otherwise(F.concat(F.lit("mask"), three(f), F.lit(".tif")))
    )
    names = m.gt.select("seq", "frame").distinct().select("seq", name.alias("name"))
    return names.withColumn("path", F.concat_ws("/", "seq", "name"))


@query(_FILES + "SELECT seq, name, frame, CASE WHEN frame IS NULL THEN 'name' WHEN count(frame) OVER (PARTITION BY seq, frame) > 1 THEN 'duplicate' END AS problem FROM numbered")
def file_index_strict(m: Masks) -> DataFrame:
    """[O-01, V-02]"""
    return frames.index_frames(_files(m), "mask", 3).select("seq", "name", "frame", "problem")


@query(_FILES + "SELECT seq, frame, max(name) AS name FROM numbered WHERE frame IS NOT NULL GROUP BY seq, frame")
def file_index_silent(m: Masks) -> DataFrame:
    """[O-04]"""
    return frames.index_frames(_files(m), "mask", 3, "silent").select("seq", "frame", "name")


@query(_FILES + "SELECT DISTINCT CAST(length(regexp_extract(name, '(?i)^mask(\\d+)\\.tiff?$', 1)) AS INTEGER) AS digits FROM files WHERE regexp_matches(name, '(?i)^mask\\d+\\.tiff?$')")
def file_widths(m: Masks) -> DataFrame:
    """[O-02, O-03]"""
    return frames.widths(frames.index_frames(_files(m), "mask", None, "lenient"))


@query(_FILES + """SELECT q.seq, 'mask' AS kind, CAST(w AS INTEGER) AS source_frame, CAST(w - 2 AS INTEGER) AS output_frame, q.seq || '/' || n.name AS source_path,
  'mask' || lpad(CAST(w - 2 AS VARCHAR), 3, '0') || '.tif' AS output_path, CASE WHEN n.name IS NULL THEN 'missing' ELSE 'copied' END AS status
  FROM (SELECT DISTINCT seq FROM gt) q CROSS JOIN range(2, 13) t(w) LEFT JOIN (SELECT seq, frame, max(name) AS name FROM numbered WHERE frame IS NOT NULL GROUP BY seq, frame) n ON n.seq = q.seq AND n.frame = w""")
def subset_mapping(m: Masks) -> DataFrame:
    """[O-25, O-33]"""
    return frames.subset_mapping(frames.index_frames(_files(m), "mask", 3, "silent"), 2, 12, "mask", ".tif", 3)


@query(_FILES + "SELECT seq, name FROM files WHERE regexp_matches(lower(name), '\\.(png|jpg|jpeg|tif|tiff)$') AND NOT regexp_matches(lower(name), '_cp_masks\\.tiff?$')")
def image_files(m: Masks) -> DataFrame:
    """[O-17]"""
    return frames.image_files(_files(m)).select("seq", "name")


def _numbered(pixels: DataFrame, step: int) -> DataFrame:
    return pixels.select("seq", (F.col("frame") * step).alias("frame"), F.lit(4).alias("digits")).distinct()


@query("""SELECT q.seq, CAST(CASE WHEN q.n > 10 THEN 0 ELSE 1 END AS INTEGER) AS kind, CAST(lo AS INTEGER) AS first, n AS frames, 4 AS digits, hi - lo + 1 = n AS contiguous
  FROM (SELECT seq, min(frame) AS lo, max(frame) AS hi, count(DISTINCT frame) AS n FROM gt GROUP BY seq) q""")
def frame_inference(m: Masks) -> DataFrame:
    """[O-19]"""
    full = m.gt.groupBy("seq").agg(F.countDistinct("frame").alias("n")).filter("n > 10").select("seq")
    return frames.infer_frames([_numbered(m.gt, 1).join(full, "seq", "left_semi"), _numbered(m.gt, 1), _numbered(m.res, 2)])


@query("SELECT seq, frame FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY frame) - 1 AS p FROM (SELECT DISTINCT seq, frame FROM gt) d) t WHERE p % 3 = 0 AND p < 12")
def selected_frames(m: Masks) -> DataFrame:
    """[O-41]"""
    return frames.select_frames(m.gt.select("seq", "frame").distinct(), 3, 4)


@query("""SELECT seq, CAST(p AS INTEGER) AS frame, 'img' || f || '.png' AS image, 'obj' || l || '.tif' AS mask, CASE WHEN f IS NULL OR l IS NULL THEN 'count' WHEN f % 5 <> l % 5 THEN 'shape' END AS problem
  FROM (SELECT seq, frame AS f, row_number() OVER (PARTITION BY seq ORDER BY frame) - 1 AS p FROM (SELECT DISTINCT seq, frame FROM gt) d) i
  FULL JOIN (SELECT seq, label AS l, row_number() OVER (PARTITION BY seq ORDER BY label) - 1 AS p FROM (SELECT DISTINCT seq, label FROM gt) e) k USING (seq, p)""")
def image_mask_pairs(m: Masks) -> DataFrame:
    """[O-71]"""

    def side(column: str, start: str, end: str) -> DataFrame:
        c = F.col(column)
        return m.gt.select("seq", column).distinct().select("seq", F.concat(F.lit(start), c.cast("string"), F.lit(end)).alias("name"), (c % 5).alias("height"), F.lit(9).alias("width"))

    pairs, problems = frames.pair_by_place(side("frame", "img", ".png"), side("label", "obj", ".tif"))
    return pairs.withColumn("problem", F.lit(None).cast("string")).unionByName(problems)


_NAMES = "SELECT DISTINCT seq, 's' || frame || CASE WHEN frame % 2 = 0 AND seq <> '02' THEN '_omni5_masks.tif' ELSE '_masks.tif' END AS name FROM gt"


def _mask_names(m: Masks) -> DataFrame:
    end = F.when((F.col("frame") % 2 == 0) & (F.col("seq") != "02"), "_omni5_masks.tif").otherwise("_masks.tif")
    return m.gt.select("seq", "frame").distinct().select("seq", F.concat(F.lit("s"), F.col("frame").cast("string"), end).alias("name"))


@query(f", n AS ({_NAMES}) SELECT seq, name FROM n WHERE seq = '02' OR ends_with(name, '_omni5_masks.tif')")
def mask_suffix(m: Masks) -> DataFrame:
    """Sequence 02 has no files of the suffix that the others have first [O-06, O-16]"""
    return frames.mask_files(_mask_names(m))


@query(f", n AS ({_NAMES}) SELECT seq, name FROM n WHERE regexp_matches(name, '^s1._masks')")
def mask_pattern(m: Masks) -> DataFrame:
    """[O-06]"""
    return frames.mask_files(_mask_names(m), pattern="s1?_masks*", required=True)


@query("SELECT DISTINCT CASE WHEN label < 10 THEN '0' || label ELSE CAST(label AS VARCHAR) END AS seq FROM gt")
def sequence_folders(m: Masks) -> DataFrame:
    """[O-14, O-15]"""
    names = m.gt.select(F.concat(F.col("label").cast("string"), F.lit("_RES")).alias("name")).distinct()
    return frames.sequence_dirs(frames.result_dirs(names).select(F.col("seq").alias("name")))


_LINES = """, lines AS (SELECT seq, label AS line_no, CASE WHEN label % 5 = 0 THEN label || ' ' || b || ' ' || e || ' 0 9' WHEN label % 7 = 0 THEN label || ' 9 3 0' WHEN label = 4 THEN 'x'
   WHEN label = 8 THEN '6 ' || b || ' ' || e || ' 0' WHEN label = 9 THEN '9 1 2 9' ELSE label || ' ' || b || ' ' || e || ' ' || parent END AS value FROM gtt) """


def _lines(m: Masks) -> DataFrame:
    c = F.col("label")
    value = (
        F.when(c % 5 == 0, F.concat_ws(" ", "label", "begin", "end", F.lit("0 9")))
        .when(c % 7 == 0, F.concat_ws(" ", "label", F.lit("9 3 0")))
        .when(c == 4, F.lit("x"))
        .when(c == 8, F.concat_ws(" ", F.lit("6"), "begin", "end", F.lit("0")))
        .when(c == 9, F.lit("9 1 2 9"))
        .otherwise(F.concat_ws(" ", "label", "begin", "end", "parent"))
    )
    return m.gt_tracks.select("seq", c.alias("line_no"), value.alias("value"))


@query(_LINES + """SELECT seq, line_no, value, CASE WHEN len(string_split(value, ' ')) <> 4 THEN 'V-05' WHEN line_no % 7 = 0 THEN 'V-07' WHEN line_no = 9 THEN 'V-08' ELSE 'V-09' END AS problem
  FROM lines WHERE len(string_split(value, ' ')) <> 4 OR line_no % 7 = 0 OR line_no = 9 OR line_no IN (6, 8)""")
def track_file_problems(m: Masks) -> DataFrame:
    """[O-10, V-05 … V-09]"""
    return text.parse_tracks(_lines(m))[1]


@query(_LINES + "SELECT seq, CAST(string_split(value, ' ')[1] AS INTEGER) AS label, CAST(string_split(value, ' ')[2] AS INTEGER) AS b, CAST(string_split(value, ' ')[3] AS INTEGER) AS e, CAST(string_split(value, ' ')[4] AS INTEGER) AS parent FROM lines WHERE len(string_split(value, ' ')) = 4 AND line_no % 7 <> 0 AND line_no NOT IN (6, 8, 9)")
def track_file_rows(m: Masks) -> DataFrame:
    """[O-10]"""
    return text.parse_tracks(_lines(m))[0].select("seq", "label", F.col("begin").alias("b"), F.col("end").alias("e"), "parent")


@query("SELECT seq, CAST(label AS VARCHAR) || ' ' || b || ' ' || e || ' ' || parent AS value FROM gtt")
def track_file_lines(m: Masks) -> DataFrame:
    """[O-21]"""
    return text.track_lines(m.gt_tracks)


@query("SELECT seq, label, CAST('0.' || label || '5' AS DOUBLE) AS score FROM gtt")
def free_scores(m: Masks) -> DataFrame:
    """[O-13]"""
    body = F.concat(F.lit("run 3 gave -1.5 and then "), F.lit("0."), F.col("label").cast("string"), F.lit("5"))
    return m.gt_tracks.select("seq", "label", logs.free_score(body).alias("score"))


@query("SELECT DISTINCT label, CAST(greatest(1, round_even(label * 0.5, 0)) AS INTEGER) AS size FROM gt")
def scaled_sizes(m: Masks) -> DataFrame:
    """[O-44, O-45]"""
    return m.gt.select("label").distinct().select("label", naming.scaled_size(F.col("label"), 0.5).alias("size"))


@query("SELECT seq, frame, greatest(0, frame - 3) AS lo, least(19, frame + 3) AS hi FROM (SELECT DISTINCT seq, frame FROM gt) t")
def focus_windows(m: Masks) -> DataFrame:
    """[O-39]"""
    lo, hi = naming.focus_bounds(F.col("frame"), F.lit(19), 3)
    return m.gt.select("seq", "frame").distinct().select("seq", "frame", lo.alias("lo"), hi.alias("hi"))


@query("SELECT t.seq, round(1 - least(5.0 * n, 10.0 * v + 1.5 * (v - k + p)) / (10.0 * v + 1.5 * (v - k + p)), 6) AS score FROM (SELECT seq, sum(e - b + 1) AS v, count(*) AS k, sum((parent <> 0)::INT) AS p FROM gtt GROUP BY seq) t JOIN (SELECT seq, count(*) AS n FROM spl GROUP BY seq) s ON t.seq = s.seq")
def graph_score(m: Masks) -> DataFrame:
    from tessera.operators import failures

    n = failures.splits(m.gt, m.res).groupBy("seq").agg((F.count(F.lit(1)) * 5.0).alias("weighted"))
    return logs.aogm_score(n, m.gt_tracks).select("seq", r6("score"))


@query("""SELECT seq, frame, label, round(atan2(2 * (n * yx - sy * sx), (n * yy - sy * sy) - (n * xx - sx * sx)) / 2, 6) AS angle
  FROM (SELECT seq, frame, label, count(*) AS n, sum(y) AS sy, sum(x) AS sx, sum(y * y) AS yy, sum(x * x) AS xx, sum(y * x) AS yx FROM gt GROUP BY seq, frame, label) t""")
def object_orientation(m: Masks) -> DataFrame:
    """[O-133]"""
    from tessera.operators import morphology

    return morphology.orientation(m.gt).select("seq", "frame", "label", r6("angle"))


@query("SELECT g.seq, g.frame, g.y, g.x, g.label, count(q.label) AS n, count(q.label) = 1 AS endpoint, count(q.label) > 2 AS branch FROM gt g CROSS JOIN near LEFT JOIN gt q ON q.seq = g.seq AND q.frame = g.frame AND q.label = g.label AND q.y = g.y + dy AND q.x = g.x + dx AND (dy <> 0 OR dx <> 0) GROUP BY g.seq, g.frame, g.y, g.x, g.label")
def neighbour_points(m: Masks) -> DataFrame:
    """[O-132]"""
    from tessera.operators import morphology

    return morphology.neighbour_counts(m.gt)


@query()
def connected_parts(m: Masks) -> DataFrame:
    """[O-131]"""
    from tessera.operators import morphology

    return morphology.connected_parts(m.res)


@query(_LINES + """, t AS (SELECT *, string_split(value, ' ') AS w, row_number() OVER (PARTITION BY seq, string_split(value, ' ')[1] ORDER BY line_no DESC) AS back, count(*) OVER (PARTITION BY seq, string_split(value, ' ')[1]) AS times FROM lines WHERE value <> 'x'),
  four AS (SELECT *, row_number() OVER (PARTITION BY seq, w[1] ORDER BY line_no DESC) AS back4, count(*) OVER (PARTITION BY seq, w[1]) AS times4 FROM t WHERE len(w) = 4),
  kept AS (
  SELECT 'subsetter' AS level, seq, w FROM four WHERE CAST(w[2] AS INT) <= CAST(w[3] AS INT) AND times = 1
  UNION ALL SELECT 'downsampler', seq, w FROM four WHERE back4 = 1
  UNION ALL SELECT 'failures', seq, w FROM t WHERE back = 1
  UNION ALL SELECT 'viewer', t.seq, t.w FROM t WHERE times = 1 AND (w[4] = '0' OR (w[4] <> w[1] AND EXISTS (SELECT 1 FROM t p WHERE p.seq = t.seq AND p.w[1] = t.w[4]))))
  SELECT level, seq, CAST(w[1] AS INTEGER) AS label, CAST(w[2] AS INTEGER) AS b, CAST(w[3] AS INTEGER) AS e, CAST(w[4] AS INTEGER) AS parent FROM kept""")
def track_file_levels(m: Masks) -> DataFrame:
    """[O-10]"""
    lines, out = _lines(m), None
    for level in ("subsetter", "downsampler", "failures", "viewer"):
        rows = text.parse_tracks(lines, level)[0].select(F.lit(level).alias("level"), "seq", "label", F.col("begin").alias("b"), F.col("end").alias("e"), "parent")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(_LINES + "SELECT seq, CAST(w[1] AS INTEGER) AS label, CAST(w[4] AS INTEGER) AS parent FROM (SELECT *, string_split(value, ' ') AS w, row_number() OVER (PARTITION BY seq, string_split(value, ' ')[1] ORDER BY line_no DESC) AS back FROM lines WHERE len(string_split(value, ' ')) = 4) t WHERE back = 1")
def track_file_parents(m: Masks) -> DataFrame:
    """[O-10]"""
    return text.parse_tracks(_lines(m), "rebuilder")[0]


@query("""SELECT 'V-17' AS rule, seq, CAST(label AS VARCHAR) AS item, b || '-' || e AS details FROM gtt WHERE e >= 15
  UNION ALL SELECT 'V-17', coalesce(g.seq, r.seq), CAST(coalesce(g.label, r.label) AS VARCHAR), CASE WHEN r.seq IS NULL THEN 'no track row' ELSE 'no pixels' END FROM rest g FULL JOIN gtt r ON g.seq = r.seq AND g.label = r.label WHERE g.seq IS NULL OR r.seq IS NULL
  UNION ALL SELECT 'V-17', c.seq, CAST(c.label AS VARCHAR), 'parent ' || c.parent FROM gtt c LEFT JOIN gtt p ON c.seq = p.seq AND c.parent = p.label WHERE c.parent <> 0 AND p.seq IS NULL""")
def export_violations(m: Masks) -> DataFrame:
    """[V-17]"""
    from tessera.operators import validate

    return validate.export_violations(m.res, m.gt_tracks, 15)


@query("SELECT 'V-01' AS rule, seq || ':' || label AS seq, seq || ':' || label AS item, 'no result folder' AS details FROM (SELECT DISTINCT seq, label FROM gt EXCEPT SELECT DISTINCT seq, label FROM res) t")
def folders_missing(m: Masks) -> DataFrame:
    """[V-01] with a folder for every object"""
    from tessera.operators import validate

    def folders(pixels: DataFrame) -> DataFrame:
        return pixels.select(F.concat_ws(":", "seq", "label").alias("seq")).distinct()

    return validate.missing_folders(folders(m.gt), folders(m.res))


@query("SELECT seq, frame, y, x, label FROM gt UNION ALL SELECT s.seq, s.frame, s.y, s.x, s.label FROM res s WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE g.seq = s.seq AND g.frame = s.frame)")
def truth_choice(m: Masks) -> DataFrame:
    """[O-55]"""
    from tessera.operators import failures

    return failures.choose_truth(m.gt, m.res)


@query("SELECT seq, label, b, e, e - b + 1 AS n FROM runs")
def sql_track_runs(m: Masks) -> DataFrame:
    """[§2.13] the table function, called from SQL"""
    from tessera.functions import registry

    registry.register(m.spark)
    rows = m.res.select("seq", "frame", "label").distinct()
    code = F.col("seq").cast("int") * 100000 + F.col("label")
    runs = m.spark.sql("SELECT * FROM track_runs(TABLE(SELECT label, frame FROM {rows}) PARTITION BY label ORDER BY frame)", rows=rows.select(code.alias("label"), "frame"))
    return runs.select(F.format_string("%02d", F.floor(F.col("label") / 100000)).alias("seq"), (F.col("label") % 100000).alias("label"), F.col("begin").alias("b"), F.col("end").alias("e"), "n")


@query("SELECT DISTINCT seq, frame, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM res CROSS JOIN near WHERE y + dy >= 0 AND x + dx >= 0")
def sql_dilate3(m: Masks) -> DataFrame:
    """[§2.13] the table function, called from SQL"""
    from tessera.functions import registry

    registry.register(m.spark)
    return m.spark.sql("SELECT DISTINCT p.seq, p.frame, d.ny AS y, d.nx AS x FROM {pixels} p, LATERAL dilate3(p.y, p.x) d", pixels=m.res)


@query()
def identity_rescue(m: Masks) -> DataFrame:
    """[O-147]"""
    from tessera.operators import rescue

    return rescue.rescue_identities(m.res)


@query()
def rescue_audit(m: Masks) -> DataFrame:
    """[O-95]"""
    from tessera.operators import rescue

    return rescue.audit_counts(rescue.rescue_identities(m.res, gap=2))


@query()
def repaired_parents(m: Masks) -> DataFrame:
    """[O-148]"""
    from tessera.operators import rescue

    return rescue.repair(m.res)["parents"]


@query()
def workflow_tracks(m: Masks) -> DataFrame:
    """[O-148, O-149, §2.14]"""
    from .queries import HEIGHT, WIDTH
    from .workflow import Config, pipeline

    return pipeline(m.res, Config(HEIGHT, WIDTH, rescue_gap=1))["tracks"].select("seq", "label", F.col("begin").alias("b"), F.col("end").alias("e"), "parent")


@query("SELECT DISTINCT seq, frame, label, y0, x0 FROM gto WHERE label = 4")
def one_label(m: Masks) -> DataFrame:
    """[O-35]"""
    return raster.objects(m.gt.filter("label = 4")).select("seq", "frame", "label", "y0", "x0")
