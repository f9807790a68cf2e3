"""Named queries over masks derived from ``lineitem``, each with the same query in SQL.

Every query is one operator (or a chain of them) on the derived masks. The SQL is written on its own
from the operator's definition and runs in DuckDB on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import masks, naming
from tessera.operators import divide, failures, lineage, logs, raster, tracker, tracks, validate
from tessera.sources import frames
from tessera.sources.shared import written_once
from tessera.streaming import sessions

HEIGHT, WIDTH = 80, 128
K = ["seq", "frame"]


class Masks:
    """Inputs of the queries: ground truth, result, and their track tables."""

    def __init__(self, spark: SparkSession, sf_dir: str, sequences: int | None = None):
        self.spark, self.dir, self.sequences = spark, sf_dir, sequences

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def gt(self) -> DataFrame:
        return masks.ground_truth(self.table("lineitem"), self.sequences)

    @cached_property
    def res(self) -> DataFrame:
        return masks.results(self.table("lineitem"), self.sequences)

    @cached_property
    def seg(self) -> DataFrame:
        return masks.segmentation(self.table("lineitem"), self.sequences)

    @cached_property
    def gt_parents(self) -> DataFrame:
        return self.gt.select("seq", "label").distinct().withColumn("parent", F.when(F.col("label") > 24, F.col("label") - 24).otherwise(0))

    @cached_property
    def res_parents(self) -> DataFrame:
        return self.res.select("seq", "label").distinct().withColumn("parent", F.when(F.col("label").between(13, 24), F.col("label") - 12).otherwise(0))

    @cached_property
    def gt_tracks(self) -> DataFrame:
        return tracks.spans(self.gt).join(self.gt_parents, ["seq", "label"]).drop("has_gap")

    @cached_property
    def res_tracks(self) -> DataFrame:
        return tracks.spans(self.res).join(self.res_parents, ["seq", "label"]).drop("has_gap")

    @cached_property
    def matched(self) -> DataFrame:
        return failures.matches(self.gt, self.res)

    @cached_property
    def events(self) -> DataFrame:
        w = self.written
        return failures.events(w.gt, w.res, w.gt_tracks, w.res_tracks, seg=w.seg)

    @cached_property
    def written(self) -> Masks:
        """The same masks as tables, for queries that read them many times: derived once."""
        out = Masks(self.spark, self.dir, self.sequences)
        for name in ("gt", "res", "seg"):
            out.__dict__[name] = written_once(getattr(self, name), f"masks-{name}")
        return out

    @cached_property
    def tra_log(self) -> DataFrame:
        """A penalty log written from the switches, misses and extras of every sequence."""
        heads = [(0, "Splitting Operations", " (Penalty=5)"), (100000, "False Negative Vertices", " (Penalty=10)"), (200000, "False Positive Vertices", ""), (300000, "Edges To Be Added", " (Penalty=x)"), (400000, "Unknown Things", "")]
        seqs = self.gt.select("seq").distinct()
        lines = [seqs.select("seq", F.lit(n).alias("line_no"), F.lit(f"----------{t}{p}----------").alias("value")) for n, t, p in heads]
        miss, extra = self.matched.filter("res = 0").select("seq", "frame", F.col("gt").alias("label")), raster.best_overlap(self.res, self.gt).filter("best = 0").select("seq", "frame", F.col("a").alias("label"))
        for base, part in ((100000, miss), (200000, extra), (400000, miss)):
            lines.append(part.select("seq", (F.lit(base + 1) + F.col("frame") * 100 + F.col("label")).alias("line_no"), F.concat(F.lit("T="), F.col("frame").cast("string"), F.lit(" Label="), F.col("label").cast("string")).alias("value")))
        lines.append(seqs.select("seq", F.lit(500000).alias("line_no"), F.lit("=" * 40).alias("value")))
        score = miss.groupBy("seq").agg((1 - F.count(F.lit(1)) / 1000).alias("score"))
        lines.append(score.select("seq", F.lit(500001).alias("line_no"), F.format_string("Tra measure: %.6f", "score").alias("value")))
        lines.append(seqs.select("seq", F.lit(499999).alias("line_no"), F.lit("TRA measure: 0.75").alias("value")))
        out = lines[0]
        for x in lines[1:]:
            out = out.unionByName(x)
        return out

    @cached_property
    def seg_log(self) -> DataFrame:
        """An object log: a header per frame (even ones without Z), then each object's best IoU."""
        iou = raster.best_iou(self.gt, self.res)
        head = iou.select(*K).distinct().select("seq", (F.col("frame") * 1000).alias("line_no"), F.concat(F.lit("----------T="), F.col("frame").cast("string"), F.when(F.col("frame") % 2 == 0, "").otherwise(" Z=-1"), F.lit("----------")).alias("value"))
        rows = iou.select("seq", (F.col("frame") * 1000 + F.col("label")).alias("line_no"), F.concat(F.lit("GT_label="), F.col("label").cast("string"), F.lit(" J="), F.format_string("%.6f", "iou")).alias("value"))
        return head.unionByName(rows)


SQL_BASE = f"""WITH {masks.SQL.strip()}, gto AS (
  SELECT seq, frame, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM gt GROUP BY seq, frame, label
), reso AS (
  SELECT seq, frame, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM res GROUP BY seq, frame, label
), ov AS (
  SELECT g.seq, g.frame, g.label AS a, r.label AS b, count(*) AS n_both FROM gt g JOIN res r ON g.seq = r.seq AND g.frame = r.frame AND g.y = r.y AND g.x = r.x GROUP BY g.seq, g.frame, g.label, r.label
), iou AS (
  SELECT o.seq, o.frame, o.a, o.b, n_both, g.area AS a_area, r.area AS b_area, n_both / (g.area + r.area - n_both) AS iou
  FROM ov o JOIN gto g ON o.seq = g.seq AND o.frame = g.frame AND o.a = g.label JOIN reso r ON o.seq = r.seq AND o.frame = r.frame AND o.b = r.label
), best AS (
  SELECT g.seq, g.frame, g.label AS gt, coalesce(o.b, 0) AS res, coalesce(o.n_both, 0) AS n, coalesce(o.n_both, 0) / g.area AS coverage
  FROM gto g LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY seq, frame, a ORDER BY n_both DESC, b) AS rn FROM ov) o ON g.seq = o.seq AND g.frame = o.frame AND g.label = o.a AND o.rn = 1
), back AS (
  SELECT g.seq, g.frame, g.label AS res, coalesce(o.a, 0) AS gt, coalesce(o.n_both, 0) AS n, coalesce(o.n_both, 0) / g.area AS coverage
  FROM reso g LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY seq, frame, b ORDER BY n_both DESC, a) AS rn FROM ov) o ON g.seq = o.seq AND g.frame = o.frame AND g.label = o.b AND o.rn = 1
), m AS (
  SELECT * FROM best WHERE res > 0 AND coverage >= 0.5
), gtt AS (
  SELECT seq, label, min(frame) AS b, max(frame) AS e, count(DISTINCT frame) AS n, CASE WHEN label > 24 THEN label - 24 ELSE 0 END AS parent FROM gt GROUP BY seq, label
), rest AS (
  SELECT seq, label, min(frame) AS b, max(frame) AS e, count(DISTINCT frame) AS n, CASE WHEN label BETWEEN 13 AND 24 THEN label - 12 ELSE 0 END AS parent FROM res GROUP BY seq, label
), lf AS (
  SELECT DISTINCT seq, label, frame FROM res
), runs AS (
  SELECT seq, label, min(frame) AS b, max(frame) AS e FROM (SELECT *, frame - row_number() OVER (PARTITION BY seq, label ORDER BY frame) AS island FROM lf) t GROUP BY seq, label, island
), nruns AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY seq ORDER BY label, b) AS INTEGER) AS new_label FROM runs
), sw AS (
  SELECT seq, frame, gt, before AS res_before, res FROM (
    SELECT *, lag(res) OVER w AS before, lag(frame) OVER w AS last FROM m WINDOW w AS (PARTITION BY seq, gt ORDER BY frame)) t
  WHERE last = frame - 1 AND before <> res
), mrg AS (
  SELECT seq, frame, res, string_agg(CAST(gt AS VARCHAR), ',' ORDER BY gt) AS gt_ids, count(*) AS n_ids FROM m GROUP BY seq, frame, res HAVING count(*) > 1
), spl AS (
  SELECT o.seq, o.frame, a AS gt, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS res_ids, count(*) AS n_ids FROM iou o WHERE n_both / a_area >= 0.2 GROUP BY o.seq, o.frame, a HAVING count(*) > 1
), frag AS (
  SELECT seq, gt, min(frame) AS frame, count(DISTINCT res) AS n_results, array_to_string(list_sort(list(DISTINCT res)), ',') AS res_ids FROM m GROUP BY seq, gt HAVING count(DISTINCT res) > 1
), steps AS (
  SELECT seq, frame, label, sqrt((cy - py) * (cy - py) + (cx - px) * (cx - px)) AS step FROM (
    SELECT *, lag(cy) OVER w AS py, lag(cx) OVER w AS px, lag(frame) OVER w AS pf FROM reso WINDOW w AS (PARTITION BY seq, label ORDER BY frame)) t WHERE pf = frame - 1
), med AS (
  SELECT seq, label, coalesce(median(CASE WHEN step > 0 THEN step END), 0) AS md FROM steps GROUP BY seq, label
), jmp AS (
  SELECT s.*, md, greatest(50.0, md * 5) AS threshold FROM steps s JOIN med USING (seq, label) WHERE step > greatest(50.0, md * 5)
), giou AS (
  SELECT g.seq, g.frame, g.label, coalesce(max(iou), 0) AS iou FROM gto g LEFT JOIN iou i ON g.seq = i.seq AND g.frame = i.frame AND g.label = i.a GROUP BY g.seq, g.frame, g.label
), riou AS (
  SELECT g.seq, g.frame, g.label, coalesce(max(iou), 0) AS iou FROM reso g LEFT JOIN iou i ON g.seq = i.seq AND g.frame = i.frame AND g.label = i.b GROUP BY g.seq, g.frame, g.label
), div AS (
  SELECT c.seq, c.b AS frame, c.label AS child, c.parent, mc.res AS res_child, mp.res AS res_parent, r.parent AS found_parent,
         CASE WHEN mc.res IS NULL OR mp.res IS NULL THEN 'division_missing_result_mapping' WHEN r.parent IS DISTINCT FROM mp.res THEN 'wrong_division_parent' ELSE 'ok' END AS outcome
  FROM gtt c JOIN gtt p ON c.seq = p.seq AND c.parent = p.label
  LEFT JOIN m mc ON c.seq = mc.seq AND c.b = mc.frame AND c.label = mc.gt
  LEFT JOIN m mp ON c.seq = mp.seq AND p.e = mp.frame AND c.parent = mp.gt
  LEFT JOIN rest r ON c.seq = r.seq AND mc.res = r.label
  WHERE c.parent > 0
), sov AS (
  SELECT g.seq, g.frame, g.label AS a, r.label AS b, count(*) AS n_both FROM seg g JOIN res r ON g.seq = r.seq AND g.frame = r.frame AND g.y = r.y AND g.x = r.x GROUP BY g.seq, g.frame, g.label, r.label
), siou AS (
  SELECT o.*, n_both / (g.area + r.area - n_both) AS iou FROM sov o JOIN gto g ON o.seq = g.seq AND o.frame = g.frame AND o.a = g.label JOIN reso r ON o.seq = r.seq AND o.frame = r.frame AND o.b = r.label
), sgiou AS (
  SELECT g.seq, g.frame, g.label, coalesce(max(iou), 0) AS iou FROM gto g LEFT JOIN siou i ON g.seq = i.seq AND g.frame = i.frame AND g.label = i.a GROUP BY g.seq, g.frame, g.label
), sriou AS (
  SELECT g.seq, g.frame, g.label, coalesce(max(iou), 0) AS iou FROM reso g LEFT JOIN siou i ON g.seq = i.seq AND g.frame = i.frame AND g.label = i.b GROUP BY g.seq, g.frame, g.label
), ev AS (
  SELECT seq, frame, 'missed_gt_object' AS event_type, CAST(gt AS VARCHAR) AS gt_id, '' AS res_id, CAST(0 AS DOUBLE) AS score, '' AS details, 0 AS p0, frame AS p1, 0 AS p2 FROM best WHERE res = 0
  UNION ALL SELECT seq, frame, 'low_gt_marker_coverage', CAST(gt AS VARCHAR), CAST(res AS VARCHAR), coverage, '', 0, frame, 0 FROM best WHERE res > 0 AND coverage < 0.5
  UNION ALL SELECT seq, frame, 'extra_result_no_gt_marker', '', CAST(res AS VARCHAR), 0, 'Marker-based check; confirm visually if GT TRA markers are sparse.', 0, frame, 1 FROM back WHERE gt = 0
  UNION ALL SELECT seq, frame, 'many_gt_to_one_result_merge', gt_ids, CAST(res AS VARCHAR), NULL, n_ids || ' GT labels matched one result label.', 0, frame, 2 FROM mrg
  UNION ALL SELECT seq, frame, 'one_gt_to_many_results_split', CAST(gt AS VARCHAR), res_ids, NULL, n_ids || ' result labels cover one GT marker/segment.', 0, frame, 3 FROM spl
  UNION ALL SELECT seq, frame, 'low_segmentation_iou', CAST(label AS VARCHAR), '', iou, 'Computed against GT SEG frame.', 0, frame, 4 FROM sgiou WHERE iou < 0.5
  UNION ALL SELECT seq, frame, 'extra_or_low_iou_result_object', '', CAST(label AS VARCHAR), iou, 'Computed against GT SEG frame.', 0, frame, 5 FROM sriou WHERE iou < 0.5
  UNION ALL SELECT seq, frame, 'id_switch', CAST(gt AS VARCHAR), CAST(res AS VARCHAR), NULL, 'Previous result label was ' || res_before || ' at frame ' || (frame - 1) || '.', 1, gt, frame FROM sw
  UNION ALL SELECT seq, frame, 'fragmented_gt_track', CAST(gt AS VARCHAR), res_ids, NULL, 'GT track matched ' || n_results || ' result IDs over time.', 1, gt, 1073741824 FROM frag
  UNION ALL SELECT seq, frame, 'suspicious_centroid_jump', '', CAST(label AS VARCHAR), step, printf('Threshold=%.2f; median_step=%.2f.', threshold, md), 2, label, frame FROM jmp
  UNION ALL SELECT seq, frame, outcome, CAST(child AS VARCHAR), CASE WHEN outcome = 'wrong_division_parent' THEN CAST(res_child AS VARCHAR) ELSE '' END, NULL,
    CASE WHEN outcome = 'wrong_division_parent' THEN 'Expected result parent ' || res_parent || ', observed ' || coalesce(CAST(found_parent AS VARCHAR), 'None') || '.'
         ELSE 'GT parent=' || parent || '; res_child=' || coalesce(CAST(res_child AS VARCHAR), 'None') || '; res_parent=' || coalesce(CAST(res_parent AS VARCHAR), 'None') || '.' END, 3, child, 0 FROM div WHERE outcome <> 'ok'
), near AS (SELECT dy, dx FROM (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)
), con AS (
  SELECT c.seq, c.frame, p.label AS prev_label, c.label AS curr_label, count(DISTINCT p.y * 100000 + p.x) AS touch_prev, count(DISTINCT c.y * 100000 + c.x) AS touch_curr
  FROM res c CROSS JOIN near JOIN res p ON p.seq = c.seq AND p.frame = c.frame - 1 AND p.y = c.y + dy AND p.x = c.x + dx
  WHERE c.y + dy >= 0 AND c.x + dx >= 0 GROUP BY c.seq, c.frame, p.label, c.label
)"""

Query = Callable[[Masks], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    """Register the function's name as a query; ``sql`` follows the common table expressions."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def r6(c: str):
    return F.round(c, 6).alias(c)


# objects and overlaps


@query("SELECT seq, frame, label, area FROM gto")
def object_areas(m: Masks) -> DataFrame:
    return raster.objects(m.gt).select(*K, "label", "area")


@query("SELECT seq, frame, label, round(cy, 6) AS cy, round(cx, 6) AS cx FROM gto")
def object_centroids(m: Masks) -> DataFrame:
    return raster.objects(m.gt).select(*K, "label", r6("cy"), r6("cx"))


@query("SELECT seq, frame, label, y0, x0, y1, x1 FROM gto")
def object_boxes(m: Masks) -> DataFrame:
    return raster.objects(m.gt).select(*K, "label", "y0", "x0", "y1", "x1")


@query("SELECT seq, frame, string_agg(CAST(label AS VARCHAR), ',' ORDER BY label) AS labels FROM gto GROUP BY seq, frame")
def frame_label_lists(m: Masks) -> DataFrame:
    return raster.frame_labels(m.gt).select(*K, F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@query("SELECT seq, label, frame, area AS n FROM gto WHERE label <> 0")
def presence_table(m: Masks) -> DataFrame:
    return raster.presence(raster.foreground(m.gt))


@query("SELECT seq, frame, gt, res, n, round(coverage, 6) AS coverage FROM best")
def best_overlap_gt(m: Masks) -> DataFrame:
    return m.matched.select(*K, "gt", "res", "n", r6("coverage"))


@query("SELECT seq, frame, res, gt, n, round(coverage, 6) AS coverage FROM back")
def best_overlap_res(m: Masks) -> DataFrame:
    return raster.best_overlap(m.res, m.gt).select(*K, F.col("a").alias("res"), F.col("best").alias("gt"), "n", r6("coverage"))


@query("SELECT seq, frame, a, b, n_both AS inter, a_area, b_area, round(iou, 6) AS iou FROM iou")
def iou_pairs(m: Masks) -> DataFrame:
    return raster.iou_pairs(m.gt, m.res).select(*K, "a", "b", "inter", "a_area", "b_area", r6("iou"))


@query("SELECT seq, frame, label, round(iou, 6) AS iou FROM giou")
def best_iou_gt(m: Masks) -> DataFrame:
    return raster.best_iou(m.gt, m.res).select(*K, "label", r6("iou"))


@query("SELECT seq, frame, a, b AS modal FROM (SELECT *, row_number() OVER (PARTITION BY seq, frame, a ORDER BY n_both DESC, b) AS rn FROM ov) t WHERE rn = 1")
def modal_labels(m: Masks) -> DataFrame:
    return raster.modal_label(m.gt, m.res)


@query("SELECT seq, frame, a, b, round(n_both / sum(n_both) OVER (PARTITION BY seq, frame, a), 6) AS fraction FROM ov")
def overlap_fractions(m: Masks) -> DataFrame:
    return raster.overlap_fraction(m.gt, m.res).select(*K, "a", "b", r6("fraction"))


def _lag_sql(lag: int) -> str:
    return f"SELECT c.seq, c.frame, p.label AS prev_label, c.label AS curr_label, count(*) AS inter FROM res p JOIN res c ON p.seq = c.seq AND c.frame = p.frame + {lag} AND p.y = c.y AND p.x = c.x GROUP BY c.seq, c.frame, p.label, c.label"


@query(_lag_sql(1))
def frame_overlap(m: Masks) -> DataFrame:
    return raster.lag_overlap(m.res)


@query(_lag_sql(2))
def gap_overlap(m: Masks) -> DataFrame:
    return raster.lag_overlap(m.res, 2)


# diagnosis


@query("SELECT seq, frame, gt, res_before, res FROM sw")
def id_switches(m: Masks) -> DataFrame:
    return failures.id_switches(m.matched)


@query("SELECT seq, gt, frame, n_results FROM frag")
def fragmentation(m: Masks) -> DataFrame:
    return failures.fragmented(m.matched)


@query("SELECT seq, frame, res, gt_ids FROM mrg")
def merges(m: Masks) -> DataFrame:
    return failures.merges(m.matched)


@query("SELECT seq, frame, gt, res_ids FROM spl")
def splits(m: Masks) -> DataFrame:
    return failures.splits(m.gt, m.res)


@query("SELECT seq, frame, label, round(step, 6) AS step FROM steps")
def step_distance(m: Masks) -> DataFrame:
    return failures.steps(raster.objects(m.res)).select(*K, "label", r6("step"))


@query("SELECT seq, label, round(md, 6) AS median FROM med")
def median_step(m: Masks) -> DataFrame:
    return failures.median_step(failures.steps(raster.objects(m.res))).select("seq", "label", r6("median"))


@query("SELECT seq, frame, label, round(step, 6) AS step FROM jmp")
def centroid_jumps(m: Masks) -> DataFrame:
    return failures.jumps(failures.steps(raster.objects(m.res))).select(*K, "label", r6("step"))


@query("SELECT seq, frame, child, parent, res_child, res_parent, found_parent, outcome FROM div")
def division_mapping(m: Masks) -> DataFrame:
    return failures.divisions(m.gt_tracks, m.matched, m.res_tracks)


@query("SELECT seq, frame, event_type, gt_id, res_id, round(score, 6) AS score, details FROM ev")
def failure_events(m: Masks) -> DataFrame:
    return m.events.select(*K, "event_type", "gt_id", "res_id", r6("score"), "details")


@query('SELECT seq, frame, event_type, count(*) AS "count" FROM ev GROUP BY seq, frame, event_type')
def failures_by_frame(m: Masks) -> DataFrame:
    return failures.by_frame(m.events)


@query("SELECT seq, CASE WHEN gt_id = '' THEN 'res:' || res_id ELSE gt_id END AS track, event_type, count(*) AS \"count\" FROM ev GROUP BY 1, 2, 3")
def failures_by_track(m: Masks) -> DataFrame:
    return failures.by_track(m.events)


@query("SELECT seq, frame, event_type, count(*) AS n FROM ev GROUP BY GROUPING SETS ((seq, frame, event_type), (seq, event_type), (seq), ())")
def failure_cube(m: Masks) -> DataFrame:
    return failures.cube(m.events)


@query("SELECT seq, frame, n, CAST(place AS INTEGER) AS place FROM (SELECT seq, frame, count(*) AS n, row_number() OVER (PARTITION BY seq ORDER BY count(*) DESC, min((p0, p1, p2))) AS place FROM ev GROUP BY seq, frame) t WHERE place <= 25")
def top_failure_frames(m: Masks) -> DataFrame:
    return failures.top_frames(m.events)


@query("SELECT seq, substr(string_agg(event_type || '=' || n, ', ' ORDER BY event_type || '=' || n), 1, 160) AS title FROM (SELECT seq, event_type, count(*) AS n FROM ev GROUP BY seq, event_type) t GROUP BY seq")
def failure_titles(m: Masks) -> DataFrame:
    return failures.title(m.events)


# tracks


@query("SELECT seq, label, b, e, e - b + 1 <> n AS has_gap FROM rest")
def track_spans(m: Masks) -> DataFrame:
    return tracks.spans(m.res).select("seq", "label", F.col("begin").alias("b"), F.col("end").alias("e"), "has_gap")


@query("SELECT seq, label, string_agg(CAST(frame AS VARCHAR), ',' ORDER BY frame) AS frames FROM lf GROUP BY seq, label")
def label_frame_lists(m: Masks) -> DataFrame:
    return tracks.frame_lists(m.res).select("seq", "label", F.array_join(F.transform("frames", lambda x: x.cast("string")), ",").alias("frames"))


@query("SELECT seq, label, b, e, new_label FROM nruns")
def track_runs(m: Masks) -> DataFrame:
    return tracks.numbered_runs(tracks.runs(tracks.label_frames(m.res))).select("seq", F.col("old_label").alias("label"), F.col("begin").alias("b"), F.col("end").alias("e"), "new_label")


_ASOF = """SELECT c.seq, c.new_label AS label, c.b, c.e, coalesce((
    SELECT arg_max(p.new_label, p.e * 100000 + p.new_label) FROM nruns p JOIN rest r ON r.seq = c.seq AND r.label = c.label AND r.parent <> 0
    WHERE p.seq = c.seq AND p.label = r.parent AND p.e < c.b AND c.b > 0), 0) AS parent FROM nruns c"""


@query(_ASOF)
def track_export(m: Masks) -> DataFrame:
    return tracks.export_tracks(m.res, m.res_parents).select("seq", "label", F.col("begin").alias("b"), F.col("end").alias("e"), "parent")


@query("SELECT seq, label, b, e, CASE WHEN b = 0 THEN 0 ELSE parent END AS parent FROM gtt")
def track_rows(m: Masks) -> DataFrame:
    return tracks.build_track_rows(tracks.spans(m.gt), m.gt_parents).select("seq", "label", F.col("begin").alias("b"), F.col("end").alias("e"), "parent")


@query("""SELECT c.seq, c.label, c.b, c.e, CASE WHEN p.e IS NOT NULL AND p.label <> c.label AND p.e < c.b AND c.b > 0 THEN c.parent ELSE 0 END AS parent
  FROM (SELECT seq, label, greatest(b, 5) - 5 AS b, least(e, 15) - 5 AS e, parent FROM gtt WHERE b <= 15 AND e >= 5) c
  LEFT JOIN (SELECT seq, label, least(e, 15) - 5 AS e FROM gtt WHERE b <= 15 AND e >= 5) p ON c.seq = p.seq AND c.parent = p.label""")
def track_clip_rebase(m: Masks) -> DataFrame:
    return tracks.clip_rebase(m.gt_tracks, 5, 15).select("seq", "label", F.col("begin").alias("b"), F.col("end").alias("e"), "parent")


@query("""SELECT c.seq, c.label, c.b, c.e, CASE WHEN p.e < c.b AND p.label <> c.label THEN c.parent ELSE 0 END AS parent, c.e - c.b + 1 <> c.n AS has_gap,
  c.parent <> 0 AND NOT coalesce(p.e < c.b AND p.label <> c.label, false) AS parent_dropped
  FROM rest c LEFT JOIN rest p ON c.seq = p.seq AND c.parent = p.label""")
def track_rebuild(m: Masks) -> DataFrame:
    return tracks.rebuild(m.res, m.res_tracks).select("seq", "label", F.col("begin").alias("b"), F.col("end").alias("e"), "parent", "has_gap", "parent_dropped")


_DOWN = """, sf AS (SELECT DISTINCT seq, label, CAST(frame / 3 AS INTEGER) AS frame FROM res WHERE frame % 3 = 0),
sr AS (SELECT seq, label, min(frame) AS b, max(frame) AS e FROM (SELECT *, frame - row_number() OVER (PARTITION BY seq, label ORDER BY frame) AS island FROM sf) t GROUP BY seq, label, island),
sn AS (SELECT *, CAST(row_number() OVER (PARTITION BY seq ORDER BY label, b) AS INTEGER) AS new_label FROM sr) """


@query(_DOWN + _ASOF.replace("nruns", "sn"))
def temporal_downsample_tracks(m: Masks) -> DataFrame:
    return tracks.downsample_tracks(m.res, m.res_parents, 3).select("seq", "label", F.col("begin").alias("b"), F.col("end").alias("e"), "parent")


@query(_DOWN + "SELECT r.seq, CAST(r.frame / 3 AS INTEGER) AS frame, r.y, r.x, n.new_label AS label FROM res r JOIN sn n ON r.seq = n.seq AND r.label = n.label AND r.frame / 3 BETWEEN n.b AND n.e WHERE r.frame % 3 = 0")
def downsample_pixels(m: Masks) -> DataFrame:
    return tracks.downsample_pixels(m.res, 3)


@query(""", ranked AS (SELECT *, row_number() OVER (PARTITION BY seq, label ORDER BY b) AS rn FROM runs),
mv AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY label, b) AS k FROM ranked WHERE rn > 1 AND e - b + 1 >= 2),
top AS (SELECT seq, max(label) AS rows FROM runs GROUP BY seq),
slots AS (SELECT seq, rows, unnest(range(1, rows + 1)) AS id FROM top),
free AS (SELECT seq, id, row_number() OVER (PARTITION BY seq ORDER BY id) AS k FROM slots s WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.seq = s.seq AND r.label = s.id)),
nf AS (SELECT t.seq, t.rows, count(f.id) AS free FROM top t LEFT JOIN free f ON t.seq = f.seq GROUP BY t.seq, t.rows)
SELECT seq, label AS old_label, b, e, label AS new_label, 'kept' AS outcome FROM ranked WHERE rn = 1
UNION ALL SELECT m.seq, m.label, m.b, m.e, CAST(coalesce(f.id, n.rows + m.k - n.free) AS INTEGER), 'moved' FROM mv m LEFT JOIN free f ON m.seq = f.seq AND m.k = f.k JOIN nf n ON m.seq = n.seq
UNION ALL SELECT seq, label, b, e, NULL, 'short' FROM ranked WHERE rn > 1 AND e - b + 1 < 2""")
def split_discontinuous(m: Masks) -> DataFrame:
    return tracks.split_discontinuous(tracks.label_frames(m.res), 2).select("seq", "old_label", F.col("begin").alias("b"), F.col("end").alias("e"), "new_label", "outcome")


@query("SELECT seq, label, n AS n_frames, CAST(row_number() OVER (PARTITION BY seq ORDER BY label) AS INTEGER) AS new_label FROM rest WHERE n >= 10")
def survivors_reid(m: Masks) -> DataFrame:
    return tracks.survivors(m.res, 10)


@query("SELECT seq, label, CAST(row_number() OVER (PARTITION BY seq ORDER BY label) AS INTEGER) AS compact FROM rest")
def compact_labels(m: Masks) -> DataFrame:
    return tracks.compact_labels(m.res)


@query("""SELECT s.seq, CAST(s.frame AS INTEGER) AS frame, coalesce(n, 0) AS n, n IS NULL AS missing
  FROM (SELECT seq, unnest(range(0, 25)) AS frame FROM (SELECT DISTINCT seq FROM gt) q) s LEFT JOIN (SELECT seq, frame, count(*) AS n FROM gt GROUP BY seq, frame) c ON s.seq = c.seq AND s.frame = c.frame""")
def pad_missing(m: Masks) -> DataFrame:
    return tracks.pad_missing(m.gt, 25)


@query(""", ends AS (SELECT seq, min(frame) AS lo, max(frame) AS hi FROM gt GROUP BY seq)
SELECT seq, CAST(frame + 2 AS INTEGER) AS frame, y, x, label FROM gt
UNION ALL SELECT g.seq, CAST(lo + i AS INTEGER), y, x, label FROM gt g JOIN ends USING (seq), (VALUES (0), (1)) v(i) WHERE frame = lo
UNION ALL SELECT g.seq, CAST(hi + 3 + i AS INTEGER), y, x, label FROM gt g JOIN ends USING (seq), (VALUES (0), (1), (2)) v(i) WHERE frame = hi""")
def pad_frames(m: Masks) -> DataFrame:
    return tracks.pad_frames(m.gt, 2, 3)


@query("SELECT g.seq, count(DISTINCT frame) AS frames, count(DISTINCT label) AS labels, max(label) AS max_label, max(t.tracks) AS tracks, max(t.wp) AS with_parent FROM gt g JOIN (SELECT seq, count(*) AS tracks, sum(CASE WHEN parent <> 0 THEN 1 ELSE 0 END)::BIGINT AS wp FROM gtt GROUP BY seq) t ON g.seq = t.seq GROUP BY g.seq")
def run_report(m: Masks) -> DataFrame:
    return tracks.report(m.gt, m.gt_tracks)


# integrity


def _by_object(pixels: DataFrame) -> DataFrame:
    """Every object of a sequence as a sequence of its own: unlike the sequences themselves, these have holes."""
    return pixels.select(F.concat_ws(":", "seq", "label").alias("seq"), "frame")


@query("SELECT coalesce(g.seq, r.seq) AS seq, coalesce(g.frame, r.frame) AS frame, CASE WHEN r.seq IS NULL THEN 'missing' ELSE 'extra' END AS what FROM (SELECT DISTINCT seq || ':' || label AS seq, frame FROM gt) g FULL JOIN (SELECT DISTINCT seq || ':' || label AS seq, frame FROM res) r ON g.seq = r.seq AND g.frame = r.frame WHERE g.seq IS NULL OR r.seq IS NULL")
def frame_reconcile(m: Masks) -> DataFrame:
    return validate.frame_reconcile(_by_object(m.gt), _by_object(m.res))


@query("SELECT coalesce(g.seq, r.seq) AS seq, coalesce(g.label, r.label) AS label, CASE WHEN r.seq IS NULL THEN 'no track row' ELSE 'no pixels' END AS what FROM (SELECT DISTINCT seq, label FROM gt) g FULL JOIN rest r ON g.seq = r.seq AND g.label = r.label WHERE g.seq IS NULL OR r.seq IS NULL")
def label_track_reconcile(m: Masks) -> DataFrame:
    return validate.label_track_reconcile(m.gt, m.res_tracks)


@query("SELECT DISTINCT g.seq, g.frame, g.label FROM gt g JOIN rest t ON g.seq = t.seq AND g.label = t.label WHERE g.frame NOT BETWEEN t.b AND t.e")
def inactive_labels(m: Masks) -> DataFrame:
    return validate.inactive_labels(m.gt, m.res_tracks)


@query("SELECT s.seq || ':' || s.label AS seq, CAST(s.frame AS INTEGER) AS frame FROM (SELECT seq, label, unnest(range(min(frame), max(frame) + 1)) AS frame FROM res GROUP BY seq, label) s WHERE NOT EXISTS (SELECT 1 FROM res g WHERE g.seq = s.seq AND g.label = s.label AND g.frame = s.frame)")
def contiguity(m: Masks) -> DataFrame:
    return validate.missing_frames(_by_object(m.res))


_VIOLATIONS = """
SELECT 'V-03' AS rule, s.seq, CAST(s.frame AS VARCHAR) AS item, 'missing frame' AS details FROM (SELECT seq, unnest(range(min(frame), max(frame) + 1)) AS frame FROM res GROUP BY seq) s WHERE NOT EXISTS (SELECT 1 FROM res g WHERE g.seq = s.seq AND g.frame = s.frame)
UNION ALL SELECT 'V-12', coalesce(g.seq, r.seq), CAST(coalesce(g.label, r.label) AS VARCHAR), CASE WHEN r.seq IS NULL THEN 'no track row' ELSE 'no pixels' END FROM (SELECT DISTINCT seq, label FROM res) g FULL JOIN gtt r ON g.seq = r.seq AND g.label = r.label WHERE g.seq IS NULL OR r.seq IS NULL
UNION ALL SELECT 'V-13', t.seq, CAST(t.label AS VARCHAR), CAST(t.e AS VARCHAR) FROM gtt t JOIN (SELECT seq, max(frame) AS last FROM res GROUP BY seq) l ON t.seq = l.seq WHERE t.e > l.last
UNION ALL SELECT 'V-14', t.seq, CAST(t.label AS VARCHAR), s.b || '-' || s.e FROM gtt t JOIN rest s ON t.seq = s.seq AND t.label = s.label WHERE t.b <> s.b OR t.e <> s.e
UNION ALL SELECT 'V-15', t.seq, CAST(t.label AS VARCHAR), 'gap' FROM gtt t JOIN rest s ON t.seq = s.seq AND t.label = s.label WHERE s.e - s.b + 1 <> s.n
UNION ALL SELECT 'V-16', c.seq, CAST(c.label AS VARCHAR), CASE WHEN p.e IS NULL THEN 'unknown parent' ELSE 'parent too long' END FROM gtt c LEFT JOIN gtt p ON c.seq = p.seq AND c.parent = p.label WHERE c.parent <> 0 AND (p.e IS NULL OR p.e >= c.b)
UNION ALL SELECT 'V-04', coalesce(g.seq, r.seq), CAST(coalesce(g.frame, r.frame) AS VARCHAR), CASE WHEN r.seq IS NULL THEN 'missing' ELSE 'extra' END FROM (SELECT DISTINCT seq, frame + 1 AS frame FROM gt) g FULL JOIN (SELECT DISTINCT seq, frame FROM res) r ON g.seq = r.seq AND g.frame = r.frame WHERE g.seq IS NULL OR r.seq IS NULL
"""


@query(_VIOLATIONS)
def violations_all(m: Masks) -> DataFrame:
    return validate.violations(m.res, m.gt_tracks, m.gt.withColumn("frame", F.col("frame") + 1))


@query("SELECT seq, array_to_string(list_slice(list_sort(list(DISTINCT label)), 1, 5), ',') AS preview, count(*) AS n FROM gtt GROUP BY seq")
def preview_labels(m: Masks) -> DataFrame:
    return validate.preview(m.gt_tracks, ["seq"], "label", 5).select("seq", F.array_join(F.transform("preview", lambda x: x.cast("string")), ",").alias("preview"), "n")


@query("SELECT seq, frame, label, 'born' AS what FROM (SELECT DISTINCT seq, frame, label FROM gt) g WHERE frame > (SELECT min(frame) FROM gt s WHERE s.seq = g.seq) AND NOT EXISTS (SELECT 1 FROM gt p WHERE p.seq = g.seq AND p.label = g.label AND p.frame = g.frame - 1) UNION ALL SELECT seq, frame, label, 'gone' FROM (SELECT DISTINCT seq, frame, label FROM gt) g WHERE frame < (SELECT max(frame) FROM gt s WHERE s.seq = g.seq) AND NOT EXISTS (SELECT 1 FROM gt p WHERE p.seq = g.seq AND p.label = g.label AND p.frame = g.frame + 1)")
def newborn_vanished(m: Masks) -> DataFrame:
    return raster.newborn_and_vanished(m.gt)


@query("SELECT DISTINCT g.seq, g.frame FROM gt g SEMI JOIN res r ON g.seq = r.seq AND g.frame = r.frame")
def common_frames(m: Masks) -> DataFrame:
    return failures.common_frames(m.gt, m.res)


# morphology and contact


@query("SELECT seq, frame, label, CAST(y + dy AS INTEGER) AS y, CAST(x + dx AS INTEGER) AS x FROM res CROSS JOIN near WHERE y + dy >= 0 AND x + dx >= 0 GROUP BY seq, frame, label, y + dy, x + dx")
def dilate3(m: Masks) -> DataFrame:
    return raster.dilate(m.res).select(*K, "label", "y", "x")


@query(f""", er AS (SELECT r.seq, r.frame, r.y, r.x, r.label FROM res r CROSS JOIN near JOIN res q ON q.seq = r.seq AND q.frame = r.frame AND q.label = r.label AND q.y = r.y + dy AND q.x = r.x + dx
   GROUP BY r.seq, r.frame, r.y, r.x, r.label HAVING count(*) = (3 - (r.y = 0)::INT - (r.y = {HEIGHT - 1})::INT) * (3 - (r.x = 0)::INT - (r.x = {WIDTH - 1})::INT))
SELECT DISTINCT q.seq, q.frame, q.y, q.x, q.label FROM er r CROSS JOIN near JOIN res q ON q.seq = r.seq AND q.frame = r.frame AND q.label = r.label AND q.y = r.y + dy AND q.x = r.x + dx""")
def open3(m: Masks) -> DataFrame:
    return raster.open_labels(m.res, HEIGHT, WIDTH)


@query("SELECT * FROM con")
def contacts(m: Masks) -> DataFrame:
    return raster.contacts(m.res)


@query("SELECT g.seq, g.frame, g.label, g.area, coalesce(c.touch_curr, 0) AS touch, coalesce(c.touch_curr, 0) >= 10 AND coalesce(c.touch_curr, 0) / g.area >= 0.05 AS continues FROM reso g LEFT JOIN con c ON g.seq = c.seq AND g.frame = c.frame AND g.label = c.curr_label AND c.prev_label = c.curr_label")
def self_continuity(m: Masks) -> DataFrame:
    return raster.self_continuity(m.res)


@query("SELECT seq, frame, curr_label AS child, prev_label AS parent, touch_prev AS touch FROM (SELECT c.*, row_number() OVER (PARTITION BY c.seq, c.frame, curr_label ORDER BY touch_prev DESC, prev_label) AS rn FROM con c JOIN reso g ON g.seq = c.seq AND g.frame = c.frame AND g.label = c.curr_label WHERE prev_label <> curr_label AND touch_prev >= 10 AND touch_prev / g.area >= 0.05) t WHERE rn = 1")
def parent_inference(m: Masks) -> DataFrame:
    return raster.infer_parents(m.res)


@query("SELECT seq, frame, mother, string_agg(CAST(child AS VARCHAR), ',' ORDER BY child) AS children FROM (SELECT seq, frame, curr_label AS child, prev_label AS mother FROM (SELECT c.*, row_number() OVER (PARTITION BY c.seq, c.frame, curr_label ORDER BY touch_prev DESC, prev_label) AS rn FROM con c JOIN reso g ON g.seq = c.seq AND g.frame = c.frame AND g.label = c.curr_label WHERE prev_label <> curr_label AND touch_prev >= 10 AND touch_prev / g.area >= 0.05) t WHERE rn = 1) u GROUP BY seq, frame, mother")
def children_by_mother(m: Masks) -> DataFrame:
    """[O-74]"""
    return raster.infer_parents(m.res).groupBy(*K, F.col("parent").alias("mother")).agg(F.array_join(F.transform(F.sort_array(F.collect_set("child")), lambda x: x.cast("string")), ",").alias("children"))


_CONFIDENCE = """, conf AS (SELECT c.seq, c.frame, c.prev_label, c.curr_label,
  0.35 * least(c.touch_prev / greatest(p.area, q.area), 1.0) + 0.30 * coalesce(i.n, 0) / (p.area + q.area - coalesce(i.n, 0))
  + 0.20 * greatest(0.0, 1 - sqrt((p.cy - q.cy) * (p.cy - q.cy) + (p.cx - q.cx) * (p.cx - q.cx)) / 50.0) + 0.15 * least(p.area, q.area) / greatest(p.area, q.area) AS confidence
  FROM con c JOIN reso p ON p.seq = c.seq AND p.frame = c.frame - 1 AND p.label = c.prev_label JOIN reso q ON q.seq = c.seq AND q.frame = c.frame AND q.label = c.curr_label
  LEFT JOIN (SELECT c.seq, c.frame, p.label AS a, c.label AS b, count(*) AS n FROM res p JOIN res c ON p.seq = c.seq AND c.frame = p.frame + 1 AND p.y = c.y AND p.x = c.x GROUP BY c.seq, c.frame, p.label, c.label) i
    ON i.seq = c.seq AND i.frame = c.frame AND i.a = c.prev_label AND i.b = c.curr_label) """


@query(_CONFIDENCE + "SELECT seq, frame, prev_label, curr_label, round(confidence, 6) AS confidence FROM conf")
def rescue_confidence(m: Masks) -> DataFrame:
    return raster.rescue_confidence(m.res).select(*K, "prev_label", "curr_label", r6("confidence"))


@query(_CONFIDENCE + """, rk AS (SELECT *, row_number() OVER (PARTITION BY seq, frame, prev_label ORDER BY confidence DESC, curr_label) AS rn FROM conf)
SELECT a.seq, a.frame, a.prev_label, a.curr_label AS best, round(a.confidence, 6) AS first, round(coalesce(b.confidence, 0), 6) AS second,
  a.confidence >= 0.3 AND NOT (coalesce(b.confidence, 0) >= a.confidence * 0.8 AND coalesce(b.confidence, 0) >= 0.3) AS accepted
  FROM rk a LEFT JOIN rk b ON a.seq = b.seq AND a.frame = b.frame AND a.prev_label = b.prev_label AND b.rn = 2 WHERE a.rn = 1""")
def rescue_candidates(m: Masks) -> DataFrame:
    return raster.ranked_candidates(raster.rescue_confidence(m.res)).select(*K, "prev_label", "best", r6("first"), r6("second"), "accepted")


_HALF = f""", rows AS (SELECT CAST(i AS INTEGER) AS ny, CAST(least(greatest(round_even((i + 0.5) * {HEIGHT} / {HEIGHT // 2} - 0.5, 0), 0), {HEIGHT - 1}) AS INTEGER) AS oy FROM range(0, {HEIGHT // 2}) t(i)),
cols AS (SELECT CAST(i AS INTEGER) AS nx, CAST(least(greatest(round_even((i + 0.5) * {WIDTH} / {WIDTH // 2} - 0.5, 0), 0), {WIDTH - 1}) AS INTEGER) AS ox FROM range(0, {WIDTH // 2}) t(i)),
small AS (SELECT seq, frame, ny AS y, nx AS x, label FROM gt JOIN rows ON y = oy JOIN cols ON x = ox) """


@query(_HALF + "SELECT seq, frame, y, x, label FROM small")
def resize_nearest(m: Masks) -> DataFrame:
    return raster.resize_nearest(m.gt, (HEIGHT, WIDTH), (HEIGHT // 2, WIDTH // 2))


@query(_HALF + """SELECT a.seq, a.frame, coalesce((SELECT string_agg(CAST(l AS VARCHAR), ',' ORDER BY l) FROM (SELECT DISTINCT label AS l FROM gt g WHERE g.seq = a.seq AND g.frame = a.frame AND NOT EXISTS (SELECT 1 FROM small s WHERE s.seq = a.seq AND s.frame = a.frame AND s.label = g.label)) q), '') AS lost,
  '' AS gained, round(coalesce(b.fg, 0) / (a.fg * 0.25), 6) AS ratio FROM (SELECT seq, frame, count(*) AS fg FROM gt GROUP BY seq, frame) a LEFT JOIN (SELECT seq, frame, count(*) AS fg FROM small GROUP BY seq, frame) b ON a.seq = b.seq AND a.frame = b.frame""")
def rescale_label_loss(m: Masks) -> DataFrame:
    out = raster.label_loss(m.gt, raster.resize_nearest(m.gt, (HEIGHT, WIDTH), (HEIGHT // 2, WIDTH // 2)), 0.5)
    return out.select(*K, *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("lost", "gained")], r6("ratio"))


@query("SELECT seq, frame, x AS y, y AS x, label FROM gt")
def transpose(m: Masks) -> DataFrame:
    return raster.transpose(m.gt)


@query(f"SELECT seq, frame, CAST(y + {(-HEIGHT % 64) // 2} AS INTEGER) AS y, CAST(x + {(-WIDTH % 64) // 2} AS INTEGER) AS x, label FROM gt")
def pad_align(m: Masks) -> DataFrame:
    return raster.pad_align(m.gt, HEIGHT, WIDTH)


@query("SELECT seq, frame, CAST(y // 16 AS INTEGER) AS py, CAST(x // 32 AS INTEGER) AS px, CAST(y % 16 AS INTEGER) AS y, CAST(x % 32 AS INTEGER) AS x, label FROM gt")
def image_patches(m: Masks) -> DataFrame:
    return raster.patches(m.gt, 16, 32)


@query("""SELECT DISTINCT label, round(CASE CAST(floor(h) AS INTEGER) WHEN 0 THEN 1.0 WHEN 1 THEN 1 - 0.85 * (h - floor(h)) WHEN 2 THEN 0.15 WHEN 3 THEN 0.15 WHEN 4 THEN 1 - 0.85 * (1 - (h - floor(h))) ELSE 1.0 END, 6) AS r,
  round(CASE CAST(floor(h) AS INTEGER) WHEN 0 THEN 1 - 0.85 * (1 - (h - floor(h))) WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 1 - 0.85 * (h - floor(h)) ELSE 0.15 END, 6) AS g,
  round(CASE CAST(floor(h) AS INTEGER) WHEN 0 THEN 0.15 WHEN 1 THEN 0.15 WHEN 2 THEN 1 - 0.85 * (1 - (h - floor(h))) WHEN 3 THEN 1.0 WHEN 4 THEN 1.0 ELSE 1 - 0.85 * (h - floor(h)) END, 6) AS b
  FROM (SELECT label, (label * CAST(0.618033988749895 AS DOUBLE) - floor(label * CAST(0.618033988749895 AS DOUBLE))) * 6 AS h FROM gt) t""")
def track_colors(m: Masks) -> DataFrame:
    return raster.overlay(m.gt).select("label", r6("r"), r6("g"), r6("b")).distinct()


# lineage


@query("""SELECT c.seq, c.label, CASE WHEN c.parent = 0 OR p.label IS NULL THEN c.label ELSE p.label END AS root, CASE WHEN c.parent = 0 OR p.label IS NULL THEN 0 ELSE 1 END AS depth FROM gtt c LEFT JOIN gtt p ON c.seq = p.seq AND c.parent = p.label""")
def lineage_depth(m: Masks) -> DataFrame:
    return lineage.depths(m.gt_tracks).select("seq", "label", "root", "depth")


@query(""", tt AS (SELECT c.*, CASE WHEN p.label IS NULL THEN 0 ELSE c.parent END AS par, coalesce(p.b, c.b) AS rb, coalesce(p.label, c.label) AS rl FROM gtt c LEFT JOIN gtt p ON c.seq = p.seq AND c.parent = p.label),
leaf AS (SELECT *, CAST(row_number() OVER (PARTITION BY seq ORDER BY rb, rl, par, b, label) - 1 AS DOUBLE) AS y FROM tt t WHERE NOT EXISTS (SELECT 1 FROM tt k WHERE k.seq = t.seq AND k.par = t.label))
SELECT seq, label, round(y, 6) AS y FROM leaf UNION ALL SELECT seq, par, round(avg(y), 6) FROM leaf WHERE par <> 0 GROUP BY seq, par""")
def lineage_layout(m: Masks) -> DataFrame:
    return lineage.layout(m.gt_tracks).select("seq", "label", r6("y"))


@query("SELECT seq, label, greatest(b, 5) AS x0, least(e, 14) AS x1 FROM gtt WHERE greatest(b, 5) <= least(e, 14)")
def lineage_segments(m: Masks) -> DataFrame:
    return lineage.segments(m.gt_tracks, 5, 17, reveal=14)


@query("SELECT c.seq, c.parent, c.label AS child, p.e AS x0, c.b AS x1 FROM gtt c JOIN gtt p ON c.seq = p.seq AND c.parent = p.label WHERE c.b BETWEEN 0 AND 19")
def lineage_connectors(m: Masks) -> DataFrame:
    return lineage.connectors(m.gt_tracks, 0, 19)


# logs


@query("""SELECT q.seq, 'TRA' AS metric, s.section, CASE WHEN s.w > 0 THEN s.w END AS penalty, CAST(coalesce(CASE s.section WHEN 'False Negative Vertices' THEN mi.n WHEN 'False Positive Vertices' THEN ex.n END, 0) AS BIGINT) AS count,
  CASE WHEN s.w > 0 THEN s.w * coalesce(CASE s.section WHEN 'False Negative Vertices' THEN mi.n WHEN 'False Positive Vertices' THEN ex.n END, 0) END AS weighted
  FROM (SELECT DISTINCT seq FROM gt) q CROSS JOIN (VALUES ('Splitting Operations', CAST(5 AS DOUBLE)), ('False Negative Vertices', 10), ('False Positive Vertices', 0), ('Redundant Edges To Be Deleted', 0), ('Edges To Be Added', 0), ('Edges with Wrong Semantics', 0)) s(section, w)
  LEFT JOIN (SELECT seq, count(*) AS n FROM best WHERE res = 0 GROUP BY seq) mi ON mi.seq = q.seq LEFT JOIN (SELECT seq, count(*) AS n FROM back WHERE gt = 0 GROUP BY seq) ex ON ex.seq = q.seq""")
def log_penalties(m: Masks) -> DataFrame:
    return logs.penalties(m.tra_log)


@query("SELECT seq, round(1 - count(*) / 1000, 6) AS score FROM best WHERE res = 0 GROUP BY seq")
def log_scores(m: Masks) -> DataFrame:
    return logs.official_score(m.tra_log, "TRA").select("seq", r6("score"))


@query("SELECT seq, frame AS t, CASE WHEN frame % 2 = 1 THEN -1 END AS z, label AS gt_label, round(iou, 6) AS jaccard FROM giou")
def log_objects(m: Masks) -> DataFrame:
    """[O-12, O-107]"""
    return logs.seg_objects(m.seg_log)


@query("SELECT seq, count(*) AS objects, sum((round(iou, 6) < 0.5)::INT)::BIGINT AS low, sum((iou = 0)::INT)::BIGINT AS zero, round(min(iou), 6) AS min_jaccard FROM giou GROUP BY seq")
def seg_summary(m: Masks) -> DataFrame:
    return logs.seg_summary(logs.seg_objects(m.seg_log)).select("seq", "objects", "low", "zero", r6("min_jaccard"))


# names and frames


@query("SELECT DISTINCT seq, frame, 'mask' || lpad(CAST(frame * 37 AS VARCHAR), 4, '0') || '.tif' AS name, 4 AS digits, '0' || seq AS padded FROM gt")
def file_names(m: Masks) -> DataFrame:
    f = m.gt.select(*K).distinct().withColumn("name", naming.frame_name("mask", F.col("frame") * 37, 4))
    return f.select(*K, "name", naming.digits_of(F.col("name")).alias("digits"), F.concat(F.lit("0"), naming.normalise_sequence(F.col("seq"))).alias("padded"))


@query("SELECT seq, frame, CAST(row_number() OVER (PARTITION BY seq ORDER BY frame * 37) AS INTEGER) AS place FROM (SELECT DISTINCT seq, frame FROM gt) t")
def natural_order(m: Masks) -> DataFrame:
    f = m.gt.select("seq", F.col("frame").alias("number")).distinct().withColumn("name", F.concat(F.lit("Frame_"), (F.col("number") * 37).cast("string"), F.lit(".TIF")))
    return frames.by_position(f, ["seq"]).select("seq", F.col("number").alias("frame"), (F.col("frame") + 1).alias("place"))


@query("SELECT DISTINCT seq, CAST(frame AS BIGINT) * 8 AS at, CAST(19 * 8 + 1 AS BIGINT) AS total FROM gt")
def interpolation_schedule(m: Masks) -> DataFrame:
    return m.gt.select(*K).distinct().select("seq", naming.interpolated_index(F.col("frame"), 3).alias("at"), naming.interpolated_count(F.lit(20), 3).alias("total"))


@query("SELECT l_orderkey, l_linenumber, round(least(1.0, greatest(0.0, l_quantity / 50)), 6) AS unit, round_even(least(1.0, greatest(0.0, l_quantity / 50)) * 255, 0) AS level FROM lineitem")
def image_normalise(m: Masks) -> DataFrame:
    unit = naming.to_unit(F.col("l_quantity"), 50.0)
    return m.table("lineitem").select("l_orderkey", "l_linenumber", F.round(unit, 6).alias("unit"), naming.from_unit(unit, 255.0).alias("level"))


@query("SELECT seq, frame, lead(frame) OVER (PARTITION BY seq ORDER BY frame) AS next FROM (SELECT DISTINCT seq, frame FROM gt) t QUALIFY next = frame + 1")
def frame_pairs(m: Masks) -> DataFrame:
    """[O-71, O-72]"""
    f = m.gt.select(*K).distinct().withColumn("next", F.lead("frame").over(Window.partitionBy("seq").orderBy("frame")))
    return f.filter("next = frame + 1")


# sequential machines: no SQL


@query()
def strict_tracker(m: Masks) -> DataFrame:
    return tracker.strict_tracks(m.res, HEIGHT, WIDTH)


@query()
def division_normalisation(m: Masks) -> DataFrame:
    return divide.normalise_divisions(m.res)


# event time


@query("__EVENTS__")
def event_sessions(m: Masks) -> DataFrame:
    return sessions.sessions(m.table("events"), "user_id", "ts", 600)


EVENT_SESSIONS = """
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM (
    SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL) a) b
GROUP BY user_id, sid
"""


def flagship(m: Masks) -> DataFrame:
    """Best result and coverage of every ground-truth object and frame, with the result it switched from."""
    switch = failures.id_switches(m.matched).select(*K, "gt", "res_before")
    return m.matched.join(switch, [*K, "gt"], "left").select(*K, "gt", "res", "n", r6("coverage"), "res_before")


def _all() -> dict[str, tuple[Query, str | None]]:
    from . import file_queries, shape_queries  # noqa: F401  register their own

    return _QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Masks(spark, sf_dir))) for name, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (_, sql) in _all().items():
        if sql == "__EVENTS__":
            out[name] = EVENT_SESSIONS
        elif sql is not None:
            out[name] = f"{SQL_BASE}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
    return out
