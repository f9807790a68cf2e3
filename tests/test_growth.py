"""What a task holds mustn't grow with the table: plans and partitions of queries on the derived masks."""

from __future__ import annotations

import collections
import math
import os

import numpy as np

from jobs import tracking_evaluation
from tessera.functions import masks
from tessera.operators import failures, frame_tables, morphology, raster, shapes, tracker
from tessera.sources.shared import written_once

SMALL = "/root/testdata/sf0.001"
PIXELS = "seq string, frame int, y int, x int, label int"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_dilation_expands_no_rows(spark):
    rows = [("01", 0, 5, 5, 1), ("01", 0, 0, 39, 2), ("01", 0, 9, 3, 3)]
    angles = [("01", 0, 1, 0.0), ("01", 0, 2, math.pi / 2)]  # label 3 has no angle
    out = morphology.line_dilation(spark.createDataFrame(rows, PIXELS), spark.createDataFrame(angles, "seq string, frame int, label int, angle double"), 5, 10, 40)
    assert "Generate" not in plan(out)
    got = sorted((r.label, r.y, r.x) for r in out.collect())
    assert got == [(1, 5, x) for x in range(3, 8)] + [(2, y, 39) for y in range(3)]


def test_masks_come_in_pieces_of_whole_frames(spark, monkeypatch):
    monkeypatch.setattr(masks, "ROWS_EACH", 200)
    lineitem = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    for made in (masks.ground_truth(lineitem), masks.results(lineitem)):
        assert made.rdd.getNumPartitions() == lineitem.count() // 200
        assert plan(made.groupBy("seq", "frame", "label").count()).count("Exchange") == 1


def test_pixels_of_the_trackers_are_never_joined_or_broadcast(spark):
    rows = [("01", f, y, x, k) for f in range(20) for k in (1, 2) for y in range(6 * k, 6 * k + 4) for x in range(f, f + 5)]
    px = spark.createDataFrame(rows, PIXELS)
    for out in (tracker.strict_tracks(px, 40, 40), raster.contacts(px), frame_tables.frame_tables(px, 2), raster.open_labels(px, 40, 40)):
        assert "Join" not in plan(out) and "Generate explode(array(" not in plan(out)


def test_meetings_across_the_borders_of_groups(spark):
    """What a frame meets doesn't depend on how frames are dealt to groups, negative and missing frames included."""
    rows = [("01", f, y, x, k) for f in (-9, -8, 0, 6, 7, 8, 9, 15, 17, 18) for k in (1, 2) for y in range(6 * k, 6 * k + 4) for x in range(abs(f), abs(f) + 5)]
    px = spark.createDataFrame(rows, PIXELS)
    lists = lambda r: tuple(sorted(map(str, x)) for x in (r.objects, r.touched, r.touching, r.inter))
    want = {r.frame: lists(r) for r in frame_tables.frame_tables(px, 2).collect()}
    assert {f: sum(t.startswith("Row(lag=1") for t in v[1]) for f, v in want.items()} == {f: 2 if f in (-8, 7, 8, 9, 18) else 0 for f in want}
    moved = {r.frame - 3: lists(r) for r in frame_tables.frame_tables(px.withColumn("frame", px.frame + 3), 2).collect()}
    assert moved == want and len(want) == 10
    tracked = {(r.frame, r.label): r.track for r in tracker.strict_tracks(px.filter("frame >= 0"), 40, 40).collect()}
    assert all(len({tracked[f, k] for f in (6, 7, 8, 9)}) == 1 for k in (1, 2))


def test_files_of_wide_rows_are_short_and_written_tables_are_not_broadcast(spark):
    wide = written_once(spark.range(1000).coalesce(1), "wide", wide=True)
    assert len(wide.inputFiles()) == 5 and wide.count() == 1000
    assert "Broadcast" not in plan(spark.range(10).join(written_once(spark.range(10), "small"), "id"))


def test_neighbours_and_boxes_take_one_pass(spark):
    rows = [("01", f, y, x, 1 + (x > 9)) for f in (0, 7, 8) for y in range(4, 9) for x in range(3, 15)]
    px = spark.createDataFrame(rows, PIXELS)
    for out in (morphology.neighbour_counts(px), morphology.neighbour_counts(morphology.skeletons(px))):
        assert "Join" not in plan(out) and "Generate explode(array(" not in plan(out)
    got = {(r.frame, r.y, r.x): r.n for r in morphology.neighbour_counts(px).collect()}
    assert len(got) == len(rows) and (got[0, 4, 3], got[7, 5, 4], got[8, 5, 9], got[8, 5, 10]) == (3, 8, 5, 5)
    chain = morphology.box_chain(px, 20, 30, [(5, "dilate"), (3, "erode")])
    apart = morphology.box_morphology(morphology.box_morphology(px, 20, 30, 5).selectExpr("*", "1 AS label"), 20, 30, 3, "erode")
    assert plan(chain).count("FlatMapGroups") == 1  # before it has run: a finished plan is shown twice
    assert set(map(tuple, chain.collect())) == set(map(tuple, apart.collect()))


def test_evaluation_shuffles_pixels_once_and_writes_a_file_for_each_sequence(spark, tmp_path):
    rows = [(s, f, y, x, k) for s in ("01", "02", "03") for f in range(4) for k in (1, 2) for y in range(6 * k, 6 * k + 4) for x in range(f, f + 5)]
    px = spark.createDataFrame(rows, PIXELS)
    assert "Join" not in plan(failures.pixel_counts(px, px, px)) and plan(failures.pixel_counts(px, px, px)).count("Exchange") == 1
    spark.createDataFrame([(s, k, 0, 3, 0) for s in ("01", "02", "03") for k in (1, 2)], "seq string, label int, begin int, end int, parent int").write.parquet(f"{tmp_path}/tracks")
    px.write.parquet(f"{tmp_path}/truth")
    px.filter("label = 1 and frame <> 2").repartition(5).write.parquet(f"{tmp_path}/result")
    inputs = {"truth": "truth", "outlines": "truth", "result": "result", "truth_tracks": "tracks", "result_tracks": "tracks"}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")  # as by default
    try:
        tracking_evaluation.run(spark, **{n: f"{tmp_path}/{p}" for n, p in inputs.items()}, out=f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    found = tracking_evaluation.read_evaluation(spark, f"{tmp_path}/out")
    files = collections.Counter(os.path.dirname(f) for f in found.inputFiles())
    assert sorted(files.values()) == [1, 1, 1]
    got = {(r.seq, r.measure): r.n for r in found.filter("seq = '02'").groupBy("seq", "measure").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert got == {("02", m): n for m, n in {"status: ok": 1, "common frames": 3, "truth objects": 6, "result objects": 3, "result runs": 2, "missed_gt_object": 3, "low_segmentation_iou": 3}.items()}


def test_small_boxes_take_no_sums(monkeypatch):
    rng = np.random.default_rng(3)
    cases = [(rng.random(shape) < share, k) for shape in ((1, 1), (1, 7), (6, 2), (20, 31)) for share in (0.1, 0.6, 0.95) for k in (1, 3, 5, 9)]
    cases += [(np.ones((5, 5), bool), 3), (np.zeros((5, 5), bool), 9)]

    def brute(m, k, grow):
        r, (h, w) = k // 2, m.shape
        near = [[m[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1] for x in range(w)] for y in range(h)]
        return np.array([[v.any() if grow else v.all() for v in row] for row in near])

    monkeypatch.setattr(np, "cumsum", None)
    for m, k in cases:
        for grow in (True, False):
            got = shapes.box(m, k, grow)
            assert got.dtype == bool and (got == brute(m, k, grow)).all()
        assert (shapes.opened(m, k) == brute(brute(m, k, False), k, True)).all()
