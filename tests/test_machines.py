"""Identity rescue, morphology and the workflow as a whole."""

from __future__ import annotations

import numpy as np

from tessera.functions import masks
from tessera.operators import morphology, rescue
from tessera.plans import workflow

PIXELS = "seq string, frame int, y int, x int, label int"


def square(frame, label, y, x, n=6):
    return [("01", frame, y + i, x + j, label) for i in range(n) for j in range(n)]


def test_lost_identity_is_taken_over(spark):
    px = spark.createDataFrame(square(0, 1, 2, 2) + square(1, 1, 2, 3) + square(2, 7, 2, 4) + square(3, 7, 2, 5) + square(0, 2, 30, 30) + square(1, 2, 30, 30), PIXELS)
    out = rescue.rescue_identities(px).collect()
    assert {(r.frame, r.id) for r in out if r.kind == "object" and r.label == 7} == {(2, 1), (3, 1)}
    assert {(r.label, r.event) for r in out if r.kind == "audit"} == {(1, "rescued"), (2, "skip_no_candidate")}
    same = rescue.rescue_identities(px, gap=0).filter("kind = 'object' and id <> label")
    assert same.count() == 0


def test_two_alike_candidates_are_ambiguous(spark):
    px = spark.createDataFrame(square(0, 1, 10, 10) + square(1, 5, 10, 6) + square(1, 6, 10, 14), PIXELS)
    out = rescue.rescue_identities(px).filter("kind = 'audit'").collect()
    assert [(r.label, r.event) for r in out] == [(1, "skip_ambiguous")]


def test_parts_and_points(spark):
    cells = [(0, 0), (1, 1), (2, 2), (2, 3), (2, 1), (3, 2), (9, 9)]
    px = spark.createDataFrame([("01", 0, y, x, 1) for y, x in cells], PIXELS)
    parts = morphology.connected_parts(px).collect()
    assert sorted({(r.part, r.size) for r in parts}) == [(0, 6), (1, 1)]
    assert morphology.connected_parts(px, least=2).count() == 6
    points = {(r.y, r.x): r for r in morphology.neighbour_counts(px).collect()}
    assert points[0, 0].endpoint and points[2, 2].branch and points[9, 9].n == 0


def test_orientation_and_boxes(spark):
    px = spark.createDataFrame([("01", 0, i, 0, 1) for i in range(5)] + [("01", 0, 9, 5 + i, 2) for i in range(5)], PIXELS)
    angle = {r.label: r.angle for r in morphology.orientation(px).collect()}
    assert abs(angle[1]) < 1e-9 and abs(abs(angle[2]) - np.pi / 2) < 1e-9
    one = spark.createDataFrame([("01", 0, 5, 5, 1)], PIXELS)
    big = morphology.box_morphology(one, 11, 11, 9)
    assert big.count() == 81
    back = big.selectExpr("seq", "frame", "y", "x", "1 as label")
    assert [(r.y, r.x) for r in morphology.box_morphology(back, 11, 11, 9, "erode").collect()] == [(5, 5)]


def test_workflow(spark):
    lineitem = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    res, gt = masks.results(lineitem), masks.ground_truth(lineitem)
    out = workflow.pipeline(res, workflow.Config(80, 128, factor=2), gt, gt.selectExpr("seq", "label", "0 as begin", "0 as end", "0 as parent").distinct())
    assert {"tracks", "parents", "sampled_tracks", "violations", "events", "by_frame", "by_track"} <= set(out)
    assert out["tracks"].count() > 10
