"""Operators of label masks, tracks, logs and files on small fixtures with known results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import naming
from tessera.operators import divide, lineage, logs, raster, tracker, tracks, validate
from tessera.sources import frames, text, tiff

PIXELS = "seq string, frame int, y int, x int, label int"
TRACKS = "seq string, label int, begin int, end int, parent int"


def rect(frame, label, y0, y1, x0, x1, seq="01"):
    return [(seq, frame, y, x, label) for y in range(y0, y1) for x in range(x0, x1)]


def paint(*rects):
    """Later rectangles overwrite earlier ones."""
    cells = {}
    for frame, label, y0, y1, x0, x1 in rects:
        for p in rect(frame, label, y0, y1, x0, x1):
            cells[p[:4]] = label
    return [(*k, v) for k, v in cells.items() if v]


def label_frames(spark, label, at):
    return spark.createDataFrame([("01", label, f) for f in at], "seq string, label int, frame int")


# names


def test_digit_widths():
    assert naming.resolve_digits(["mask000.tif"], 2) == 3
    assert naming.resolve_digits(["mask0000.tif"], 2) == 4
    assert naming.resolve_digits(["0002243_cp_masks.tif"], 1001) == 4 or naming.resolve_digits([], 1001) == 4
    assert naming.resolve_digits(["mask0000.tif"], 28177) == 5
    assert naming.resolve_digits([], 28177, "5") == 5
    with pytest.raises(ValueError):
        naming.resolve_digits([], 1001, "3")
    with pytest.raises(ValueError):
        naming.minimum_digits(-1)
    assert naming.cycles_for_factor(8) == 3
    with pytest.raises(ValueError):
        naming.cycles_for_factor(6)


def test_natural_order_and_names(spark):
    names = ["t10.tif", "T2.tif", "t1.tif", "a", "t02b.tif", "t007.tif"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [r.name for r in df.orderBy(naming.natural_key(F.col("name")), "name").collect()]
    assert got == ["a", "t1.tif", "T2.tif", "t02b.tif", "t007.tif", "t10.tif"]
    row = spark.createDataFrame([("7", "x1", "mask012.TIF")], "a string, b string, c string").select(
        naming.normalise_sequence(F.col("a")), naming.normalise_sequence(F.col("b")), naming.digits_of(F.col("c")), naming.short_number(F.lit(0.75)), naming.short_number(F.lit(20.0)), naming.fixed_number(F.lit(0.03125), 4)
    ).first()
    assert tuple(row) == ("07", "x1", 3, "0.75", "20", "0.0312")


# tracks


def test_split_within_capacity(spark):
    f = label_frames(spark, 1, [0, 2, 4])
    rows = spark.createDataFrame([("01", 1)], "seq string, rows int")
    got = {r.begin: (r.new_label, r.outcome) for r in tracks.split_discontinuous(f, 1, rows, capacity=2).collect()}
    assert got == {0: (1, "kept"), 2: (2, "moved"), 4: (None, "capacity")}


def test_split_takes_free_slots(spark):
    rows = spark.createDataFrame([("01", 5)], "seq string, rows int")
    got = {r.begin: r.new_label for r in tracks.split_discontinuous(label_frames(spark, 5, [0, 2, 4]), 1, rows, capacity=5).collect()}
    assert got == {0: 5, 2: 1, 4: 2}


def test_compact(spark):
    px = [("01", 0, 0, 1, 10), ("01", 0, 1, 0, 70000), ("01", 1, 0, 0, 10), ("01", 1, 1, 1, 42)]
    got = {r.label: r.compact for r in tracks.compact_labels(spark.createDataFrame(px, PIXELS)).collect()}
    assert got == {10: 1, 42: 2, 70000: 3}


@pytest.mark.parametrize(
    ("labels", "parents", "factor", "expected"),
    [
        ([(7, 0), (7, 16), (7, 32), (13, 16), (13, 32)], [(7, 0), (13, 7)], 16, [(1, 0, 2, 0), (2, 1, 2, 0)]),
        ([(7, 0), (7, 32)], [(7, 0)], 16, [(1, 0, 0, 0), (2, 2, 2, 0)]),
        ([(1, 0), (2, 16), (2, 32)], [(1, 0), (2, 1)], 16, [(1, 0, 0, 0), (2, 1, 2, 1)]),
    ],
)
def test_downsample(spark, labels, parents, factor, expected):
    px = spark.createDataFrame([("01", f, 1, n, n) for n, f in labels], PIXELS)
    p = spark.createDataFrame([("01", a, b) for a, b in parents], "seq string, label int, parent int")
    got = tracks.downsample_tracks(px, p, factor).collect()
    assert sorted((r.label, r.begin, r.end, r.parent) for r in got) == expected


def test_clip(spark):
    t = spark.createDataFrame([("01", 15, 395, 396, 0), ("01", 16, 397, 400, 15), ("01", 17, 100, 200, 0)], TRACKS)
    got = sorted((r.label, r.begin, r.end, r.parent) for r in tracks.clip_rebase(t, 395, 398).collect())
    assert got == [(15, 0, 1, 0), (16, 2, 3, 15)]


# validation


def test_validator(spark):
    px = spark.createDataFrame(paint((0, 1, 1, 3, 1, 3), (1, 1, 1, 3, 1, 3), (1, 2, 4, 5, 4, 5)), PIXELS)
    good = spark.createDataFrame([("01", 1, 0, 1, 0), ("01", 2, 1, 1, 0)], TRACKS)
    assert validate.violations(px, good).count() == 0
    bad = spark.createDataFrame([("01", 1, 0, 1, 1), ("01", 3, 2, 1, 9), ("01", 3, 0, 5, 0)], TRACKS)
    rules = {r.rule for r in validate.violations(px, bad).collect()}
    assert {"V-07", "V-08", "V-09", "V-12", "V-13", "V-16"} <= rules
    with pytest.raises(ValueError):
        validate.check_parameters(factor=0)


# divisions

WHOLE, TOP, LOW = (3, 11, 4, 13), (3, 7, 4, 13), (7, 11, 4, 13)  # a mother, and her halves: rows from and to, columns from and to
D1 = [(0, 1, *WHOLE)]


def mother_continues(*more, frames=(1,)):
    out = list(D1)
    for f in frames:
        out += [(f, 1, *TOP), (f, 2, *LOW)]
    return out + list(more)


CASES = {
    "she goes on": (mother_continues(), 20, {2: 1, 3: 1}, {1: {2, 3}}),
    "two newborns": ([*D1, (1, 2, *TOP), (1, 3, *LOW)], 20, {2: 1, 3: 1}, {1: {2, 3}}),
    "a used label": ([*D1, (0, 2, 14, 17, 15, 18), (1, 2, *TOP), (1, 3, *LOW)], 20, {3: 1, 4: 1}, {0: {1, 2}, 1: {3, 4}}),
    "guarded, renamed back": ([*mother_continues(), (2, 1, *TOP), (2, 4, *LOW)], 20, {2: 1, 5: 1}, {2: {2, 5}}),
    "guarded, a stranger": ([*mother_continues(frames=(1, 2)), (2, 4, 10, 14, 4, 13)], 20, {2: 1, 5: 1}, {2: {2, 4, 5}}),
    "unguarded": ([*mother_continues(), (2, 1, *TOP), (2, 4, *LOW)], 0, {2: 1, 5: 1}, {2: {4, 5}}),
}


@pytest.mark.parametrize("case", CASES)
def test_divisions(spark, case):
    rects, cooldown, parents, labels = CASES[case]
    out = divide.normalise_divisions(spark.createDataFrame(paint(*rects), PIXELS), cooldown).collect()
    assert {r.label: r.id for r in out if r.kind == "parent"} == parents
    for f, want in labels.items():
        assert {r.id for r in out if r.kind == "object" and r.frame == f} == want


def test_no_division_after_rename(spark):
    rects = [(0, 1, 2, 6, 2, 6), (1, 1, 2, 6, 2, 6), (2, 2, 2, 6, 2, 6)]
    out = divide.normalise_divisions(spark.createDataFrame(paint(*rects), PIXELS)).collect()
    assert [r for r in out if r.kind == "parent"] == []


# raster


def test_contacts_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    grid = rng.integers(0, 4, (3, 12, 12))
    px = [("01", f, y, x, int(grid[f, y, x])) for f in range(3) for y in range(12) for x in range(12) if grid[f, y, x]]
    got = {(r.frame, r.prev_label, r.curr_label): (r.touch_prev, r.touch_curr) for r in raster.contacts(spark.createDataFrame(px, PIXELS)).collect()}

    def grow(mask):
        big = np.pad(mask, 1)
        return np.any([big[1 + dy : 13 + dy, 1 + dx : 13 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], 0)

    for f in (1, 2):
        for p in (1, 2, 3):
            for c in (1, 2, 3):
                a, b = grid[f - 1] == p, grid[f] == c
                want = (int((a & grow(b)).sum()), int((b & grow(a)).sum()))
                assert got.get((f, p, c), (0, 0)) == want


def test_opening_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    grid = (rng.random((14, 17)) < 0.85).astype(int)
    px = [("01", 0, y, x, 1) for y, x in zip(*np.nonzero(grid), strict=True)]
    px = [(s, f, int(y), int(x), v) for s, f, y, x, v in px]
    got = {(r.y, r.x) for r in raster.open_labels(spark.createDataFrame(px, PIXELS), 14, 17).collect()}

    def moved(mask, fill):
        big = np.pad(mask, 1, constant_values=fill)
        return [big[1 + dy : 15 + dy, 1 + dx : 18 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]

    opened = np.any(moved(np.all(moved(grid.astype(bool), True), 0), False), 0)
    assert got == set(zip(*(a.tolist() for a in np.nonzero(opened)), strict=True))


def test_rescale_keeps_labels(spark):
    px = spark.createDataFrame(paint((0, 7, 0, 4, 0, 4), (0, 13, 4, 8, 4, 8)), PIXELS)
    small = raster.resize_nearest(px, (8, 8), (4, 4))
    assert {r.label for r in small.collect()} == {7, 13}
    loss = raster.label_loss(px, small, 0.5).first()
    assert loss.lost == [] and loss.ratio == 1.0


# tracker


def brute_track(stack):
    """The strict rule on arrays, pixel by pixel."""
    t, h, w = stack.shape
    out = np.zeros_like(stack)

    def opened(mask):
        def moved(a, fill):
            big = np.pad(a, 1, constant_values=fill)
            return [big[1 + dy : h + 1 + dy, 1 + dx : w + 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)]

        return np.any(moved(np.all(moved(mask, True), 0), False), 0)

    prev, lost, top = stack[0].copy(), {}, int(stack[0].max())
    out[0] = stack[0]
    for f in range(1, t):
        seg, now, free = stack[f], np.zeros_like(stack[f]), stack[f].copy()
        owners = set(np.unique(prev[prev > 0]).tolist())
        if not owners and not lost:
            now = seg.copy()
            top = int(seg.max()) if top == 0 else top
        else:
            for i in sorted(owners | set(lost)):
                under = seg[lost[i]] if i in lost else free[prev == i]
                under = under[under > 0]
                if len(under):
                    values, counts = np.unique(under, return_counts=True)
                    s = values[counts.argmax()]
                    now[seg == s] = i
                    free[seg == s] = 0
            held = set(np.unique(now).tolist())
            lost = {i: prev == i for i in owners if i not in held}
            for s in np.unique(free[free > 0]).tolist():
                kept = opened(free == s)
                if kept.any():
                    top += 1
                    now[kept] = top
        prev = now
        out[f] = now
    return out


@pytest.mark.parametrize("seed", range(4))
def test_strict_tracker_equals_pixels(spark, seed):
    rng = np.random.default_rng(seed)
    stack = np.zeros((8, 24, 24), int)
    for f in range(8):
        for k in range(1, 6):
            if rng.random() < 0.8:
                y, x = rng.integers(0, 19, 2)
                stack[f, y : y + rng.integers(1, 6), x : x + rng.integers(1, 6)] = k
    px = [("01", f, int(y), int(x), int(stack[f, y, x])) for f in range(8) for y, x in zip(*np.nonzero(stack[f]), strict=True)]
    meta = spark.createDataFrame([("01", f) for f in range(8)], "seq string, frame int")
    got = tracker.strict_tracks(spark.createDataFrame(px, PIXELS), 24, 24, meta).collect()
    want = brute_track(stack)
    table = {(r.frame, r.label): r.track for r in got}
    for f in range(8):
        ids = {(int(stack[f, y, x]), int(want[f, y, x])) for y, x in zip(*np.nonzero(want[f]), strict=True)}
        assert ids == {(label, t) for (g, label), t in table.items() if g == f}


# lineage


def test_lineage(spark):
    t = spark.createDataFrame([("01", 1, 0, 1, 0), ("01", 2, 2, 3, 1), ("01", 3, 2, 3, 1)], TRACKS)
    assert {r.label: r.y for r in lineage.layout(t).collect()} == {1: 0.5, 2: 0.0, 3: 1.0}
    assert lineage.connectors(t, 0, 3, reveal=1).count() == 0
    assert {(r.parent, r.child) for r in lineage.connectors(t, 0, 3, reveal=2).collect()} == {(1, 2), (1, 3)}
    w = spark.createDataFrame([("01", 1, 0, 10, 0), ("01", 2, 12, 20, 1), ("01", 3, 30, 40, 0)], TRACKS)
    assert {(r.label, r.x0, r.x1) for r in lineage.segments(w, 10, 15).collect()} == {(1, 10, 10), (2, 12, 15)}


# logs

TRA = """----------Splitting Operations (Penalty=5)----------
----------False Negative Vertices (Penalty=10)----------
T=1 Label=2
T=1 Label=2
----------False Positive Vertices (Penalty=1)----------

====================
TRA measure: 0.75"""


def lines(spark, body):
    return spark.createDataFrame([("01", i, v) for i, v in enumerate(body.split("\n"))], "seq string, line_no int, value string")


def test_penalty_log(spark):
    got = {r.section: (r["count"], r.weighted) for r in logs.penalties(lines(spark, TRA)).collect()}
    assert len(got) == 6
    assert got["False Negative Vertices"] == (2, 20.0) and got["False Positive Vertices"] == (0, 0.0) and got["Edges To Be Added"] == (0, None)
    assert logs.official_score(lines(spark, TRA), "TRA").first().score == 0.75


def test_object_log(spark):
    body = "----------T=5 Z=0----------\nGT_label=1 J=0.5\nGT_label=2 J=0.49\nGT_label=3 J=0\n----------T=7 Z=2----------\nGT_label=5 J=0.1\nSEG measure: 0.2"
    o = logs.seg_objects(lines(spark, body))
    assert {(r.t, r.z, r.gt_label) for r in o.filter("jaccard < 0.5").collect()} == {(5, 0, 2), (5, 0, 3), (7, 2, 5)}
    s = logs.seg_summary(o).first()
    assert (s.objects, s.low, s.zero, s.min_jaccard) == (4, 3, 1, 0.0)
    assert spark.range(1).select(logs.free_score(F.lit("a 1 b 0.25"))).first()[0] == 0.25


def test_score_from_penalties(spark):
    """Published sample: 105 of 278.5."""
    gt = [(1, 0, 3, 0), (2, 0, 2, 0), (3, 1, 1, 0), (4, 1, 2, 0), (5, 4, 6, 0), (6, 4, 5, 4), (7, 4, 6, 0), (9, 5, 6, 1), (10, 4, 6, 1), (12, 2, 3, 3)]
    t = spark.createDataFrame([("03", *r) for r in gt], TRACKS)
    p = spark.createDataFrame([("03", 25.0), ("03", 50.0), ("03", 3.0), ("03", 1.0), ("03", 24.0), ("03", 2.0)], "seq string, weighted double")
    assert round(logs.aogm_score(p, t).first().score, 6) == 0.62298


# files


def test_frame_index(spark):
    names = ["mask000.tif", "mask001.tif", "mask1.tif", "MASK002.TIFF", "mask001.tiff", "maskx.tif", "other.tif"]
    f = spark.createDataFrame([("p/" + n, n) for n in names], "path string, name string")
    strict = {r.name: r.problem for r in frames.index_frames(f, "mask", 3).collect()}
    assert strict == {"mask000.tif": None, "mask001.tif": "duplicate", "mask1.tif": "name", "MASK002.TIFF": None, "mask001.tiff": "duplicate", "maskx.tif": "name"}
    assert frames.index_frames(f, "mask", None, "silent").count() == 3
    m = frames.subset_mapping(frames.index_frames(f, "mask", 3, "silent"), 1, 3, "mask", ".tif", 3).collect()
    assert [(r.source_frame, r.output_path, r.status) for r in sorted(m, key=lambda r: r.source_frame)] == [(1, "mask000.tif", "copied"), (2, "mask001.tif", "copied"), (3, "mask002.tif", "missing")]


def test_track_text(spark):
    rows = ["1 0 3 0", "2 4 9 1", "bad", "3 5 4 0", "4 0 1 4", "5 0 1 0 7", "1 0 9 0", ""]
    good, bad = text.parse_tracks(spark.createDataFrame(list(enumerate(rows)), "line_no int, value string"))
    assert {r.problem for r in bad.collect()} == {"V-05", "V-07", "V-08", "V-09"}
    assert [r.label for r in good.collect()] == [2]
    last, _ = text.parse_tracks(spark.createDataFrame(list(enumerate(rows)), "line_no int, value string"), "downsampler")
    assert {(r.label, r.end) for r in last.collect()} == {(1, 9), (2, 9), (3, 4), (4, 1)}


def test_tiff_round_trip(spark):
    image = np.zeros((5, 7), int)
    image[1, 2], image[4, 6] = 9, 65535
    assert (tiff.decode(tiff.encode(image)) == image).all()
    px = spark.createDataFrame([("01", 0, 1, 2, 9), ("01", 0, 4, 6, 65535)], PIXELS)
    files = tiff.mask_images(px, 5, 7).select(F.col("seq").alias("path"), "content")
    assert {(r.y, r.x, r.label) for r in tiff.read_masks(files).collect()} == {(1, 2, 9), (4, 6, 65535)}
    with pytest.raises(ValueError):
        tiff.decode(b"PNG.....")
