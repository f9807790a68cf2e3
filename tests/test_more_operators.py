"""Logs, lineages, truth choice, repair, components, file selection and sinks on small fixtures and brute force."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import failures, lineage, logs, morphology, rescue, validate
from tessera.sources import frames, text

from . import pixel_machines

PIXELS = "seq string, frame int, y int, x int, label int"
TRACKS = "seq string, label int, begin int, end int, parent int"


def box(frame, label, y, x, h=4, w=4, seq="01"):
    return [(seq, frame, y + i, x + j, label) for i in range(h) for j in range(w)]


def log(spark, *values):
    return spark.createDataFrame([("01", i, v) for i, v in enumerate(values)], "seq string, line_no int, value string")


def test_sections_without_a_penalty_end_the_one_before(spark):
    lines = log(spark, "-----Splitting Operations-----", "T=1 Label=2", "", "---Other---", "T=1 Label=3", "T=2 Label=3", "---False Negative Vertices (Penalty=10)---", "a", "a", "=====", "b")
    got = {r.section: (r.penalty, r["count"], r.weighted) for r in logs.penalties(lines).collect()}
    assert got["Splitting Operations"] == (None, 1, None) and got["False Negative Vertices"] == (10.0, 2, 20.0)


def test_frames_without_or_below_z_and_scores_in_any_case(spark):
    lines = log(spark, "----T=1----", "GT_label=4 J=0.25", "---T=2 Z=-1---", "GT_label=5 J=1e-1", "GT_label=5 J=x", "seg Measure: 0.5", "xSEG measure: 0.9")
    assert [(r.t, r.z, r.gt_label, r.jaccard) for r in logs.seg_objects(lines).orderBy("t").collect()] == [(1, None, 4, 0.25), (2, -1, 5, 0.1)]
    assert logs.official_score(lines, "SEG").first().score == 0.5
    assert logs.official_score(lines, "TRA").count() == 0


def test_long_lineages_and_cycles(spark):
    rows = [("01", 1, 0, 0, 0)] + [("01", i, i, i, i - 1) for i in range(2, 201)] + [("02", 5, 0, 1, 9), ("02", 7, 0, 1, 8), ("02", 8, 0, 1, 7), ("02", 3, 2, 4, 5)]
    t = spark.createDataFrame(rows, TRACKS)
    got = {(r.seq, r.label): (r.root, r.depth) for r in lineage.depths(t).collect()}
    assert got["01", 200] == (1, 199) and got["02", 3] == (5, 1) and ("02", 7) not in got
    assert {r.y for r in lineage.layout(t).filter("seq = '01'").collect()} == {0.0}


def test_layout_equals_recursion(spark):
    rng = np.random.default_rng(1)
    rows = [("01", i, int(rng.integers(20)), 20, int(rng.integers(0, i)) if i > 3 else 0) for i in range(1, 80)]
    children = collections.defaultdict(list)
    for _, label, begin, _, parent in sorted(rows, key=lambda r: (r[2], r[1])):
        children[parent].append(label)
    y, leaves = {}, iter(range(100))

    def place(label):
        for c in children[label]:
            place(c)
        y[label] = sum(y[c] for c in children[label]) / len(children[label]) if children[label] else float(next(leaves))

    for r in children[0]:
        place(r)
    assert {r.label: r.y for r in lineage.layout(spark.createDataFrame(rows, TRACKS)).collect()} == pytest.approx(y)


def test_events_use_outlines_where_annotated(spark):
    gt = spark.createDataFrame(box(0, 1, 5, 5, 2, 2) + box(1, 1, 5, 5, 2, 2), PIXELS)
    res = spark.createDataFrame(box(0, 1, 4, 4) + box(1, 1, 4, 4), PIXELS)
    seg = spark.createDataFrame(box(1, 1, 4, 4, 4, 2), PIXELS)
    t = spark.createDataFrame([("01", 1, 0, 1, 0)], TRACKS)
    assert failures.events(gt, res, t, t).count() == 0  # nothing annotated: markers alone say nothing of outlines
    assert failures.events(gt, res, t, t, seg=seg).count() == 0  # half covered, and frame 0 has no outline
    thin = spark.createDataFrame(box(1, 1, 4, 4, 4, 1), PIXELS)
    assert {(r.frame, r.score) for r in failures.events(gt, res, t, t, seg=thin).collect()} == {(1, 0.25)}


def test_sequences_without_common_markers_fall_back_to_outlines(spark):
    gt = spark.createDataFrame(box(7, 1, 5, 5) + box(0, 1, 5, 5, seq="02"), PIXELS)
    res = spark.createDataFrame(box(0, 2, 5, 5) + box(1, 2, 5, 5) + box(0, 2, 50, 50, seq="02"), PIXELS)
    seg = spark.createDataFrame(box(1, 1, 5, 5) + box(9, 1, 5, 5, seq="02"), PIXELS)
    assert {(r.seq, r.frame) for r in failures.common_frames(gt, res, seg).collect()} == {("01", 1), ("02", 0)}
    assert {(r.seq, r.frame) for r in failures.choose_truth(gt, seg).select("seq", "frame").distinct().collect()} == {("01", 7), ("02", 0), ("01", 1), ("02", 9)}


def test_event_plan_stays_small(spark):
    gt = spark.createDataFrame(box(0, 1, 5, 5), PIXELS)
    t = spark.createDataFrame([("01", 1, 0, 1, 0)], TRACKS)
    out = failures.events(gt, gt, t, t, seg=gt)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") < 15


def test_ties_go_to_the_frame_met_first(spark):
    rows = [("01", 9, 0, 9, 0), ("01", 9, 0, 9, 1), ("01", 2, 1, 4, 2), ("01", 2, 1, 4, 2), ("01", 5, 0, 5, 0)]
    e = spark.createDataFrame(rows, "seq string, frame int, a int, b int, c int").select("seq", "frame", F.struct("a", "b", "c").alias("place"))
    assert [(r.frame, r.n) for r in failures.top_frames(e, 2).orderBy("place").collect()] == [(9, 2), (2, 2)]


def test_steps_are_judged_by_their_own_track(spark):
    rows = [("01", f, 1, 0.0, 60.0 * f) for f in range(4)] + [("01", f, 2, 0.0, 1.0 * f) for f in range(3)] + [("01", 3, 2, 0.0, 70.0)]
    s = failures.steps(spark.createDataFrame(rows, "seq string, frame int, label int, cy double, cx double"))
    assert [(r.label, r.frame) for r in failures.jumps(s).collect()] == [(2, 3)]


def flood(cells):
    """Sizes of 8-connected parts of equal labels, by plain flooding."""
    left, out = dict(cells), []
    while left:
        (p, label), n, todo = left.popitem(), 0, None
        todo = [p]
        while todo:
            y, x = todo.pop()
            n += 1
            for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if left.get(q) == label:
                    del left[q]
                    todo.append(q)
        out.append((label, n))
    return sorted(out)


@pytest.mark.parametrize("seed", range(8))
def test_parts_equal_flooding(seed):
    import pandas as pd

    rng = np.random.default_rng(seed)
    grid = rng.integers(0, 3, (40, 30)) * (rng.random((40, 30)) < rng.uniform(0.2, 0.9))
    y, x = np.nonzero(grid)
    keep = rng.permutation(len(y))
    frame = pd.DataFrame({"seq": "01", "frame": 0, "y": y[keep], "x": x[keep], "label": grid[y, x][keep]})
    got = morphology._components(frame).groupby("part").agg(label=("label", "first"), n=("size", "first"), rows=("size", "size"))
    assert (got.n == got.rows).all()
    assert sorted(zip(got.label, got.n, strict=True)) == flood(dict(zip(zip(y.tolist(), x.tolist(), strict=True), grid[y, x].tolist(), strict=True)))


# three-stage repair


def stages_by_hand(cells, cooldown, gap):
    """The stages over whole frames held in memory, one sequence."""

    def code(ps):
        return np.array([y * pixel_machines.WIDE + x for y, x, _ in ps], np.int64), np.array([v for *_, v in ps], np.int64)

    def run_rescue(fs, until, excluded):
        state, before, out = pixel_machines.IdentityRescue(gap, 0.3, 50.0, until, excluded), (np.zeros(0, np.int64),) * 2, []
        for i, (c, v) in enumerate(fs):
            state.step(i, before, fs[i : i + gap])
            before = (c, state.ids(v))
            out.append(before)
        return out

    fs = run_rescue([code(c) for c in cells], {}, frozenset())
    d = pixel_machines.Divider(max(int(v.max()) for _, v in fs if len(v)), cooldown)
    fs = [(c, d.step(i, c, v)) for i, (c, v) in enumerate(fs)]
    if d.until:
        fs = run_rescue(fs, d.until, frozenset(d.parents.values()))
    return fs, d.parents


@pytest.mark.parametrize("seed", range(3))
def test_repair_equals_stages_by_hand(spark, seed):
    rng = np.random.default_rng(seed)
    cells, rows = [], []
    for f in range(12):
        frame = {}
        for k in range(4):
            label = k + 1 + (10 if f > 4 + k and k % 2 else 0) + (20 if k == 0 and f > 8 else 0)
            for y in range(10 * k, 10 * k + 7):
                for x in range(5 + f, 15 + f):
                    if (f, k) != (6, 2):
                        frame[y, x] = label + (40 if k == 3 and f > 3 and x > 9 + f else 0)
        for _ in range(5):
            frame[int(rng.integers(45)), int(rng.integers(45))] = int(rng.integers(1, 5))
        cells.append([(y, x, v) for (y, x), v in sorted(frame.items())])
        rows += [("01", f, y, x, v) for y, x, v in cells[-1]]
    got = rescue.repair(spark.createDataFrame(rows, PIXELS), cooldown=3, gap=2)
    want, parents = stages_by_hand(cells, 3, 2)
    found = collections.defaultdict(dict)
    for r in got["pixels"].collect():
        found[r.frame][r.y * pixel_machines.WIDE + r.x] = r.label
    assert {f: dict(zip(c.tolist(), v.tolist(), strict=True)) for f, (c, v) in enumerate(want)} == found
    assert {r.label: r.parent for r in got["parents"].collect()} == parents and parents
    assert got["before"].count() > 0


def test_repair_without_rescue_is_division_alone(spark):
    rows = box(0, 1, 2, 2, 6, 6) + box(1, 1, 2, 2, 3, 6) + box(1, 2, 5, 2, 3, 6)
    got = rescue.repair(spark.createDataFrame(rows, PIXELS), gap=0)
    assert {(r.label, r.parent) for r in got["parents"].collect()} == {(2, 1), (3, 1)}
    assert got["before"].count() == got["after"].count() == 0
    assert {r.label for r in got["pixels"].filter("frame = 1").collect()} == {2, 3}


# files


def test_frames_and_shapes_are_inferred(spark):
    def listed(*rows):
        return spark.createDataFrame(list(rows), "seq string, frame int, digits int")

    t, tra, seg = listed(("01", 5, 3), ("01", 6, 3)), listed(("01", 0, 4), ("02", 1, 3), ("02", 3, 4)), listed(("03", 9, 3), ("02", 0, 3))
    got = {r.seq: (r.kind, r.first, r.frames, r.digits, r.contiguous) for r in frames.infer_frames([t, tra, seg]).collect()}
    assert got == {"01": (0, 5, 2, 3, True), "02": (1, 1, 2, None, False), "03": (2, 9, 1, 3, True)}
    shape = "seq string, frame int, height int, width int"
    a, b = spark.createDataFrame([("01", 3, 7, 8), ("01", 1, 5, 6)], shape), spark.createDataFrame([("01", 0, 1, 1), ("02", 0, 2, 3)], shape)
    assert {(r.seq, r.height, r.width) for r in frames.infer_shape([a, b]).collect()} == {("01", 5, 6), ("02", 2, 3)}


def test_strided_selection_and_pairs(spark):
    f = spark.createDataFrame([("01", x) for x in (3, 5, 8, 9, 20, 21, 22)], "seq string, frame int")
    assert sorted(r.frame for r in frames.select_frames(f, 3).collect()) == [3, 9, 22]
    assert sorted(r.frame for r in frames.select_frames(f, 3, 2).collect()) == [3, 9]
    names = "seq string, name string, height int, width int"
    images = spark.createDataFrame([("01", "i10", 4, 4), ("01", "i9", 4, 4), ("01", "i11", 4, 4)], names)
    masks = spark.createDataFrame([("01", "m1", 4, 4), ("01", "m2", 4, 5)], names)
    pairs, problems = frames.pair_by_place(images, masks)
    assert [(r.image, r.mask) for r in pairs.collect()] == [("i9", "m1")]
    assert {(r.image, r.mask, r.problem) for r in problems.collect()} == {("i10", "m2", "shape"), ("i11", None, "count")}


def test_time_axis():
    assert [frames.time_axis(s) for s in ((5, 10, 12), (6, 10, 12), (40, 5, 5), (10, 12, 4), (4, 9, 4))] == [0, 2, 2, 2, 2]
    assert frames.time_axis((9, 4, 9)) == 1 and frames.time_axis((1, 2, 3), "last") == 2 and frames.time_axis((1, 2, 3), "-2") == 1
    with pytest.raises(ValueError):
        frames.time_axis((1, 2, 3), "3")


def test_levels_of_strictness(spark):
    rows = ["1 0 5 0", "2 0 3 2", "3 4 2 0", "70000 0 1 0", "5 0 1 9", "6 0 1 0 extra", "1 0 9 0", "7 1"]
    lines = spark.createDataFrame(list(enumerate(rows)), "line_no int, value string")
    got = {level: (sorted(r.label for r in good.collect()), {r.problem for r in bad.collect()}) for level in text.STRICTNESS for good, bad in [text.parse_tracks(lines, level)]}
    assert got["validator"] == ([5], {"V-05", "V-06", "V-07", "V-08", "V-09"})
    assert got["subsetter"] == ([2, 5, 70000], {"V-05", "V-07", "V-09"})
    assert got["downsampler"][0] == got["rebuilder"][0] == [1, 2, 3, 5, 70000]
    assert got["failures"] == ([1, 2, 3, 5, 6, 70000], {"V-05"})
    assert got["viewer"] == ([3, 6, 70000], {"V-05", "V-08", "V-09"})
    assert text.parse_tracks(lines, "rebuilder")[0].columns == ["label", "parent"]


def test_manifests_reports_and_backups(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    text.write_lines(spark, text.manifest_lines({"sequence": "01", "frames": "2"}, ["mask10.tif", "mask9.tif"]), path)
    settings, names = text.parse_manifest(text.read_lines(spark, path))
    assert {r.key: r.value for r in settings.collect()} == {"sequence": "01", "frames": "2"}
    assert [(r.place, r.name) for r in names.orderBy("place").collect()] == [(0, "mask10.tif"), (1, "mask9.tif")]
    assert [text.backup_path(spark, path), text.backup_path(spark, path)] == [f"{path}.bak", None]
    text.write_lines(spark, ["x"], path)
    assert text.backup_path(spark, path) == f"{path}.bak1"
    table = spark.createDataFrame([("01", 3, "id_switch", 2, "more")], "sequence string, frame int, event_type string, count int, other string")
    text.write_report(table, "failure_summary_by_frame", f"file://{tmp_path}/r")
    assert spark.read.csv(f"file://{tmp_path}/r", header=True).columns == ["sequence", "frame", "event_type", "count"]


def test_export_folder_and_type_rules(spark):
    px = spark.createDataFrame(box(0, 1, 0, 0) + box(2, 1, 0, 0) + box(1, 3, 9, 9), PIXELS)
    t = spark.createDataFrame([("01", 1, 0, 2, 0), ("01", 2, 1, 5, 9)], TRACKS)
    got = {(r.item, r.details) for r in validate.export_violations(px, t, 3).collect()}
    assert got == {("2", "1-5"), ("2", "no pixels"), ("3", "no track row"), ("2", "parent 9")}
    seqs = spark.createDataFrame([("01",), ("02",)], "seq string")
    assert [r.seq for r in validate.missing_folders(seqs, seqs.limit(0)).orderBy("seq").collect()] == ["01", "02"]
    meta = spark.createDataFrame([("01", 0, 9, 9, "uint16"), ("01", 1, 9, 9, "int32")], "seq string, frame int, height int, width int, dtype string")
    assert [(r.rule, r.item, r.details) for r in validate.violations(px, t, meta=meta).filter("rule = 'V-10'").collect()] == [("V-10", "1", "int32")]
