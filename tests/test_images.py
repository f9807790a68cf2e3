"""Shapes as DataFrames, resampling and number formats against plain definitions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import naming, registry
from tessera.operators import morphology, resample, shapes

from .test_loose_tracker import SMALL, Sets, as_dict

PIXELS = "seq string, frame int, y int, x int, label int"


def blobs(rng, h, w, n):
    m = np.zeros((h, w), np.int64)
    for k in range(1, n + 1):
        for _ in range(3):
            y, x = rng.integers(0, h - 4), rng.integers(0, w - 4)
            m[y : y + rng.integers(2, 5), x : x + rng.integers(4, 14)] = k
    return m


def test_skeletons_and_turned_lines(spark):
    rng = np.random.default_rng(6)
    frames = [blobs(rng, 30, 40, 4) for _ in range(3)]
    px = spark.createDataFrame([("01", f, y, x, v) for f, m in enumerate(frames) for (y, x), v in as_dict(m).items()], PIXELS)
    got = {(r.frame, r.label, r.y, r.x) for r in morphology.skeletons(px).collect()}
    want = {(f, k, y, x) for f, m in enumerate(frames) for k in range(1, 5) for y, x in Sets.thin({p for p, v in as_dict(m).items() if v == k})}
    assert got == want
    angles = [("01", f, k, a) for f in range(3) for k, a in ((1, 0.0), (2, 0.7), (3, math.pi / 2), (4, -1.1))]
    turned = morphology.line_dilation(px, spark.createDataFrame(angles, "seq string, frame int, label int, angle double"), 21, 30, 40)
    want = {(f, k, y, x) for _, f, k, a in angles for y, x in as_dict(shapes.dilated_by(frames[f] == k, shapes.line_element(21, a)))}
    assert {(r.frame, r.label, r.y, r.x) for r in turned.collect()} == want
    for k in (9, 27):
        for operation in ("dilate", "erode"):
            got = {(r.frame, r.y, r.x) for r in morphology.box_morphology(px, 30, 40, k, operation).collect()}
            assert got == {(f, y, x) for f, m in enumerate(frames) for y, x in as_dict(shapes.box(m > 0, k, operation == "dilate"))}


def test_new_branch_labels(spark):
    cross = {(10, x) for x in range(2, 20)} | {(y, 10) for y in range(2, 20)}
    bar = {(10, x) for x in range(2, 20)}
    under = [("01", 0, y, x, 7 if y < 10 else 8) for y, x in cross]
    rows = lambda s: spark.createDataFrame([("01", 0, y, x, 1) for y, x in s], PIXELS)
    got = morphology.new_branch_labels(rows(cross), rows(bar), spark.createDataFrame(under, PIXELS)).collect()
    assert [(r.label, r.labels) for r in got] == [(1, [7, 8])]
    assert morphology.new_branch_labels(rows(cross), rows(cross), spark.createDataFrame(under, PIXELS)).count() == 0
    sets = Sets(30, 30, SMALL)
    bones = Sets.thin(cross)
    assert {p for p in bones if sets.around(bones, p) > 2}


# resampling


def plain_resize(image, to_shape, order, anti_aliasing):
    """One axis after the other, place by place, from the definitions."""

    def mirror(i, n):
        while n > 1 and not 0 <= i < n:
            i = -i if i < 0 else 2 * (n - 1) - i
        return i if n > 1 else 0

    def spline(x):
        """Centred B-spline by its truncated powers."""
        return sum((-1) ** k * math.comb(order + 1, k) * max(0.0, x + (order + 1) / 2 - k) ** order for k in range(order + 2)) / math.factorial(order)

    def line(values, n_out):
        n = len(values)
        sigma = (n / n_out - 1) / 2
        if anti_aliasing and sigma > 0:
            reach = int(4 * sigma + 0.5)
            bell = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
            values = [sum(b * values[mirror(i + d, n)] for b, d in zip(bell, range(-reach, reach + 1), strict=True)) / sum(bell) for i in range(n)]
        if order == 0:
            return [values[mirror(math.floor((i + 0.5) * n / n_out), n)] for i in range(n_out)]
        a = np.zeros((n, n))
        for i in range(n):
            for d in range(-3, 4):
                a[i, mirror(i + d, n)] += spline(d)
        c = np.linalg.solve(a, values)
        at = [(i + 0.5) * n / n_out - 0.5 for i in range(n_out)]
        return [sum(spline(x - j) * c[mirror(j, n)] for j in range(math.floor(x) - 3, math.floor(x) + 5)) for x in at]

    half = np.array([line(column, to_shape[0]) for column in image.T]).T
    out = np.array([line(row, to_shape[1]) for row in half])
    return np.clip(out, image.min(), image.max())


@pytest.mark.parametrize("order", range(6))
def test_resampling_equals_its_definition(spark, order):
    rng = np.random.default_rng(order)
    for shape, to_shape in (((12, 17), (5, 9)), ((9, 8), (20, 13)), ((6, 6), (6, 6)), ((1, 7), (3, 2))):
        image = np.round(rng.random(shape) * 200) * (rng.random(shape) < 0.8)
        rows = [("01", 0, int(y), int(x), float(image[y, x])) for y, x in zip(*np.nonzero(image), strict=True)]
        got = resample.resample(spark.createDataFrame(rows, "seq string, frame int, y int, x int, value double"), shape, to_shape, order)
        dense = np.zeros(to_shape)
        for r in got.collect():
            dense[r.y, r.x] = r.value
        want = plain_resize(image, to_shape, order, True)
        assert np.abs(dense - want).max() < 1e-6, (shape, to_shape)
        by_matrix = resample.axis_weights(shape[0], to_shape[0], order, True) @ image @ resample.axis_weights(shape[1], to_shape[1], order, True).T
        assert np.abs(dense - np.clip(by_matrix, image.min(), image.max())).max() < 1e-6
        if shape == to_shape:
            assert np.abs(dense - image).max() < 1e-6


def test_resampling_to_levels(spark):
    rows = [("01", 0, y, x, 10 * y + x) for y in range(4) for x in range(4)] + [("01", 0, 0, 0, None)]
    px = spark.createDataFrame(rows[1:], "seq string, frame int, y int, x int, value int")
    got = resample.resample(px, (4, 4), (2, 2), 1, False, levels=(0, 20)).orderBy("y", "x").collect()
    assert [r.value for r in got] == [6.0, 8.0, 20.0, 20.0]  # 5.5 and 7.5 to even
    with pytest.raises(ValueError):
        resample.resample(px, (4, 4), (2, 2), 6)


# numbers


def test_short_numbers_equal_printf(spark):
    rng = random.Random(1)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-20, 20) for _ in range(2000)]
    values += [0.0, -0.0, 1.0, -1.0, 100.0, 1e11, 999999999999.0, 999999999999.5, 1e12, 123456789012.0, 1e-4, 0.0001234, 9.9999999999995e-5, 1e100, -1e-300, 1.7e308, math.nan, math.inf, -math.inf, 1 / 3, None]
    registry.register(spark)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", naming.short_number(F.col("v")).alias("a"), F.expr("fmt_g12(v)").alias("b")).collect():
        want = None if r.v is None else f"{r.v:.12g}"
        assert (r.a, r.b) == (want, want), r.v


# mask files


def tiff_file(images, order="<", how=1, planar=1, predictor=1, kind=1, strips=2):
    """A file of several pages, written out by the layout alone."""
    import struct
    import zlib

    def packed(raw):
        if how == 1:
            return raw
        if how in (8, 32946):
            return zlib.compress(raw)
        out = b""
        for i in range(0, len(raw), 100):  # PackBits: literal runs, and one that repeats
            part = raw[i : i + 100]
            out += bytes([257 - len(part)]) + part[:1] if len(set(part)) == 1 and len(part) > 1 else bytes([len(part) - 1]) + part
        return out + bytes([128])

    data, heads = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0), []
    for image in images:
        h, w, s = image.shape
        values = np.diff(image, axis=1, prepend=np.zeros((h, 1, s), image.dtype)) if predictor == 2 else image
        values = values.astype(image.dtype.newbyteorder(order))
        planes = [values[:, :, i : i + 1] for i in range(s)] if planar == 2 else [values]
        parts = [packed(np.ascontiguousarray(p[a : a + -(-h // strips)]).tobytes()) for p in planes for a in range(0, h, -(-h // strips))]
        places = []
        for part in parts:
            places.append(len(data))
            data += part
        entries = [(256, 3, [w]), (257, 3, [h]), (258, 3, [image.dtype.itemsize * 8] * s), (259, 3, [how]), (273, 4, places), (277, 3, [s]), (278, 3, [-(-h // strips)]), (279, 4, [len(p) for p in parts]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [kind])]
        body = struct.pack(order + "H", len(entries))
        for tag, k, numbers in entries:
            raw = struct.pack(f"{order}{len(numbers)}{'H' if k == 3 else 'I'}", *numbers)
            if len(raw) > 4:
                where, data = len(data), data + raw
                raw = struct.pack(order + "I", where)
            body += struct.pack(order + "HHI", tag, k, len(numbers)) + raw.ljust(4, b"\0")
        heads.append((len(data), len(data) + len(body)))
        data += body + struct.pack(order + "I", 0)
    data = data[:4] + struct.pack(order + "I", heads[0][0]) + data[8:]
    for (_, link), (start, _) in zip(heads, heads[1:], strict=False):
        data = data[:link] + struct.pack(order + "I", start) + data[link + 4 :]
    return data


@pytest.mark.parametrize("order", ["<", ">"])
def test_files_of_every_kind(spark, order):
    from tessera.sources import tiff

    rng = np.random.default_rng(1)
    grey = [rng.integers(0, 65536, (7, 9, 1)).astype(np.uint16) for _ in range(3)]
    rgb = rng.integers(0, 256, (7, 9, 3)).astype(np.uint8)
    for how in (1, 8, 32946, 32773):
        for predictor in (1, 2):
            got = tiff.pages(tiff_file(grey, order, how, predictor=predictor))
            assert len(got) == 3 and all((a == b).all() for a, b in zip(got, grey, strict=True)), (how, predictor)
        for planar in (1, 2):
            (back,) = tiff.pages(tiff_file([rgb], order, how, planar))
            assert (back == rgb).all() and (tiff.as_mask(back) == rgb[:, :, 0]).all() and (tiff.as_picture(back) == rgb).all()
    flat = np.zeros((7, 9, 1), np.uint8)
    assert (tiff.pages(tiff_file([flat], order, 32773))[0] == 0).all()
    real = rng.integers(0, 9, (7, 9, 1)).astype(np.float32)
    (back,) = tiff.pages(tiff_file([real], order, 8, kind=3))
    assert (tiff.as_mask(back) == real[:, :, 0]).all()
    assert (tiff.as_mask(np.moveaxis(rgb, 2, 0)) == rgb[:, :, 0]).all()
    assert tiff.as_picture(grey[0]).shape == (7, 9, 3)
    half, low, wide = real + 0.5, -1 - real, grey[0].astype(np.uint32) + 65536
    files = {
        "good": tiff_file(grey[:2], order, 8), "half": tiff_file([half], order, kind=3), "low": tiff_file([low], order, kind=3), "wide": tiff_file([wide], order),
        "lzw": tiff_file([rgb], order).replace(b"", b""), "none": None, "text": b"PNG.....", "cut": tiff_file(grey, order, 8)[:60],
    }
    files["lzw"] = tiff_file([flat], order, 1)
    at = files["lzw"].index((b"\x03\x01\x03\x00" if order == "<" else b"\x01\x03\x00\x03")) + 8
    files["lzw"] = files["lzw"][:at] + (b"\x05\x00" if order == "<" else b"\x00\x05") + files["lzw"][at + 2 :]
    found = tiff.read_pages(spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "path string, content binary")).collect()
    problems = {r.path: r.problem for r in found if r.problem}
    assert set(problems) == set(files) - {"good"} and "compression 5" in problems["lzw"] and "whole numbers" in problems["half"] and "16 bits" in problems["low"] and "16 bits" in problems["wide"]
    assert {(r.page, r.y, r.x): r.label for r in found if r.path == "good"} == {(p, y, x): v for p in (0, 1) for (y, x), v in as_dict(grey[p][:, :, 0]).items()}


def test_no_common_frame_is_an_error(spark):
    from tessera.operators import failures

    a, b = (spark.createDataFrame([("01", f, 0, 0, 1)], PIXELS) for f in (0, 1))
    failures.require_common_frames(a, a)
    with pytest.raises(ValueError, match="no frame in common"):
        failures.require_common_frames(a, b)
    failures.require_common_frames(a, b, b)


# downsampling


def test_downsampling_to_a_shape_pads_or_refuses(spark):
    from tessera.operators import tracks

    px = spark.createDataFrame([("01", f, y, x, 3) for f in (0, 2, 6) for y in range(4) for x in range(4)], PIXELS)
    parents = spark.createDataFrame([("01", 3, 0)], "seq string, label int, parent int")
    with pytest.raises(ValueError, match="01/4"):
        tracks.downsample_result(px, parents, 4, 2)
    out = tracks.downsample_result(px, parents, 4, 2, 0, (4, 4), (2, 2), pad_missing=True)
    assert {(r.frame, r.source_frame, r.missing) for r in out["frames"].collect()} == {(0, 0, False), (1, 2, False), (2, 4, True), (3, 6, False)}
    assert {(r.frame, r.y, r.x, r.label) for r in out["pixels"].collect()} == {(f, y, x, k) for f, k in ((0, 1), (1, 1), (3, 2)) for y in (0, 1) for x in (0, 1)}
    assert {(r.label, r.begin, r.end) for r in out["tracks"].collect()} == {(1, 0, 1), (2, 3, 3)}
    meta = spark.createDataFrame([("01", f) for f in range(7)], "seq string, frame int")
    assert tracks.downsample_result(px, parents, 4, 2, meta=meta)["frames"].filter("missing").count() == 0


# audit


def test_a_failing_sequence_is_a_row(spark):
    from tessera.operators import validate

    good = [("01", f, 0, 0, 1) for f in range(3)]
    bad = [("02", f, 0, 0, 1) for f in (0, 2)]
    px = spark.createDataFrame(good + bad, PIXELS)
    rows = [("01", 1, 0, 2, 0), ("02", 1, 0, 1, 0), ("03", 4, 0, 1, 9)]
    audited = validate.audit(px, spark.createDataFrame(rows, "seq string, label int, begin int, end int, parent int"))
    found = {r.seq: r for r in audited.collect()}
    assert found["01"].passed and found["01"].rules == "" and (found["01"].frames, found["01"].labels, found["01"].tracks) == (3, 1, 1)
    assert found["02"].rules == "V-03=1, V-14=1, V-15=1" and found["02"].n_violations == 3 and not found["02"].passed
    assert found["03"].rules == "V-12=1, V-16=1" and found["03"].frames == 0
    assert validate.of_passed(px, audited).count() == 3
    assert validate.enforced(px.filter("seq = '01'"), audited).count() == 3
    for seq, what in (("02", "sequence 02 breaks V-03=1"), ("09", "not audited")):
        with pytest.raises(Exception, match=what):
            validate.enforced(px.filter("seq = '02'").withColumn("seq", F.lit(seq)), audited).collect()


# files and channels


def test_mask_files_by_suffix_or_pattern(spark):
    from tessera.sources import frames

    rows = [("01", "a_masks.tif"), ("01", "b_cp_masks.tif"), ("02", "c_masks.tif"), ("03", "d.png")]
    files = spark.createDataFrame(rows, "seq string, name string")
    assert {r.name for r in frames.mask_files(files).collect()} == {"b_cp_masks.tif", "c_masks.tif"}
    assert {r.name for r in frames.mask_files(files.drop("seq")).collect()} == {"b_cp_masks.tif"}
    assert {r.name for r in frames.mask_files(files, pattern="[ab]*.tif").collect()} == {"a_masks.tif", "b_cp_masks.tif"}
    with pytest.raises(FileNotFoundError, match="x\\*"):
        frames.mask_files(files, pattern="x*", required=True)
    assert len(naming.three_channels([F.lit(1)])) == 3 and len(naming.three_channels([F.lit(1)] * 4)) == 3
