"""TIFF masks and images, decoded and encoded from the public TIFF 6.0 layout, in executors."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIXELS = "path string, y int, x int, label int"
#: Tag numbers and value sizes of TIFF 6.0.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, FORMAT = 284, 317, 339
_SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
_KINDS = {1: "u", 2: "i", 3: "f"}


def _tags(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    """The whole-number tags of the directory at a place, and the place of the next one (0: none)."""
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    tags: dict[int, tuple[int, ...]] = {}
    for i in range(n):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind not in _SIZES:
            continue
        letter, size = _SIZES[kind]
        raw = entry[8:12] if size * count <= 4 else data[(p := struct.unpack(order + "I", entry[8:12])[0]) : p + size * count]
        tags[tag] = struct.unpack(f"{order}{count}{letter}", raw[: size * count])
    return tags, struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]


def _unpacked_bits(data: bytes) -> bytes:
    """PackBits: a count byte is followed by that many bytes, or by one to repeat."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


#: How strips are held, by TIFF's number.
UNPACK = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 32773: _unpacked_bits}


def _image(data: bytes, tags: dict[int, tuple[int, ...]], order: str) -> np.ndarray:
    """One page as (height, width, samples), in whatever order its samples are held."""
    h, w, s, bits = tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0], tags.get(BITS, (1,))[0]
    how, kind = tags.get(COMPRESSION, (1,))[0], _KINDS.get(tags.get(FORMAT, (1,))[0])
    if how not in UNPACK:
        raise ValueError(f"compression {how} isn't read")
    if kind is None or bits not in (8, 16, 32, 64) or (kind == "f" and bits < 32):
        raise ValueError(f"{bits} bits a sample of this kind aren't read")
    body = b"".join(UNPACK[how](data[a : a + b]) for a, b in zip(tags[STRIPS], tags[COUNTS], strict=True))
    apart = tags.get(PLANAR, (1,))[0] == 2
    values = np.frombuffer(body, f"{order}{kind}{bits // 8}", h * w * s).reshape((s, h, w) if apart else (h, w, s))
    image = np.moveaxis(values, 0, 2) if apart else values
    if tags.get(PREDICTOR, (1,))[0] == 2:  # differences along a row
        image = np.cumsum(image, axis=1, dtype=image.dtype.newbyteorder("="))
    return image


def pages(data: bytes) -> list[np.ndarray]:
    """Every page of a file as (height, width, samples) [O-08]."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", data[4:8])
    out, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        tags, following = _tags(data, at, order)
        out.append(_image(data, tags, order))
        at = following
    return out


def as_mask(image: np.ndarray) -> np.ndarray:
    """Labels of an image: its first channel, whole numbers from 0 to 65535; anything else is an error [O-08, O-09].

    Channels lie last, or first where the first axis alone is as short as channels are.
    """
    image = np.squeeze(image) if image.ndim > 2 and 1 in image.shape[:1] + image.shape[2:] else image
    if image.ndim == 3:
        image = image[0] if image.shape[0] <= 4 < min(image.shape[1:]) else image[:, :, 0]
    if image.ndim != 2:
        raise ValueError(f"a mask has two axes, not {image.ndim}")
    if image.dtype.kind == "f" and not np.isfinite(image).all() or not (image == np.floor(image)).all():
        raise ValueError("labels must be whole numbers")
    if image.min(initial=0) < 0 or image.max(initial=0) > 65535:
        raise ValueError("labels must fit 16 bits")
    return image.astype(np.int64)


def as_picture(image: np.ndarray) -> np.ndarray:
    """The first three channels of an image, channels last; grey is repeated three times [O-09, O-43]."""
    if image.ndim == 3 and image.shape[0] <= 4 < min(image.shape[1:]):
        image = np.moveaxis(image, 0, 2)
    image = image[:, :, None] if image.ndim == 2 else image
    return np.repeat(image[:, :, :1], 3, axis=2) if image.shape[2] < 3 else image[:, :, :3]


def decode(data: bytes, channel: int = 0) -> np.ndarray:
    """One channel of the first page as a 2-D array [O-08, O-09]."""
    return pages(data)[0][:, :, channel]


def encode(image: np.ndarray, deflate: bool = False) -> bytes:
    """A 16-bit grey image in one strip [O-22]."""
    if image.min(initial=0) < 0 or image.max(initial=0) > 65535:
        raise ValueError("labels must fit 16 bits")
    body = np.ascontiguousarray(image, "<u2").tobytes()
    body = zlib.compress(body, 6) if deflate else body
    body += b"\0" * (len(body) % 2)  # directories begin at even places
    h, w = image.shape
    entries = [(WIDTH, 4, w), (HEIGHT, 4, h), (BITS, 3, 16), (COMPRESSION, 3, 8 if deflate else 1), (PHOTOMETRIC, 3, 1), (STRIPS, 4, 8), (SAMPLES, 3, 1), (ROWS, 4, h), (COUNTS, 4, len(body))]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in entries) + struct.pack("<I", 0)
    return b"II" + struct.pack("<HI", 42, 8 + len(body)) + body + ifd


def read_pages(files: DataFrame) -> DataFrame:
    """(path, page, y, x, label, problem): labelled pixels of every page of binary files (path, content) [O-08, O-09].

    A file that can't be read, or holds no mask, is one row with its ``problem`` and null elsewhere; it never stops the
    others. Null contents are such files; pages without labelled pixels give no rows.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    masks = [as_mask(p) for p in pages(bytes(content or b""))]
                except (ValueError, KeyError, struct.error, zlib.error) as e:
                    yield pd.DataFrame({"path": [path], "page": [None], "y": [None], "x": [None], "label": [None], "problem": [str(e) or type(e).__name__]}).astype({c: "Int32" for c in ("page", "y", "x", "label")})
                    continue
                for number, mask in enumerate(masks):
                    y, x = np.nonzero(mask)
                    found = pd.DataFrame({"path": path, "page": number, "y": y, "x": x, "label": mask[y, x], "problem": None})
                    yield found.astype({c: "Int32" for c in ("page", "y", "x", "label")})

    return files.select("path", "content").mapInPandas(run, "path string, page int, y int, x int, label int, problem string")


def read_masks(files: DataFrame) -> DataFrame:
    """(path, y, x, label) of all labelled pixels of binary files (path, content) [O-08]."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                image = decode(bytes(content))
                y, x = np.nonzero(image)
                yield pd.DataFrame({"path": path, "y": y.astype("int32"), "x": x.astype("int32"), "label": image[y, x].astype("int32")})

    return files.select("path", "content").mapInPandas(run, PIXELS)


def mask_images(pixels: DataFrame, height: int, width: int, deflate: bool = False) -> DataFrame:
    """(seq, frame, content): an encoded mask per frame, for any binary sink [O-22]."""
    cells = pixels.groupBy("seq", "frame").agg(F.collect_list(F.struct("y", "x", "label")).alias("p"))  # at most one per pixel of the image
    cells = cells.select("seq", "frame", "p.y", "p.x", "p.label")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples():
                image = np.zeros((height, width), np.int64)
                image[r.y, r.x] = r.label
                out.append((r.seq, r.frame, encode(image, deflate)))
            yield pd.DataFrame(out, columns=["seq", "frame", "content"])

    return cells.mapInPandas(run, "seq string, frame int, content binary")


def nested_masks(arrays: DataFrame) -> DataFrame:
    """(path, y, x, label) of masks held as arrays of rows, the safe stand-in for pickled arrays [O-05]."""
    rows = arrays.select("path", F.posexplode("mask").alias("y", "line"))
    return rows.select("path", "y", F.posexplode("line").alias("x", "label")).filter("label <> 0")
