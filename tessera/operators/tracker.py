"""Strict tracker: segments of each frame take over the ids of the frame before.

The tracker never looks inside a segment, so frames are reduced to small tables in parallel first
(overlaps with the last frame and the one before it, and which segments survive an opening); only
the greedy claiming, which depends on the frame before, runs in order, one group per sequence.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import raster
from .frame_tables import FRAMES_EACH, Places, counted, dealt

ASSIGNED = "seq string, frame int, label int, track int"


def _overlaps(shape: tuple[int, int] | None):
    """Segments of a group of frames and their overlaps at lags 1 and 2; what is open is told by column or, with a shape, found here."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        p = Places(group)
        opened = group["open"].to_numpy(bool)[p.order] if shape is None else p.opened(*shape)
        rows, _ = counted(p.frame, p.label)
        kept, _ = counted(p.frame[opened], p.label[opened])
        parts = [("segment", 0, rows[:, 0], rows[:, 1], rows[:, 1], np.ones(len(rows), int)), ("opened", 0, kept[:, 0], kept[:, 1], kept[:, 1], np.ones(len(kept), int))]
        for lag in (1, 2):
            i = p.index(-lag)
            for kind, met in (("whole", i >= 0), ("open", (i >= 0) & opened[i])):
                rows, n = counted(p.frame[met], p.label[i[met]], p.label[met])
                parts.append((kind, lag, *rows.T, n))
        kinds, lags, *columns = zip(*parts, strict=True)
        sizes = [len(n) for n in columns[-1]]
        out = pd.DataFrame({"seq": key[0], "kind": np.repeat(np.array(kinds, object), sizes), "lag": np.repeat(lags, sizes)} | {k: np.concatenate(v) for k, v in zip(("frame", "prev", "label", "n"), columns, strict=True)})
        return out[out["frame"].between(key[1] * FRAMES_EACH, (key[1] + 1) * FRAMES_EACH - 1)]

    return run


def _rows(pixels: DataFrame, shape: tuple[int, int] | None, meta: DataFrame | None) -> DataFrame:
    grouped = dealt(pixels, 2, *(["open"] if shape is None else [])).groupBy("seq", "part")
    met = grouped.applyInPandas(_overlaps(shape), "seq string, frame int, kind string, lag int, prev int, label int, n int")
    segments, opened = (F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("label")))).alias(name) for k, name in (("segment", "segments"), ("opened", "opened")))
    overlaps = F.collect_list(F.when(F.col("kind").isin("whole", "open"), F.struct("lag", "kind", "prev", "label", "n"))).alias("overlaps")
    rows = met.groupBy("seq", "frame").agg(segments, opened, overlaps)
    return rows if meta is None else meta.select("seq", "frame").distinct().join(rows.hint("merge"), ["seq", "frame"], "left")


def overlap_table(pixels: DataFrame, opened: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row per frame: segments, surviving openings and overlap counts at lags 1 and 2.

    ``meta`` names every frame, so that empty frames are rows too (none: frames with pixels). Pixels meet in groups of a few frames, never by a join.
    """
    both = pixels.select(*raster.PIXEL, "label", F.lit(False).alias("open")).unionByName(opened.select(*raster.PIXEL, "label", F.lit(True).alias("open")))
    return _rows(both.groupBy(*raster.PIXEL, "label").agg(F.max("open").alias("open")), None, meta)


def opened_overlaps(pixels: DataFrame, height: int, width: int, meta: DataFrame | None = None) -> DataFrame:
    """``overlap_table`` with the 3 x 3 opening of every label, found in the same pass."""
    return _rows(pixels, (height, width), meta)


class StrictTracker:
    """State of one sequence: who owns which segment of the last frame, who was just lost, the largest id."""

    def __init__(self, state: dict | None = None):
        state = state or {}
        self.owners: dict[int, tuple[int, str]] = state.get("owners", {})
        self.memory: dict[int, tuple[int, str]] = state.get("memory", {})
        self.top: int = state.get("top", 0)
        self.started: bool = state.get("started", False)

    def step(self, segments: Iterable[int], opened: Iterable[int], overlaps: Iterable[dict]) -> dict[int, int]:
        """Segment to track id for one frame."""
        segments, opened = list(segments), set(opened)
        counts: dict[tuple[int, str, int], list[tuple[int, int]]] = {}
        for o in overlaps:
            counts.setdefault((o["lag"], o["kind"], o["prev"]), []).append((o["label"], o["n"]))
        if not self.started or (not self.owners and not self.memory):  # no history: ids are the segments' labels
            given = {s: s for s in segments}
            if not self.started or self.top == 0:
                self.top = max(segments, default=0)
            self.started = True
            self.memory = {}
            self.owners = {t: (s, "whole") for s, t in given.items()}
            return given
        claimed: dict[int, int] = {}
        for track in sorted({*self.owners, *self.memory}):
            if track in self.memory:  # its one retry: every segment is open to it, claimed or not
                segment, kind = self.memory[track]
                found = counts.get((2, kind, segment), [])
            else:
                segment, kind = self.owners[track]
                found = [x for x in counts.get((1, kind, segment), []) if x[0] not in claimed]
            if found:
                best = min(found, key=lambda x: (-x[1], x[0]))[0]
                claimed[best] = track
        holders = {t: (s, "whole") for s, t in claimed.items()}
        self.memory = {t: v for t, v in self.owners.items() if t not in holders}
        for s in sorted(set(segments) - set(claimed)):
            if s in opened:
                self.top += 1
                claimed[s] = self.top
                holders[self.top] = (s, "open")
        self.owners = holders
        return claimed


def track_sequence(group: pd.DataFrame) -> pd.DataFrame:
    """Run one sequence's frames in order."""
    tracker, out = StrictTracker(), []
    for r in group.sort_values("frame").itertuples():
        given = tracker.step(*([] if x is None else x for x in (r.segments, r.opened, r.overlaps)))
        out += [(r.seq, r.frame, s, t) for s, t in sorted(given.items())]
    return pd.DataFrame(out, columns=["seq", "frame", "label", "track"])


def strict_tracks(pixels: DataFrame, height: int, width: int, meta: DataFrame | None = None) -> DataFrame:
    """(seq, frame, label, track): the id of every tracked segment [O-56, O-57, O-110, O-111, O-112, O-125, O-140, O-142].

    A new object owns only what is left of its segment after opening; a segment that opens to
    nothing is not tracked when new. A lost id is kept for one missing frame.
    """
    return opened_overlaps(pixels, height, width, meta).groupBy("seq").applyInPandas(track_sequence, ASSIGNED)
