"""The tracker that looks inside segments: shares of overlap, and two repairs by the change of an object's area.

One frame after another per sequence: a task streams pixel rows in frame order and holds the ids of the last frame, the pixels of
lost ids and the frame at hand, never more. Ids take over segments in ascending order. An object covers a
segment's opened part when enough of what it covers belongs to that segment. An object that would grow much is cut back to its
old pixels and what is left around them (``grown``); one that would shrink much though still covered takes the segments along its
axis (``shrunk``). A lost id stays in memory until a segment covers a quarter of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shapes

TRACKED = "seq string, frame int, y int, x int, label int"


@dataclass(frozen=True)
class Rules:
    """Shares, area ratios and part sizes of the rule, in pixels."""

    memory_share: float = 0.25
    good_share: float = 0.35
    least_share: float = 0.10
    grown: float = 0.80
    shrunk: float = 1.1
    covered: float = 0.9
    core: int = 9
    end_box: int = 27
    line: int = 81
    large_part: int = 1000
    rest_parts: tuple[int, int] = (80, 10_000)
    whole_parts: tuple[int, int] = (20, 10_000_000)
    segment_of_object: float = 0.9
    segment_of_overlap: float = 1.5
    #: Off: an object that shrinks keeps what it got and claims nothing, as established results have it.
    repair_shrunk: bool = False


def _boxes(labels: np.ndarray) -> dict[int, tuple[int, int, int, int]]:
    """Top, left, bottom, right (exclusive) of every label."""
    y, x = np.nonzero(labels)
    v = labels[y, x]
    order = np.argsort(v, kind="stable")
    v, y, x = v[order], y[order], x[order]
    first = np.flatnonzero(np.append(True, v[1:] != v[:-1])) if len(v) else np.zeros(0, np.int64)
    if not len(first):
        return {}
    low = [np.minimum.reduceat(a, first).tolist() for a in (y, x)]
    high = [(np.maximum.reduceat(a, first) + 1).tolist() for a in (y, x)]
    return {k: (t, left, b, r) for k, t, left, b, r in zip(v[first].tolist(), *low, *high, strict=True)}


class LooseTracker:
    """State of one sequence: ids of the last frame, pixels of lost ids, the largest id."""

    def __init__(self, height: int, width: int, rules: Rules = Rules()):
        self.shape, self.rules = (height, width), rules
        self.last: np.ndarray | None = None
        self.memory = np.zeros(self.shape, np.int64)
        self.top = 0

    def step(self, segments: np.ndarray) -> np.ndarray:
        """Ids of one frame's pixels; the first frame is matched with itself."""
        if self.last is None:
            self.last, self.top = segments.copy(), int(segments.max(initial=0))
            first = True
        else:
            first = False
        held, lost = _boxes(self.last), _boxes(self.memory)
        if not held and not lost:
            if first or self.top == 0:
                self.top = int(segments.max(initial=0))
            self.last = segments.copy()
            return self.last
        self.segments, self.where = segments, _boxes(segments)
        self.now = np.zeros(self.shape, np.int64)
        self.free = np.where(self.last > 0, segments, 0)  # segments where the last frame had an id, less what is claimed
        self.left = segments.copy()  # segments less what is claimed
        for track in sorted({*held, *lost}):
            self._claim(track, held.get(track), lost.get(track))
        still = np.unique(self.now)
        gone = [t for t in held if t not in set(still.tolist())]
        if gone:
            at = np.isin(self.last, gone)
            self.memory[at] = self.last[at]
        self._newborn()
        self.last = self.now
        return self.now

    def _newborn(self) -> None:
        """What no id holds, opened, is a new object for each segment."""
        rest = np.where(self.now == 0, self.segments, 0)
        for label, place in sorted(_boxes(rest).items()):
            view = self._view(place)
            kept = shapes.opened(rest[view] == label)
            if kept.any():
                self.top += 1
                self.now[view][kept] = self.top

    def _view(self, *places: tuple[int, int, int, int]) -> tuple[slice, slice]:
        """A window around boxes, with room for the widest erosion."""
        room = self.rules.core // 2 + 1
        top, left = (max(0, min(p[i] for p in places) - room) for i in (0, 1))
        bottom, right = (min(n, max(p[i] for p in places) + room) for i, n in ((2, self.shape[0]), (3, self.shape[1])))
        return slice(top, bottom), slice(left, right)

    def _claim(self, track: int, held: tuple[int, int, int, int] | None, lost: tuple[int, int, int, int] | None) -> None:
        """Give one id its pixels of this frame."""
        rules, remembered = self.rules, held is None
        source, sight = (self.memory, self.segments) if remembered else (self.last, self.free)
        place = lost if remembered else held
        view = self._view(place)
        own = source[view] == track
        under = np.where(own, sight[view], 0)
        labels, counts = np.unique(under[under > 0], return_counts=True)
        if not len(labels) or (remembered and counts.sum() / own.sum() < rules.memory_share):
            return
        share = counts / counts.sum()
        chosen = labels[share >= rules.good_share]
        if not len(chosen):
            chosen = labels[share >= rules.least_share]
        view = self._view(place, *[self.where[k] for k in labels.tolist()])
        own = source[view] == track
        under = np.where(own, sight[view], 0)
        now, left = self.now[view], self.left[view]
        took = np.zeros(own.shape, bool)
        for k in chosen.tolist():
            took |= shapes.opened(left == k)
        now[took] = track
        if remembered:
            self.memory[self.memory == track] = 0
        mine = now == track
        ratio = own.sum() / mine.sum() if mine.any() else 0.0
        if ratio <= rules.grown and (core := shapes.box(own, rules.core, grow=False)).any():
            took = self._grown(own, mine, took, core, now)
        elif ratio >= rules.shrunk:
            took = self._shrunk(track, own, under, now, left, self.free[view])
        now[took] = track
        self.free[view][took] = 0
        left[took] = 0

    def _grown(self, own: np.ndarray, mine: np.ndarray, took: np.ndarray, core: np.ndarray, now: np.ndarray) -> np.ndarray:
        """Pixels of an object that would grow too much; large parts that it must not take are freed in ``now``."""
        rules = self.rules
        axis = shapes.skeleton(core)
        tips = shapes.parts(shapes.box(shapes.endpoints(axis), rules.end_box, grow=True) & axis)
        hits = np.zeros(own.shape, np.int64)
        for n in range(1, int(tips.max(initial=0)) + 1):
            tip = tips == n
            hits += shapes.dilated_by(tip, shapes.line_element(rules.line, shapes.angle_of(*np.nonzero(tip))))
        extra = mine & ~own
        grown = shapes.parts(shapes.opened(extra))
        size = shapes.sizes(grown)
        # the rule names a hit part by its number times the lines that cross it
        named = [k for k in np.unique(hits * grown).tolist() if k]
        if named:
            small = [k for k in named if k >= len(size) or size[k] <= rules.large_part]
            apart = (grown > 0) & ~np.isin(grown, small)
            now[apart] = 0
            rest = shapes.parts(extra & ~apart)
            n = shapes.sizes(rest)
            low, high = rules.rest_parts
            return own | ((rest > 0) & ((n >= low) & (n <= high))[rest])
        large = np.flatnonzero(size >= rules.large_part)
        large = large[large > 0]
        if not len(large):
            return took
        now[np.isin(grown, large)] = 0
        kept = (grown > 0) & ~np.isin(grown, large)
        rest = extra & ~kept
        joined = shapes.parts(own | kept | (rest & ~shapes.opened(rest)))
        n = shapes.sizes(joined)
        low, high = rules.whole_parts
        return (joined > 0) & ((n >= low) & (n <= high))[joined]

    def _shrunk(self, track: int, own: np.ndarray, under: np.ndarray, now: np.ndarray, left: np.ndarray, free: np.ndarray) -> np.ndarray:
        """Pixels of an object that would shrink too much though segments cover it."""
        rules, area = self.rules, int(own.sum())
        nothing = np.zeros(own.shape, bool)
        if not rules.repair_shrunk or (under > 0).sum() / area <= rules.covered:
            return nothing
        core = shapes.box(own, 3, grow=False)
        along = free[shapes.skeleton(core)]
        if not (along > 0).any():
            along = free[core]
        gathered = nothing.copy()
        for k in np.unique(along[along > 0]).tolist():
            whole, part = shapes.opened(left == k), under == k
            n, m = int(whole.sum()), int(part.sum())
            if not m:
                continue
            if n / area < rules.segment_of_object and n / m < rules.segment_of_overlap:
                gathered |= whole
            elif n / m > rules.segment_of_overlap:
                gathered |= part
        if not gathered.any():
            return shapes.opened(own & (now == track))

        def at_branches(mask: np.ndarray) -> np.ndarray:
            near = shapes.box(shapes.branch_points(shapes.skeleton(mask)), 3, grow=True)
            return np.unique(under[near & (under > 0)])

        new = np.setdiff1d(at_branches(gathered), at_branches(own))  # branches that the old shape didn't have [O-127]
        return shapes.opened(gathered & ~np.isin(under, new))


def _frames(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one frame at a time, of batches in order of (seq, frame)."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        key = batch["seq"].ne(batch["seq"].shift()) | batch["frame"].ne(batch["frame"].shift())
        cuts = [*np.flatnonzero(key.to_numpy()).tolist(), len(batch)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.iloc[a:b]
            if held and (held[0]["seq"].iloc[0], held[0]["frame"].iloc[0]) != (part["seq"].iloc[0], part["frame"].iloc[0]):
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def loose_tracks(pixels: DataFrame, height: int, width: int, meta: DataFrame | None = None, rules: Rules = Rules()) -> DataFrame:
    """(seq, frame, y, x, label): tracked pixels; label is the track [O-125, O-127, O-130, O-131, O-132, O-141].

    ``meta`` (seq, frame) names every frame, so that empty ones count (without it only frames with pixels do). Pixels of
    a track may lie outside all segments: an object that is cut back keeps its old pixels. Frames of a sequence run in order in one task,
    which holds three of them at most; other sequences run elsewhere. Empty tables give none.
    """
    rows = pixels.select("seq", F.col("frame").cast("int").alias("frame"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("label").cast("int").alias("label"))
    if meta is not None:
        nowhere = F.lit(-1)
        rows = rows.unionByName(meta.select("seq", F.col("frame").cast("int").alias("frame"), nowhere.alias("y"), nowhere.alias("x"), F.lit(0).alias("label")).distinct())

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, tracker = object(), None
        for frame in _frames(batches):
            if frame["seq"].iloc[0] != seq:
                seq, tracker = frame["seq"].iloc[0], LooseTracker(height, width, rules)
            at = frame["y"].to_numpy() >= 0
            segments = np.zeros((height, width), np.int64)
            segments[frame["y"].to_numpy()[at], frame["x"].to_numpy()[at]] = frame["label"].to_numpy()[at]
            ids = tracker.step(segments)
            y, x = np.nonzero(ids)
            yield pd.DataFrame({"seq": seq, "frame": frame["frame"].iloc[0], "y": y, "x": x, "label": ids[y, x]})

    return rows.repartition("seq").sortWithinPartitions("seq", "frame", "y", "x").mapInPandas(run, TRACKED)
