"""Identity rescue: a track that is lost takes over a newborn that looks like its continuation."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import written_once

from .divide import normalise_divisions
from .frame_tables import FrameTable, frame_tables, owned

OUTPUT = "seq string, kind string, frame int, label int, id int, event string, score double, second double"


def confidence(lost: set[int], last: FrameTable, found: set[int], now: FrameTable, gap: int, cooling: bool, reach: float) -> float:
    """Contact, IoU, centroid distance (more drift per gap frame) and size of two ids, by the labels that they own [O-146]."""
    a, b = last.size(lost), now.size(found)
    big, small = max(a, b), min(a, b)
    touch, both = now.near(found, lost, gap) / big, now.common(found, lost, gap)
    (ay, ax), (by, bx) = last.centre(lost), now.centre(found)
    near = max(0.0, 1 - math.hypot(ay - by, ax - bx) / (reach * (1 + 0.5 * (gap - 1))))
    score = 0.35 * min(touch, 1.0) + 0.30 * both / (a + b - both) + 0.20 * near + 0.15 * small / big
    return min(score * 1.15, 1.0) if cooling else score


@dataclass
class IdentityRescue:
    """State of one sequence: names of raw labels, newborns already taken, and the audit.

    A lost id is compared with ids that are absent from its last frame, in this and the next
    gap - 1 frames. It takes the best one over from the frame of its loss on, if the score reaches
    the threshold and no other comes within four fifths of it. Ties: the earlier frame, then the
    smaller id.
    """

    gap: int = 1
    threshold: float = 0.3
    reach: float = 50.0
    until: dict[int, int] = field(default_factory=dict)
    excluded: frozenset[int] = frozenset()
    names: dict[int, int] = field(default_factory=dict)
    taken: set[int] = field(default_factory=set)
    audit: list[tuple[int, int, str, float, float]] = field(default_factory=list)

    def ids(self, table: FrameTable) -> dict[int, int]:
        return {k: self.names.get(k, k) for k in table.objects}

    def rename(self, old: int, new: int) -> None:
        self.names = {r: new if i == old else i for r, i in self.names.items()}
        self.names.setdefault(old, new)

    def step(self, frame: int, last: FrameTable, last_ids: dict[int, int], coming: list[FrameTable]) -> None:
        """Decide for everything lost at ``frame``; ``coming`` are this frame and the ones to look ahead to."""
        prev = owned(last_ids)
        for lost in sorted(set(prev) - set(self.ids(coming[0]).values())):
            if lost in self.excluded:
                self.audit.append((frame, lost, "skip_excluded_parent", 0.0, 0.0))
                continue
            cooling = frame <= self.until.get(lost, -1)
            scores = []
            for k, table in enumerate(coming[: self.gap], 1):
                now = owned(self.ids(table))
                fresh = sorted(set(now) - set(prev) - self.taken)
                scores += [(-confidence(prev[lost], last, now[i], table, k, cooling, self.reach), k, i) for i in fresh]
            scores.sort()
            first, second = (-s[0] for s in (scores + [(0.0, 0, 0)] * 2)[:2])
            if not scores or first <= 0 or first < self.threshold:
                event = "skip_no_candidate"
            elif second >= 0.8 * first and second >= self.threshold:
                event = "skip_ambiguous"
            else:
                event = "rescued"
                self.rename(scores[0][2], lost)
                self.taken.add(scores[0][2])
            self.audit.append((frame, lost, event, first, second))


def rescue_identities(pixels: DataFrame, gap: int = 1, threshold: float = 0.3, reach: float = 50.0, history: DataFrame | None = None) -> DataFrame:
    """(seq, kind, frame, label, id, event, score, second) [O-95, O-119, O-147].

    kind 'object': the id of each raw object; 'audit': what became of a lost id. A task runs through the small rows of its
    sequences (``frame_tables``) in frame order, holds those of gap + 1 frames and never sees a pixel. A gap of 0 changes nothing. ``history``: rows of
    ``normalise_divisions``; its cooldowns raise scores and its mothers are never rescued.
    """
    frames = frame_tables(pixels, max(gap, 1)).drop("touching")
    if history is None:
        frames = frames.withColumns({"guarded": F.array().cast("array<struct<l:int,f:int>>"), "mothers": F.array().cast("array<int>")})
    else:  # at most a row per track of the sequence
        h = history.groupBy("seq").agg(F.collect_list(F.when(F.col("kind") == "cooldown", F.struct(F.col("label").alias("l"), F.col("frame").alias("f")))).alias("guarded"), F.collect_set(F.when(F.col("kind") == "parent", F.col("id"))).alias("mothers"))
        frames = frames.join(h, "seq", "left")
    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def table(out: list[tuple]) -> pd.DataFrame:
        names = ["seq", "kind", "frame", "label", "id", "event", "score", "second"]
        return pd.DataFrame(out, columns=names).astype({"frame": "Int32", "label": "Int32", "id": "Int32", "score": "float64", "second": "float64"})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, state, queue, last, ids = None, None, deque(), FrameTable(), {}
        out: list[tuple] = []

        def advance(at_least: int) -> None:
            nonlocal last, ids
            while len(queue) > at_least:
                frame, table = queue[0]
                if gap:
                    state.step(frame, last, ids, [t for _, t in list(queue)[:gap]])
                queue.popleft()
                last, ids = table, state.ids(table)
                out.extend((seq, "object", frame, a, b, None, None, None) for a, b in sorted(ids.items()))

        def finish() -> None:
            advance(0)
            out.extend((seq, "audit", f, i, None, e, s, t) for f, i, e, s, t in state.audit)

        for batch in batches:
            for r in batch.itertuples():
                if r.seq != seq:
                    if state is not None:
                        finish()
                    until = {int(g["l"]): int(g["f"]) for g in (r.guarded if r.guarded is not None else [])}
                    mothers = frozenset(map(int, r.mothers if r.mothers is not None else []))
                    seq, state, queue, last, ids, at = r.seq, IdentityRescue(gap, threshold, reach, until, mothers), deque(), FrameTable(), {}, None
                for blank in range(at + 1 if at is not None else r.frame, r.frame):
                    queue.append((blank, FrameTable()))
                queue.append((int(r.frame), FrameTable(r.objects, r.touched, (), r.inter)))
                at = int(r.frame)
                advance(max(gap - 1, 0))
            yield table(out)
            out.clear()
        if state is not None:
            finish()
            yield table(out)

    return frames.repartition(n, "seq").sortWithinPartitions("seq", "frame").mapInPandas(run, OUTPUT)


def audit_counts(rows: DataFrame) -> DataFrame:
    """How often each event befell a lost id, per sequence [O-95]."""
    return rows.filter("kind = 'audit'").groupBy("seq", "event").agg(F.count(F.lit(1)).alias("n"))


def _renamed(pixels: DataFrame, rows: DataFrame) -> DataFrame:
    names = rows.filter("kind = 'object'").select("seq", "frame", "label", "id")
    return pixels.join(names, ["seq", "frame", "label"]).select("seq", "frame", "y", "x", F.col("id").alias("label"))


def repair(pixels: DataFrame, cooldown: int = 20, rule: str = "base", gap: int = 1, threshold: float = 0.3, reach: float = 50.0) -> dict[str, DataFrame]:
    """Rescue identities, normalise divisions, and rescue again with the cooldowns and without the mothers [O-148].

    Tables: pixels, parents (seq, label, parent), before and after (audits of both rescues). A gap of 0 leaves both
    rescues out; a sequence without divisions has no second one. Every stage is written once, so that a later stage doesn't
    run an earlier one again.
    """
    first = written_once(rescue_identities(pixels, gap, threshold, reach), "rescue") if gap else None
    named = written_once(_renamed(pixels, first), "rescued") if gap else pixels
    divided = written_once(normalise_divisions(named, cooldown, rule), "divided")
    parents = divided.filter("kind = 'parent'").select("seq", "label", F.col("id").alias("parent"))
    out = written_once(_renamed(named, divided), "divided-pixels")
    last = None
    if gap and cooldown:
        some = divided.filter("kind = 'cooldown'").select("seq").distinct()
        last = written_once(rescue_identities(out.join(some, "seq", "left_semi"), gap, threshold, reach, divided), "rescue")
        out = _renamed(out.join(some, "seq", "left_semi"), last).unionByName(out.join(some, "seq", "left_anti"))
    none = divided.filter("false").select("seq", "frame", "label", F.lit("").alias("event"), F.lit(0.0).alias("score"))
    audits = [none if x is None else x.filter("kind = 'audit'").select("seq", "frame", "label", "event", "score") for x in (first, last)]
    return {"pixels": out, "parents": parents, "before": audits[0], "after": audits[1]}
