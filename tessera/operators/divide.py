"""Division normalisation: a mother ends where her daughters begin.

Pixels never move; only labels are renamed from a frame on. So the state of a sequence is a map from
raw labels to ids, its parents and cooldowns, and what it needs of a frame are contact counts between raw labels.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frame_tables import FrameTable, frame_tables, owned
from .tracks import CAPACITY

MIN_PIXELS, MIN_RATIO = 10, 0.05
OUTPUT = "seq string, kind string, frame int, label int, id int"


class Divider:
    """One sequence: renames raw labels so that divisions follow the rules; collects parents.

    ``rule`` 'base': any object that doesn't go on from itself looks for a mother; a mother that is
    still there is renamed and counts as a daughter, otherwise two children are needed. 'legacy':
    only newborn objects look for one, and she must still be there.
    """

    def __init__(self, top: int, cooldown: int = 20, rule: str = "base", capacity: int = CAPACITY):
        if cooldown < 0:
            raise ValueError("cooldown can't be negative")
        self.top, self.cooldown, self.rule, self.capacity = top, cooldown, rule, capacity
        self.names: dict[int, int] = {}
        self.parents: dict[int, int] = {}
        self.until: dict[int, int] = {}
        self.last: dict[int, int] = {}

    def rows(self, seq: str) -> list[tuple]:
        """Parents and cooldowns at the end of the sequence."""
        return [(seq, "parent", None, c, p) for c, p in self.parents.items()] + [(seq, "cooldown", end, c, None) for c, end in self.until.items()]

    def _ids(self, table: FrameTable) -> dict[int, int]:
        return {k: self.names.get(k, k) for k in table.objects}

    def _rename(self, old: int, new: int) -> None:
        """From here on every raw label that goes by ``old`` goes by ``new``."""
        self.names = {r: new if i == old else i for r, i in self.names.items()}
        if old not in self.names:
            self.names[old] = new

    def _fresh(self) -> int:
        self.top += 1
        if self.top > self.capacity:
            raise ValueError("ids exceed the label capacity")
        return self.top

    def step(self, frame: int, table: FrameTable) -> dict[int, int]:
        """The id of every object of the frame."""
        if self.last:
            self._divide(frame, owned(self.last), table)
        self.last = self._ids(table)
        return self.last

    def _divide(self, frame: int, prev: dict[int, set[int]], table: FrameTable) -> None:
        now = owned(self._ids(table))
        before = {label: i for i, labels in prev.items() for label in labels}
        guarded = {t for t, end in self.until.items() if frame <= end} if self.cooldown else set()
        born = sorted(set(now) - set(prev))
        if guarded and born:
            taken: set[int] = set()
            for t in sorted(guarded & set(prev)):
                if t in now and t not in taken:
                    continue
                near = [b for b in born if b not in taken and table.near(now[b], prev[t])]
                if len(near) == 1:
                    self._rename(near[0], t)
                    taken.add(near[0])
            now = owned(self._ids(table))
            born = sorted(set(now) - set(prev))
        mothers: dict[int, list[int]] = {}
        for child in born if self.rule == "legacy" else sorted(now):
            size = table.size(now[child])
            if child in prev:
                stay = table.near(now[child], prev[child])
                if stay >= MIN_PIXELS and stay / size >= MIN_RATIO:
                    continue
            touch: dict[int, int] = {}
            for label, n in table.under(now[child]).items():
                touch[before[label]] = touch.get(before[label], 0) + n
            allowed = [(-n, t) for t, n in touch.items() if t != child and t not in guarded]
            if allowed and -min(allowed)[0] >= MIN_PIXELS and -min(allowed)[0] / size >= MIN_RATIO:
                mothers.setdefault(min(allowed)[1], []).append(child)
        present = set(now)
        for mother in sorted(mothers):
            daughters = []
            if mother in present:
                daughters.append(self._fresh())
                self._rename(mother, daughters[0])
                present = present - {mother} | {daughters[0]}
            elif self.rule == "legacy" or len(mothers[mother]) < 2:
                continue
            for child in mothers[mother]:
                daughter = child
                if child not in born:
                    daughter = self._fresh()
                    self._rename(child, daughter)
                    present = present - {child} | {daughter}
                daughters.append(daughter)
            for d in daughters:
                self.parents[d] = mother
                if self.cooldown:
                    self.until[d] = frame + self.cooldown


def normalise_divisions(pixels: DataFrame, cooldown: int = 20, rule: str = "base") -> DataFrame:
    """(seq, kind, frame, label, id): kind 'object' gives the id of each raw object, 'parent' the parent (id) of a track (label),
    'cooldown' the last frame (frame) in which a daughter (label) is guarded.

    [O-60, O-74, O-113, O-143, O-144]. Contacts are counted in parallel (``frame_tables``); a task runs through the
    small rows of its sequences frame by frame and never sees a pixel.
    """
    top = pixels.groupBy("seq").agg(F.max("label").alias("top"))
    frames = frame_tables(pixels).drop("inter").join(top, "seq")
    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq, divider, at = None, None, -1
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.seq != seq:
                    if divider is not None:
                        out += divider.rows(seq)
                    seq, divider, at = r.seq, Divider(int(r.top), cooldown, rule), -1
                if r.frame != at + 1:  # blank frames between: nothing to go on from
                    divider.last = {}
                ids = divider.step(int(r.frame), FrameTable(r.objects, r.touched, r.touching))
                at = r.frame
                out += [(seq, "object", r.frame, a, b) for a, b in sorted(ids.items())]
            yield pd.DataFrame(out, columns=["seq", "kind", "frame", "label", "id"]).astype({"frame": "Int32", "label": "Int32", "id": "Int32"})
        if divider is not None:
            yield pd.DataFrame(divider.rows(seq), columns=["seq", "kind", "frame", "label", "id"]).astype({"frame": "Int32", "label": "Int32", "id": "Int32"})

    return frames.repartition(n, "seq").sortWithinPartitions("seq", "frame").mapInPandas(run, OUTPUT)
