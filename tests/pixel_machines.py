"""The division and rescue rules on whole frames of pixels, as brute force for the operators that see small tables only."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

CAPACITY, MIN_PIXELS, MIN_RATIO = 65535, 10, 0.05
WIDE = 1 << 24
_NEAR = np.array([dy * WIDE + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1)], np.int64)


class Frame:
    """Pixel codes of every object of a frame, by id."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        names, first = np.unique(ids[order], return_index=True)
        self.pixels = dict(zip(names.tolist(), np.split(codes[order], first[1:]), strict=True)) if len(names) else {}
        self.codes, self.ids = (codes[o := np.argsort(codes)], ids[o]) if len(codes) else (codes, ids)

    def under(self, codes: np.ndarray) -> np.ndarray:
        """Ids of this frame's pixels among the given codes."""
        if not len(self.codes):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return self.ids[at[self.codes[at] == codes]]


def grown(codes: np.ndarray) -> np.ndarray:
    """Distinct codes within one step."""
    return np.unique((codes[:, None] + _NEAR).ravel())


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
        self.last: tuple[np.ndarray, np.ndarray] | None = None

    def rows(self, seq: str) -> list[tuple]:
        """Parents and cooldowns at the end of the sequence."""
        return [(seq, "parent", None, c, p) for c, p in self.parents.items()] + [(seq, "cooldown", end, c, None) for c, end in self.until.items()]

    def _ids(self, labels: np.ndarray) -> np.ndarray:
        raw, back = np.unique(labels, return_inverse=True)
        return np.array([self.names.get(r, r) for r in raw.tolist()], np.int64)[back] if len(raw) else labels

    def _rename(self, old: int, new: int, labels: Iterable[int]) -> None:
        """From here on every raw label that goes by ``old`` goes by ``new``."""
        self.names = {r: new if i == old else i for r, i in self.names.items()}
        if old not in self.names:
            self.names[old] = new

    def _fresh(self) -> int:
        self.top += 1
        if self.top > self.capacity:
            raise ValueError("ids exceed the label capacity")
        return self.top

    def step(self, frame: int, codes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Ids of the frame's pixels."""
        before = self.last
        if before is not None and len(before[0]):
            self._divide(frame, Frame(*before), codes, labels)
        ids = self._ids(labels)
        self.last = (codes, ids)
        return ids

    def _divide(self, frame: int, prev: Frame, codes: np.ndarray, labels: np.ndarray) -> None:
        now = Frame(codes, self._ids(labels))
        guarded = {t for t, end in self.until.items() if frame <= end} if self.cooldown else set()
        born = sorted(set(now.pixels) - set(prev.pixels))
        if guarded and born:
            taken: set[int] = set()
            for t in sorted(guarded & set(prev.pixels)):
                if t in now.pixels and t not in taken:
                    continue
                reach = grown(prev.pixels[t])
                near = [b for b in born if b not in taken and np.isin(now.pixels[b], reach).any()]
                if len(near) == 1:
                    self._rename(near[0], t, labels)
                    taken.add(near[0])
            now = Frame(codes, self._ids(labels))
            born = sorted(set(now.pixels) - set(prev.pixels))
        mothers: dict[int, list[int]] = {}
        for child in born if self.rule == "legacy" else sorted(now.pixels):
            own = now.pixels[child]
            if child in prev.pixels:
                stay = int(np.isin(own, grown(prev.pixels[child])).sum())
                if stay >= MIN_PIXELS and stay / len(own) >= MIN_RATIO:
                    continue
            names, touch = np.unique(prev.under(grown(own)), return_counts=True)
            allowed = [(-n, t) for t, n in zip(names.tolist(), touch.tolist(), strict=True) if t != child and t not in guarded]
            if allowed and -min(allowed)[0] >= MIN_PIXELS and -min(allowed)[0] / len(own) >= MIN_RATIO:
                mothers.setdefault(min(allowed)[1], []).append(child)
        present = set(now.pixels)
        for mother in sorted(mothers):
            daughters = []
            if mother in present:
                daughters.append(self._fresh())
                self._rename(mother, daughters[0], labels)
                present = present - {mother} | {daughters[0]}
            elif self.rule == "legacy" or len(mothers[mother]) < 2:
                continue
            for child in mothers[mother]:
                daughter = child
                if child not in born:
                    daughter = self._fresh()
                    self._rename(child, daughter, labels)
                    present = present - {child} | {daughter}
                daughters.append(daughter)
            for d in daughters:
                self.parents[d] = mother
                if self.cooldown:
                    self.until[d] = frame + self.cooldown


def confidence(lost: np.ndarray, found: np.ndarray, gap: int, cooling: bool, reach: float) -> float:
    """Contact, IoU, centroid distance (more drift per gap frame) and size, from pixel codes [O-146]."""
    if not len(lost) or not len(found):
        return 0.0
    big, small = max(len(lost), len(found)), min(len(lost), len(found))
    touch = np.isin(found, grown(lost)).sum() / big
    both = len(np.intersect1d(lost, found, assume_unique=True))

    def centre(c: np.ndarray) -> tuple[float, float]:
        return float((c // WIDE).mean()), float((c % WIDE).mean())

    (ay, ax), (by, bx) = centre(lost), centre(found)
    near = max(0.0, 1 - float(np.hypot(ay - by, ax - bx)) / (reach * (1 + 0.5 * (gap - 1))))
    score = 0.35 * min(touch, 1.0) + 0.30 * both / (len(lost) + len(found) - both) + 0.20 * near + 0.15 * small / big
    return float(min(score * 1.15, 1.0) if cooling else score)


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

    def ids(self, labels: np.ndarray) -> np.ndarray:
        raw, back = np.unique(labels, return_inverse=True)
        return np.array([self.names.get(r, r) for r in raw.tolist()], np.int64)[back] if len(raw) else labels

    def rename(self, old: int, new: int) -> None:
        self.names = {r: new if i == old else i for r, i in self.names.items()}
        self.names.setdefault(old, new)

    def step(self, frame: int, before: tuple[np.ndarray, np.ndarray], coming: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Decide for everything lost at ``frame``; ``coming`` are this frame and the ones to look ahead to."""
        prev = Frame(*before)
        for lost in sorted(set(prev.pixels) - set(np.unique(self.ids(coming[0][1])).tolist())):
            if lost in self.excluded:
                self.audit.append((frame, lost, "skip_excluded_parent", 0.0, 0.0))
                continue
            cooling = frame <= self.until.get(lost, -1)
            scores = []
            for k, (codes, labels) in enumerate(coming[: self.gap], 1):
                now = Frame(codes, self.ids(labels))
                fresh = sorted(set(now.pixels) - set(prev.pixels) - self.taken)
                scores += [(-confidence(prev.pixels[lost], now.pixels[i], k, cooling, self.reach), k, i) for i in fresh]
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
