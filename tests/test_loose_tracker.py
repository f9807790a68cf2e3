"""Shapes and the loose tracker against plain rules on sets of pixels."""

from __future__ import annotations

import collections
import dataclasses
import math

import numpy as np
import pytest

from tessera.operators import loose_tracker, shapes

PIXELS = "seq string, frame int, y int, x int, label int"
EIGHT = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]


class Sets:
    """The same rules pixel by pixel on Python sets; counts which branches a run enters."""

    def __init__(self, h, w, rules):
        self.h, self.w, self.r, self.met = h, w, rules, collections.Counter()
        self.memory, self.top, self.prev = {}, 0, None

    def inside(self, p):
        return 0 <= p[0] < self.h and 0 <= p[1] < self.w

    def square(self, p, k):
        r = k // 2
        return [q for dy in range(-r, r + 1) for dx in range(-r, r + 1) if self.inside(q := (p[0] + dy, p[1] + dx))]

    def erode(self, s, k):
        return {p for p in s if all(q in s for q in self.square(p, k))}

    def dilate(self, s, k):
        return {q for p in s for q in self.square(p, k)}

    def open(self, s):
        return self.dilate(self.erode(s, 3), 3)

    def parts(self, s):
        out, todo = [], set(s)
        for p in sorted(s):
            if p in todo:
                part, stack = set(), [p]
                todo.discard(p)
                while stack:
                    y, x = stack.pop()
                    part.add((y, x))
                    for dy, dx in EIGHT:
                        q = (y + dy, x + dx)
                        if q in todo:
                            todo.discard(q)
                            stack.append(q)
                out.append(part)
        return out

    @staticmethod
    def thin(s):
        s = set(s)
        while True:
            before = len(s)
            for first in (True, False):
                gone = set()
                for y, x in s:
                    ring = [(y - 1, x) in s, (y - 1, x + 1) in s, (y, x + 1) in s, (y + 1, x + 1) in s, (y + 1, x) in s, (y + 1, x - 1) in s, (y, x - 1) in s, (y - 1, x - 1) in s]
                    rises = sum(not a and b for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
                    n, e, so, w = ring[0], ring[2], ring[4], ring[6]
                    blocked = (n and e and so) or (e and so and w) if first else (n and e and w) or (n and so and w)
                    if 2 <= sum(ring) <= 6 and rises == 1 and not blocked:
                        gone.add((y, x))
                s -= gone
            if len(s) == before:
                return s

    @staticmethod
    def around(s, p):
        return sum((p[0] + dy, p[1] + dx) in s for dy, dx in EIGHT)

    def line(self, part):
        n = len(part)
        my, mx = sum(p[0] for p in part) / n, sum(p[1] for p in part) / n
        vy, vx, c = (sum(f(p) for p in part) for f in (lambda p: (p[0] - my) ** 2, lambda p: (p[1] - mx) ** 2, lambda p: (p[0] - my) * (p[1] - mx)))
        angle = -math.pi / 4 if abs(vy - vx) < 1e-9 and abs(c) < 1e-9 else 0.5 * math.atan2(2 * c, vy - vx)
        r = self.r.line // 2
        return {
            (dy, dx)
            for dy in range(-r, r + 1)
            for dx in range(-r, r + 1)
            if -0.5 <= math.cos(angle) * dy + math.sin(angle) * dx < 0.5 and abs(math.cos(angle) * dx - math.sin(angle) * dy) <= r + 1e-9
        }

    def step(self, seg):
        r = self.r
        if self.prev is None:
            self.prev, self.top = dict(seg), max(seg.values(), default=0)
        held = set(self.prev.values())
        if not held and not self.memory:
            if self.top == 0:
                self.top = max(seg.values(), default=0)
            self.prev = dict(seg)
            return self.prev
        free = {p: v for p, v in seg.items() if p in self.prev}
        left, now = dict(seg), {}
        for t in sorted(held | set(self.memory.values())):
            lost = t not in held
            own = {p for p, v in (self.memory if lost else self.prev).items() if v == t}
            under = {p: v for p, v in (seg if lost else free).items() if p in own}
            if not under:
                continue
            if lost and len(under) / len(own) < r.memory_share:
                self.met["memory too little"] += 1
                continue
            share = {k: n / len(under) for k, n in collections.Counter(under.values()).items()}
            chosen = [k for k, x in share.items() if x >= r.good_share]
            if not chosen:
                self.met["least share"] += 1
                chosen = [k for k, x in share.items() if x >= r.least_share]
            took = set().union(*[self.open({p for p, v in left.items() if v == k}) for k in chosen])
            now.update(dict.fromkeys(took, t))
            if lost:
                self.met["memory"] += 1
                self.memory = {p: v for p, v in self.memory.items() if v != t}
            mine = {p for p, v in now.items() if v == t}
            ratio = len(own) / len(mine) if mine else 0
            core = self.erode(own, r.core)
            if ratio <= r.grown and core:
                took = self.grown(own, mine, took, core, now)
            elif ratio >= r.shrunk:
                took = self.shrunk(t, own, under, now, left, free)
            now.update(dict.fromkeys(took, t))
            for p in took:
                free.pop(p, None)
                left.pop(p, None)
        for p, v in self.prev.items():
            if v not in set(now.values()):
                self.memory[p] = v
        born = {p: v for p, v in seg.items() if p not in now}
        for k in sorted(set(born.values())):
            kept = self.open({p for p, v in born.items() if v == k})
            if kept:
                self.top += 1
                now.update(dict.fromkeys(kept, self.top))
        self.prev = now
        return now

    def grown(self, own, mine, took, core, now):
        axis = self.thin(core)
        tips = self.parts(self.dilate({p for p in axis if self.around(axis, p) == 1}, self.r.end_box) & axis)
        hits = collections.Counter()
        for tip in tips:
            line = self.line(tip)
            hits.update({(y + dy, x + dx) for y, x in tip for dy, dx in line})
        extra = mine - own
        parts = self.parts(self.open(extra))
        named = {n * hits[p] for n, part in enumerate(parts, 1) for p in part if hits[p]}
        if named:
            self.met["grown, hit"] += 1
            apart = set().union(*[part for n, part in enumerate(parts, 1) if n not in named or len(part) > self.r.large_part])
            for p in apart:
                now.pop(p, None)
            self.met["grown, part freed"] += bool(apart)
            low, high = self.r.rest_parts
            return own.union(*[x for x in self.parts(extra - apart) if low <= len(x) <= high])
        large = [x for x in parts if len(x) >= self.r.large_part]
        if not large:
            self.met["grown, as it is"] += 1
            return took
        self.met["grown, large"] += 1
        kept = set().union(*[x for x in parts if len(x) < self.r.large_part])
        for p in set().union(*large):
            now.pop(p, None)
        rest = extra - kept
        low, high = self.r.whole_parts
        return set().union(*[x for x in self.parts(own | kept | (rest - self.open(rest))) if low <= len(x) <= high])

    def shrunk(self, t, own, under, now, left, free):
        if not self.r.repair_shrunk or len(under) / len(own) <= self.r.covered:
            self.met["shrunk, unclaimed"] += 1
            return set()
        core = self.erode(own, 3)
        along = {free[p] for p in self.thin(core) if p in free} or {free[p] for p in core if p in free}
        gathered = set()
        for k in along:
            whole, part = self.open({p for p, v in left.items() if v == k}), {p for p, v in under.items() if v == k}
            if part and len(whole) / len(own) < self.r.segment_of_object and len(whole) / len(part) < self.r.segment_of_overlap:
                gathered |= whole
            elif part and len(whole) / len(part) > self.r.segment_of_overlap:
                gathered |= part
        if not gathered:
            self.met["shrunk, nothing along"] += 1
            return self.open({p for p in own if now.get(p) == t})
        self.met["shrunk, gathered"] += 1

        def branches(s):
            bones = self.thin(s)
            return {under[p] for p in self.dilate({p for p in bones if self.around(bones, p) > 2}, 3) if p in under}

        new = branches(gathered) - branches(own)
        self.met["shrunk, branch left out"] += bool(new)
        return self.open({p for p in gathered if under.get(p) not in new})


SMALL = loose_tracker.Rules(core=5, end_box=9, line=21, large_part=12, rest_parts=(4, 200), whole_parts=(3, 10_000))


def scene(rng, h, w, frames):
    """Bars and blobs that move, grow, shrink, break, meet and vanish."""
    out = []
    things = [(rng.integers(0, h), rng.integers(0, w), rng.integers(3, 9), rng.integers(3, 16), rng.random() < 0.5) for _ in range(rng.integers(3, 8))]
    for _ in range(frames):
        m = np.zeros((h, w), np.int64)
        for k, (y, x, a, b, flip) in enumerate(things, 1):
            if rng.random() < 0.15:
                continue
            a2, b2 = max(2, int(a * rng.choice([0.6, 1, 1, 1, 1.6]))), max(2, int(b * rng.choice([0.5, 1, 1, 1, 2.2])))
            y2, x2 = y + rng.integers(-2, 3), x + rng.integers(-2, 3)
            dy, dx = (b2, a2) if flip else (a2, b2)
            m[max(0, y2) : max(0, y2 + dy), max(0, x2) : max(0, x2 + dx)] = k
            if rng.random() < 0.3:  # broken in two
                m[max(0, y2) : max(0, y2 + dy), max(0, x2 + dx // 2) : max(0, x2 + dx)] *= np.where(m[max(0, y2) : max(0, y2 + dy), max(0, x2 + dx // 2) : max(0, x2 + dx)] == k, 0, 1)
                m[max(0, y2) : max(0, y2 + dy), max(0, x2 + dx // 2 + 1) : max(0, x2 + dx)] = k + 20
        m[rng.random((h, w)) < 0.01] = 0
        out.append(m)
    return out


def as_dict(m):
    return {(int(y), int(x)): int(m[y, x]) for y, x in zip(*np.nonzero(m), strict=True)}


def compare(seeds, rules, h=40, w=44, frames=7, make=scene):
    met = collections.Counter()
    for seed in seeds:
        rng = np.random.default_rng(seed)
        fast, slow = loose_tracker.LooseTracker(h, w, rules), Sets(h, w, rules)
        for f, m in enumerate(make(rng, h, w, frames)):
            assert as_dict(fast.step(m)) == slow.step(as_dict(m)), (seed, f)
        met += slow.met
    return met


def test_tracker_equals_sets_in_every_branch():
    met = compare(range(120), SMALL)
    met += compare(range(200, 320), dataclasses.replace(SMALL, repair_shrunk=True, covered=0.6, shrunk=1.02))
    wanted = {"memory", "memory too little", "least share", "grown, hit", "grown, part freed", "grown, as it is", "grown, large", "shrunk, unclaimed", "shrunk, gathered", "shrunk, nothing along", "shrunk, branch left out"}
    assert wanted <= {k for k, n in met.items() if n}, met


def test_tracker_with_the_rules_as_they_are():
    """A thick bar that grows by large parts at its tip, beside it, and by small ones."""

    def growing(rng, h, w, frames):
        out = []
        for f in range(frames):
            m = np.zeros((h, w), np.int64)
            m[40:60, 30:70] = 1
            if f % 3 == 1:
                m[20:60, 70:115] = 1
            if f % 3 == 2:
                m[60:120, 35:60] = 1
            m[5:15, 5:25] = 2
            out.append(m)
        return out

    met = compare([0], loose_tracker.Rules(), 130, 130, 6, growing)
    assert sum(n for k, n in met.items() if k.startswith("grown")) >= 2


def test_tracked_pixels_of_many_sequences(spark):
    rows, want = [], {}
    meta = []
    for s in range(3):
        rng, slow = np.random.default_rng(50 + s), Sets(40, 44, SMALL)
        for f, m in enumerate([*scene(rng, 40, 44, 5), np.zeros((40, 44), np.int64), *scene(rng, 40, 44, 2)]):
            rows += [(f"0{s}", f, y, x, v) for (y, x), v in as_dict(m).items()]
            meta.append((f"0{s}", f))
            want |= {(f"0{s}", f, y, x): v for (y, x), v in slow.step(as_dict(m)).items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = loose_tracker.loose_tracks(spark.createDataFrame(rows, PIXELS), 40, 44, spark.createDataFrame(meta, "seq string, frame int"), SMALL).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.seq, r.frame, r.y, r.x): r.label for r in got} == want
    assert loose_tracker.loose_tracks(spark.createDataFrame([], PIXELS), 4, 4).count() == 0


# shapes


@pytest.mark.parametrize("seed", range(6))
def test_shapes_equal_plain_rules(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(5, 40, 2)
    mask = rng.random((h, w)) < rng.choice([0.2, 0.5, 0.8, 0.97])
    for _ in range(4):  # blobs
        y, x = rng.integers(0, h), rng.integers(0, w)
        mask[y : y + 9, x : x + 12] = rng.random() < 0.8
    sets, s = Sets(h, w, SMALL), set(as_dict(mask))
    bones = shapes.skeleton(mask)
    assert set(as_dict(bones)) == sets.thin(s)
    assert set(as_dict(shapes.endpoints(bones))) == {p for p in sets.thin(s) if sets.around(sets.thin(s), p) == 1}
    assert set(as_dict(shapes.branch_points(bones))) == {p for p in sets.thin(s) if sets.around(sets.thin(s), p) > 2}
    for k in (3, 9, 27):
        assert set(as_dict(shapes.box(mask, k, grow=True))) == sets.dilate(s, k)
        assert set(as_dict(shapes.box(mask, k, grow=False))) == sets.erode(s, k)
    numbered = shapes.parts(mask)
    assert [set(as_dict(numbered == i)) for i in range(1, numbered.max() + 1)] == sets.parts(s)


@pytest.mark.parametrize("degrees", [0, 7, 30, 45, 60, 90, -45, -80, 133])
def test_line_of_81_at_any_angle(degrees):
    angle = math.radians(degrees)
    got = set(map(tuple, shapes.line_element(81, angle).tolist()))
    want = {(y, x) for y in range(-40, 41) for x in range(-40, 41) if math.floor(math.cos(angle) * y + math.sin(angle) * x + 0.5) == 0 and abs(math.cos(angle) * x - math.sin(angle) * y) <= 40 + 1e-9}
    assert got == want and len(got) >= 57 and (0, 0) in got
    one = np.zeros((100, 90), bool)
    one[50, 45] = one[3, 4] = True
    moved = {(y + dy, x + dx) for y, x in ((50, 45), (3, 4)) for dy, dx in want}
    assert set(as_dict(shapes.dilated_by(one, shapes.line_element(81, angle)))) == {p for p in moved if 0 <= p[0] < 100 and 0 <= p[1] < 90}
