"""Divisions and rescue on small tables against the same rules on whole frames of pixels."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import divide, rescue

from . import pixel_machines

PIXELS = "seq string, frame int, y int, x int, label int"


def scene(rng, frames=9, side=26):
    """Blocks that drift, split, join, vanish and change their label; some labels own several parts."""
    things = [(int(rng.integers(0, 3)) * 9, int(rng.integers(0, 3)) * 9, k + 1) for k in range(5)]
    out, top = [], 5
    for _ in range(frames):
        m = np.zeros((side, side), np.int64)
        if rng.random() < 0.08:
            out.append(m)
            continue
        for i, (y, x, k) in enumerate(things):
            y, x = int(np.clip(y + rng.integers(-1, 2), 0, side - 8)), int(np.clip(x + rng.integers(-1, 2), 0, side - 8))
            draw = rng.random()
            if draw < 0.12:  # lost for a frame
                things[i] = (y, x, k)
                continue
            if draw < 0.24:  # another label from here on
                top += 1
                k = top
            m[y : y + 7, x : x + 7] = k
            if draw > 0.8:  # two halves, one of them new
                top += 1
                m[y : y + 3, x : x + 7] = top
                things.append((y, x, top)) if rng.random() < 0.5 else None
            elif draw > 0.7:  # a part elsewhere
                m[(y + 12) % (side - 3) : (y + 12) % (side - 3) + 3, x : x + 4] = k
            things[i] = (y, x, k)
        out.append(m)
    return out


def coded(m):
    y, x = np.nonzero(m)
    return y * pixel_machines.WIDE + x, m[y, x]


def rows_of(stacks):
    return [(f"{s:02d}", f, int(y), int(x), int(m[y, x])) for s, stack in enumerate(stacks) for f, m in enumerate(stack) for y, x in zip(*np.nonzero(m), strict=True)]


@pytest.mark.parametrize("rule,cooldown", [("base", 2), ("base", 0), ("legacy", 3)])
def test_divisions_equal_pixels(spark, rule, cooldown):
    stacks = [scene(np.random.default_rng(s)) for s in range(12)]
    got = divide.normalise_divisions(spark.createDataFrame(rows_of(stacks), PIXELS), cooldown, rule).collect()
    parents = 0
    for s, stack in enumerate(stacks):
        machine = pixel_machines.Divider(max(int(m.max()) for m in stack), cooldown, rule)
        want = {}
        for f, m in enumerate(stack):
            codes, labels = coded(m)
            if not len(codes):
                machine.last = None
                continue
            ids = machine.step(f, codes, labels)
            want |= {(f, a): b for a, b in set(zip(labels.tolist(), ids.tolist(), strict=True))}
        mine = [r for r in got if r.seq == f"{s:02d}"]
        assert {(r.frame, r.label): r.id for r in mine if r.kind == "object"} == want, s
        assert {r.label: r.id for r in mine if r.kind == "parent"} == machine.parents, s
        assert {r.label: r.frame for r in mine if r.kind == "cooldown"} == machine.until, s
        parents += len(machine.parents)
    assert parents > 10


@pytest.mark.parametrize("gap", [1, 3])
def test_rescue_equals_pixels(spark, gap):
    stacks = [scene(np.random.default_rng(100 + s)) for s in range(12)]
    pixels = spark.createDataFrame(rows_of(stacks), PIXELS)
    history = spark.createDataFrame([(f"{s:02d}", "cooldown", 5, 2, None) for s in range(12)] + [(f"{s:02d}", "parent", None, 9, 3) for s in range(12)], divide.OUTPUT)
    got = rescue.rescue_identities(pixels, gap, history=history).collect()
    events = set()
    for s, stack in enumerate(stacks):
        machine = pixel_machines.IdentityRescue(gap, 0.3, 50.0, {2: 5}, frozenset({3}))
        first, last = (f([i for i, m in enumerate(stack) if m.any()]) for f in (min, max))
        frames, before, want = [coded(m) for m in stack[: last + 1]], (np.zeros(0, np.int64),) * 2, {}
        for f in range(first, last + 1):
            machine.step(f, before, frames[f : f + gap])
            before = (frames[f][0], machine.ids(frames[f][1]))
            want |= {(f, a): b for a, b in set(zip(frames[f][1].tolist(), before[1].tolist(), strict=True))}
        mine = [r for r in got if r.seq == f"{s:02d}"]
        assert {(r.frame, r.label): r.id for r in mine if r.kind == "object"} == want, s
        audit = sorted((r.frame, r.label, r.event, round(r.score, 9), round(r.second, 9)) for r in mine if r.kind == "audit")
        assert audit == sorted((f, i, e, round(a, 9), round(b, 9)) for f, i, e, a, b in machine.audit), s
        events |= {a[2] for a in audit}
    assert {"rescued", "skip_no_candidate", "skip_ambiguous", "skip_excluded_parent"} <= events
