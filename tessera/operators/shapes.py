"""Binary shapes as small arrays: square and line elements, parts, skeletons and their points.

Pixels outside an array neither grow nor eat. These are the per-frame helpers of operators that work on pixels of one
frame at a time.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np


#: Up to this odd size an element is a chain of 3 x 3 elements; each takes four passes over bytes.
MOST_STEPS = 9


def box(mask: np.ndarray, k: int, grow: bool) -> np.ndarray:
    """k x k dilation or erosion, by steps of one pixel or by running sums over both axes."""
    r = k // 2
    if k % 2 and k <= MOST_STEPS:
        merge, near = np.logical_or if grow else np.logical_and, mask.astype(bool)
        for _ in range(r):
            for axis in (0, 1):
                last, near = near, near.copy()
                (a, b), (c, d) = ((x[1:], x[:-1]) if axis == 0 else (x[:, 1:], x[:, :-1]) for x in (near, last))
                merge(a, d, out=a)
                merge(b, c, out=b)
        return near
    out = mask.astype(np.int64)
    for axis in (0, 1):
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], constant_values=0 if grow else 1)
        total = np.cumsum(np.insert(padded, 0, 0, axis=axis), axis=axis)
        window = np.take(total, range(k, total.shape[axis]), axis) - np.take(total, range(total.shape[axis] - k), axis)
        out = (window > 0 if grow else window == k).astype(np.int64)
    return out.astype(bool)


def opened(mask: np.ndarray, k: int = 3) -> np.ndarray:
    core = box(mask, k, grow=False)
    return box(core, k, grow=True) if core.any() else core


def parts(mask: np.ndarray) -> np.ndarray:
    """8-connected parts numbered from 1 in the order of their first pixels, row by row; 0 outside."""
    out = np.zeros(mask.shape, np.int64)
    y, x = np.nonzero(mask)
    if not len(y):
        return out
    new = np.ones(len(y), bool)
    new[1:] = (y[1:] != y[:-1]) | (x[1:] != x[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(y)) - 1
    row, lo, hi = y[first], x[first], x[last]
    # runs of neighbouring rows touch where neither ends more than one pixel before the other begins
    wide = mask.shape[1] + 3
    begin, end = row * wide + lo + 1, row * wide + hi + 1
    touch_from = np.searchsorted(end, begin - wide - 1)
    touch_to = np.searchsorted(begin, end - wide + 1, side="right")
    n = np.maximum(touch_to - touch_from, 0)
    below = np.repeat(np.arange(len(first)), n)
    above = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(touch_from, n)
    root = np.arange(len(first))
    while True:  # every run takes the least root of the runs that it touches, and roots are shortened
        low = root.copy()
        np.minimum.at(low, below, root[above])
        np.minimum.at(low, above, root[below])
        np.minimum.at(low, root, low)
        low = low[low]
        if (low == root).all():
            break
        root = low
    number = np.unique(root, return_inverse=True)[1] + 1
    out[y, x] = number[np.cumsum(new) - 1]
    return out


def sizes(numbered: np.ndarray) -> np.ndarray:
    """Pixels of every part, by number."""
    return np.bincount(numbered.ravel(), minlength=2)


@lru_cache(1)
def thinning_tables() -> tuple[np.ndarray, np.ndarray]:
    """For both sub-passes: whether a pixel goes, by the byte of its eight neighbours (north first, clockwise).

    It goes with two to six neighbours that form one run around it, if north, east or south and east, south or west
    (first pass), or north, east or west and north, south or west (second) are not all set.
    """
    code = np.arange(256)
    ring = (code[:, None] >> np.arange(8)) & 1
    n, e, s, w = ring[:, 0], ring[:, 2], ring[:, 4], ring[:, 6]
    may = (ring.sum(1) >= 2) & (ring.sum(1) <= 6) & (((ring == 0) & (np.roll(ring, -1, 1) == 1)).sum(1) == 1)
    return may & (n * e * s == 0) & (e * s * w == 0), may & (n * e * w == 0) & (n * s * w == 0)


#: Neighbours clockwise from the north.
RING = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def _neighbours(mask: np.ndarray) -> np.ndarray:
    """The byte of every pixel's neighbours."""
    big = np.pad(mask.astype(np.uint8), 1)
    h, w = mask.shape
    out = np.zeros(mask.shape, np.uint8)
    for bit, (dy, dx) in enumerate(RING):
        out |= big[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] << bit
    return out


def skeleton(mask: np.ndarray) -> np.ndarray:
    """Parallel thinning: two alternating sub-passes remove border pixels until neither finds any [O-132]."""
    out = mask.astype(bool)
    while True:
        before = out
        for table in thinning_tables():
            out = out & ~table[_neighbours(out)]
        if (out == before).all():
            return out


def neighbour_count(mask: np.ndarray) -> np.ndarray:
    """Set neighbours of every set pixel, -1 elsewhere."""
    return np.where(mask, np.bitwise_count(_neighbours(mask)).astype(np.int64), -1)


def endpoints(mask: np.ndarray) -> np.ndarray:
    return neighbour_count(mask) == 1


def branch_points(mask: np.ndarray) -> np.ndarray:
    return neighbour_count(mask) > 2


def angle_of(y: np.ndarray, x: np.ndarray) -> float:
    """Angle of the major axis from the first axis, in radians; -pi/4 where no direction stands out [O-133]."""
    n = len(y)
    vy, vx, c = (int(n * (a * b).sum() - a.sum() * b.sum()) for a, b in ((y, y), (x, x), (y, x)))
    if vy == vx and c == 0:
        return -math.pi / 4
    return math.atan2(2 * c, vy - vx) / 2


def line_element(length: int, angle: float) -> np.ndarray:
    """(dy, dx) offsets of a line of odd ``length`` along the second axis, turned by ``angle``: nearest places, none beyond its ends [O-130]."""
    r = length // 2
    c, s = math.cos(angle), math.sin(angle)
    # along the axis that the line leans to, it passes within one place of the nearest
    go = np.repeat(np.arange(-r, r + 1), 3)
    side = np.rint(-go * (s / c if abs(c) >= abs(s) else c / s)).astype(np.int64) + np.tile([-1, 0, 1], length)
    dy, dx = (side, go) if abs(c) >= abs(s) else (go, side)
    on = (np.floor(c * dy + s * dx + 0.5) == 0) & (np.abs(c * dx - s * dy) <= r + 1e-9) & (np.abs(side) <= r)
    return np.stack([dy[on], dx[on]], 1)


def dilated_by(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Every set pixel moved by every offset, inside the array."""
    out = np.zeros(mask.shape, bool)
    at = (np.argwhere(mask)[:, None, :] + offsets[None, :, :]).reshape(-1, 2)
    at = at[((at >= 0) & (at < mask.shape)).all(1)]
    out[at[:, 0], at[:, 1]] = True
    return out
