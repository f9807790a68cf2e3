"""Lineage forests: descendants, layout, plot segments and connectors."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTHS = "seq string, label int, root int, depth int"
LAYOUT = "seq string, label int, y double"


def _forest(group: pd.DataFrame) -> tuple[list[int], dict[int, list[int]]]:
    """Roots and children of one sequence, each in order of (begin, label); an unknown parent makes a root."""
    rows = sorted(zip(group["begin"].tolist(), group["label"].tolist(), group["parent"].tolist(), strict=True))
    known = set(group["label"].tolist())
    roots, children = [], defaultdict(list)
    for _, label, parent in rows:
        (children[parent] if parent in known and parent != 0 else roots).append(label)
    return roots, children


def _depths(group: pd.DataFrame) -> pd.DataFrame:
    roots, children = _forest(group)
    out, level = [], [(r, r) for r in roots]
    depth = 0
    while level:
        out += [(label, root, depth) for label, root in level]
        level, depth = [(c, root) for label, root in level for c in children[label]], depth + 1
    return pd.DataFrame(out, columns=["label", "root", "depth"]).assign(seq=group["seq"].iloc[0])[["seq", "label", "root", "depth"]]


def _layout(group: pd.DataFrame) -> pd.DataFrame:
    roots, children = _forest(group)
    y: dict[int, float] = {}
    leaves, stack = 0, [(r, False) for r in reversed(roots)]
    while stack:
        label, seen = stack.pop()
        if not children[label]:
            y[label], leaves = float(leaves), leaves + 1
        elif seen:
            y[label] = sum(y[c] for c in children[label]) / len(children[label])
        else:
            stack.append((label, True))
            stack += [(c, False) for c in reversed(children[label])]
    return pd.DataFrame({"seq": group["seq"].iloc[0], "label": list(y), "y": list(y.values())})


def depths(tracks: DataFrame) -> DataFrame:
    """(seq, label, root, depth) from the roots down, at any depth [O-156].

    Roots have parent 0; orphans (unknown parent) are roots of their own; tracks on a cycle have no root
    and are left out. A group is one sequence, which the label capacity bounds to 65,535 tracks.
    """
    return tracks.select("seq", "label", "begin", "parent").groupBy("seq").applyInPandas(_depths, DEPTHS)


def layout(tracks: DataFrame) -> DataFrame:
    """Row of every track: leaves in depth-first order from 0; a parent at the mean of its children [O-120, O-154]."""
    return tracks.select("seq", "label", "begin", "parent").groupBy("seq").applyInPandas(_layout, LAYOUT)


def segments(tracks: DataFrame, start: int, stop: int, reveal: int | None = None) -> DataFrame:
    """Visible part [x0, x1] of every track in a view, up to the reveal frame [O-38, O-155]."""
    stop_at = stop if reveal is None else min(stop, reveal)
    x0, x1 = F.greatest("begin", F.lit(start)), F.least("end", F.lit(stop_at))
    return tracks.select("seq", "label", x0.alias("x0"), x1.alias("x1")).filter("x0 <= x1")


def connectors(tracks: DataFrame, start: int, stop: int, reveal: int | None = None) -> DataFrame:
    """(parent, child, x) for children whose begin is in view and revealed [O-73, O-155]."""
    stop_at = stop if reveal is None else min(stop, reveal)
    p = tracks.select("seq", F.col("label").alias("parent"), F.col("end").alias("parent_end"))
    j = tracks.filter("parent <> 0").join(p, ["seq", "parent"])
    return j.filter(F.col("begin").between(start, stop_at)).select("seq", "parent", F.col("label").alias("child"), F.col("parent_end").alias("x0"), F.col("begin").alias("x1"))


def active(frame: int) -> Column:
    """Whether a track is active at a frame."""
    return F.col("begin").__le__(frame) & F.col("end").__ge__(frame)
