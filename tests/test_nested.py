"""Stacks inside nested documents against a recursive search in plain Python."""

from __future__ import annotations

import json
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans import shape_queries
from tessera.sources import frames, nested
from tessera.sources.shared import written_once


def first_stack(node, key="$"):
    """(key, array) that a depth-first search meets first, or None."""
    if isinstance(node, list):
        a = np.array(node, dtype=object)
        if a.ndim in (2, 3) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in a.ravel()):
            return key, np.array(node, float)
        items = [(f"{key}[{i}]", v) for i, v in enumerate(node)]
    elif isinstance(node, dict):
        rank = {k.lower(): i for i, k in enumerate(nested.PREFERRED)}
        items = [(f"{key}.{k}", node[k]) for k in sorted(node, key=lambda k: (rank.get(k.lower(), len(rank)), k))]
    else:
        return None
    return next((f for k, v in items if (f := first_stack(v, k))), None)


MASK = [[0, 1, 2], [3, 0, 0]]
STACK = [MASK, [[0, 0, 0], [0, 0, 9]]]
DOCUMENTS = {
    "bare": MASK,
    "stack": STACK,
    "preferred": {"a": [[1, 1], [1, 1]], "Data": MASK, "MASKS": STACK},
    "by name": {"zeta": [[1]], "beta": {"gamma": MASK}, "text": "x", "numbers": [1, 2, 3]},
    "preferred without": {"labels": "none", "masks": [1, 2], "other": [{"x": 1}, {"seg": STACK}]},
    "in a list": [1, "a", None, {"k": [[7]]}, MASK],
    "nothing": {"a": 1, "b": [1, 2, 3], "c": {"d": None}},
    "half": {"data": [[0.5, 1]]},
    "whole": {"data": [[0.0, 2.0]]},
    "negative": {"data": [[-1]]},
    "large": {"data": [[65536]]},
    "empty": {},
    "blank": {"data": [[0, 0]]},
}


def test_stacks_equal_a_recursive_search(spark):
    rows = [(k, json.dumps(v)) for k, v in DOCUMENTS.items()] + [("broken", "{nothing"), ("null", None)]
    docs = spark.createDataFrame(rows, "path string, body string")
    for given in (docs, docs.withColumn("body", F.try_parse_json("body"))):
        got = nested.nested_stacks(given).collect()
        for path in [r[0] for r in rows]:
            mine = [r for r in got if r.path == path]
            found = first_stack(DOCUMENTS[path]) if path in DOCUMENTS else None
            if found is None:
                assert [r.problem for r in mine] == ["no stack found"], path
                continue
            key, a = found
            if (a != np.floor(a)).any() or a.min() < 0 or a.max() > 65535:
                assert [(r.key, r.problem) for r in mine] == [(key, "labels must be whole numbers from 0 to 65535")], path
                continue
            a = a if a.ndim == 3 else a[None]
            assert {(r.key, r.frame, r.y, r.x, r.label) for r in mine} == {(key, *map(int, at), int(a[at])) for at in zip(*np.nonzero(a), strict=True)}, path
    assert {r.key for r in nested.describe(docs).filter("path = 'preferred without'").collect()} >= {"$", "$.labels", "$.masks", "$.other", "$.other[1]", "$.other[1].seg"}


@pytest.mark.parametrize("shape", [(2, 5, 6), (5, 2, 6), (5, 6, 2), (4, 4, 4), (3, 5, 7)])
def test_time_axes(spark, shape):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 4, shape)
    docs = spark.createDataFrame([("a", json.dumps(a.tolist()))], "path string, body string")
    for wanted in ("first", "last", "auto"):
        moved = np.moveaxis(a, frames.time_axis(shape, wanted), 0)
        got = {(r.frame, r.y, r.x): r.label for r in nested.nested_stacks(docs, time_axis=wanted).collect()}
        assert got == {tuple(map(int, at)): int(moved[at]) for at in zip(*np.nonzero(moved), strict=True)}, wanted


def test_documents_are_walked_once_and_nothing_is_joined(spark, monkeypatch):
    written = []
    monkeypatch.setattr(nested, "written_once", lambda df, *a, **k: written.append(df.columns) or written_once(df, *a, **k))
    docs = spark.createDataFrame([("a", json.dumps({"x": [1, {"y": {"seg": STACK}}]})), ("b", "[]")], "path string, body string")
    out = nested.nested_stacks(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert len(written) == 1 and "Join" not in plan and plan.count("from_json(") == 2  # of two and of three axes
    assert sorted((r.path, r.key, r.label) for r in out.collect() if r.path == "a") == [("a", "$.x[1].y.seg", k) for k in (1, 2, 3, 9)]


def test_deep_documents_and_several_of_a_path(spark):
    deep = MASK
    for i in range(2 * nested.LEVELS + 1):
        deep = {"z": deep} if i % 2 else [0, {"w": 1}, deep]
    later = [{}, {"q": {"q": {"q": {"q": {"q": {"q": {"q": {"q": STACK}}}}}}}}, [[5]]]  # the first is the deeper one
    rows = [("deep", deep), ("later", later), ("twice", {"data": [[7]]}), ("twice", {"masks": [[8]]}), ("twice", {}), ("none", {"a": deep[:2]})]
    got = nested.nested_stacks(spark.createDataFrame([(p, json.dumps(v)) for p, v in rows], "path string, body string")).collect()
    for path, body in (("deep", deep), ("later", later), ("twice", {"masks": [[8]]})):
        key, a = first_stack(body)
        assert sorted((r.key, r.label) for r in got if r.path == path) == sorted((key, int(v)) for v in a.ravel() if v), path
    assert [(r.key, r.problem) for r in got if r.path == "none"] == [(None, "no stack found")]


def test_the_query_writes_whole_masks(spark, monkeypatch):
    px = [("01", 0, 0, 0, 5), ("01", 0, 0, 2, 6), ("01", 0, 79, 127, 70), ("01", 1, 40, 127, 1), ("02", 0, 3, 0, 2), ("02", 0, 3, 1, 2)]
    seen = []
    monkeypatch.setattr(nested, "nested_stacks", lambda docs: seen.append(docs) or docs.selectExpr("path", "'' AS key", "0 AS frame", "0 AS y", "0 AS x", "0 AS label"))
    shape_queries.nested_stack(types.SimpleNamespace(gt=spark.createDataFrame(px, "seq string, frame int, y int, x int, label int")))
    assert "map_from_entries(" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()  # no look-up for each cell of a mask
    bodies = {r.path: r.body for r in seen[0].collect()}
    assert set(bodies) == {"01/0", "01/1", "02/0"}
    for path, body in bodies.items():
        mask = np.zeros((80, 128), int)
        for seq, frame, y, x, label in px:
            if path == f"{seq}/{frame}":
                mask[y, x] = label
        want = {"meta": {"labels": "none", "shape": [80, 128]}, "Result": [{"x": 1}, {"MASKS": mask.tolist()}]}
        assert body == json.dumps(want, separators=(",", ":")), path
