"""Centroid clustering and near-duplicate vectors against brute force, with odd rows, ties and hot groups."""

from __future__ import annotations

import glob
import hashlib
import itertools
import os

import numpy as np
import pytest

from tessera.llm import capfilters, centroids

VECTORS = "vec_id bigint, embedding array<double>, label int"
NAN, INF = float("nan"), float("inf")
TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def unit(rng, n, d=64):
    v = rng.standard_normal((n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("module", [centroids, capfilters])
def test_queries_equal_their_sql(spark, duck, module):
    df = module.query(spark, TABLES)
    columns = sorted(df.columns)
    rows = sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows == sorted(duck.sql(module.ORACLE).select(*columns).fetchall())


# 11 centroid clustering


def brute_clusters(rows, k, rounds, dims, scale=256):
    """Every distance in every round, in Python integers."""
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centres = [q for _, q in named[:k]]

    def nearest(q):
        return min(range(len(centres)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(q, centres[c], strict=True)), c))

    for _ in range(rounds):
        of = [nearest(q) for _, q in kept]
        for c in range(len(centres)):
            mine = [q for (_, q), o in zip(kept, of, strict=True) if o == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = [(i, nearest(q), q) for i, q in kept]
    far = [(i, c, sum((a - b) ** 2 for a, b in zip(q, centres[c], strict=True))) for i, c, q in out]
    return [(i, c, d, sum(y for _, z, y in far if z == c), sum(y for _, _, y in far), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in far]


def test_clusters_equal_a_scan_of_everything(spark):
    rng = np.random.default_rng(3)
    groups = rng.standard_normal((9, 5)) * 3
    rows = [(i, (groups[i % 9] + rng.standard_normal(5) * (0.1 if i % 2 else 1)).tolist()) for i in range(400)]
    rows += [(i, [1.0] * 5) for i in range(400, 460)] + [(7, [1.0] * 5)] * 3 + [(None, [1.0, 2.0, 3.0, 4.0, 5.0])]  # a hot vector, repeated rows, a null id
    rows += [(900, None), (901, []), (902, [1.0] * 4), (903, [1.0, None, 1.0, 1.0, 1.0]), (904, [NAN] * 5), (905, [INF] + [0.0] * 4), (906, [-INF] + [0.0] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], VECTORS)
    for k, rounds in ((40, 5), (12, 5), (3, 2), (1, 3), (1000, 2)):
        got = centroids.cluster(df, centroids=k, rounds=rounds, dims=5)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_clusters(rows, k, rounds, 5), key=str), (k, rounds)


def test_clusters_of_nothing_and_clashing_names(spark):
    empty = spark.createDataFrame([], VECTORS)
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster(empty).columns == columns and centroids.cluster(empty).count() == 0
    odd = spark.createDataFrame([(1, [1.0] * 63, 1), (2, None, None), (None, [0.5] * 64, 1)], VECTORS)
    assert centroids.cluster(odd).count() == 0  # a null id names no first centroid
    one = spark.createDataFrame([(1, [0.5] * 64, 1, 5, 6), (2, [1e12] * 64, 1, 5, 6)], VECTORS + ", cluster int, q int")
    assert [tuple(r)[:5] for r in centroids.cluster(one).collect()] == [(1, 0, 0, 0, 0)]  # 1e12 has no distance in 64 bits
    big = [(i, [float((-1) ** i * (1 << 17) + i)] * 64, 1) for i in range(6)]
    got = centroids.cluster(spark.createDataFrame(big, VECTORS), centroids=2)
    assert sorted(map(tuple, got.collect())) == sorted(brute_clusters([(i, v) for i, v, _ in big], 2, 5, 64))


def test_bounds_certify_and_rescan(monkeypatch):
    """Bounds spare most distances on settled groups, and every step gives the state of a full scan."""
    rng = np.random.default_rng(1)
    groups = rng.integers(-900, 900, (12, 8))
    q = groups[rng.integers(0, 12, 3000)] + rng.integers(-30, 30, (3000, 8))
    q[:50] = q[0]
    centres = q[rng.choice(3000, 12, replace=False)].astype(np.int64)
    near, upper, lower = centroids.scan(q, centres, 4)
    bounds, needed = 4, []
    for _ in range(6):
        own = near[:, 0]
        after = centres.copy()
        for c in np.unique(own):
            after[c] = q[own == c].sum(0) // (own == c).sum()
        moved = np.sqrt(((after - centres) ** 2).sum(1).astype(float)) * (1 + 1e-9)
        near, upper, lower, place = centroids.drake_step(q, near, upper, lower, after, moved, bounds)
        centres = after
        d = centroids.distances(q, centres)
        assert (near[:, 0] == d.argmin(1)).all()
        real = np.sqrt(d)
        assert (upper >= real[np.arange(len(q)), near[:, 0]] - 1e-6).all()
        assert (lower[:, :-1] <= np.take_along_axis(real, near[:, 1:], 1) + 1e-6).all()
        others = real.copy()
        np.put_along_axis(others, near, np.inf, 1)
        assert (lower[:, -1] <= others.min(1) + 1e-6).all()
        needed.append((place > 0).mean())
        bounds = min(bounds, max(1, int(place.max())))
    assert needed[-1] < 0.2  # most vectors are certified by their bounds alone


# 12 near-duplicate vectors


def brute_links(rows, threshold=0.98):
    sound = [v is not None and len(v) > 0 and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    link = {i: set() for i in range(len(rows))}
    for i, j in itertools.combinations([i for i, ok in enumerate(sound) if ok], 2):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        if la == lb and len(a) == len(b) and capfilters.cosine(np.array(a, float), np.array(b, float)) >= threshold:
            link[i].add(j)
            link[j].add(i)
    out = []
    for i, (rid, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((rid, len(link[i]), low, rid == low))
    return out


def near_rows(rng):
    base = unit(rng, 30)
    rows = [(i, b.tolist(), i % 3) for i, b in enumerate(base)]
    for i in range(60):  # chains and stars around some of them
        v = base[i % 6] + 0.02 * rng.standard_normal(64) * rng.integers(1, 3)
        rows.append((100 + i, (v * rng.uniform(0.001, 1000)).tolist(), (i % 6) % 3))
    rows += [(300 + i, base[2].tolist(), 2) for i in range(5)] + [(300, base[2].tolist(), 2)] * 2  # copies and a repeated row
    rows += [(400, base[2].tolist(), 1), (401, base[2].tolist(), None), (402, None, 2), (403, [], 2), (404, [0.0] * 64, 2), (405, [NAN] * 64, 2), (406, [INF] + [0.0] * 63, 2), (407, [None] + [1.0] * 63, 2)]
    rows += [(500, [1.0, 0.0], 2), (501, [2.0, 0.0], 2), (502, [0.0, 1.0], 2), (503, [3.0], 2), (504, [1e-300], 2), (505, [-1.0], 2), (506, [1e200, 0.0, 0.0], 2), (507, [1e-200, 0.0, 0.0], 2)]
    return rows + [(None, base[3].tolist(), 0), (None, unit(rng, 1)[0].tolist(), 0)]


def test_links_equal_all_pairs(spark):
    rows = near_rows(np.random.default_rng(8))
    got = capfilters.near_vectors(spark.createDataFrame(rows, VECTORS))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    want = [(a, b, c, bool(k)) for a, b, c, k in brute_links(rows)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_links_of_nothing_and_clashing_names(spark):
    assert capfilters.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 2.0], 1, 0, "x"), (2, [1.0, 2.0], 1, 0, "x")], VECTORS + ", cid int, s1 string")
    assert sorted(map(tuple, capfilters.near_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_a_third_of_the_rows_in_one_group(spark, monkeypatch):
    monkeypatch.setattr(capfilters, "BLOCK_CLASSES", 16)
    rng = np.random.default_rng(4)
    centre = unit(rng, 1)[0]
    near = centre + 0.015 * rng.standard_normal((150, 64))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(near)] + [(1000 + i, centre.tolist(), 1) for i in range(150)] + [(2000 + i, v.tolist(), 1) for i, v in enumerate(unit(rng, 300))]
    got = capfilters.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    want = [(a, b, c, bool(k)) for a, b, c, k in brute_links(rows)]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("dims,bits", [(64, 16), (64, 10), (3, 12), (17, 14), (1, 4)])
def test_recall_at_the_threshold(dims, bits):
    size, bound = capfilters.calibrated(dims, bits, 0.98, 0.9999, 16)
    u, v = capfilters.random_pairs(3000, dims, 0.98, seed=99)
    met = np.zeros(len(u), bool)
    for code in range(16):
        made = capfilters.product_code(dims, size, code)
        (r1, d1), (r2, d2) = capfilters.list_decode(u, made, bound), capfilters.list_decode(v, made, bound)
        met[np.unique(np.intersect1d((r1 << size) + d1, (r2 << size) + d2) >> size)] = True
    assert met.mean() >= 0.998


def test_list_decoding_equals_all_directions():
    rng = np.random.default_rng(2)
    units = unit(rng, 40)
    rotation, books = code = capfilters.product_code(64, 10, 3)
    turned = units.astype(np.float32) @ rotation
    all_scores = (turned[:, :32] @ books[0].T)[:, :, None] + (turned[:, 32:] @ books[1].T)[:, None, :]
    for bound in (-1.0, 0.1, 0.3, 0.45):
        row, direction = capfilters.list_decode(units, code, bound)
        want = np.argwhere(all_scores.reshape(40, -1) >= bound)
        near_edge = np.abs(all_scores - bound) < 1e-5
        assert len(set(zip(row.tolist(), direction.tolist(), strict=True)) ^ set(map(tuple, want.tolist()))) <= near_edge.sum()
