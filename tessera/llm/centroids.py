"""Centroid clustering in exact integers, with Drake's adaptive bounds.

Every vector keeps its centroid with an upper bound of the distance to it, the next nearest centroids each with a
lower bound, nearest first, and one remainder bound below the distance of all others. When centroids move, the upper
bound grows by its centroid's step, each lower bound falls by its own centroid's step, and the remainder bound by the
largest. A vector whose upper bound stays below the bounds behind some place of its list can only move to a
centroid before that place: those distances alone are computed again, exactly. Where no place certifies that,
all centroids are scanned. The number of bounds shrinks to what the last round needed (an eighth of the centroids at least).

The state of a round is a table of its own; the sums of a round are one aggregation to a row per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, fresh_path, materialise

DIMS, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
#: Integers beyond this leave squared distances no room in 64 bits.
MOST_VALUE = 1 << 26
#: Below this every squared distance is exact in double precision.
_EXACT = 1 << 21
#: Bounds are certified with this much room, far more than their rounding.
_ROOM = 1e-9
_ROWS = 2048
_STATE = "vec_id {id}, q array<int>, near array<int>, upper double, lower array<double>, place int"


def distances(q: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every centroid, as integers."""
    kind = np.float64 if max(np.abs(q).max(initial=0), np.abs(centres).max(initial=0)) < _EXACT else np.int64
    q, centres = q.astype(kind), centres.astype(kind)
    return ((q * q).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * (q @ centres.T)).astype(np.int64)


def scan(q: np.ndarray, centres: np.ndarray, bounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(near, upper, lower) of vectors by all distances: the nearest ``bounds + 1`` centroids, ties by number."""
    d = distances(q, centres)
    order = np.argsort(d, axis=1, kind="stable")
    far = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    far = np.concatenate([far, np.full((len(q), 1), np.inf)], 1)
    return order[:, : bounds + 1], far[:, 0], far[:, 1 : bounds + 2]


def drake_step(q: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray, moved: np.ndarray, bounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The state after the centroids moved: (near, upper, lower, place); place: how many listed centroids a vector needed.

    ``lower`` has a bound for each listed centroid but the first, then the remainder bound; ``bounds`` is the new number of listed ones.
    """
    near, lower = near.copy(), lower.copy()
    upper = upper + moved[near[:, 0]]
    lower[:, :-1] -= moved[near[:, 1:]]
    lower[:, -1] -= moved.max(initial=0.0)
    if near.shape[1] > bounds + 1:  # the bounds given up join the remainder
        lower = np.concatenate([lower[:, :bounds], lower[:, bounds:].min(1, keepdims=True)], 1)
        near = near[:, : bounds + 1]
    behind = np.minimum.accumulate(lower[:, ::-1], 1)[:, ::-1]  # at z: below every centroid but the first z listed

    def certified(upper: np.ndarray, behind: np.ndarray) -> np.ndarray:
        return upper[:, None] * (1 + _ROOM) + _ROOM < behind

    open_rows = np.flatnonzero(~certified(upper, behind)[:, 0])
    if len(open_rows):  # the bound itself, exactly
        step = q[open_rows].astype(np.int64) - centres[near[open_rows, 0]]
        upper[open_rows] = np.sqrt((step * step).sum(1).astype(np.float64))
    sure = certified(upper, behind)
    place = np.where(sure.any(1), sure.argmax(1), bounds + 1)
    for z in np.unique(place[place > 0]).tolist():
        at = np.flatnonzero(place == z)
        if z > bounds:
            near[at], upper[at], lower[at] = scan(q[at], centres, bounds)
            continue
        step = q[at][:, None, :].astype(np.int64) - centres[near[at, : z + 1]]
        d = (step * step).sum(2)
        order = np.lexsort((near[at, : z + 1], d), axis=1)
        near[at, : z + 1] = np.take_along_axis(near[at, : z + 1], order, 1)
        far = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        upper[at], lower[at, :z] = far[:, 0], far[:, 1:]
    return near, upper, lower, place


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = np.asarray(column.flatten(), kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    edges = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values.ravel(), kind))


def _assign(centres: np.ndarray, bounds: int, moved: np.ndarray | None):
    """A task of one round: by all distances without ``moved``, else by the bounds of the round before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                q = _matrix(batch.column("q"), np.int64)
                if moved is None:
                    near, upper, lower = scan(q, centres, bounds)
                    place = np.zeros(len(q), np.int64)
                else:
                    near, upper, lower, place = drake_step(q, _matrix(batch.column("near"), np.int64), np.array(batch.column("upper")), _matrix(batch.column("lower"), np.float64), centres, moved, bounds)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("q"), _lists(near, pa.int32()), pa.array(upper), _lists(lower, pa.float64()), pa.array(place, pa.int32())], names=["vec_id", "q", "near", "upper", "lower", "place"])

    return run


def integers(vector: str, dims: int, scale: int) -> Column:
    """The vector as integers floor(scale * x), or null where it isn't a clean vector of ``dims`` components."""
    x = F.transform(vector, lambda v: v.cast("double"))
    whole = F.transform(x, lambda v: F.floor(v * scale))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * scale <= MOST_VALUE))
    return F.when((F.size(vector) == dims) & F.coalesce(sound, F.lit(False)), whole.cast("array<int>"))


def cluster(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; also left out is a vector with a component
    beyond 2**26 / ``scale``, whose squared distances could not be told in 64 bits. The first centroids are the kept vectors
    with the least SHA-256 of ``seed:vec_id`` (ties: by the vector, repeated rows each for itself; a null id never), fewer where
    there are fewer. Each round assigns every vector (ties: smaller number) and replaces each non-empty centroid by
    the floor of its mean; then vectors are assigned once more. Distances are squared. No kept vector or no id: no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    kept = df.select(F.col(vec_id).alias("vec_id"), integers(vector, dims, scale).alias("q")).filter("q is not null")
    named = kept.filter("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "q")
    centres = np.array([r.q for r in named.orderBy("h", "q").limit(centroids).collect()], np.int64).reshape(-1, dims)
    columns = f"vec_id {df.schema[vec_id].dataType.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centres):
        return spark.createDataFrame([], columns)
    schema = _STATE.format(id=df.schema[vec_id].dataType.simpleString())
    k = len(centres)
    bounds, moved, before, state = min(k - 1, max(1, k // 4)), None, None, kept
    for i in range(rounds + 1):
        path = fresh_path(spark, f"centroids-{i}")
        state = materialise(state.mapInArrow(_assign(centres, bounds, moved), schema), "state", path)
        if before:
            discard(spark, before)
        before = path
        if i == rounds:
            break
        sums = state.groupBy(F.col("near")[0].alias("c")).agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("place"), F.array(*[F.sum(F.col("q")[j].cast("long")) for j in range(dims)]).alias("sums")).collect()  # a row per centroid
        after = centres.copy()
        for r in sums:
            after[r.c] = [s // r.n for s in r.sums]
        step = (after - centres).astype(np.float64)
        moved = np.sqrt((step * step).sum(1)) * (1 + _ROOM)
        if i:  # the first round scanned everything
            bounds = min(bounds, max(k // 8, *(r.place for r in sums), 1))
        centres = after

    texts = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres.tolist()]
    table = spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(zip(centres.tolist(), texts, strict=True))], "cluster int, c array<bigint>, centroid_sha256 string")
    squared = F.aggregate(F.zip_with("q", "c", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    far = state.select("vec_id", F.col("near")[0].alias("cluster"), "q").join(F.broadcast(table), "cluster").select("vec_id", "cluster", squared.alias("distance"), "centroid_sha256")
    far = materialise(far, "distances")
    per = far.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row per centroid
    total = sum(r.cluster_inertia for r in per)
    inertia = spark.createDataFrame([(r.cluster, r.cluster_inertia, total) for r in per], "cluster int, cluster_inertia bigint, inertia bigint")
    return far.join(F.broadcast(inertia), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    nearest = "SELECT n, vec_id, q, k FROM (SELECT v.n, v.vec_id, v.q, c.k, row_number() OVER (PARTITION BY v.n ORDER BY list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.k) AS r FROM v CROSS JOIN {c} c) t WHERE r = 1"
    mean = "SELECT c.k, coalesce(m.q, c.q) AS q FROM {c} c LEFT JOIN (SELECT k, list(f ORDER BY i) AS q FROM (SELECT k, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM {a}) u GROUP BY k, i) w) z GROUP BY k) m ON c.k = m.k"
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED ({nearest.format(c=f'c{i}')})")
        if i < ROUNDS:
            steps.append(f"c{i + 1} AS MATERIALIZED ({mean.format(c=f'c{i}', a=f'a{i}')})")
    return f"""WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS INTEGER) AS k, q FROM v QUALIFY k < {CENTROIDS}
), {', '.join(steps)}, f AS (
  SELECT a.vec_id, a.k, list_sum(list_transform(list_zip(a.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d, sha256(array_to_string(c.q, ',')) AS h FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (k)
)
SELECT vec_id, k AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256 FROM f"""


ORACLE = _oracle()
