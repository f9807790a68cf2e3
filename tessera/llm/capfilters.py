"""Near-duplicate vectors by spherical-cap filters, verified by cosine.

1. Equal vectors of one label are one *class* (copies collapse here), named by 128 bits of hash.
2. A filter is a direction of a random product code: after a random rotation the dimensions fall into blocks, each
   with a codebook of random unit codewords, and every combination of one codeword a block is a direction. A vector is
   list-decoded to *all* directions whose inner product reaches the cap's bound: codewords that can't reach it with the
   best of the other blocks are left out before blocks are combined.
3. Classes that share a filter meet in a bucket. Buckets with the same members are one bucket, large ones are dealt
   into blocks, and each pair of blocks is a group of bounded size. All pairs of a group are verified by cosine in
   double precision; a pair that meets in several buckets counts in its first.
4. A group gives link counts per class and a spanning forest of its links, not pairs.

Since the rotation is random, a pair of a given angle falls into a common cap with a probability that doesn't depend on
the data: the bound is calibrated on random pairs at the threshold, and independent codes raise recall to ``recall``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .joins import many_to_one
from .nearjoin import BLOCK_BYTES, BLOCK_CLASSES, forest, intersections
from .scratch import materialise, shuffle_parts

THRESHOLD = 0.98
RECALL = 0.9999
#: Independent codes, and blocks of each.
CODES, BLOCKS = 16, 2
#: About so many directions of a code for each vector, and at most 2 ** MOST_BITS (more vectors: larger buckets).
DIRECTIONS_EACH, MOST_BITS = 16, 28
#: Directions of a code that a vector may have on average, else the code gets fewer directions (few dimensions).
LONGEST_LIST = 8
#: Pairs closer to the threshold than this are computed again with exactly rounded sums.
CLOSE = 1e-12
_FOUND = "is_edge boolean, a bigint, b bigint, links bigint, row_links bigint"
_PAIRS = 1500
_CELLS = 1 << 19


@lru_cache(32)
def product_code(dims: int, bits: int, code: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation of the space and a codebook of unit vectors for each block of dimensions."""
    rng = np.random.default_rng((77, dims, bits, code))
    q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
    rotation = (q * np.where(np.diag(r) < 0, -1.0, 1.0)).astype(np.float32)
    blocks, books = min(BLOCKS, dims), []
    for part, b in zip(np.array_split(np.arange(dims), blocks), np.array_split(np.arange(bits), blocks), strict=True):
        words = rng.standard_normal((1 << len(b), len(part)))
        books.append((words / np.linalg.norm(words, axis=1, keepdims=True) / math.sqrt(blocks)).astype(np.float32))
    return rotation, books


def list_decode(units: np.ndarray, code: tuple[np.ndarray, list[np.ndarray]], bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, direction) of every direction of the code whose inner product with the unit vector is ``bound`` or more."""
    rotation, books = code
    step = max(1, _CELLS // max(len(b) for b in books))
    rows, directions = [], []
    for at in range(0, len(units), step):
        turned = units[at : at + step].astype(np.float32) @ rotation
        edges = np.cumsum([0, *[b.shape[1] for b in books]])
        scores = [turned[:, lo:hi] @ b.T for lo, hi, b in zip(edges[:-1], edges[1:], books, strict=True)]
        best = [s.max(1) for s in scores]
        total = np.sum(best, axis=0)
        row, sums, index = np.arange(len(turned)), np.zeros(len(turned), np.float32), np.zeros(len(turned), np.int64)
        rest = total.copy()
        for s, top in zip(scores, best, strict=True):
            rest -= top  # what the blocks after this one can add at most
            where, word = np.nonzero(s >= (bound - total + top)[:, None])
            first = np.searchsorted(where, np.arange(len(turned) + 1))
            times = (first[1:] - first[:-1])[row]
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[row], times)
            row, index = np.repeat(row, times), np.repeat(index, times) * s.shape[1] + word[place]
            sums = np.repeat(sums, times) + s[row, word[place]]
            keep = sums + rest[row] >= bound
            row, sums, index = row[keep], sums[keep], index[keep]
        rows.append(row + at)
        directions.append(index)
    return np.concatenate(rows or [np.zeros(0, np.int64)]), np.concatenate(directions or [np.zeros(0, np.int64)])


def random_pairs(n: int, dims: int, cosine: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors in random directions at one cosine."""
    rng = np.random.default_rng((seed, dims))
    u, w = rng.standard_normal((2, n, dims))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    if dims == 1:
        return u, u
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    return u, cosine * u + math.sqrt(max(0.0, 1 - cosine**2)) * w


@lru_cache(256)
def calibrated(dims: int, bits: int, threshold: float, recall: float, codes: int) -> tuple[int, float]:
    """(bits, bound): the tightest bound at which one code joins a random pair at the threshold with the probability that
    makes ``recall`` of all codes, and the bits of the largest code whose lists stay short at it."""
    wanted = (1 - (1 - recall) ** (1 / codes)) * _PAIRS
    u, v = random_pairs(_PAIRS, dims, threshold)
    bits = min(bits, 2 * dims)

    def met(bound: float) -> int:
        (r1, d1), (r2, d2) = list_decode(u, code, bound), list_decode(v, code, bound)
        return len(np.unique(np.intersect1d((r1 << bits) + d1, (r2 << bits) + d2) >> bits))

    while True:
        code, high, step = product_code(dims, bits, 0), 1.0, 1 / 16
        while len(list_decode(u[:32], code, high)[0]) <= 64 * LONGEST_LIST * 32 and met(high) < wanted:  # from above: lists stay short
            high -= step
        for _ in range(6):
            step /= 2
            high += step if met(high + step) >= wanted else 0.0
        if bits == 0 or len(list_decode(u[:256], code, high)[0]) <= 256 * LONGEST_LIST:
            return bits, high - 1e-6  # room for rounding
        bits = max(0, bits - 2)


def bits_for(vectors: int) -> int:
    """Directions of a code, as a power of two."""
    return min(MOST_BITS, max(2, math.ceil(math.log2(DIRECTIONS_EACH * max(vectors, 1)))))


def as_units(values: np.ndarray) -> np.ndarray:
    """Rows at length one, without overflow or underflow on the way."""
    scaled = values / np.abs(values).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two vectors by exactly rounded sums."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _filters_udf(bits: int, threshold: float, recall: float, codes: int, known: dict[int, tuple[int, float]]):
    @F.arrow_udf("array<bigint>")
    def cap_filters(vector: pa.Array) -> pa.Array:
        if isinstance(vector, pa.ChunkedArray):
            vector = vector.combine_chunks()
        flat = np.asarray(vector.flatten(), np.float64)
        length = np.asarray(vector.value_lengths())
        start = np.cumsum(length) - length
        out: list[np.ndarray | None] = [None] * len(vector)
        for dims in np.unique(length).tolist():
            at = np.flatnonzero(length == dims)
            units = as_units(flat[start[at][:, None] + np.arange(dims)])
            size, bound = known.get(dims) or calibrated(dims, bits, threshold, recall, codes)
            rows, names = [], []
            for code in range(codes):
                row, direction = list_decode(units, product_code(dims, size, code), bound)
                rows.append(row)
                names.append(direction + (code << 40))
            row, name = np.concatenate(rows), np.concatenate(names)
            name = name[np.argsort(row, kind="stable")]
            ends = np.cumsum(np.bincount(row, minlength=len(at)))
            for i, part in zip(at.tolist(), np.split(name, ends[:-1]), strict=True):
                out[i] = part
        return pa.array(out, pa.list_(pa.int64()))

    return cap_filters


def verify_group(bucket: int, lo: int, hi: int, side: np.ndarray, label: np.ndarray, vectors: list[np.ndarray], kept: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All links (i < j) of a group, and which of them belong to this bucket rather than an earlier shared one."""
    length = np.array([len(v) for v in vectors])
    linked = np.zeros((len(vectors),) * 2, bool)
    for dims in np.unique(length).tolist():  # one length, but where hashes collide
        at = np.flatnonzero(length == dims)
        units = as_units(np.stack([vectors[i] for i in at]))
        near = units @ units.T
        link = near >= threshold
        for i, j in np.argwhere(np.triu(np.abs(near - threshold) < CLOSE, 1)).tolist():
            link[i, j] = cosine(vectors[at[i]], vectors[at[j]]) >= threshold
        linked[np.ix_(at, at)] = link
    linked = np.triu(linked & (label[:, None] == label[None, :]), 1)
    if lo != hi:
        linked &= side[:, None] != side[None, :]
    i, j = np.nonzero(linked)
    if len(i):
        own = intersections([k[k < bucket] for k in kept])[i, j] == 0
    else:
        own = np.zeros(0, bool)
    return np.stack([i, j], 1), own


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows of one key, across batches."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        key = np.asarray(table.column("key"))
        cuts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = table.slice(a, b - a)
            if held and held[0].column("key")[0] != part.column("key")[0]:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    flat = np.asarray(column.flatten())
    return np.split(flat, np.cumsum(np.asarray(column.value_lengths()))[:-1])


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    types = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*parts, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["is_edge", "a", "b", "links", "row_links"])


def _verify(threshold: float):
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in _groups(batches):
            if len(group) < 2:
                continue
            bucket, lo, hi = (group.column(c)[0].as_py() for c in ("bucket", "lo", "hi"))
            side, label, n_rows = (np.asarray(group.column(c)) for c in ("side", "label", "n_rows"))
            vectors = [v.astype(np.float64) for v in _arrays(group.column("vector"))]
            pairs, own = verify_group(bucket, lo, hi, side, label, vectors, _arrays(group.column("kept")), threshold)
            if not len(pairs):
                continue
            cid = group.column("cid").to_pylist()
            out += [(True, cid[i], cid[j], None, None) for i, j in forest(len(cid), pairs)]
            i, j = pairs[own].T
            links = np.bincount(i, minlength=len(cid)) + np.bincount(j, minlength=len(cid))
            rows = np.bincount(i, n_rows[j], len(cid)) + np.bincount(j, n_rows[i], len(cid))
            out += [(False, cid[r], None, int(links[r]), int(rows[r])) for r in np.flatnonzero(links).tolist()]
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return verify


def linkable(vector: str, label: str) -> Column:
    """Whether a vector can link at all: labelled, not null, not zero, nothing null or non-finite in it."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(df: DataFrame, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id", threshold: float = THRESHOLD, recall: float = RECALL, codes: int = CODES) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link when their labels are equal (null equals nothing), their lengths are equal and their cosine in double
    precision is at least ``threshold``; null, empty and zero vectors and those with null or non-finite components link
    with nothing. ``n_links`` counts the other rows that link directly, copies included; ``component_id`` is the least
    vec_id reachable by links, the row's own included (null only where all are), and ``kept`` says whether
    the row's id is that one (rows that repeat the id are kept with it). Other columns are ignored. Empty tables give none.
    A pair at the threshold is found with probability ``recall``, a closer one with more; no pair below it is linked.
    """
    spark = df.sparkSession
    kind = df.schema[vector].dataType.elementType.typeName()
    values = F.col(vector) if kind in ("float", "double") else F.col(vector).cast("array<double>")
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), values.alias("vector"))
    sound = linkable("vector", "label")
    keys = [F.when(sound, F.xxhash64("label", F.size("vector"), "vector")).alias("s1"), F.when(sound, F.xxhash64("vector", F.lit("vector"), "label")).alias("s2")]
    signed = materialise(rows.select("vec_id", *keys), "vector-keys")
    classes = signed.filter("s1 is not null").groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n_rows"), F.min("vec_id").alias("low_id"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("cid"), "s1", "s2", "n_rows", "low_id"), "vector-classes")

    firsts = rows.filter(sound).select(*[k for k in keys], F.xxhash64("label", F.lit("label")).alias("label"), "vector").dropDuplicates(["s1", "s2"])
    firsts = materialise(firsts.join(classes.select("cid", "s1", "s2", "n_rows"), ["s1", "s2"]).select("cid", "label", "n_rows", "vector"), "vectors")
    bits = bits_for(classes.count())
    usual = [r[0] for r in firsts.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(4).collect()]
    known = {d: calibrated(d, bits, threshold, recall, codes) for d in usual}

    members = firsts.select("cid", "label", F.size("vector").alias("dims"), F.explode(_filters_udf(bits, threshold, recall, codes, known)(F.col("vector"))).alias("filter"))
    members = materialise(members.select("cid", (F.col("dims") * 8).cast("long").alias("bytes"), F.xxhash64("label", "dims", "filter").alias("bucket")), "vector-filters")
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes"), F.expr("bit_xor(xxhash64(cid))").alias("x"), F.expr("bit_xor(xxhash64(cid, 'other'))").alias("y")).filter("m > 1")
    buckets = buckets.groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket"), F.max("bytes").alias("bytes")).select("bucket", "m", "bytes", F.col("m").alias("jn_rows"))
    buckets = materialise(buckets, "vector-buckets")
    shared = materialise(many_to_one(members.select("cid", "bucket"), buckets, ["bucket"]), "vector-members")
    lists = shared.groupBy("cid").agg(F.collect_list(F.struct("bucket", "m", "bytes")).alias("in"))  # no more than the directions of one vector

    blocks = F.ceil(F.greatest(F.col("i.m") / BLOCK_CLASSES, F.col("i.bytes") / BLOCK_BYTES)).cast("int")
    placed = firsts.join(lists, "cid").select("cid", "label", "n_rows", "vector", F.transform("in", lambda s: s["bucket"]).alias("kept"), F.explode("in").alias("i")).withColumn("blocks", blocks)
    placed = placed.withColumn("side", F.pmod(F.xxhash64("cid", "i.bucket"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bucket = F.col("i.bucket")
    placed = placed.select(bucket.alias("bucket"), F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "cid", "label", "n_rows", F.filter("kept", lambda k: k < bucket).alias("kept"), "vector")
    placed = placed.withColumn("key", F.xxhash64("bucket", "lo", "hi"))
    dealt = placed.repartition(shuffle_parts(spark), "key").sortWithinPartitions("key", "bucket", "lo", "hi", "cid")
    found = materialise(dealt.mapInArrow(_verify(threshold), _FOUND), "vector-links")

    roots = components(found.filter("is_edge").select("a", "b"))
    links = found.filter("not is_edge").groupBy(F.col("a").alias("cid")).agg(F.sum("row_links").alias("row_links"))
    rooted = materialise(roots.withColumnRenamed("node", "cid").join(classes.select("cid", "low_id"), "cid").select("cid", "root", "low_id"), "vector-roots")
    least = materialise(rooted.groupBy("root").agg(F.min("low_id").alias("component_id"), F.count(F.lit(1)).alias("jn_rows")), "vector-components")
    linked = many_to_one(rooted.select("cid", "root"), least, ["root"]).join(links, "cid", "left")
    info = classes.join(linked, "cid", "left").filter((F.col("n_rows") > 1) | F.col("root").isNotNull())
    info = info.select("s1", "s2", F.coalesce("component_id", "low_id").alias("component_id"), (F.col("n_rows") - 1 + F.coalesce("row_links", F.lit(0))).alias("n_links"), F.col("n_rows").alias("jn_rows"))
    out = many_to_one(signed, materialise(info, "vector-info"), ["s1", "s2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), sound AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.n AS a, b.n AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e) AND a.n <> b.n WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach AS (
  SELECT n AS a, n AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (
  SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON b = n GROUP BY a
), degree AS (
  SELECT a, count(*) AS k FROM link GROUP BY a
)
SELECT vec_id, coalesce(k, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN least ON least.a = n LEFT JOIN degree ON degree.a = n"""
