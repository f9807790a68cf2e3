"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Every text becomes its set of 5-word shingles; equal sets are one *class* (copies collapse here). Sets
   and texts are told apart by 128 bits of hash, and classes are numbered.
2. Classes that share a band of their MinHash signature meet in a bucket. Buckets with the same
   members are one bucket.
3. Members meet in groups of bounded size: a large bucket is dealt into blocks, and each pair of
   blocks is a group of its own. All pairs of a group are verified on full shingle sets by
   intersection counts; a pair that meets in several buckets counts in its first.
4. A group gives link counts per class and a spanning forest of its links, not pairs. Components of
   the forests are the groups of near duplicates.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import possible, possible_members
from .components import components
from .joins import as_row, many_to_one
from .scratch import materialise, shuffle_parts, small_batches
from .words import hash_words, mix, release_memory, shingle_hashes, shingle_sets, slices, string_buffers

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 5
#: A bucket is dealt into blocks of about so many classes, or so many bytes of text.
BLOCK_CLASSES, BLOCK_BYTES = 512, 4 << 20
_SIGNATURE = pa.struct([("s1", pa.int64()), ("s2", pa.int64()), ("bands", pa.list_(pa.int64()))])
_FOUND = "is_edge boolean, a bigint, b bigint, links bigint, doc_links bigint"
_CHUNK = 4096


def band_count(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` hashes so that a pair at the threshold meets with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _families(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band of ``rows`` minima."""
    mul, add = _families(bands * rows)
    low = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(shingles), 512):
            np.minimum(low, ((shingles[i : i + 512, None] ^ add) * mul).min(0), out=low)
        acc = np.zeros(bands, np.uint64)
        for r in range(rows):
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + low[r::rows])
    return acc


def set_id(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of shingles."""
    out = []
    with np.errstate(over="ignore"):
        for odd in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
            spread = mix(shingles * np.uint64(odd) + np.uint64(odd >> 7))
            total = np.add.reduce(spread) + np.bitwise_xor.reduce(spread) * np.uint64(odd) + np.uint64(len(shingles))
            out.append(int(mix(np.array([total], np.uint64)).view(np.int64)[0]))
    return out[0], out[1]


def _signature_udf(shingle: int, bands: int, rows: int):
    @F.arrow_udf("struct<s1:bigint,s2:bigint,bands:array<bigint>>")
    def sign(text: pa.Array) -> pa.Array:
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        out = []
        for a, b in slices(text):
            words, _, _, at = hash_words(*string_buffers(text.slice(a, b - a)))
            for i in range(b - a):
                s = np.unique(shingle_hashes(words[at[i] : at[i + 1]], shingle))
                one, two = set_id(s) if len(s) else (None, None)
                out.append({"s1": one, "s2": two, "bands": signature(s, bands, rows).view(np.int64) if len(s) else None})
        release_memory()
        return pa.array(out, _SIGNATURE)

    return sign


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from shingles that at least two sets hold."""
    n = len(sets)
    if n == 2:
        out = np.zeros((2, 2), np.float32)
        out[0, 1] = out[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return out
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    dense = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], dense[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    edges = np.searchsorted(column, np.arange(0, total + _CHUNK, _CHUNK))
    for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = np.zeros((n, min(_CHUNK, total - i * _CHUNK)), np.float32)
        part[owner[lo:hi], column[lo:hi] - i * _CHUNK] = 1
        out += part @ part.T
    return out


def verify_group(bucket: int, lo: int, hi: int, side: np.ndarray, kept: list[list[int]], sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All links (i < j) of a group, and which of them belong to this bucket rather than an earlier shared one."""
    size = np.array([len(s) for s in sets], np.float32)
    common = intersections(sets)
    union = size[:, None] + size[None, :] - common
    linked = np.triu(common >= threshold * union - 1e-4, 1) & (union > 0)
    if lo != hi:
        linked &= side[:, None] != side[None, :]
    i, j = np.nonzero(linked)
    grid = np.zeros((len(sets), 32), np.int64)
    for r, buckets in enumerate(kept):
        for b in buckets:
            grid[r, b & 31] = b
    own = np.ones(len(i), bool)
    for band in range(bucket & 31):
        own &= (grid[i, band] != grid[j, band]) | (grid[i, band] == 0)
    return np.stack([i, j], 1), own


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _verify(shingle: int, threshold: float):
    columns = ("key", "bucket", "lo", "hi", "side", "cid", "n_docs", "kept", "text")

    def groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
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

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group in groups(batches):
            cols = {c: group.column(c) for c in columns}
            if len(group) < 2:
                continue
            cid, n_docs = cols["cid"].to_pylist(), np.asarray(cols["n_docs"])
            sets = shingle_sets(cols["text"], shingle)
            bucket, lo, hi = (cols[c][0].as_py() for c in ("bucket", "lo", "hi"))
            pairs, own = verify_group(bucket, lo, hi, np.asarray(cols["side"]), cols["kept"].to_pylist(), sets, threshold)
            out += [(True, cid[i], cid[j], None, None) for i, j in forest(len(cid), pairs)]
            i, j = pairs[own].T if own.any() else (np.zeros(0, np.int64),) * 2
            links = np.bincount(i, minlength=len(cid)) + np.bincount(j, minlength=len(cid))
            docs = np.bincount(i, n_docs[j], len(cid)) + np.bincount(j, n_docs[i], len(cid))
            out += [(False, cid[r], None, int(links[r]), int(docs[r])) for r in np.flatnonzero(links).tolist()]
            if len(out) > 20_000:
                yield _batch(out)
                out = []
        yield _batch(out)
        release_memory()

    return verify


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    parts = list(zip(*rows, strict=True)) or [[]] * 5
    types = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(parts, types, strict=True)], names=["is_edge", "a", "b", "links", "doc_links"])


def near_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, k1, k2, class_key, class_id, n_links.

    Words are lower-cased (A-Z) runs of characters other than ASCII control, space and punctuation;
    a text of fewer than five words is one shingle. Two documents link when the Jaccard
    similarity of their shingle sets is at least ``threshold``. ``n_links`` counts the other documents
    that link, copies included; ``class_key`` names the connected component (null: a document alone) and
    ``class_id`` is the least doc_id in it. Texts without words (null, empty) link only to equal texts.
    Null ids are never a class_id unless all of the class are null; repeated rows are copies of each
    other. ``k1`` and ``k2`` are a 128-bit hash of id and text. Other columns are ignored.
    """
    spark = docs.sparkSession
    bands = band_count(threshold, recall, rows)
    if bands > 32:
        raise ValueError("at most 32 bands: raise rows or lower recall")
    signed = docs.select(F.col(doc_id).alias("doc_id"), *row_keys(docs, text, doc_id), *text_keys(text), F.octet_length(text).cast("long").alias("n_bytes"), _signature_udf(shingle, bands, rows)(F.col(text)).alias("s"))
    signed = signed.select("doc_id", "k1", "k2", "t1", "t2", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), F.coalesce("s.s1", F.xxhash64(F.lit("no words"), "t1")).alias("s1"), F.coalesce("s.s2", "t2").alias("s2"), "s.bands")
    with small_batches(spark):
        signed = materialise(signed, "signatures")

    classes = signed.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("low_id"), F.min(F.struct("t1", "t2", "n_bytes")).alias("t"), F.first("bands").alias("bands"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("cid"), "s1", "s2", "n_docs", "low_id", "t.*", "bands"), "classes")
    members = classes.filter(F.col("bands").isNotNull()).select("cid", "n_bytes", F.posexplode("bands").alias("band", "value"))
    members = members.select("cid", "n_bytes", F.xxhash64("band", "value").bitwiseAND(F.lit(~31)).bitwiseOR(F.col("band").cast("long")).alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"), F.sum("n_bytes").alias("bytes"), F.expr("bit_xor(xxhash64(cid))").alias("x"), F.expr("bit_xor(xxhash64(cid, 'other'))").alias("y")).filter("m > 1")
    buckets = buckets.groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket"), F.max("bytes").alias("bytes")).select("bucket", "m", "bytes", F.col("m").alias("jn_rows"))
    buckets = materialise(buckets, "buckets")
    kept = materialise(many_to_one(members.select("cid", "bucket"), buckets, ["bucket"]), "members")
    per_class = kept.groupBy("cid").agg(F.collect_list(F.struct("bucket", "m", "bytes")).alias("in"))  # at most one per band
    need = materialise(per_class.join(classes.select("cid", "t1", "t2", "n_docs"), "cid"), "needed")

    texts = possible_members(docs.select(*text_keys(text), F.col(text).alias("text")), "t1", need.select("t1"))
    texts = texts.dropDuplicates(["t1", "t2"]).join(need, ["t1", "t2"])  # copies collapse before the shuffle
    blocks = F.ceil(F.greatest(F.col("i.m") / BLOCK_CLASSES, F.col("i.bytes") / BLOCK_BYTES)).cast("int")
    placed = texts.select("text", "cid", "n_docs", F.transform("in", lambda s: s["bucket"]).alias("kept"), F.explode("in").alias("i")).withColumn("blocks", blocks)
    placed = placed.withColumn("side", F.pmod(F.xxhash64("cid", "i.bucket"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(F.col("i.bucket").alias("bucket"), F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "cid", "n_docs", "kept", "text")
    placed = placed.withColumn("key", F.xxhash64("bucket", "lo", "hi"))
    dealt = placed.repartition(shuffle_parts(spark), "key").sortWithinPartitions("key", "bucket", "lo", "hi", "cid")
    with small_batches(spark):
        found = materialise(dealt.mapInArrow(_verify(shingle, threshold), _FOUND), "found")

    roots = components(found.filter("is_edge").select("a", "b"))
    links = found.filter("not is_edge").groupBy(F.col("a").alias("cid")).agg(F.sum("doc_links").alias("doc_links"))
    rooted = materialise(roots.withColumnRenamed("node", "cid").join(classes.select("cid", "low_id"), "cid").select("cid", "root", "low_id"), "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("low_id").alias("class_id"), F.count(F.lit(1)).alias("jn_rows")), "roots")
    linked = many_to_one(rooted.select("cid", "root"), least, ["root"]).join(links, "cid", "left")
    # classes that need more than their own row: copies or links
    info = classes.select("cid", "s1", "s2", "n_docs", "low_id").join(linked, "cid", "left").filter((F.col("n_docs") > 1) | F.col("root").isNotNull())
    info = info.select("s1", "s2", F.coalesce("root", "cid").alias("class_key"), F.when(F.col("root").isNull(), F.col("low_id")).otherwise(F.col("class_id")).alias("class_id"), (F.col("n_docs") - 1 + F.coalesce("doc_links", F.lit(0))).alias("n_links"), F.col("n_docs").alias("jn_rows"))
    out = many_to_one(signed.select("doc_id", "k1", "k2", "s1", "s2"), materialise(info, "info"), ["s1", "s2"], "left")
    return out.select("doc_id", "k1", "k2", "class_key", F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def text_keys(text: str) -> list[Column]:
    """128 bits that name a text; null and empty are one."""
    body = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(body).alias("t1"), F.xxhash64(F.lit("text"), body).alias("t2")]


def row_keys(docs: DataFrame, text: str, doc_id: str) -> list[Column]:
    """128 bits that name an id (null unlike any) with its text."""
    body, rid = F.coalesce(F.col(text), F.lit("")), F.col(doc_id)
    return [F.xxhash64(rid, rid.isNull(), body).alias("k1"), F.xxhash64(body, rid, rid.isNull(), F.lit("row")).alias("k2")]


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the least id (null last), then the least key of id and text.

    Rows equal in id and text are copies even where other columns differ. Documents alone stay where
    they are; only the possible members of groups, found by a Bloom filter, are shuffled.
    """
    marked = materialise(near_join(docs, text, doc_id).filter(F.col("class_key").isNotNull()).select("class_key", "doc_id", "k1", "k2"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2")
    first = marked.groupBy("class_key").agg(F.min(order).alias("o")).select("o.k1", "o.k2", F.lit(True).alias("stays"))
    rows = marked.select("k1", "k2").distinct().join(first, ["k1", "k2"], "left").select("k1", "k2", F.coalesce("stays", F.lit(False)).alias("stays"))
    rows = materialise(rows, "grouped")
    keyed = possible(docs.select(as_row(docs).alias("row"), *row_keys(docs, text, doc_id)), "k1", rows.select("k1"))
    maybe = keyed.filter("bf_maybe").drop("bf_maybe").dropDuplicates(["k1", "k2"])  # repeated rows collapse before the shuffle
    chosen = maybe.join(rows, ["k1", "k2"], "left").filter(F.coalesce("stays", F.lit(True)))
    return keyed.filter("not bf_maybe").select("row.*").unionByName(chosen.select("row.*"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_join(docs).select("doc_id", "class_id", "n_links")
