"""Sharding by histogram sort: near-equal bytes, equal texts together, one exchange.

Rows are ordered by the hash of their text. Exact byte counts below candidate boundaries are gathered as
histograms over hash prefixes; only the bins that hold a wanted splitter are probed again, with the
next bits, until each splitter is within tolerance or at the edge of one text's copies. Texts whose copies
weigh more than a share of a shard are placed first, whole, each in the emptiest shard; the splitters then
share out the rest. Then every row knows its shard, and one exchange brings the rows together.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import as_row
from .scratch import materialise

SHARDS = 40
OVERHEAD = 16
#: Splitters may miss their exact place by this share of a shard.
TOLERANCE = 0.002
#: Copies of a text that weigh more than this share of a shard are placed before the rest: no more than shards / HEAVY texts can.
HEAVY = 0.01
BITS = 12
#: A shard is sorted in pieces of about this size, and in this many at least.
PIECE_BYTES = 64 << 20
LEAST_PIECES = 4
_LOW = -(1 << 63)


def _keys(df: DataFrame, text: str, id_column: str | None, with_text: bool) -> DataFrame:
    """hs_size, hs_k1 (equal texts share it) and hs_k2 (spreads equal texts by id)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rid = F.xxhash64(F.col(id_column), F.lit("row")) if id_column else F.xxhash64(F.lit("row"))
    kept = df if with_text else df.drop(text)
    row = F.struct(*[df[f"`{c}`"] for c in kept.columns]) if kept.columns else F.lit(None).cast("struct<none:int>")
    return df.select(row.alias("row"), (F.octet_length(body) + OVERHEAD).cast("long").alias("hs_size"), F.xxhash64(body).alias("hs_k1"), rid.alias("hs_k2"))


class Cut:
    """A wanted splitter: about ``target`` bytes below it, within ``slack``. ``atom``: inside the copies of one text."""

    def __init__(self, target: float, slack: float, atom: int = 0):
        self.target, self.slack, self.atom = target, slack, atom
        self.prefix, self.below, self.settled, self.value = 0, 0, False, 0

    def narrow(self, bins: list[tuple[int, int, int]], width: int, shift: int) -> None:
        """Take the bin that the target falls into, or settle on one of its borders."""
        run, at, size, rows = self.below, None, 0, 0
        for b, s, n in bins:
            if run + s > self.target:
                at, size, rows = b, s, n
                break
            run += s
        if at is None:  # all bytes lie below the target: after the last bin
            self.settle((self.prefix << width) + (bins[-1][0] + 1 if bins else 0), shift)
            return
        full = (self.prefix << width) | at
        low, high = self.target - run, run + size - self.target
        if low <= self.slack or high <= self.slack or rows == 1 or shift == 0:
            self.settle(full if low <= high else full + 1, shift)
        else:
            self.prefix, self.below = full, run

    def settle(self, prefix: int, shift: int) -> None:
        self.value, self.settled = _as_signed(prefix, shift), True


def _probe(rows: DataFrame, key: str, cuts: list[Cut], atom: Column) -> None:
    """Settle every cut on ``key``, a few bits of it at a time.

    Each round counts the bytes of every live bin exactly: partial sums on the executors, then one
    row per bin, at most cuts x 2**BITS rows.
    """
    bits = F.col(key).bitwiseXOR(F.lit(_LOW))  # signed order as the order of bit strings
    depth = 0
    while live := [c for c in cuts if not c.settled]:
        width = min(BITS, 64 - depth)
        shift = 64 - depth - width
        prefix = F.shiftrightunsigned(bits, 64 - depth) if depth else F.lit(0).cast("long")
        probed = rows.filter(atom.isin(sorted({c.atom for c in live})) & prefix.isin(sorted({_signed(c.prefix) for c in live})))
        sub = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        bins: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        counted = probed.groupBy(atom.alias("a"), prefix.alias("p"), sub.alias("b")).agg(F.sum("hs_size").alias("s"), F.count(F.lit(1)).alias("n"))
        for r in counted.collect():
            bins.setdefault((r.a, r.p), []).append((r.b, r.s, r.n))
        for b in bins.values():
            b.sort()
        for c in live:
            c.narrow(bins.get((c.atom, _signed(c.prefix)), []), width, shift)
        depth += width


def _signed(x: int) -> int:
    return x if x < 1 << 63 else x - (1 << 64)


def _as_signed(prefix: int, shift: int) -> int:
    """The least key with this prefix, as a signed value (one past the last key stays the last)."""
    return min(prefix << shift, (1 << 64) - 1) + _LOW


def place_heavy(groups: dict[int, int], shards: int, share: float) -> tuple[dict[int, list[int]], list[float]]:
    """Shards of every heavy text, and the bytes that they put into each shard.

    The largest first, each whole into the emptiest shard. A text that outweighs a shard is cut into the
    fewest equal parts that don't, each placed so.
    """
    parts = sorted(((size / n, k) for k, size in groups.items() for n in [max(1, math.ceil(size / share))] for _ in range(n)), key=lambda p: (-p[0], p[1]))
    load, heap, where = [0.0] * shards, [(0.0, s) for s in range(shards)], {}
    for size, k in parts:
        used, s = heapq.heappop(heap)
        where.setdefault(k, []).append(s)
        load[s] = used + size
        heapq.heappush(heap, (load[s], s))
    return where, load


def rooms(load: list[float], total: float) -> list[float]:
    """Bytes of the other rows that each shard takes, so that the shards end as level as they can."""
    rest, level = total - sum(load), 0.0
    order = sorted(load)
    for i, x in enumerate(order, 1):  # water level over the i emptiest shards
        level = (rest + sum(order[:i])) / i
        if i == len(order) or level <= order[i]:
            break
    return [max(0.0, level - x) for x in load]


def _lookup(spark, splitters: list[int], name: str) -> DataFrame:
    """A row for each of the 2**BITS prefixes: the splitters inside it, sorted, and how many lie below it."""
    inside: dict[int, list[int]] = {}
    for k in sorted(splitters):
        inside.setdefault((k - _LOW) >> (64 - BITS), []).append(k)
    rows, below = [], 0
    for prefix in range(1 << BITS):
        rows.append((prefix, below, inside.get(prefix, [])))
        below += len(inside.get(prefix, []))
    return spark.createDataFrame(rows, f"hs_prefix int, {name}_below int, {name}_cuts array<bigint>")


def _at_or_above(cuts: Column, key: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= key))


def histogram_shards(df: DataFrame, shards: int = SHARDS, text: str = "text", id_column: str | None = "doc_id", tolerance: float = TOLERANCE, with_text: bool = True) -> DataFrame:
    """``df`` (without ``with_text``: all but the text, which then isn't shuffled) with hs_size, hs_shard (0 to shards - 1) and hs_slot (gapless from 0 in each shard).

    A row counts its text's UTF-8 bytes (null: none) plus 16. Equal texts are in one shard, unless
    their bytes outweigh a whole shard: then they are parted by id into the fewest equal parts that
    don't. Shards hold near-equal bytes: texts above HEAVY of a shard go to the emptiest shards first, and the
    rest levels them, each border within half of HEAVY or ``tolerance`` of a shard from its exact place (more only
    where single rows, or too few others, leave no choice). Repeated rows (same id and text) stay together. Null and empty
    texts are equal. Columns of ``df`` with these three names are replaced.
    """
    spark = df.sparkSession
    made = {"hs_size", "hs_shard", "hs_slot"}
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in made])
    keyed = _keys(df, text, id_column, with_text)
    probes = materialise(keyed.select("hs_size", "hs_k1", "hs_k2"), "probes")
    total = probes.agg(F.sum("hs_size")).first()[0] or 0
    share = total / shards
    weights = probes.groupBy("hs_k1").agg(F.sum("hs_size").alias("w")).filter(F.col("w") > HEAVY * share)
    groups = {r.hs_k1: r.w for r in weights.collect()}  # at most shards / HEAVY
    where, load = place_heavy(groups, shards, share) if groups else ({}, [0.0] * shards)
    parted = [(k, s) for k, s in where.items() if len(s) > 1]
    cuts = [Cut(groups[k] * i / len(s), tolerance * share, k) for k, s in parted for i in range(1, len(s))]
    _probe(probes.filter(F.col("hs_k1").isin([k for k, _ in parted])), "hs_k2", cuts, F.col("hs_k1"))
    inner_cuts: dict[int, list[int]] = {}
    for c in cuts:
        inner_cuts.setdefault(c.atom, []).append(c.value)
    heavy = spark.createDataFrame([(k, s, sorted(inner_cuts.get(k, []))) for k, s in where.items()], "hs_k1 bigint, hs_in array<int>, hs_parts array<bigint>")
    heavy = F.broadcast(heavy)

    room = rooms(load, total)
    pieces = max(LEAST_PIECES, math.ceil(share / PIECE_BYTES))
    piece_bits = max(BITS, math.ceil(math.log2(pieces * shards)))  # hashes are even, so equal ranges of them are
    ends = [sum(room[: i + 1]) for i in range(shards)]
    borders = [Cut(x, tolerance * share) for x in ends[:-1]]
    if total:
        light = probes.join(heavy, "hs_k1", "left_anti") if groups else probes
        _probe(light, "hs_k1", borders, F.lit(0))
    order = F.col("hs_k1").bitwiseXOR(F.lit(_LOW))
    prefix = F.shiftrightunsigned(order, 64 - BITS).cast("int")
    lookup = F.broadcast(_lookup(spark, [c.value for c in borders], "b"))
    placed = keyed.withColumn("hs_prefix", prefix).join(lookup, "hs_prefix").join(heavy, "hs_k1", "left")
    part = _at_or_above(F.col("hs_parts"), F.col("hs_k2"))
    placed = placed.withColumns(
        {
            "hs_shard": F.when(F.col("hs_in").isNotNull(), F.get("hs_in", part)).otherwise(F.col("b_below") + _at_or_above(F.col("b_cuts"), F.col("hs_k1"))).cast("int"),
            # copies of heavy texts are sorted apart from the rest, dealt by id
            "hs_piece": F.when(F.col("hs_in").isNotNull(), -1 - F.pmod(F.xxhash64("hs_k1", "hs_k2"), F.lit(pieces))).otherwise(F.shiftrightunsigned(order, 64 - piece_bits)),
        }
    ).select("row", "hs_size", "hs_k1", "hs_k2", "hs_shard", "hs_piece")
    counts = placed.groupBy("hs_shard", "hs_piece").agg(F.count(F.lit(1)).alias("hs_n"))
    before = Window.partitionBy("hs_shard").orderBy("hs_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("hs_shard", "hs_piece", F.coalesce(F.sum("hs_n").over(before), F.lit(0)).alias("hs_before"))
    inside = Window.partitionBy("hs_shard", "hs_piece").orderBy("hs_k1", "hs_k2")
    ranked = placed.withColumn("hs_rank", F.row_number().over(inside) - 1)
    out = ranked.join(offsets, ["hs_shard", "hs_piece"])  # dealt by these already
    return out.select("row.*", "hs_size", "hs_shard", (F.col("hs_rank") + F.col("hs_before")).cast("long").alias("hs_slot"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    out = histogram_shards(docs, with_text=False)
    return out.select("doc_id", F.col("hs_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("hs_shard").alias("shard"), F.col("hs_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
