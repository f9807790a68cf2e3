"""Packing by best-fit decreasing.

Overlong documents are cut into full windows. The rest goes to the tightest open window, longest
first. Equal lengths are interchangeable, so the decisions depend on the corpus only through the
number of pieces of each length: the plan is made on the driver from that table (at most one row
per length) with a segment tree indexed by remaining capacity, whose entries are batches of equal
windows. Every piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import as_row
from .pretokens import encoder, token_ids
from .scratch import materialise
from .words import release_memory, slices

WINDOW = 2048
END_ID = 1
#: Pieces of one length are ranked in hash groups of about this size.
GROUP_ROWS = 1_000_000
PIECES = "array<struct<start:bigint,length:bigint,ids_crc32:bigint,doc_tokens:bigint>>"
_PIECES = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]))
_PLACE = pa.struct([("sequence_id", pa.int64()), ("offset", pa.int64())])


def tokenizer_path() -> str:
    """The public byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks_path() -> str:
    """The same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _cut_udf(json_path: str, ranks: str | None, window: int, end_id: int):
    @F.arrow_udf(PIECES)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        end = np.array([end_id], "<u4")
        for text in batches:
            if isinstance(text, pa.ChunkedArray):
                text = text.combine_chunks()
            out = []
            for a, b in slices(text, 1 << 20):
                for ids in token_ids(text.slice(a, b - a), json_path, ranks):
                    ids = np.concatenate((ids.astype("<u4"), end))
                    n = len(ids)
                    out.append([{"start": s, "length": min(window, n - s), "ids_crc32": zlib.crc32(ids[s : s + window].tobytes()), "doc_tokens": n} for s in range(0, n, window)])
            yield pa.array(out, _PIECES)
            del out, text
            release_memory()
        encoder.cache_clear()  # the worker lives on, into tasks that need no tokenizer
        release_memory()

    return cut


class CapacityTree:
    """Segment tree over remaining capacities: the least capacity of at least x with an open window."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.count[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.count[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_plan(counts: dict[int, int], window: int = WINDOW) -> tuple[dict[str, np.ndarray], int]:
    """Best-fit decreasing over ``counts`` pieces of each length.

    Returns placement rows (length, first rank, first sequence, pieces in a row per sequence,
    offset of the first) in order of (length, rank), and the number of sequences. A row covers
    ranks up to the next row of its length. Its size depends on the window, not on the corpus.
    """
    tree, open_at, rows, sequences = CapacityTree(window), {}, [], 0
    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                first, n, room = sequences, -(-left // (window // length)), window
                sequences += n
            else:
                first, n = open_at[room].pop()
                tree.add(room, -n)
            # one after the other: a window stays the tightest until it takes no more of this length
            each = room // length
            full = min(n, left // each)
            if full:
                rows.append((length, rank, first, each, window - room))
                rank, left = rank + full * each, left - full * each
                if rest := room - each * length:
                    open_at.setdefault(rest, []).append((first, full))
                    tree.add(rest, full)
            if left and full < n:
                rows.append((length, rank, first + full, left, window - room))
                if rest := room - left * length:
                    open_at.setdefault(rest, []).append((first + full, 1))
                    tree.add(rest, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < n:
                open_at.setdefault(room, []).append((first + full, n - full))
                tree.add(room, n - full)
    rows.sort()
    names = ("length", "rank", "sequence", "each", "offset")
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(names)}, sequences


def _place_udf(plan: dict[str, np.ndarray]):
    """(length, rank) to (sequence_id, offset); the plan's size is bounded by the window."""

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = np.asarray(length), np.asarray(rank)
        first = np.searchsorted(plan["length"], n)
        last = np.searchsorted(plan["length"], n, side="right")
        while (wide := first + 1 < last).any():  # binary search by rank inside the rows of the length
            mid = (first + last) // 2
            up = wide & (plan["rank"][np.minimum(mid, len(plan["rank"]) - 1)] <= r)
            first, last = np.where(up, mid, first), np.where(wide & ~up, mid, last)
        k = r - plan["rank"][first]
        each = plan["each"][first]
        return pa.StructArray.from_arrays([pa.array(plan["sequence"][first] + k // each), pa.array(plan["offset"][first] + (k % each) * n)], fields=list(_PLACE))

    return place


def _groups(counts: dict[int, int]) -> list[tuple[int, int]]:
    """(length, hash groups that its pieces are ranked in): about GROUP_ROWS pieces in each."""
    return [(length, -(-n // GROUP_ROWS)) for length, n in sorted(counts.items())]


def pack(docs: DataFrame, text: str = "text", window: int = WINDOW, end_id: int = END_ID, json_path: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: the columns of ``docs`` but the text, and start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document is its token ids and ``end_id``; a null or empty text is the end id alone. Each
    token lies in exactly one piece; pieces of a sequence follow each other from offset 0 without
    gaps, at most ``window`` tokens in all. Repeated rows are packed each; ties between pieces of
    equal length are broken by place in the table. Columns of ``docs`` named like the result are
    dropped.
    """
    if json_path is None:
        json_path, ranks = tokenizer_path(), ranks_path()
    spark = docs.sparkSession
    made = {"start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    keep = docs.select(*[f"`{c}`" for c in docs.columns if c != text and c.lower() not in made])
    cut = docs.select(as_row(keep).alias("row") if keep.columns else F.lit(None).cast("struct<none:int>").alias("row"), _cut_udf(json_path, ranks, window, end_id)(F.col(text)).alias("pieces"))
    pieces = materialise(cut.select("row", F.inline("pieces")).withColumn("place", F.xxhash64(F.monotonically_increasing_id())), "pieces")

    totals = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most a row per length
    plan, _ = best_fit_plan(totals, window)
    groups = F.broadcast(spark.createDataFrame(_groups(totals), "length bigint, n_groups bigint"))
    grouped = pieces.join(groups, "length").withColumn("part", F.pmod("place", "n_groups"))
    sizes = grouped.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # a row per GROUP_ROWS pieces and one per length
    inside = Window.partitionBy("length", "part").orderBy("place", "ids_crc32", "start", "doc_tokens")
    ranked = grouped.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(offsets), ["length", "part"])
    if totals:
        placed = ranked.withColumn("at", _place_udf(plan)(F.col("length"), F.col("rank") + F.col("first")))
    else:
        placed = ranked.withColumn("at", F.lit(None).cast("struct<sequence_id:bigint,offset:bigint>"))
    return placed.select(*[F.col(f"row.`{c}`") for c in keep.columns], "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs)
