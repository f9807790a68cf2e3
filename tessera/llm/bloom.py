"""Blocked Bloom filters as tables: one row per 512-bit block, eight 64-bit words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
WORDS = 8
#: Most bytes of a filter, so that it can always be broadcast. With more keys than fit at BITS_PER_KEY it
#: lets more false positives through, which the exact join behind it removes.
BROADCAST_BYTES = 32 << 20


def blocks_for(keys: int) -> int:
    """Blocks of a filter for so many keys, within BROADCAST_BYTES."""
    return max(1, min(-(-keys * BITS_PER_KEY // (64 * WORDS)), BROADCAST_BYTES // (8 * (WORDS + 1))))


def block_of(key: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def key_bits(key: str) -> list[Column]:
    """One bit in each of the block's words, from slices of a second hash."""
    return [F.expr(f"shiftleft(1L, cast(shiftright(xxhash64({key}, 'bits'), {6 * j}) & 63 AS INT))") for j in range(WORDS)]


def bloom_table(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """Rows (bf_block, bf_w0 … bf_w7): each key touches one block, one bit per word."""
    rows = keys.select(block_of(key, blocks).alias("bf_block"), *[b.alias(f"bf_w{j}") for j, b in enumerate(key_bits(key))])
    return rows.groupBy("bf_block").agg(*[F.bit_or(f"bf_w{j}").alias(f"bf_w{j}") for j in range(WORDS)])


def holds(key: str) -> Column:
    """Whether the joined block has all bits of the key (null without a block)."""
    out = F.lit(True)
    for j, b in enumerate(key_bits(key)):
        out = out & (F.col(f"bf_w{j}").bitwiseAND(b) != 0)
    return out


def possible(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``df`` with ``bf_maybe``: false only where the row's key (from a column ``key`` of both) is none of ``keys``.

    No shuffle of ``df``: the filter's size is bounded and it is broadcast.
    """
    blocks = blocks_for(keys.count())
    table = F.broadcast(bloom_table(keys, key, blocks))
    probed = df.withColumn("bf_block", block_of(key, blocks)).join(table, "bf_block", "left")
    return probed.select(*df.columns, F.coalesce(holds(key), F.lit(False)).alias("bf_maybe"))


def possible_members(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key may be among ``keys``: none that is gets lost."""
    return possible(df, key, keys).filter("bf_maybe").drop("bf_maybe")
