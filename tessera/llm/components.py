"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import many_to_one
from .scratch import materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def _least(edges: DataFrame) -> DataFrame:
    """The least neighbour of every node and its number of edges."""
    return materialise(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("jn_rows")), "least")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; the root is the component's least node.

    Every round keeps the components and turns them further into stars (u > v, v towards the root);
    rounds grow with the logarithm of the component's size. Minima are pre-aggregated, and edges of a node
    with many of them meet its minimum where they are; each round is written to the shared folder.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = materialise(now, "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least(both).withColumn("m", F.least("u", "m"))
        large = many_to_one(both.filter("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")
        low = _least(large)
        moved = many_to_one(large, low, ["u"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
