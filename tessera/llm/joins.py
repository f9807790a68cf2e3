"""Joins to a table of one row per key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than 1 / MOST_HOT of all rows: no more keys than this can be.
MOST_HOT = 10_000
#: A key with fewer rows is never hot.
LEAST_ROWS = 1000


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: str = "jn_rows") -> DataFrame:
    """``left`` joined to ``right``, which has one row per key and in ``rows`` how many rows of ``left`` (or more) have it.

    Rows of hot keys stay where they are: at most MOST_HOT keys can be hot, so these are broadcast
    whatever the size. The others are joined as the optimizer likes, no key of them above its share.
    ``rows`` is dropped. Both sides are read more than once: give scans, or what is cheap.
    """
    total, most = right.agg(F.sum(rows), F.max(rows)).first()
    limit = max(LEAST_ROWS, (total or 0) // MOST_HOT)
    if most is None or most <= limit:
        return left.join(right.drop(rows), on, how)
    hot = F.broadcast(right.filter(F.col(rows) > limit).drop(rows))
    near = left.join(hot, on)
    rest = left.join(hot.select(*on), on, "left_anti").join(right.filter(F.col(rows) <= limit).drop(rows), on, how)
    return near.unionByName(rest)


def as_row(df: DataFrame) -> Column:
    """All columns as one struct, so that the operator's own names can't clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])
