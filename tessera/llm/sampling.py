"""A bounded sample by hash, without gathering candidates from every partition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 1 << 31
#: So many more rows than wanted are let through on average; the caller keeps the wanted ones with the least hashes.
MARGIN = 1.1


def hash_of(key: str, salt: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(_RANGE))


def limit_of(wanted: int, total: int) -> int:
    """About ``wanted`` of ``total`` hashes are below it."""
    return int(min(1.0, MARGIN * wanted / max(total, 1)) * _RANGE)


def in_sample(key: str, salt: str, wanted: int, total: int) -> Column:
    """Whether a row is among about ``wanted`` of ``total`` rows, the same ones at every run."""
    return hash_of(key, salt) < limit_of(wanted, total)
