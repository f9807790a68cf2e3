"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import capfilters, centroids, decontaminate, langid, licences, nearjoin, packing, quality, sharding, toxicity, urlfilter, warc

MODULES = {
    "op1_ngram_jaccard_join": nearjoin,
    "op2_warc": warc,
    "op3_licence_scan": licences,
    "op4_toxicity": toxicity,
    "op5_decontaminate": decontaminate,
    "op6_language_id": langid,
    "op7_histogram_shards": sharding,
    "op8_url_filter": urlfilter,
    "op9_quality_rules": quality,
    "op10_pack": packing,
    "op11_centroid_clustering": centroids,
    "op12_vector_near_dedup": capfilters,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name, m in MODULES.items() if getattr(m, "ORACLE", None)}
