"""A corpus from raw documents: quality rules, toxicity, near duplicates, decontamination, packing.

Every stage takes and (but for the last) returns rows with the columns of ``documents``. A null or empty text has no
words, so the quality stage rejects it; a null source is a host of its own. Null or repeated ids are rows
like any other: the near-duplicate stage keeps one row of equal id and text, and of a group the least id (null last), then
the least key of id and text. Without usable labels nothing is toxic; without benchmark items nothing is
contaminated. Empty tables give empty tables. Other columns than doc_id, text, source and n_chars pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contamination, verdict
from tessera.llm.nearjoin import one_of_each
from tessera.llm.packing import pack
from tessera.llm.quality import quality_rules
from tessera.llm.scratch import discard, fresh_path, materialise
from tessera.llm.toxicity import toxicity


def _packed(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that a stage works on, and all others in one struct, so that no name can clash with the operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, (F.struct(*rest) if rest else F.lit(None)).alias("rest"))


def _unpacked(df: DataFrame, docs: DataFrame, *used: str) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return df.select(*[F.col(c) if c in used else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are too frequent on their host are cut; documents rejected by the rules go."""
    judged = quality_rules(_packed(docs, "text", "source"), with_text="clean").filter("kept")
    kept = _unpacked(judged, docs, "text", "source")
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the labels come from the ``labels`` table."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _unpacked(toxicity(_packed(docs, "doc_id", "text"), labels).filter("toxic_predicted = 0"), docs, "doc_id", "text")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words or more go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(_packed(docs, "doc_id", "text"), items)
    return _unpacked(found.filter(~verdict(F.col("contamination"))["contaminated"]), docs, "doc_id", "text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every remaining document with its sequence and offset."""
    return pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The trained classifier, the similarity join and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        docs = materialise(stage(spark, docs, sf_dir), name, path)
        if before:  # nothing reads the stage before any more
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
