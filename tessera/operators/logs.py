"""Metric logs: sectioned text to penalties, objects and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Titles of the known sections of tracking and detection logs, in log order.
SECTIONS = {
    "TRA": ("Splitting Operations", "False Negative Vertices", "False Positive Vertices", "Redundant Edges To Be Deleted", "Edges To Be Added", "Edges with Wrong Semantics"),
    "DET": ("Splitting Operations", "False Negative Vertices", "False Positive Vertices"),
}
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def _words(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def _between_dashes(line: Column) -> Column:
    """What a ruled line says between its dashes ('' for a plain rule); null where a line isn't ruled at both ends."""
    return F.when(line.startswith("-") & line.endswith("-") & (F.length(line) > 1), F.trim(F.btrim(line, F.lit("-"))))


def _value(word: Column, name: str, kind: str) -> Column:
    """The value of a word 'name=value'; null where it has another name or isn't of the kind."""
    return F.when(word.startswith(f"{name}="), F.substring(word, len(name) + 2, 64)).try_cast(kind)


def _section(line: Column) -> Column:
    """(title, penalty) of a section's header: dashes, a title, maybe its penalty in brackets, dashes."""
    said = _between_dashes(line)
    penalty = F.when(said.endswith(")") & said.contains("(Penalty="), F.rtrim(F.substring_index(said, "(Penalty=", -1), F.lit(")")))
    title = F.when(penalty != "", F.trim(F.substring_index(said, "(Penalty=", 1))).otherwise(said)
    return F.when(said.isNotNull(), F.struct(title.alias("title"), penalty.alias("penalty")))


def _fill(column: Column, order: str = "line_no") -> Column:
    return F.last(column, ignorenulls=True).over(Window.partitionBy("seq").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def penalties(lines: DataFrame, metric: str = "TRA") -> DataFrame:
    """Lines per known section, its penalty and their product [O-11, O-84, O-107, Q24].

    ``lines``: (seq, line_no, value). A section runs from its header to the next header or a line of
    '='; blank lines don't count, repeated lines do. Known sections without lines count 0; an
    unreadable or absent penalty gives a null product.
    """
    v = F.trim("value")
    start = F.coalesce(_section(v), F.when(v.startswith("="), F.struct(F.lit("").alias("title"), F.lit(None).cast("string").alias("penalty"))))
    marked = lines.withColumns({"head": start, "v": v}).withColumn("section", _fill(F.col("head")))
    counted = marked.filter("head is null and v <> ''").groupBy("seq", F.col("section.title").alias("section")).agg(F.count(F.lit(1)).alias("n"))
    weights = marked.filter("head is not null").groupBy("seq", F.col("head.title").alias("section")).agg(F.max_by(F.expr("try_cast(head.penalty AS DOUBLE)"), "line_no").alias("penalty"))
    known = lines.select("seq").distinct().select("seq", F.explode(F.array(*[F.lit(s) for s in SECTIONS[metric]])).alias("section"))
    out = known.join(weights, ["seq", "section"], "left").join(counted, ["seq", "section"], "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("seq", F.lit(metric).alias("metric"), "section", "penalty", n.alias("count"), (F.col("penalty") * n).alias("weighted"))


def official_score(lines: DataFrame, metric: str) -> DataFrame:
    """The last '<metric> measure: x' of every log [O-11]."""
    line, words = F.lower(F.array_join(_words(F.col("value")), " ")), f"{metric.lower()} measure:"
    before, after = F.substring_index(line, words, 1), F.substring_index(line, words, -1)
    said = line.contains(words) & ~before.rlike("[0-9a-z_]$")
    found = lines.filter(said).select("seq", "line_no", F.get(F.split(F.trim(after), " "), 0).try_cast("double").alias("score"))
    return found.filter("score is not null").groupBy("seq").agg(F.max_by("score", "line_no").alias("score"))


def free_score(text: Column) -> Column:
    """The last number anywhere in a text [O-13]."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), 0), F.lit(-1)).try_cast("double") if hasattr(Column, "try_cast") else F.element_at(F.regexp_extract_all(text, F.lit(NUMBER), 0), -1).cast("double")


def seg_objects(lines: DataFrame) -> DataFrame:
    """(seq, t, z, gt_label, jaccard): frame headers carried down to the object lines; z is null where a header has none [O-12, O-107]."""
    said = _words(_between_dashes(F.trim("value")))
    t, z = _value(F.get(said, 0), "T", "int"), _value(F.get(said, 1), "Z", "int")
    head = F.when(t.isNotNull() & ((F.size(said) == 1) | ((F.size(said) == 2) & z.isNotNull())), F.struct(t.alias("t"), z.alias("z")))
    words = _words(F.col("value"))
    label, jaccard = _value(F.get(words, 0), "GT_label", "int"), _value(F.get(words, 1), "J", "double")
    marked = lines.withColumn("head", head).withColumn("frame", _fill(F.col("head")))
    objects = marked.filter((F.size(words) == 2) & label.isNotNull() & jaccard.isNotNull())
    return objects.select("seq", "frame.t", "frame.z", label.alias("gt_label"), jaccard.alias("jaccard"))


def seg_summary(objects: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Objects, those below the threshold, those at 0, and the least Jaccard [O-85]."""
    return objects.groupBy("seq").agg(
        F.count(F.lit(1)).alias("objects"),
        F.count_if(F.col("jaccard") < threshold).alias("low"),
        F.count_if(F.col("jaccard") == 0).alias("zero"),
        F.min("jaccard").alias("min_jaccard"),
    )


def aogm_score(penalty_rows: DataFrame, tracks: DataFrame, metric: str = "TRA") -> DataFrame:
    """1 - sum of penalties / cost of building the graph from nothing (vertex 10, edge 1.5)."""
    n = tracks.groupBy("seq").agg(F.sum(F.col("end") - F.col("begin") + 1).alias("vertices"), F.sum(F.col("end") - F.col("begin")).alias("inner"), F.count_if(F.col("parent") != 0).alias("links"))
    cost = F.col("vertices") * 10.0 + ((F.col("inner") + F.col("links")) * 1.5 if metric == "TRA" else F.lit(0.0))
    total = penalty_rows.groupBy("seq").agg(F.sum("weighted").alias("weighted"))
    return total.join(n, "seq").select("seq", (1 - F.least(F.col("weighted"), cost) / cost).alias("score"))
