"""Label masks derived from a line-item table, so that every operator has rows to run on.

The rules are deterministic arithmetic: ground truth and result masks of twelve objects that drift,
divide, vanish, merge, split, jump and switch identity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Order keys of one sequence: their number, and so the number of sequences, grows with the table.
KEYS_EACH = 1000
#: Rows of the table that one task turns into masks.
ROWS_EACH = 100_000


def _cells(lineitem: DataFrame, sequences: int | None) -> DataFrame:
    """Cells of objects; ``sequences`` deals them to so many sequences (None: a sequence for every KEYS_EACH order keys)."""
    if sequences is None:
        seq = F.format_string("%02d", 1 + F.floor(F.col("l_orderkey") / KEYS_EACH))
    else:
        seq = F.lpad((1 + F.floor(F.col("l_orderkey") / 20) % sequences).cast("string"), 5, "0")
    return lineitem.select(
        seq.alias("seq"),
        (F.col("l_orderkey") % 20).cast("int").alias("frame"),
        (1 + F.col("l_suppkey") % 12).cast("int").alias("obj"),
        (F.col("l_partkey") % 6).cast("int").alias("dy"),
        (F.col("l_quantity").cast("int") % 6).cast("int").alias("dx"),
    )


def _pixels(cells: DataFrame, pieces: int, label, x) -> DataFrame:
    """Whole frames lie in ``pieces`` partitions, so what is counted or moved inside a frame needs no second shuffle."""
    y = F.col("obj") * 5 + F.col("frame") % 3 + F.col("dy")
    dealt = cells.select("seq", "frame", y.alias("y"), x.alias("x"), label.alias("label")).repartition(pieces, "seq", "frame")
    return dealt.groupBy("seq", "frame", "y", "x").agg(F.min("label").alias("label"))


def _pieces(lineitem: DataFrame) -> int:
    """A task's share doesn't grow with the table, however well that is compressed."""
    return max(lineitem.sparkSession.sparkContext.defaultParallelism, lineitem.count() // ROWS_EACH)


def ground_truth(lineitem: DataFrame, sequences: int | None = None) -> DataFrame:
    """pixels(seq, frame, y, x, label) of the ground truth."""
    c = _cells(lineitem, sequences).filter("not (obj = 11 and frame = 2)")
    x = (F.col("obj") * 7) % 40 + F.col("frame") % 2 + F.col("dx")
    label = F.when((F.col("obj") % 4 == 0) & (F.col("frame") >= 12), F.col("obj") + 24).otherwise(F.col("obj"))
    return _pixels(c, _pieces(lineitem), label, x)


def results(lineitem: DataFrame, sequences: int | None = None) -> DataFrame:
    """pixels(seq, frame, y, x, label) of the tracking result."""
    c = _cells(lineitem, sequences).filter("not ((obj + frame) % 7 = 0) and not (obj = 2 and frame = 8 and dx >= 2)")
    x = (F.col("obj") * 7) % 40 + F.col("frame") % 2 + F.col("dx") + F.when((F.col("obj") == 4) & (F.col("frame") == 15), 80).otherwise(0)
    label = (
        F.when((F.col("obj") == 8) & F.col("frame").isin(3, 4), 7)
        .when((F.col("obj") == 10) & F.col("frame").isin(5, 6) & (F.col("dx") < 3), 40)
        .when((F.col("obj") % 3 == 0) & (F.col("frame") >= 10), F.col("obj") + 12)
        .otherwise(F.col("obj"))
    )
    return _pixels(c, _pieces(lineitem), label, x)


def segmentation(lineitem: DataFrame, sequences: int | None = None) -> DataFrame:
    """pixels(seq, frame, y, x, label) of outlines: the ground truth's objects, drawn one pixel further right."""
    return ground_truth(lineitem, sequences).withColumn("x", F.col("x") + 1)


#: The same masks in SQL, as common table expressions gt, res and seg.
SQL = """
cells AS (
  SELECT DISTINCT printf('%02d', CAST(1 + l_orderkey // 1000 AS INTEGER)) AS seq, CAST(l_orderkey % 20 AS INTEGER) AS frame,
         CAST(1 + l_suppkey % 12 AS INTEGER) AS obj, CAST(l_partkey % 6 AS INTEGER) AS dy, CAST(CAST(l_quantity AS INTEGER) % 6 AS INTEGER) AS dx
  FROM lineitem
), gt AS (
  SELECT seq, frame, CAST(obj * 5 + frame % 3 + dy AS INTEGER) AS y, CAST((obj * 7) % 40 + frame % 2 + dx AS INTEGER) AS x,
         CAST(min(CASE WHEN obj % 4 = 0 AND frame >= 12 THEN obj + 24 ELSE obj END) AS INTEGER) AS label
  FROM cells WHERE NOT (obj = 11 AND frame = 2) GROUP BY seq, frame, obj * 5 + frame % 3 + dy, (obj * 7) % 40 + frame % 2 + dx
), res AS (
  SELECT seq, frame, y, x, CAST(min(label) AS INTEGER) AS label FROM (
    SELECT seq, frame, CAST(obj * 5 + frame % 3 + dy AS INTEGER) AS y,
           CAST((obj * 7) % 40 + frame % 2 + dx + CASE WHEN obj = 4 AND frame = 15 THEN 80 ELSE 0 END AS INTEGER) AS x,
           CASE WHEN obj = 8 AND frame IN (3, 4) THEN 7 WHEN obj = 10 AND frame IN (5, 6) AND dx < 3 THEN 40
                WHEN obj % 3 = 0 AND frame >= 10 THEN obj + 12 ELSE obj END AS label
    FROM cells WHERE NOT ((obj + frame) % 7 = 0) AND NOT (obj = 2 AND frame = 8 AND dx >= 2)) t
  GROUP BY seq, frame, y, x
), seg AS (
  SELECT seq, frame, y, x + 1 AS x, label FROM gt
)"""
