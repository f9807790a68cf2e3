"""SQL functions and table functions of the library, for use in spark.sql."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="label: int, begin: int, end: int, n: int")
class TrackRuns:
    """Runs of consecutive frames of a label: TABLE(...) of (label, frame), partitioned by label and ordered by frame."""

    def __init__(self):
        self.run: list[int] | None = None

    def eval(self, row: Row) -> Iterator[tuple]:
        label, frame = row["label"], row["frame"]
        if self.run is not None and frame <= self.run[2]:
            return
        if self.run is not None and frame == self.run[2] + 1:
            self.run[2] = frame
            return
        if self.run is not None:
            yield self.run[0], self.run[1], self.run[2], self.run[2] - self.run[1] + 1
        self.run = [label, frame, frame]

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            yield self.run[0], self.run[1], self.run[2], self.run[2] - self.run[1] + 1


#: Scalar and table functions written in SQL itself, so that the optimizer sees through them.
FUNCTIONS = (
    r"""CREATE OR REPLACE TEMPORARY FUNCTION natural_key(name STRING) RETURNS ARRAY<STRING>
        RETURN transform(regexp_extract_all(name, '(\\d+|\\D+)', 1), p -> CASE WHEN p RLIKE '^\\d'
          THEN concat('0', lpad(cast(length(regexp_replace(p, '^0+(?=.)', '')) AS STRING), 6, '0'), regexp_replace(p, '^0+(?=.)', '')) ELSE concat('1', lower(p)) END)""",
    r"""CREATE OR REPLACE TEMPORARY FUNCTION ctc_digits(name STRING) RETURNS INT
        RETURN nullif(length(regexp_extract(name, '(?i)^(mask|t|man_track|man_seg)(\\d+)\\.tiff?$', 2)), 0)""",
    r"""CREATE OR REPLACE TEMPORARY FUNCTION fmt_g12(value DOUBLE) RETURNS STRING
        RETURN (SELECT CASE WHEN isnan(value) THEN 'nan' WHEN abs(value) = double('inf') THEN CASE WHEN value > 0 THEN 'inf' ELSE '-inf' END ELSE concat(sign, rtrim('.', CASE
            WHEN power < -4 OR power >= 12 THEN concat(rtrim('.', rtrim('0', concat(left(digits, 1), '.', substring(digits, 2)))), CASE WHEN power < 0 THEN 'e-' ELSE 'e+' END, lpad(abs(power), greatest(length(abs(power)), 2), '0'))
            WHEN power >= 0 THEN rtrim('0', concat(left(digits, power + 1), '.', substring(digits, power + 2)))
            ELSE rtrim('0', concat('0.', repeat('0', -power - 1), digits, '0')) END)) END
          FROM (SELECT replace(replace(substring_index(said, 'e', 1), '.'), '-') AS digits, try_cast(substring_index(said, 'e', -1) AS INT) AS power, CASE WHEN said LIKE '-%' THEN '-' ELSE '' END AS sign
                FROM (SELECT format_string('%.11e', value) AS said)))""",
    r"""CREATE OR REPLACE TEMPORARY FUNCTION dilate3(y INT, x INT) RETURNS TABLE (ny INT, nx INT)
        RETURN SELECT y + dy, x + dx FROM VALUES (-1), (0), (1) AS a(dy) CROSS JOIN VALUES (-1), (0), (1) AS b(dx) WHERE y + dy >= 0 AND x + dx >= 0""",
)


def register(spark: SparkSession) -> None:
    """natural_key, ctc_digits, fmt_g12, dilate3 (of one pixel) and track_runs, in the session [§2.13]."""
    for text in FUNCTIONS:
        spark.sql(text)
    spark.udtf.register("track_runs", TrackRuns)
