"""Quality rules with cross-document line frequency (DataFrame functions only).

One pass over the texts gives every document's counts and the hashes of its lines, written once to the
shared folder; line frequencies, the lines that each document loses and the verdicts come from that table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import possible, possible_members
from .joins import as_row, many_to_one
from .scratch import materialise

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line is removed above both limits: documents of its host that hold it, and their share of the host's documents.
MIN_LINE_DOCS = 20
MAX_LINE_SHARE = 0.01
SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body`` (a lambda over a one-item array)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spaced(text: Column) -> Column:
    """White space as spaces; the regular expression runs only over texts with other white space than line ends."""
    return F.replace(F.when(text.rlike(r"[\x09\x0B-\x0D]"), F.regexp_replace(text, r"[\x09-\x0D]", " ")).otherwise(text), F.lit("\n"), F.lit(" "))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(_spaced(text), " "), "")


def normal_lines(text: Column) -> Column:
    """The text's lines in lower case, runs of white space as one space, trimmed; lines without a word are ''."""
    low = F.lower(text)
    even = F.when(low.rlike(r"[\x09\x0B-\x0D]|  "), F.regexp_replace(low, r"[\x20\x09\x0B-\x0D]+", " ")).otherwise(low)
    return F.transform(F.split(even, "\n"), lambda x: F.trim(x))


def _covered(windows: Column) -> Column:
    """Places that any window found more than once covers; ``windows`` are (hash, place), sorted."""
    hits = F.filter(windows, lambda x, j: (F.get(windows, j - 1)["h"] == x["h"]) | (F.get(windows, j + 1)["h"] == x["h"]))
    return _let(
        F.sort_array(F.transform(hits, lambda x: x["i"])),
        lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x),
    )


def with_counts(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with ``s``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines of a whole text.

    ``lines`` has (hash of the normalised line, its words) for every line that holds a word. Arrays that
    several results need are columns of a projection of their own, so that generated code evaluates each once. Columns named qr_* are reserved.
    """
    own = df.columns
    d = df.withColumn("qr_t", F.coalesce(text, F.lit("")))
    d = d.withColumns({"qr_w": words_of(F.col("qr_t")), "qr_l": F.filter(F.split("qr_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    last = F.when(F.size("qr_w") < 4, F.lit(0)).otherwise(F.size("qr_w") - 3)
    d = d.withColumn("qr_h", F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get("qr_w", i), F.get("qr_w", i + 1), F.get("qr_w", i + 2))))
    placed = F.transform("qr_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    d = d.withColumn("qr_p", F.when(F.size(F.array_distinct("qr_h")) < F.size("qr_h"), F.sort_array(placed)))
    lines = F.filter(normal_lines(F.col("qr_t")), lambda n: n != "")
    return d.select(
        *own,
        F.struct(
            F.size("qr_w").cast("long").alias("n_words"),
            F.length(F.array_join("qr_w", "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace("qr_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size("qr_l") - F.size(F.array_distinct("qr_l"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("qr_p").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("qr_p"))).alias("n_repeat_words"),
            F.transform(lines, lambda n: F.struct(F.xxhash64(n).alias("h"), F.size(F.split(n, " ")).cast("long").alias("w"))).alias("lines"),
        ).alias("s"),
    )


def frequent_lines(counted: DataFrame, min_docs: int, max_share: float, copies_once: bool) -> DataFrame:
    """(host, h, jn_rows) of lines above the limits; jn_rows is the number of documents with the line.

    Every document counts once for each of its lines; the counts add up per (host, line) before the
    shuffle, so no task gets a hot host or line whole.
    """
    docs = counted.dropDuplicates(["host", "t1", "t2"]) if copies_once else counted
    hashes = F.array_distinct(F.transform("s.lines", lambda x: x["h"]))
    counts = docs.select("host", F.explode(hashes).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    hosts = docs.groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
    # lines per host are skewed like hosts: the hosts' table meets them by the same rule
    lines = materialise(counts, "counts")
    sized = hosts.join(lines.groupBy("host").agg(F.count(F.lit(1)).alias("jn_rows")), "host")
    above = many_to_one(lines, materialise(sized, "hosts"), ["host"]).filter(F.col("n") > F.col("n_host") * max_share)
    if copies_once:  # how many rows will meet the line: copies too
        above = above.join(counted.select("host", F.explode(hashes).alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("all")), ["host", "h"]).withColumn("n", F.col("all"))
    return above.select("host", "h", F.col("n").alias("jn_rows"))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    host: str = "source",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    min_line_docs: int = MIN_LINE_DOCS,
    max_line_share: float = MAX_LINE_SHARE,
    copies_once: bool = False,
    with_text: str | None = None,
) -> DataFrame:
    """Judge every document by base counts and by what frequent lines leave of it.

    Words are runs of non-white-space characters of the whole text. A document fails the base rules
    with fewer than ``min_words`` words, or with more than ``max_repeat_percent`` percent of its words
    in repeated 3-word windows. A line (normalised: case and white space) found in more than
    ``min_line_docs`` documents of its host *and* in more than ``max_line_share`` of them is
    removed; a document left with fewer than ``min_words`` words is depleted and rejected. Every row is a
    document; with ``copies_once`` rows of a host with equal texts count as one.

    Returns the columns of ``docs`` but the text, and ``qr_stats``, ``words_left``, ``base_failed`` and
    ``kept`` (columns of these names are replaced). ``with_text``: 'whole' keeps the text, 'clean' gives it without the removed lines.
    Null text: no words, so it fails. Null host: a host of its own ('' and null are one). Repeated rows are
    judged alike and all stay.
    """
    made = {"qr_stats", "words_left", "base_failed", "kept", *([] if with_text else [text.lower()])}
    keep = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in made])
    body = F.coalesce(F.col(text), F.lit(""))
    copies = [F.xxhash64(body).alias("t1"), F.xxhash64(F.lit("text"), body).alias("t2")] if copies_once else []
    row = as_row(keep) if keep.columns else F.lit(None).cast("struct<none:int>")
    counted = with_counts(docs.select(row.alias("row"), F.coalesce(F.col(host), F.lit("")).alias("host"), *copies, F.col(text).alias("t")), F.col("t")).drop("t")
    counted = materialise(counted.withColumn("id", F.monotonically_increasing_id()), "counted")

    frequent = materialise(frequent_lines(counted, min_line_docs, max_line_share, copies_once).withColumn("k", F.xxhash64("host", "h")), "frequent")
    lines = possible_members(counted.select("id", "host", F.inline("s.lines")).withColumn("k", F.xxhash64("host", "h")), "k", frequent)
    hits = many_to_one(lines.drop("k"), frequent.drop("k"), ["host", "h"])
    lost = materialise(hits.groupBy("id").agg(F.sum("w").alias("lost"), F.collect_set("h").alias("removed")), "lost")
    # documents that lose nothing stay where they are
    marked = possible(counted.drop("host", "t1", "t2"), "id", lost)
    fields = ["row", "s", "lost", "removed"]
    hit = marked.filter("bf_maybe").join(lost, "id", "left").select(*fields)
    judged = marked.filter("not bf_maybe").select("row", "s", F.lit(0).cast("long").alias("lost"), F.lit(None).cast("array<bigint>").alias("removed")).unionByName(hit)
    stats = F.col("s").dropFields("lines")
    n, rep = F.col("s.n_words"), F.col("s.n_repeat_words")
    failed = (n < min_words) | (rep * 100 > n * max_repeat_percent)
    left = n - F.coalesce("lost", F.lit(0))
    columns = {c: F.col(f"row.`{c}`") for c in keep.columns}
    if with_text == "clean":
        whole, gone = columns[text], F.col("removed")
        pairs = F.arrays_zip(F.split(whole, "\n").alias("raw"), normal_lines(whole).alias("line"))
        kept_lines = F.transform(F.filter(pairs, lambda x: (x["line"] == "") | ~F.array_contains(gone, F.xxhash64(x["line"]))), lambda x: x["raw"])
        columns[text] = F.when(gone.isNull(), whole).otherwise(F.array_join(kept_lines, "\n"))
    return judged.select(*[v.alias(c) for c, v in columns.items()], stats.alias("qr_stats"), left.alias("words_left"), failed.alias("base_failed"), (~failed & (left >= min_words)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    s = F.col("qr_stats")
    return quality_rules(docs).select("doc_id", *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept")


ORACLE = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
         string_split(text, chr(10)) AS ls FROM base
), wins AS (
  SELECT rid, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM split WHERE len(ws) >= 3) t
), dups AS (
  SELECT w.rid, w.i FROM wins w JOIN (SELECT rid, win FROM wins GROUP BY rid, win HAVING count(*) > 1) d ON w.rid = d.rid AND w.win = d.win
), rep AS (
  SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest([i, i+1, i+2]) AS j FROM dups) t GROUP BY rid
), rawlines AS (
  SELECT rid, host, text, unnest(ls) AS line FROM split
), lines AS (
  SELECT rid, host, text, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM rawlines WHERE regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g') <> ''
), hosts AS (
  SELECT host, count(*) AS n_host FROM base GROUP BY host
), freq AS (
  SELECT l.host, l.norm FROM lines l JOIN hosts h ON l.host = h.host
  GROUP BY l.host, l.norm, h.n_host HAVING count(DISTINCT l.rid) > 20 AND count(DISTINCT l.rid) > h.n_host * 0.01
), lost AS (
  SELECT l.rid, sum(length(norm) - length(replace(norm, ' ', '')) + 1) AS n_lost
  FROM lines l SEMI JOIN freq f ON l.host = f.host AND l.norm = f.norm GROUP BY l.rid
), dupl AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid
), stats AS (
  SELECT s.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_lost, 0) AS n_lost
  FROM split s LEFT JOIN rep ON s.rid = rep.rid LEFT JOIN dupl ON s.rid = dupl.rid LEFT JOIN lost ON s.rid = lost.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_lost >= 50 AS kept
FROM stats
"""
