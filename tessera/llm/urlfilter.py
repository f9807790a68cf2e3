"""URL filters: host and path rules, then a listed-URL test by blocked Bloom filter and exact join.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import WORDS, block_of, bloom_table, blocks_for, holds
from .joins import as_row, many_to_one
from .scratch import materialise

#: (action, host, path). The longest fitting rule wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: First labels of hosts (after www., m. or blog.) whose pages make up the query's list of URLs.
LISTED_LABELS = ("spam-farm", "cheap-pills")
#: A list of at most so many bytes is broadcast for the exact join.
SMALL_LIST = 16 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_of(url: Column, host: Column, path: Column) -> Column:
    """Host without 'www.', path without closing slashes, sorted query without tracking parameters.

    Scheme and fragment are dropped. Null for a null url or one without '://'.
    """
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref|gclid|fbclid)(=|$)")))
    joined = F.array_join(kept, "&")
    return F.when(url.contains("://"), F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""), F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit("?"), joined))))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as 'host' + 'path', and its action; null where none fits."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        action = F.when(fits, F.lit(verdict)).otherwise(action)
    return name, action


def url_filter(pages: DataFrame, listed: DataFrame, url: str = "url", listed_url: str = "url", rules=RULES, small_list: int = SMALL_LIST) -> DataFrame:
    """``pages`` with uf_host, uf_path, uf_rule and uf_verdict ('allow' or 'block'), every row once.

    A fitting rule decides. Otherwise a URL is blocked when its canonical form is in ``listed``:
    the blocked Bloom filter lets absent URLs pass without a shuffle, and only possible hits go
    to the exact hash join, which removes false positives. Where the list's canonical URLs weigh at most
    ``small_list`` bytes (measured) that join needs no shuffle either and the pages are read once. Null urls and urls
    without '://' have empty host and path and are allowed. Repeated rows and repeated list entries change
    nothing; an empty list blocks nothing. Columns of ``pages`` named like the result are replaced.
    """
    own = listed.select(canonical_of(F.col(listed_url), host_of(F.col(listed_url)), path_of(F.col(listed_url))).alias("uf_key"))
    own = materialise(own.filter(F.col("uf_key").isNotNull()).distinct(), "listed")
    size, entries = own.agg(F.sum(F.octet_length("uf_key") + 32), F.count(F.lit(1))).first()
    blocks = blocks_for(entries)
    bloom = F.broadcast(bloom_table(own, "uf_key", blocks))  # of bounded size
    found = own.withColumn("uf_listed", F.lit(True))

    made = {"uf_host", "uf_path", "uf_rule", "uf_verdict"}
    keep = pages.select(*[f"`{c}`" for c in pages.columns if c.lower() not in made])
    base = pages.select(as_row(keep).alias("row"), F.col(url).alias("uf_url"), host_of(F.col(url)).alias("uf_host"), path_of(F.col(url)).alias("uf_path"))
    rule, action = rule_of(F.col("uf_host"), F.col("uf_path"), rules)
    base = base.withColumns({"uf_rule": rule, "uf_action": action})
    # only urls that no rule decides are probed
    base = base.withColumn("uf_key", F.when(F.col("uf_action").isNull(), canonical_of(F.col("uf_url"), F.col("uf_host"), F.col("uf_path"))))
    probed = base.withColumn("bf_block", block_of("uf_key", blocks)).join(bloom, "bf_block", "left")
    probed = probed.withColumn("uf_key", F.when(holds("uf_key"), F.col("uf_key"))).drop("bf_block", *[f"bf_w{j}" for j in range(WORDS)])
    if (size or 0) <= small_list:
        out = probed.join(F.broadcast(found), "uf_key", "left")
    else:
        possible = probed.filter(F.col("uf_key").isNotNull())
        met = materialise(possible.groupBy("uf_key").agg(F.count(F.lit(1)).alias("jn_rows")).join(found, "uf_key"), "listed-hits")
        hits = many_to_one(possible, met, ["uf_key"], "left")  # a listed url may hold many of the pages
        out = probed.filter(F.col("uf_key").isNull()).withColumn("uf_listed", F.lit(None).cast("boolean")).unionByName(hits)
    verdict = F.coalesce("uf_action", F.when(F.col("uf_listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("row.*", "uf_host", "uf_path", "uf_rule", verdict.alias("uf_verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    label = F.element_at(F.split(F.regexp_replace(host_of(F.col("url")), r"^(www|m|blog)\.", ""), r"\."), 1)
    listed = pages.filter(label.isin(*LISTED_LABELS)).select("url")
    out = url_filter(pages, listed)
    return out.select("page_id", F.col("uf_host").alias("host"), F.col("uf_path").alias("path"), F.col("uf_rule").alias("rule"), F.col("uf_verdict").alias("verdict"))


ORACLE = r"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
                   lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)'))) AS params
  FROM pages
), keyed AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
           regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '') ||
           CASE WHEN len(params) = 0 THEN '' ELSE '?' || array_to_string(params, '&') END END AS ckey
  FROM parts
), listed AS (
  SELECT DISTINCT ckey FROM keyed
  WHERE string_split(regexp_replace(host, '^(www|m|blog)\.', ''), '.')[1] IN ('spam-farm', 'cheap-pills')
), ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    END AS rule
  FROM keyed
)
SELECT r.page_id, r.host, r.path, r.rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN l.ckey IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled r LEFT JOIN listed l ON r.ckey = l.ckey
"""
