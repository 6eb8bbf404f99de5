"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join. DataFrame functions only.

The list has one entry a rule: a host with a path prefix, which fits that host and all its subdomains, or a whole canonical
URL (see canonical()). A url's possible keys are its canonical form and every (host suffix, path prefix) of the lengths that
the list has, an array that is one value of the plan whatever its size. Keys are tested against the filter, where all bits of a key lie in one 64-bit
block; possible hits go to an exact join with the list, which removes the filter's false positives. The longest rule that fits
wins over shorter ones and over listed urls; without a rule a listed url's verdict holds, else the url is allowed.

Defined cases: null urls and urls without :// have an empty host and path and are allowed, unless a rule is for the empty host;
repeated rows get equal results (distinct urls are joined); entries listed twice count once, block before allow; an empty list
or table is fine. Added columns replace input columns of the same names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BLOCKS, ascii_lower, bloom, bloom_blocks, bloom_hit, literals, materialize, packed, small, table

#: Fixed values: (verdict, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Sites whose pages are listed, with what their hosts begin and end with, and the pages' languages.
SITES, BEGIN, END, LANGUAGES = ("ads-track", "adult-x", "casino-win", "free-bets"), ("", "blog.", "m.", "www."), ("com", "net", "org"), ("de", "en", "es", "fr")
#: Pages listed of each site, host and language, numbered from 0: 384,000 canonical urls; a parameter.
PAGES = 2000


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host in lower case and path, without scheme, query and fragment, a slash or .html at its end; null for a url without ://."""
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.regexp_replace(path_of(url), r"(?:\.html|/)$", "")))


def listed_urls(spark: SparkSession, pages: int = PAGES) -> DataFrame:
    """The listed canonical urls, one column url, by rule."""
    lists = (BEGIN, SITES, END, LANGUAGES)
    hosts = math.prod(map(len, lists))
    at, picked = F.col("id"), []
    for x in lists:
        picked.append(F.element_at(F.array(*map(F.lit, x)), (at % len(x) + 1).cast("int")))
        at = F.floor(at / len(x))
    begin, site, end, language = picked
    return spark.range(hosts * pages).select(F.concat(begin, site, F.lit(".example."), end, F.lit("/"), language, F.lit("/"), at.cast("string")).alias("url"))


def listing(spark: SparkSession, rules=RULES, urls: DataFrame | None = None) -> DataFrame:
    """The list as a table: key, rule (null for a listed url), path_size, verdict."""
    own = literals(spark, [("r:" + h + p, h + p, len(p), v) for v, h, p in rules], "key string, rule string, path_size int, verdict string")
    urls = listed_urls(spark) if urls is None else urls
    return own.unionByName(urls.select(F.concat(F.lit("u:"), "url").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("path_size"), F.lit("block").alias("verdict")))


def verdicts(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """pages with host, path, rule and verdict."""
    pages = pages.drop(*[c for c in pages.columns if c.lower() in {"host", "path", "rule", "verdict"}])
    entries = materialize(entries, "url-list").withColumn("h", F.xxhash64("key"))
    blocks = bloom_blocks(entries.count(), MOST_BLOCKS)
    sizes = entries.agg(F.array_sort(F.collect_set(F.when(F.col("rule").isNotNull(), F.col("path_size")))).alias("sizes"))
    words, sizes = materialize(bloom(entries, "h", blocks), "bloom"), materialize(sizes, "path-sizes")
    # every key of a distinct url, then those that the filter lets pass; filter and sizes are one row each: scalar subqueries
    urls = pages.select("url").filter("url IS NOT NULL").distinct().withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    keyed = urls.withColumn("own", canonical(F.col("url"))).withColumn("labels", F.split("host", r"\.", -1)).withColumn("sizes", sizes.scalar())
    by_rule = "flatten(transform(sequence(1, size(labels)), k -> transform(filter(sizes, s -> s <= length(path)), s -> concat('r:', array_join(slice(labels, k, size(labels)), '.'), substr(path, 1, s)))))"
    keyed = keyed.withColumn("keys", F.expr(f"array_compact(array_append({by_rule}, concat('u:', own)))")).withColumn("words", words.scalar())
    tested = keyed.withColumn("hits", F.expr(f"filter(keys, k -> {bloom_hit('xxhash64(k)', 'words', blocks)})"))
    possible = tested.filter(F.size("hits") > 0).select("url", F.explode("hits").alias("key"))
    exact = possible.join(small(entries.select("key", "rule", "verdict")), "key")
    order = F.struct(F.coalesce(F.length("rule"), F.lit(-1)), F.col("verdict") == "block")
    found = exact.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), order).alias("best"))
    joined = packed(pages, "url").join(found.withColumnRenamed("url", "found_url"), F.col("url") == F.col("found_url"), "left")
    return joined.select("row_.*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))


def op7_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return verdicts(pages, listing(spark)).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
u AS (SELECT *, CASE
  WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN try_cast(regexp_extract(own, '^(?:(?:blog|m|www)\.)?(?:ads-track|adult-x|casino-win|free-bets)\.example\.(?:com|net|org)/(?:de|en|es|fr)/(0|[1-9][0-9]*)$', 1) AS BIGINT) < 2000 THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, host || regexp_replace(path, '(\.html|/)$', '') AS own FROM u)
"""
