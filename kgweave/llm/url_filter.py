"""URL filters: rules on hosts and paths, then a list of URLs behind a blocked Bloom filter.

Each listed canonical URL sets one bit in each of the eight 32-bit words of one block of the filter; the filter is
a table of blocks. A page's URL is a possible hit where all its eight bits stand in its block. Possible hits are
joined with the list by the whole canonical URL, so false positives go. The filter has a bound, and so may be
broadcast: beyond it more pages are possible hits, and the join still judges each rightly."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, materialise

#: Odd multipliers that give a word's bit from a hash, as Parquet's split-block Bloom filters have them: fixed values.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: Query parameters that only track: fixed values.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
#: Bits of the filter a listed URL, and blocks of 256 bits at most (2^18: 8 MB, which a broadcast holds).
BITS_EACH, MOST_BLOCKS = 16, 1 << 18

#: (verdict, host and path) of the query's rules: fixed values.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Names of hosts whose pages the query lists: fixed values.
LISTED_HOSTS = r"(^|\.)(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)\."


def _part(url: Column, k: int) -> Column:
    """Host (1), path (2) or query (3) of a URL; empty if null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return lower_ascii(_part(url, 1))


def path(url: Column) -> Column:
    return _part(url, 2)


def canonical(url: Column) -> Column:
    """A URL without what doesn't tell pages apart: scheme, www. or m., usual port, final slashes or .html, tracking
    parameters, order of parameters, fragment. Null if null or without a host."""
    site = F.regexp_replace(F.regexp_replace(host(url), r"^(www|m)\.", ""), r":(80|443)$", "")
    place = F.regexp_replace(path(url), r"(/+|\.html?)$", "")
    rest = F.array_join(F.array_sort(F.filter(F.split(_part(url, 3), "&"), lambda x: (x != "") & ~F.rlike(x, F.lit(TRACKING)))), "&")
    return F.when(host(url) != "", F.concat(site, place, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(F.lit(""))))


def fits(rule: str, site: Column, place: Column) -> Column:
    name, slash, start = rule.partition("/")
    return ((site == name) | F.endswith(site, F.lit("." + name))) & F.startswith(place, F.lit(slash + start))


def first_rule(rules, site: Column, place: Column) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones the first by its text) and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        hit = fits(text, site, place)
        rule, verdict = F.when(hit, F.lit(text)).otherwise(rule), F.when(hit, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _hash(url: str) -> Column:
    return F.xxhash64(F.col(url))


def _bit(low: Column, salt: int) -> Column:
    # the product's lower 32 bits; the halves are multiplied apart, as it has no room in a long
    high, rest = F.shiftrightunsigned(low, 16), low.bitwiseAND(F.lit(0xFFFF))
    product = F.pmod(F.pmod(high * salt, F.lit(1 << 16)) * (1 << 16) + rest * salt, F.lit(1 << 32))
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(product, 27).cast("int"))


def _bits(key: Column) -> list[Column]:
    """One of 32 bits in each of a block's eight words, from the hash's lower half."""
    low = key.bitwiseAND(F.lit(0xFFFFFFFF))
    return [_bit(low, salt) for salt in SALTS]


def blocked_bloom(listed: DataFrame, url: str, bits_each: int = BITS_EACH, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of listed's (distinct) URLs, a row per block that isn't empty (block, w0 to w7), and its number of
    blocks. Blocks are OR-ed in each task before they are shuffled."""
    n = max(1, min(most_blocks, 1 << math.ceil(math.log2(max(1, listed.count() * bits_each / 256)))))
    key = listed.select(_hash(url).alias("key"))
    words = key.select(F.pmod(F.shiftright("key", 32), F.lit(n)).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(_bits(F.col("key")))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)]), n


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, url_col: str = "url", bits_each: int = BITS_EACH, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """pages' columns with host, path, rule, verdict, possible (the filter let it pass) and listed.

    A rule fits its host and all below it where the path starts with the rule's; the longest one judges. Where none
    fits, URLs on the list are blocked and all others allowed. listed: a DataFrame with a column url.
    Null URLs, and those without ://, have an empty host and path, no rule and no place on the list: they are
    allowed. Rows that repeat a URL are judged alike, and each stays. An empty list blocks nothing; an empty table
    gives none. Columns of pages with the names added here are replaced."""
    added = ("host", "path", "rule", "verdict", "possible", "listed")
    own, back = apart(pages.drop(*added))
    url = F.col(f"`{own.columns[[c for c in pages.columns if c not in added].index(url_col)]}`")
    known = materialise(listed.select(canonical(F.col("url")).alias("canonical")).where("canonical IS NOT NULL").distinct(), "listed-urls")
    blocks, n = blocked_bloom(known, "canonical", bits_each, most_blocks)
    rule, verdict = first_rule(rules, F.col("host"), F.col("path"))
    judged = own.withColumns({"host": host(url), "path": path(url), "canonical": canonical(url)}).withColumns({"rule": rule, "verdict": verdict})
    asked = judged.withColumn("key", _hash("canonical")).withColumn("block", F.pmod(F.shiftright("key", 32), F.lit(n)))
    stands = F.lit(True)
    for k, bit in enumerate(_bits(F.col("key"))):
        stands = stands & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    tried = asked.join(F.broadcast(blocks), "block", "left")  # at most most_blocks rows of 72 bytes
    tried = tried.withColumn("possible", F.col("canonical").isNotNull() & F.coalesce(stands, F.lit(False)))
    # only possible hits are shuffled; the table's URLs are read a second time for all others
    hits = tried.where("possible").join(known.withColumn("listed", F.lit(True)).hint("shuffle_hash"), "canonical", "left")
    both = hits.unionByName(tried.where("NOT possible").withColumn("listed", F.lit(False))).withColumn("listed", F.coalesce("listed", F.lit(False)))
    return back(both.withColumn("verdict", F.coalesce("verdict", F.when(F.col("listed"), "block").otherwise("allow"))), *added)


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: every URL of pages on hosts with a listed name, as a crawl finds them; it grows with the table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    judged = filter_urls(pages, pages.where(F.rlike(host(F.col("url")), F.lit(LISTED_HOSTS))).select("url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


OP12_SQL = rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '') AS query FROM pages
), c AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '(/+|\.html?)$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))), '&'), ''), '') END AS canonical FROM u
), k AS (
  SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND regexp_matches(host, '{LISTED_HOSTS}')
), r(says, rule, name, start) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
    ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), f AS (
  SELECT c.page_id, c.host, c.path, c.canonical, r.says, r.rule FROM c LEFT JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start)
  QUALIFY row_number() OVER (PARTITION BY page_id, host, path, canonical ORDER BY len(rule) DESC NULLS LAST, rule) = 1
)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN k.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, k.canonical IS NOT NULL AS listed
FROM f LEFT JOIN k USING (canonical)
"""
