"""URL filter: a blocked Bloom filter passes possible hits to an exact hash join.

The listed canonical URLs set bits of a Bloom filter that is cut into blocks of 512 bits (eight long words): one hash
picks the block, the others the bits inside it.  A URL whose bits are not all set is surely not listed and leaves the
flow without a shuffle.  The possible hits are joined with the list itself, which removes the false positives.

The filter is broadcast only while its blocks, whose number is known from the count of listed URLs, fit
``BROADCAST_BYTES``; a larger filter is joined by block over the distinct canonical URLs.

Canonical form: scheme dropped, host lower-cased, leading ``www.`` and default ports dropped, fragment and ``utm_``
parameters dropped, one trailing slash dropped.  Null urls have empty host and path, are never listed and are allowed.
Repeated rows are judged each; extra columns are ignored; an empty table gives no rows, an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut
from .common import ascii_lower, join_hot, table

BITS_PER_URL = 12
HASHES = 6
BLOCK_BITS = 512
BROADCAST_BYTES = 16 << 20
# fixed values: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
         ("block", "com", "/de/")]
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^www\\.", ""), ":(80|443)$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    out = F.concat(host, F.regexp_replace(path_of(url), "/$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(url.contains("://"), out)


def _fits(host: Column, path: Column, rule: tuple) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; nulls if none does."""
    by_length = sorted(RULES, key=lambda r: len(r[1] + r[2]))
    name = verdict = F.lit(None).cast("string")
    for r in by_length:                                     # the longest is tried first, as it wraps the shorter ones
        fits = _fits(host, path, r)
        name, verdict = F.when(fits, F.lit(r[1] + r[2])).otherwise(name), F.when(fits, F.lit(r[0])).otherwise(verdict)
    return name, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bits(url: Column) -> list[Column]:
    """Positions inside the block, from two hashes that are independent of the block's."""
    a, b = F.pmod(F.xxhash64(F.lit("a"), url), F.lit(BLOCK_BITS)), F.pmod(F.xxhash64(F.lit("b"), url), F.lit(BLOCK_BITS // 2)) * 2 + 1
    return [F.pmod(a + F.lit(i) * b, F.lit(BLOCK_BITS)).cast("int") for i in range(HASHES)]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, w0..w7): the words of each block that has any bit set."""
    bits = listed.select(_block(F.col("url"), blocks).alias("block"), F.explode(F.array(*_bits(F.col("url")))).alias("bit"))
    word = lambda i: F.bit_or(F.when(F.floor(F.col("bit") / 64) == i, F.expr("shiftleft(1L, bit % 64)")).otherwise(F.lit(0).cast("long")))
    return bits.groupBy("block").agg(*[word(i).alias(f"w{i}") for i in range(BLOCK_BITS // 64)])


def _all_set(url: Column) -> Column:
    words = F.array(*[F.col(f"w{i}") for i in range(BLOCK_BITS // 64)])
    ok = F.lit(True)
    for bit in _bits(url):
        ok = ok & (F.call_function("shiftright", F.element_at(words, (F.floor(bit / 64) + 1).cast("int")), bit % 64).bitwiseAND(F.lit(1)) == 1)
    return F.coalesce(ok, F.lit(False))


def listed_hits(urls: DataFrame, listed: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows of ``urls`` with ``possible`` (the Bloom filter's answer) and ``is_listed`` (exact) for their column ``canonical``.

    ``listed``: column url.
    """
    listed = cut(listed.where(F.col("url").isNotNull()).select("url").distinct())
    n = listed.count()
    blocks = max(1, -(-n * BITS_PER_URL // BLOCK_BITS))
    words = cut(bloom(listed, blocks))
    target = F.col("canonical")
    if blocks * (BLOCK_BITS // 8 + 16) <= broadcast_bytes:
        tested = urls.withColumn("block", _block(target, blocks)).join(F.broadcast(words), "block", "left")
        tested = tested.select(*urls.columns, _all_set(target).alias("possible"))
    else:
        once = urls.where(target.isNotNull()).groupBy("canonical").agg(F.count(F.lit(1)).alias("n"))
        hit = cut(once.withColumn("block", _block(target, blocks)).join(words, "block").where(_all_set(target)).select("canonical", "n", F.lit(True).alias("hit")))
        tested = join_hot(urls, hit, "canonical", "n", urls.count(), F.xxhash64(*urls.columns))
        tested = tested.select(*urls.columns, F.coalesce("hit", F.lit(False)).alias("possible"))
    tested = cut(tested)
    maybe = tested.where("possible")
    exact = cut(maybe.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).join(
        listed.select(F.col("url").alias("canonical"), F.lit(True).alias("is_listed")), "canonical"))
    sure = join_hot(maybe, exact, "canonical", "n", maybe.count(), F.xxhash64(*urls.columns)).drop("n")
    out = sure.withColumn("is_listed", F.coalesce("is_listed", F.lit(False)))
    return out.unionByName(tested.where(~F.col("possible")).withColumn("is_listed", F.lit(False)))


def judge(pages: DataFrame, listed: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict, canonical, possible, is_listed) for pages (page_id, url) and listed urls."""
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    return listed_hits(rows, listed, broadcast_bytes).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("is_listed"), "block").otherwise("allow")).alias("verdict"), "canonical", "possible", "is_listed")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under the rules and a block list: the canonical URLs that were reached by a tracked (utm_) link."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.regexp_like("url", F.lit(r"[?&]utm_"))).select(canonical(F.col("url")).alias("url"))
    return judge(pages, listed).drop("possible")


ORACLE = r"""
WITH parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path,
    regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS query
  FROM pages),
forms AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
    regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/$', '') ||
    CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical
  FROM (SELECT *, array_to_string(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_')), '&') AS kept FROM parts)),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule,
    coalesce(canonical IN (SELECT canonical FROM forms WHERE regexp_matches(url, '[?&]utm_') AND canonical IS NOT NULL), false) AS is_listed
  FROM forms)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN is_listed THEN 'block' ELSE 'allow' END AS verdict, canonical, is_listed
FROM ruled
"""
