"""URL filter: rules first, then a blocked Bloom filter before an exact join.

The listed canonical URLs set a few bits each in one block of 512 bits.  The
filter is a table of blocks, eight longs to a row, so a URL is looked up in
one row.  Only URLs whose bits are all set go on to the exact hash join with
the list, which removes the false positives; all others are done without a
shuffle.  The blocks are broadcast up to ``BROADCAST_BYTES``, which is checked
against their number; beyond that they are joined by block.

Results for odd input: a null URL or one without ``://`` has an empty host and
path, fits no rule and is allowed; null or empty entries of the list are
ignored, repeated ones count once; repeated pages give repeated rows.  Other
columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.session import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8  # longs of a block
BITS = 6  # bits that a URL sets in its block
BITS_PER_URL = 16
BLOCK_BYTES = 8 * (WORDS + 2)
BROADCAST_BYTES = 8 << 20
PREFIXES = ["www.", "m."]
TRACKING = ["ref", "fbclid", "gclid"]

# Verdict, host and path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
JUNK_TITLE = r"<title>[^<]*(%%%|###|\$\$\$|\*\*\*|&&&)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``, empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host``, ``path`` and the query string ``args`` to rows with ``url``."""
    rest = pages.withColumn("rest", F.coalesce(_rest(F.col("url")), F.lit("")))
    return rest.select(
        *pages.columns,
        F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract("rest", r"^[^?#]*\?([^#]*)", 1).alias("args"),
    )


def canonical() -> Column:
    """One name for a page's spellings, from ``host``, ``path`` and ``args``.

    Without scheme, fragment, ``www.`` or ``m.``, default port, closing slash
    and tracking arguments; the other arguments in order.
    """
    host = F.regexp_replace("host", ":(80|443)$", "")
    host = F.regexp_replace(host, f"^({'|'.join(p.replace('.', '[.]') for p in PREFIXES)})", "")
    path = F.regexp_replace("path", "/+$", "")
    tracked = f"^(utm_[^=]*|{'|'.join(TRACKING)})(=|$)"
    args = F.array_sort(F.filter(F.split("args", "&"), lambda a: (a != "") & ~a.rlike(tracked)))
    args = F.when(F.size(args) > 0, F.concat(F.lit("?"), F.array_join(args, "&"))).otherwise("")
    return F.when(F.col("host") == "", F.lit(None)).otherwise(F.concat(host, path, args))


def rule_of(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null without one.

    The rules are a short list that is part of the query.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _places(url: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """Block of a URL, and the places of its bits in it."""
    block = F.pmod(F.xxhash64(url), F.lit(n_blocks))
    spread = F.xxhash64(url, F.lit("bits"))
    return block, [F.shiftrightunsigned(spread, 9 * k).bitwiseAND(F.lit(64 * WORDS - 1)).cast("int") for k in range(BITS)]


def blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """The filter: ``block`` and its longs, from rows with ``canonical``."""
    block, places = _places(F.col("canonical"), n_blocks)
    bits = listed.select(block.alias("block"), F.explode(F.array(*places)).alias("place"))
    bit = F.expr("shiftleft(1L, place & 63)")
    words = [
        F.bit_or(F.when(F.shiftright("place", 6) == w, bit).otherwise(F.lit(0).cast("bigint"))) for w in range(WORDS)
    ]
    return bits.groupBy("block").agg(F.array(*words).alias("longs"))


def possible(urls: DataFrame, listed: DataFrame, n_listed: int) -> DataFrame:
    """Adds ``possible``: false only where ``canonical`` is not in the list of ``n_listed``."""
    n_blocks = max(1, math.ceil(n_listed * BITS_PER_URL / (64 * WORDS)))
    table = blocks(listed, n_blocks)
    if n_blocks * BLOCK_BYTES <= BROADCAST_BYTES:
        table = F.broadcast(table)
    block, places = _places(F.col("canonical"), n_blocks)
    # A URL without a canonical form is looked up in any block, so that these rows do not meet in one task.
    asked = urls.withColumn("block", F.coalesce(block, F.pmod(F.xxhash64(*urls.columns), F.lit(n_blocks))))
    every = F.lit(True)
    for place in places:
        long = F.get(F.col("longs"), F.shiftright(place, 6))
        every = every & (F.call_function("getbit", long, place.bitwiseAND(63)) == 1)
    set_ = F.col("canonical").isNotNull() & F.col("longs").isNotNull() & every
    return asked.join(table, "block", "left").withColumn("possible", F.coalesce(set_, F.lit(False))).drop("block", "longs")


def judged(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Page, host, path, rule and verdict of every page; ``listed`` has the blocked ``url``."""
    canon = (
        with_parts(listed.select("url")).select(canonical().alias("canonical")).where("canonical IS NOT NULL").distinct()
    )
    canon = cut(canon, "listed-urls")
    n_listed = canon.count()
    rule, verdict = rule_of(rules)
    urls = with_parts(pages.select("page_id", "url")).select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), canonical().alias("canonical")
    )
    ruled = urls.where("verdict IS NOT NULL")
    asked = possible(urls.where("verdict IS NULL"), canon, n_listed)
    missed = asked.where(~F.col("possible")).withColumn("verdict", F.lit("allow"))
    exact = canon.withColumn("found", F.lit(True)).hint("shuffle_hash")
    hits = asked.where("possible").join(exact, "canonical", "left")
    hits = hits.withColumn("verdict", F.when(F.col("found"), F.lit("block")).otherwise(F.lit("allow")))
    columns = ["page_id", "host", "path", "rule", "verdict"]
    return ruled.select(columns).union(missed.select(columns)).union(hits.select(columns))


def junk_titled(pages: DataFrame) -> DataFrame:
    """URLs of pages whose title is strewn with symbols."""
    return pages.where(F.col("html").rlike(JUNK_TITLE)).select("url")


_SQL_RULES = " ".join(
    f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '%s'"
    for _, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
)


def _case(values: list[str]) -> str:
    return f"CASE {_SQL_RULES % tuple(values)} END"


_ORDERED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
SQL = f"""
WITH rest AS (
  SELECT page_id, html,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\\?([^#]*)', 1), '&'),
      lambda a: a <> '' AND NOT regexp_matches(a, '^(utm_[^=]*|{"|".join(TRACKING)})(=|$)'))) AS args
  FROM rest
), named AS (
  SELECT page_id, html, host, path,
    CASE WHEN host = '' THEN NULL ELSE
      regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www[.]|m[.])', '') || regexp_replace(path, '/+$', '')
      || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canonical
  FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM named WHERE regexp_matches(html, '{JUNK_TITLE}') AND canonical IS NOT NULL
)
SELECT page_id, host, path, {_case([h + p for _, h, p in _ORDERED])} AS rule,
  coalesce({_case([v for v, _, _ in _ORDERED])}, CASE WHEN listed.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN listed ON named.canonical = listed.canonical
"""
