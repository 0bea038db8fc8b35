"""URL filters (native): rules by host and path, and a list of URLs behind a blocked Bloom filter.

Listed URLs and the rows' URLs are brought to one canonical form. The list becomes a blocked Bloom filter: a
URL's hash names one block of 256 bits, four words of 64, and sets two bits in each word. Its size is bounded, so
it is broadcast, and only rows whose bits are all set (possible hits) are shuffled, to an exact hash join with the
list that removes false positives. A list beyond the filter's bound only makes more of these.

One URL may hold a third of all rows: possible hits are salted, and each listed URL meets every salt.

Canonical form: host (letters lower-cased, no user, no default port, no leading `www.`, no closing dot), path
(repeated slashes and a closing slash go) and parameters (tracking ones go, the rest sorted). Scheme and fragment
go. Defined results: a null URL or one without `://` has no canonical form, an empty host and an empty path, fits
no rule, isn't listed and is allowed; such entries of a list are left out. Repeated rows are judged each for
itself, repeated entries count once. An empty list blocks nothing, an empty table gives an empty result. Texts may
be of any length. The row's own columns stay; where a name clashes, the added column gets an underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fresh, scratch, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Names of parameters that don't tell pages apart.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
WORDS, BITS_A_WORD = 4, 2
#: 2 ** 18 blocks are rows of 48 bytes: some 13 MB, and 16 bits for each of 4 million URLs.
MOST_BLOCKS = 1 << 18
BITS_A_URL = 16
SALTS = 32


@dataclass(frozen=True)
class Rule:
    """Fits a host and its subdomains where the path starts with the rule's."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The policy's rules, fixed by the query's contract.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
#: Sites whose pages stand in for a feed of listed URLs.
LISTED_SITES = ("cheap-pills", "free-bets", "spam-farm")


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; null where there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for URLs that name the same page; null where there is no `://`."""
    site = F.regexp_replace(host(url), r"^[^@]*@", "")
    site = F.regexp_replace(F.regexp_replace(site, r":(80|443)?$", ""), r"\.$", "")
    site = F.regexp_replace(site, r"^www\.", "")
    way = F.regexp_replace(F.regexp_replace(path(url), r"/+", "/"), r"/$", "")
    asked = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda p: (p != "") & ~F.rlike(p, F.lit(TRACKING))))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(after_scheme(url).isNotNull(), F.concat(site, way, query))


def longest_rule(at_host: Column, at_path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, nulls where none does. Rules are a short policy, not a list."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((at_host == r.host) | at_host.endswith("." + r.host)) & at_path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def block_of(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks).cast("long"))


def masks(url: Column) -> list[Column]:
    """The bits of a URL in each word of its block, from a hash of its own."""
    h = F.xxhash64(url, F.lit("bits"))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    return [bit(2 * w).bitwiseOR(bit(2 * w + 1)) for w in range(WORDS)]


def bloom(listed: DataFrame, column: str, n: int, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, int]:
    """The filter of n URLs as rows (block, w0 to w3), and its number of blocks, most_blocks at most."""
    blocks = max(1, min(most_blocks, -(-n * BITS_A_URL // (64 * WORDS))))
    url = F.col(column)
    x = listed.select(block_of(url, blocks).alias("block"), *[m.alias(f"w{w}") for w, m in enumerate(masks(url))])
    return x.groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(WORDS)]), blocks


def with_listed(rows: DataFrame, url: str, listed: DataFrame, listed_url: str, most_blocks: int = MOST_BLOCKS, salts: int = SALTS) -> tuple[DataFrame, str, str]:
    """Adds two booleans: whether a row's URL passes the filter, and whether it is listed. Returns the frame and their names."""
    key, block, salt, may, is_listed = fresh(rows, "_key", "_block", "_salt", "possible", "listed")
    entries = scratch(listed.select(canonical(F.col(f"`{listed_url}`")).alias("entry")).where("entry is not null").distinct(), "listed")
    made, blocks = bloom(entries, "entry", entries.count(), most_blocks)
    made = made.toDF(block, *(names := fresh(rows, *[f"_w{w}" for w in range(WORDS)])))
    x = rows.select("*", canonical(F.col(f"`{url}`")).alias(key))
    x = x.select("*", block_of(F.col(key), blocks).alias(block)).join(F.broadcast(made), block, "left")  # at most most_blocks rows
    hit = F.col(key).isNotNull()
    for w, m in zip(names, masks(F.col(key)), strict=True):
        hit &= F.col(w).bitwiseAND(m) == m
    x = x.select(*[F.col(f"`{c}`") for c in rows.columns], key, F.coalesce(hit, F.lit(False)).alias(may))
    own = [F.col(f"`{c}`") for c in rows.columns]
    no = x.where(~F.col(may)).select(*own, may, F.lit(False).alias(is_listed))
    # any salt is right: each listed URL comes with all of them
    yes = x.where(may).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    every = entries.select(F.col("entry").alias(key), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias(salt), F.lit(True).alias(is_listed))
    yes = yes.join(every.hint("shuffle_hash"), [key, salt], "left").select(*own, may, F.coalesce(is_listed, F.lit(False)).alias(is_listed))
    return no.unionByName(yes), may, is_listed


def judge(rows: DataFrame, url: str, listed: DataFrame, listed_url: str, rules: tuple[Rule, ...] = RULES, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block: the rule's, else block where the URL is listed) and possible."""
    x, may, is_listed = with_listed(rows, url, listed, listed_url, most_blocks)
    h, p, r, v = fresh(x, "host", "path", "rule", "verdict")
    x = x.select("*", host(F.col(f"`{url}`")).alias(h), path(F.col(f"`{url}`")).alias(p))
    name, verdict = longest_rule(F.col(h), F.col(p), rules)
    return x.select(*[F.col(f"`{c}`") for c in rows.columns], h, p, name.alias(r), F.coalesce(verdict, F.when(F.col(is_listed), "block").otherwise("allow")).alias(v), may)


def op11(spark, sf_dir: str) -> DataFrame:
    """Query op11_url_filters: every url of `pages`, against the URLs of the pages on the listed sites."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.rlike(host(F.col("url")), F.lit(rf"(^|\.)({'|'.join(LISTED_SITES)})\."))
    return judge(pages, "url", pages.where(bad).select("url"), "url").select("page_id", "host", "path", "rule", "verdict")


OP11_SQL = r"""
WITH a AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
b AS (SELECT page_id, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
c AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS kept FROM b),
d AS (SELECT page_id, host, path, CASE WHEN rest IS NOT NULL THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)?$', ''), '\.$', ''), '^www\.', '')
  || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canon FROM c),
l AS (SELECT DISTINCT canon FROM d WHERE regexp_matches(host, '(^|\.)(cheap-pills|free-bets|spam-farm)\.') AND canon IS NOT NULL),
r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS v(verdict, h, p)),
m AS (SELECT d.*, list_max(list_transform(list_filter((SELECT list(r) FROM r), lambda x: (host = x.h OR ends_with(host, '.' || x.h)) AND starts_with(path, x.p)),
  lambda x: {'n': length(x.h || x.p), 'rule': x.h || x.p, 'verdict': x.verdict})) AS best FROM d)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN canon IN (SELECT canon FROM l) THEN 'block' ELSE 'allow' END) AS verdict FROM m
"""
