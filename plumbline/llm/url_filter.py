"""URL rules, and a blocked Bloom filter of listed URLs before an exact join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import picked
from plumbline.session import cut_lineage

Rule = tuple[str, str]  # verdict and host/path, like ("block", "net/es/")
#: Words of 64 bits to a block, bits a URL sets in each, and listed URLs to a block.
WORDS, BITS, URLS_PER_BLOCK = 4, 2, 16
#: Blocks up to which the filter is broadcast (40 bytes each); a larger one is joined by block.
BROADCAST_BLOCKS = 1 << 18

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host, path without a last slash, and query without ``utm_`` parameters; empty if there is no ``://``."""
    query = F.regexp_extract(rest(url), "^[^?#]*[?]([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)utm_[^&=]*=[^&]*", ""), "^&", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))).otherwise("")


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, else null; of equal length the one with the longer host."""
    out = F.lit(None).cast("string")
    order = sorted({r for _, r in rules}, key=lambda r: (len(r), r.index("/"), r))
    for rule in order:  # the last wins
        name, slash, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + prefix)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: list[Rule]) -> Column:
    out = F.lit(None).cast("string")
    for verdict, text in rules:
        out = F.when(rule == text, F.lit(verdict)).otherwise(out)
    return out


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _masks(key: Column) -> list[Column]:
    """The bits of a URL in each word of its block."""
    h = F.xxhash64(key, F.lit("bits"))
    one = F.lit(1).cast("bigint")
    place = lambda i: F.shiftrightunsigned(h, 6 * i).bitwiseAND(63).cast("int")
    shifted = lambda i: F.call_function("shiftleft", one, place(i))
    out = []
    for w in range(WORDS):
        mask = shifted(w * BITS)
        for k in range(1, BITS):
            mask = mask.bitwiseOR(shifted(w * BITS + k))
        out.append(mask)
    return out


def bloom_filter(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0, w1, ...): one row for each block that holds a URL; bits are joined before the shuffle."""
    words = listed.select(_block(F.col(key), blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return words.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, page_id: str = "page_id", url: str = "url", listed_url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, listed: one row per row of ``pages``.

    A rule decides where one fits. Elsewhere a page is blocked if its canonical URL is among those of
    ``listed``: the Bloom filter passes possible hits, and a join on the URL itself removes the false
    ones. Null URLs and URLs without ``://`` have an empty host and path, and are never listed; repeated
    rows each give a row; an empty list blocks nothing.
    """
    urls = cut_lineage(listed.select(canonical(F.col(f"`{listed_url}`")).alias("canonical")).filter("canonical <> ''").distinct(), "listed")
    blocks = max(1, -(-urls.count() // URLS_PER_BLOCK))
    bits = bloom_filter(urls, "canonical", blocks)
    bits = F.broadcast(bits) if blocks <= BROADCAST_BLOCKS else bits
    source = picked(pages, page_id=page_id, url=url)
    u = F.col("url")
    seen = source.select("page_id", host_of(u).alias("host"), path_of(u).alias("path"), canonical(u).alias("canonical"))
    seen = seen.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("block", _block(F.col("canonical"), blocks))
    passed = F.lit(True)
    for i, m in enumerate(_masks(F.col("canonical"))):
        passed = passed & (F.col(f"w{i}").bitwiseAND(m) == m)
    possible = F.coalesce(passed & F.col("rule").isNull(), F.lit(False))
    tested = seen.join(bits, "block", "left").select("page_id", "host", "path", "rule", "canonical", possible.alias("possible"))
    tested = cut_lineage(tested, "tested")
    hits = tested.filter("possible").join(urls.withColumn("listed", F.lit(True)), "canonical", "left")
    out = hits.withColumn("listed", F.coalesce("listed", F.lit(False))).unionByName(tested.filter("not possible").withColumn("listed", F.lit(False)))
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "listed")
