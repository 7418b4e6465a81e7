"""Queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import alignment, archives, decontaminate, language, lexical, pieces, pii, quality, secret_scan, simhash, suffix_dedup, token_store, url_filter
from plumbline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


@query
def op1_url_filter(spark, root):
    """The list: canonical URLs that at least two pages have."""
    pages = table(spark, root, "pages")
    same = url_filter.canonical(F.col("url"))
    listed = pages.groupBy(same.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("url")).filter("n > 1")
    return url_filter.judge(pages, RULES, listed)


ORACLES["op1_url_filter"] = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, rest IS NOT NULL AS whole,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), ''), '(^|&)utm_[^&=]*=[^&]*', '', 'g'), '^&', '') AS query
  FROM rests),
named AS (
  SELECT page_id, host, path,
    CASE WHEN whole THEN host || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END ELSE '' END AS canonical,
    CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts),
listed AS (SELECT canonical FROM named WHERE canonical <> '' GROUP BY canonical HAVING count(*) > 1),
judged AS (
  SELECT n.*, n.rule IS NULL AND l.canonical IS NOT NULL AS listed FROM named n LEFT JOIN listed l USING (canonical))
SELECT page_id, host, path, rule, listed,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""


@query
def op2_pii(spark, root):
    return pii.digests(table(spark, root, "documents"))


@query
def op3_token_store(spark, root):
    return token_store.round_trip(table(spark, root, "documents"))


@query
def op5_secret_scan(spark, root):
    """Learns from the documents that aren't held out; judges all."""
    return secret_scan.scan(table(spark, root, "documents"), learn=~language.held_out())


@query
def op6_language_id(spark, root):
    docs = table(spark, root, "documents")
    judged = language.predict(docs, language.train(docs))
    return judged.select("doc_id", language.held_out().alias("held_out"), "language.*")


@query
def op7_quality_rules(spark, root):
    return quality.judge(table(spark, root, "documents"))


@query
def op9_decontamination(spark, root):
    return decontaminate.digests(decontaminate.find(table(spark, root, "documents"), table(spark, root, "benchmark")))


@query
def op4_simhash(spark, root):
    return simhash.near_duplicates(table(spark, root, "documents"))


@query
def op10_sentencepiece(spark, root):
    return pieces.digests(table(spark, root, "documents"))


@query
def op8_suffix_dedup(spark, root):
    return suffix_dedup.digests(suffix_dedup.dedup(table(spark, root, "documents")))


@query
def op13_alignment(spark, root):
    return alignment.align(table(spark, root, "documents"))


@query
def op12_lexical_search(spark, root):
    return lexical.rank(table(spark, root, "documents"), table(spark, root, "benchmark"))


ORACLES["op12_lexical_search"] = r"""
WITH words AS (
  SELECT r, doc_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM (
    SELECT r, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents))),
lengths AS (SELECT r, doc_id, count(*) AS n FROM words GROUP BY ALL),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths),
asked AS (
  SELECT item_id, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark))
  GROUP BY ALL),
tfs AS (SELECT r, t, count(*) AS tf FROM words WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tfs, totals GROUP BY t, docs),
scored AS (
  SELECT item_id, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN tfs USING (t) JOIN weights USING (t) JOIN lengths USING (r), totals GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10"""


@query
def op11_warc(spark, root):
    return archives.round_trip(table(spark, root, "pages"))


ORACLES["op11_warc"] = r"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
kept AS (SELECT html, max(page_id) AS last FROM payloads GROUP BY html)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (5 * (k // 4) + 1)::BIGINT, 5))::INTEGER >> (15 - 5 * (k % 4))::INTEGER) & 31) + 1)::BIGINT, 1)
                   for k in range(32)], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM payloads JOIN kept USING (html)"""
