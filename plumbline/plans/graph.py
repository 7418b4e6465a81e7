"""Graph, inventory and estate queries over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import graph as G
from plumbline.plans.integrity import STEPS, event_edges
from plumbline.plans.registry import query


@query("disconnected_nodes", """
SELECT DISTINCT user_id FROM events e WHERE NOT EXISTS (
  SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts >= TIMESTAMP '2024-01-20')""")
def disconnected_nodes(t):
    edges = t.events.filter("event_type = 'purchase' and ts >= timestamp_ntz '2024-01-20'").select(
        F.col("user_id").alias("src"))
    return G.disconnected_nodes(t.events.select("user_id").distinct(), "user_id", edges, ("src",))


@query("node_degree", """
WITH e AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
SELECT 'part ' || CAST(l_partkey AS VARCHAR) AS node, count(*) AS degree FROM e GROUP BY 1 HAVING count(*) > 35
UNION ALL SELECT 'supplier ' || CAST(l_suppkey AS VARCHAR), count(*) FROM e GROUP BY 1 HAVING count(*) > 35""")
def node_degree(t):
    edges = t.lineitem.select("l_partkey", "l_suppkey").distinct().select(
        F.concat(F.lit("part "), F.col("l_partkey")).alias("src"),
        F.concat(F.lit("supplier "), F.col("l_suppkey")).alias("dst"))
    return G.node_degree(edges, above=35)


FLAGGED = STEPS + """, flagged AS (SELECT src, dst, CASE WHEN src < dst THEN 'both' ELSE 'single' END AS cross_filter,
  n % 2 = 0 AS is_active, CASE WHEN src = dst THEN 'sum' ELSE 'none' END AS summarize_by FROM edges)
"""


def flagged_edges(t):
    return event_edges(t).select(
        "src", "dst", F.when(F.col("src") < F.col("dst"), "both").otherwise("single").alias("cross_filter"),
        (F.col("n") % 2 == 0).alias("is_active"),
        F.when(F.col("src") == F.col("dst"), "sum").otherwise("none").alias("summarize_by"))


@query("edge_flags", FLAGGED + """
SELECT 'bidirectional' AS "check", count(*) AS n_edges, count(*) FILTER (WHERE cross_filter = 'both') AS n_hits,
       CASE WHEN count(*) = 0 THEN 'N/A' WHEN n_hits = 0 THEN 'PASS' WHEN n_hits > 3 THEN 'FAIL' ELSE 'WARN' END AS status FROM flagged
UNION ALL SELECT 'inactive', count(*), count(*) FILTER (WHERE NOT is_active) AS n_hits,
       CASE WHEN count(*) = 0 THEN 'N/A' WHEN n_hits = 0 THEN 'PASS' ELSE 'WARN' END FROM flagged
UNION ALL SELECT 'implicit_summary', count(*), count(*) FILTER (WHERE summarize_by = 'sum') AS n_hits,
       CASE WHEN count(*) = 0 THEN 'N/A' WHEN n_hits = 0 THEN 'PASS' ELSE 'WARN' END FROM flagged""")
def edge_flags(t):
    return G.edge_flags(flagged_edges(t))


@query("cross_group_edges", """
SELECT rc.r_name AS customer_region, rs.r_name AS supplier_region, count(*) AS n_edges
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN nation ns ON s_nationkey = ns.n_nationkey
JOIN region rc ON nc.n_regionkey = rc.r_regionkey JOIN region rs ON ns.n_regionkey = rs.r_regionkey
WHERE c_nationkey <> s_nationkey GROUP BY ALL""")
def cross_group_edges(t):
    buyers = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    lines = t.lineitem.select("l_orderkey", "l_suppkey")
    edges = (lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
             .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")))
    by_nation = G.cross_group_edges(edges, "c_nationkey", "s_nationkey")
    place = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    c = place.toDF("c_nationkey", "customer_region")
    s = place.toDF("s_nationkey", "supplier_region")
    return (by_nation.join(c, "c_nationkey").join(s, "s_nationkey")
            .groupBy("customer_region", "supplier_region").agg(F.sum("n_edges").alias("n_edges")))


@query("excess_members", """
SELECT c_nationkey, c_mktsegment, count(*) AS n_members FROM customer GROUP BY ALL HAVING count(*) > 5""")
def excess_members(t):
    return G.excess_members(t.customer, ["c_nationkey", "c_mktsegment"], 5)


@query("duplicate_records", """
SELECT p_name, p_brand, p_type, count(*) AS n_rows, min(p_partkey) AS keep_id FROM part GROUP BY ALL HAVING count(*) > 1""")
def duplicate_records(t):
    return G.duplicate_records(t.part, ["p_name", "p_brand", "p_type"], "p_partkey")


@query("status_health", """
SELECT o_custkey, count(*) AS n_rows, count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'P')) AS n_failing,
       CASE WHEN n_failing = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM orders GROUP BY o_custkey""")
def status_health(t):
    return G.status_health(t.orders, "o_custkey", "o_orderstatus", ("O", "P"))


@query("version_check", """
SELECT p_partkey, version FROM (
  SELECT p_partkey, replace(p_brand, 'Brand#', '') || '.' || CAST(p_size AS VARCHAR) AS version,
         CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS major FROM part) WHERE major < 10""")
def version_check(t):
    parts = t.part.select("p_partkey", F.concat_ws(
        ".", F.replace("p_brand", F.lit("Brand#"), F.lit("")), "p_size").alias("version"))
    return G.version_check(parts, "version", (10, 0))


@query("inventory_counts", "SELECT source, lang, count(*) AS n_items FROM documents GROUP BY ALL")
def inventory_counts(t):
    return G.inventory_counts(t.documents, ["source", "lang"])


@query("format_share", """
SELECT source, count(*) AS n_items, count(*) FILTER (WHERE lang <> 'en') AS n_other FROM documents GROUP BY source""")
def format_share(t):
    return G.format_share(t.documents, ["source"], "lang", "en")


@query("computed_share", """
SELECT 'n_chars' AS column_name, count(*) AS n_rows, count(*) FILTER (WHERE n_chars = length(text)) AS n_match,
       round(count(*) FILTER (WHERE n_chars = length(text))::DOUBLE / count(*), 4) AS share FROM documents
UNION ALL SELECT 'source', count(*), count(*) FILTER (WHERE source = 'src' || CAST(doc_id % 20 AS VARCHAR)),
       round(count(*) FILTER (WHERE source = 'src' || CAST(doc_id % 20 AS VARCHAR))::DOUBLE / count(*), 4) FROM documents""")
def computed_share(t):
    return G.computed_columns(t.documents, {
        "n_chars": F.length("text").cast("bigint"),
        "source": F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"))})


@query("pseudo_hierarchies", """
SELECT r_name, count(*) AS n_levels FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name HAVING count(*) <= 5""")
def pseudo_hierarchies(t):
    levels = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return G.pseudo_hierarchies(levels, "r_name", 5)


@query("estate_report", """
WITH b AS (SELECT source, lang, count(*) AS n_items FROM documents GROUP BY ALL),
     n AS (SELECT source, lang, string_agg(id, ', ' ORDER BY id) AS first_names FROM (
        SELECT source, lang, CAST(doc_id AS VARCHAR) AS id FROM documents
        QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) <= 3) GROUP BY ALL)
SELECT source, lang, n_items, CAST(sum(n_items) OVER (PARTITION BY source) AS BIGINT) AS n_total,
       round(n_items::DOUBLE / sum(n_items) OVER (PARTITION BY source), 4) AS share, first_names
FROM b JOIN n USING (source, lang)""")
def estate_report(t):
    from plumbline.operators.report import estate_report as report
    return report(t.documents, "source", "lang", name="doc_id")


@query("version_check_short", """
SELECT p_partkey, version FROM (SELECT p_partkey, CASE CAST(p_size % 3 AS INTEGER) WHEN 0 THEN '10' WHEN 1 THEN '9.12' ELSE '10.0.1' END AS version FROM part)
WHERE version = '9.12'""")
def version_check_short(t):
    size = F.col("p_size") % 3
    version = F.when(size == 0, "10").when(size == 1, "9.12").otherwise("10.0.1")
    return G.version_check(t.part.select("p_partkey", version.alias("version")), "version", (10, 0))
