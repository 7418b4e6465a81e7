"""The whole audit over the sample tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V
from plumbline.functions import predicates as PR
from plumbline.plans.audit import Inputs, run_audit
from plumbline.plans.catalog import RULES
from plumbline.plans.registry import query
from plumbline.plans.sample_sql import facts_sql, profile_sql

REFERENCES = [
    ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"),
]


def _like(pattern: str, column: str = "lower(column_name)") -> str:
    return f"regexp_matches({column}, '{pattern}')"


KEY = _like(V.KEY_NAME, "column_name")
WORDS = ", ".join(f"'{w}'" for w in V.BOOLEAN_WORDS)
AUDIT = ", ".join(f"'{n}'" for n in V.CREATED_NAMES + V.UPDATED_NAMES)
BAD = _like(V.BAD_IDENTIFIER, "column_name")
LONG = "kind = 'string' AND max_len > 500"
FLOATS = "data_type IN ('float', 'double')"
OLD = "data_type IN ('text', 'ntext', 'image')"
COLUMN_RULES = {
    "LH-006": LONG, "WH-004": LONG, "WH-033": LONG, "LH-007": f"{KEY} AND n_nulls > 0", "WH-010": f"{KEY} AND n_nulls > 0",
    "LH-008": FLOATS, "WH-003": FLOATS, "LH-009": BAD, "WH-005": BAD, "LH-S03": OLD, "WH-002": OLD,
    "LH-010": f"kind = 'string' AND {_like(V.DATE_NAME)}",
    "LH-011": f"kind = 'string' AND max_len <= 20 AND {_like(V.NUMBER_NAME)} AND NOT {_like(V.NUMBER_NAME_EXCEPT)}",
    "LH-031": "data_type LIKE 'array<%'", "LH-S01": _like(V.SENSITIVE_NAME), "WH-015": "kind = 'string' AND max_len > 8000",
    "SM-B01": "max_len > 100 AND n_distinct > 10000 AND n_distinct > max_distinct * 0.7",
    "SM-B02": f"max_len > 200 AND n_distinct > 100 AND {_like(V.FREE_TEXT_NAME)}",
    "SM-B03": f"max_len BETWEEN 32 AND 40 AND n_distinct > 1000 AND {_like(V.GUID_NAME)}",
    "SM-B04": "n_distinct = 1 AND lower(column_name) NOT LIKE '%rownum%'",
    "SM-B05": f"n_distinct = 2 AND max_len BETWEEN 1 AND 10 AND (lower(min_value) IN ({WORDS}) OR lower(max_value) IN ({WORDS}))",
    "SM-B06": f"kind = 'string' AND max_len BETWEEN 8 AND 30 AND {_like(V.DATE_NAME)}",
    "SM-B07": f"kind = 'string' AND max_len BETWEEN 1 AND 20 AND {_like(V.NUMBER_PREFIX)} "
              "AND try_cast(min_value AS DOUBLE) IS NOT NULL AND try_cast(max_value AS DOUBLE) IS NOT NULL",
    "SM-B13": f"n_distinct > 10000 AND (kind = 'date' OR (kind = 'string' AND max_len BETWEEN 15 AND 30)) "
              f"AND ({_like(V.TIMESTAMP_NAME)} OR column_name = 'ts')",
    "SM-B14": "n_distinct > 2 AND n_distinct <= 20 AND max_distinct > 10000 AND max_len BETWEEN 1 AND 50",
}
TABLE_RULES = {
    "LH-005": "n_rows = 0", "WH-011": "n_rows = 0", "WH-034": "n_rows BETWEEN 1 AND 10", "LH-S02": "n_rows > 1000000",
    "LH-012": "n_columns > 30", "SM-B09": "n_columns > 30", "WH-012": "n_columns > 50", "SM-B10": "n_columns > 100",
    "SM-B12": "n_columns = 1", "LH-013": "n_columns > 5 AND n_with_nulls > 0.9 * n_columns",
    "LH-014": "n_audit = 0", "WH-016": "n_audit = 0", "LH-015": "n_date_types > 1", "WH-013": "n_date_types > 1",
    "WH-037": "false", "LH-S04": "n_keys = 0", "WH-001": "n_unique_keys = 0", "WH-006": _like(V.BAD_IDENTIFIER, "table_name"),
    "SM-B08": "n_number_keys = 0 AND n_text_keys > 0 AND max_distinct > 1000", "SM-B11": "n_high_card > 5",
    "WH-014": "table_name NOT IN (" + ", ".join(f"'{n}'" for r in REFERENCES for n in (r[0], r[2])) + ")",
}
AUDIT_SQL = f"""WITH profile AS ({profile_sql()}),
cols AS (SELECT facts.table_name, facts.column_name, facts.data_type, coalesce(kind, 'other') AS kind, n_rows, n_nulls, n_distinct, min_value, max_value, max_len,
         max(n_distinct) OVER (PARTITION BY facts.table_name) AS max_distinct
         FROM {facts_sql()} LEFT JOIN profile p ON p.table_name = facts.table_name AND p.column_name = facts.column_name),
tabs AS (SELECT table_name, count(*) AS n_columns, max(n_rows) AS n_rows, max(n_distinct) AS max_distinct,
         count(*) FILTER (WHERE n_nulls > 0) AS n_with_nulls, count(*) FILTER (WHERE {KEY}) AS n_keys,
         count(*) FILTER (WHERE {KEY} AND n_nulls = 0 AND n_distinct = n_rows) AS n_unique_keys,
         count(*) FILTER (WHERE lower(column_name) IN ({AUDIT})) AS n_audit,
         count(*) FILTER (WHERE {_like(V.MODEL_KEY_SUFFIX)} AND kind = 'number') AS n_number_keys,
         count(*) FILTER (WHERE {_like(V.MODEL_KEY_SUFFIX)} AND kind = 'string' AND max_len > 0) AS n_text_keys,
         count(*) FILTER (WHERE n_distinct > 50000 AND max_len > 0) AS n_high_card,
         count(DISTINCT data_type) FILTER (WHERE data_type = 'timestamp_ntz') AS n_date_types FROM cols GROUP BY table_name),
hits AS (
""" + " UNION ALL ".join(
    [f"SELECT '{r}' AS rule_id, count(*) AS n_issues FROM cols WHERE {c}" for r, c in COLUMN_RULES.items()]
    + [f"SELECT '{r}', count(*) FROM tabs WHERE {c}" for r, c in TABLE_RULES.items()]
    + ["SELECT 'SM-009', count(*) FROM (SELECT count(*) AS n FROM tabs) WHERE n = 0",
       "SELECT 'SM-018', count(*) FROM (SELECT count(*) AS n FROM tabs) WHERE n > 20",
       f"SELECT 'SM-010', count(*) FROM (SELECT count(*) AS n FROM tabs WHERE {_like(V.DATE_TABLE_NAME, 'lower(table_name)')}) WHERE n = 0"]
    + ["SELECT 'WH-009', CAST(sum(n) AS BIGINT) FROM (" + " UNION ALL ".join(
        f"SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS n FROM {c} WHERE {ck} IS NOT NULL AND {ck} NOT IN (SELECT {pk} FROM {p})"
        for c, ck, p, pk in REFERENCES) + ")"]) + """),
rules AS (SELECT * FROM (VALUES """ + ", ".join(f"('{r}', '{s}', '{h}')" for r, s, h, _ in RULES) + """) r(rule_id, severity, on_hit))
SELECT rule_id, severity, CASE WHEN n_issues IS NULL THEN 'N/A' WHEN n_issues = 0 THEN 'PASS' ELSE on_hit END AS status,
       coalesce(n_issues, 0) AS n_issues FROM rules LEFT JOIN hits USING (rule_id)"""


@query("full_audit", AUDIT_SQL)
def full_audit(t):
    """Every rule of the catalog over the sample tables."""
    return run_audit(t.pick(), REFERENCES).select("rule_id", "severity", "status", "n_issues")


@query("boolean_names", f"""
WITH named AS (SELECT CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN 'is_' WHEN 1 THEN 'Has_' WHEN 2 THEN 'n_' ELSE 'the_' END || event_type AS name FROM events)
SELECT name, count(*) AS n_rows FROM named WHERE regexp_matches(lower(name), '{V.BOOLEAN_NAME}') GROUP BY name""")
def boolean_names(t):
    """Names that announce a yes or no."""
    stems = F.array(*map(F.lit, ("is_", "Has_", "n_", "the_")))
    named = t.events.select(F.concat(F.element_at(stems, (F.col("event_id") % 4 + 1).cast("int")), "event_type").alias("name"))
    return named.filter(PR.boolean_like(F.col("name"))).groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


@query("user_schemas", """
SELECT schema_name, count(*) AS n_orders FROM (
  SELECT CASE o_orderstatus WHEN 'F' THEN 'sys' WHEN 'O' THEN 'sales' ELSE 'INFORMATION_SCHEMA' END AS schema_name FROM orders)
WHERE schema_name = 'sales' GROUP BY 1""")
def user_schemas(t):
    """Objects outside the schemas of the system."""
    status = F.col("o_orderstatus")
    named = t.orders.select(F.when(status == "F", "sys").when(status == "O", "sales").otherwise("INFORMATION_SCHEMA").alias("schema_name"))
    return named.filter(PR.user_schema(F.col("schema_name"))).groupBy("schema_name").agg(F.count(F.lit(1)).alias("n_orders"))


@query("size_text", """
WITH sums AS (SELECT event_type, CAST(sum(floor(value) * 1000) AS BIGINT) AS size FROM events GROUP BY 1
  UNION ALL SELECT 'row ' || CAST(r_regionkey AS VARCHAR), CAST(r_regionkey * 500 AS BIGINT) FROM region)
SELECT event_type, CASE WHEN size >= 1073741824 THEN format('{:,.1f}', size / 1073741824.0) || ' GB' WHEN size >= 1048576 THEN format('{:,.1f}', size / 1048576.0) || ' MB'
  WHEN size >= 1024 THEN format('{:,.1f}', size / 1024.0) || ' KB' ELSE format('{:,}', size) || ' B' END AS size_text FROM sums""")
def size_text(t):
    """Byte counts as people read them."""
    sums = t.events.groupBy("event_type").agg(F.sum(F.floor("value") * 1000).cast("bigint").alias("size"))
    rows = t.region.select(F.concat(F.lit("row "), "r_regionkey").alias("event_type"), (F.col("r_regionkey") * 500).cast("bigint").alias("size"))
    return sums.unionByName(rows).select("event_type", PR.whole_word_size(F.col("size")).alias("size_text"))


# Inputs of the audit beside the tables, stated once for both engines; the sample tables play the inventories.
INPUTS = {
    "gateways": "SELECT CAST(s_suppkey AS STRING) AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'Personal' ELSE 'Resource' END AS type, "
                "CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE s_name END AS display_name FROM supplier",
    "connections": "SELECT CAST(c_custkey AS STRING) AS id, CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE CAST(c_custkey % 50 AS STRING) END AS gateway_id, c_name AS display_name, "
                   "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE 'Private' END AS privacy_level, CASE WHEN c_nationkey = 3 THEN '' ELSE 'Basic' END AS credential_type FROM customer",
    "datasources": "SELECT p_partkey AS id, CAST(p_partkey % 60 AS STRING) AS gateway_id, p_brand AS type, p_type AS details FROM part",
    "entities": "SELECT CASE o_custkey % 5 WHEN 0 THEN 'gateway' WHEN 1 THEN 'datasource' WHEN 2 THEN 'endpoint' WHEN 3 THEN 'database' ELSE 'store' END AS kind, "
                "'e' || CAST(o_custkey AS STRING) AS name, CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'P' THEN '' ELSE "
                "CASE o_custkey % 5 WHEN 0 THEN 'Live' WHEN 1 THEN 'OK' WHEN 2 THEN 'Success' WHEN 3 THEN 'Online' ELSE 'Running' END END AS status, "
                "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_orderkey % 4000 AS STRING) || '.12.1' END AS version FROM orders",
    "members": "SELECT c_mktsegment AS group_name, c_name AS member, CASE WHEN c_nationkey % 4 = 0 THEN 'Admin' WHEN c_nationkey % 4 = 1 THEN 'db_owner' ELSE 'Viewer' END AS role FROM customer",
    "exports": "SELECT n_name AS name, n_regionkey <> 1 AS is_running, n_regionkey = 2 AS is_disabled FROM nation",
    "functions": "SELECT r_name AS name FROM region",
    "catalog": "SELECT n_name AS table_name, CASE n_regionkey WHEN 0 THEN 'delta' WHEN 1 THEN 'Delta' WHEN 2 THEN NULL ELSE 'csv' END AS format FROM nation",
    "documented": "SELECT CASE p_size % 3 WHEN 0 THEN 'procedure' WHEN 1 THEN 'schema' ELSE 'measure' END AS kind, p_name AS name, "
                  "CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_type END AS description FROM part",
    "defaults": "SELECT 'part' AS table_name, p_name AS column_name, p_size % 2 = 0 AS is_nullable, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '0' END AS default_value FROM part",
    "dependencies": "SELECT 'v' || CAST(l_suppkey AS STRING) AS src, 't' || CAST(l_partkey % 30 AS STRING) AS dst, CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS src_schema, "
                    "CASE WHEN l_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS dst_schema FROM lineitem",
    "volumes": "SELECT event_type AS table_name, count(*) * 5000 AS n_rows, count(*) FILTER (WHERE value > 100) * 5000 AS n_hot FROM events GROUP BY event_type",
    "streamed": "SELECT DISTINCT event_type AS table_name FROM events WHERE event_type IN ('view', 'click')",
    "levels": "SELECT CAST(s_nationkey AS STRING) AS hierarchy FROM supplier",
    "failures": "SELECT 'u' || CAST(user_id AS STRING) AS entity, ts FROM events WHERE event_type = 'error'",
    "query_log": "SELECT event_id AS query_id, 'user ' || CAST(user_id AS STRING) AS query_text, event_type AS command_type, 'main' AS database, ts AS start_time, "
                 "value * 300 AS elapsed_ms, CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Succeeded' END AS status FROM events",
}


def _blank(column: str) -> str:
    return f"trim(coalesce({column}, '')) = ''"


def _failing(kind: str, *ok: str) -> str:
    return f"SELECT DISTINCT name FROM entities WHERE kind = '{kind}' AND NOT {_blank('status')} AND lower(status) NOT IN ({', '.join(repr(x) for x in ok)})"


INVENTORY_HITS = {
    "GW-012": f"SELECT 1 FROM gateways WHERE type <> 'Personal' AND {_blank('display_name')}",
    "GW-003": "SELECT 1 FROM gateways WHERE type <> 'Personal' AND id NOT IN (SELECT gateway_id FROM connections WHERE gateway_id IS NOT NULL)",
    "GW-008": "SELECT 1 FROM connections WHERE gateway_id NOT IN (SELECT id FROM gateways)",
    "GW-004": "SELECT 1 FROM datasources WHERE gateway_id NOT IN (SELECT gateway_id FROM connections WHERE gateway_id IS NOT NULL)",
    "GW-007": f"SELECT 1 FROM connections WHERE {_blank('credential_type')}", "GW-011": f"SELECT 1 FROM connections WHERE {_blank('privacy_level')}",
    "GW-010": "SELECT gateway_id FROM datasources GROUP BY gateway_id, type, details HAVING count(*) > 1",
    "GW-001": _failing("gateway", "live", "online"), "GW-005": _failing("datasource", "ok"), "LH-001": _failing("endpoint", "success"),
    "WH-031": _failing("database", "online"), "EH-001": _failing("store", "running", "active"),
    "GW-002": f"SELECT 1 FROM entities WHERE kind = 'gateway' AND NOT {_blank('version')} AND CAST(split_part(version, '.', 1) AS INTEGER) < 3000",
    "GW-006": "SELECT group_name FROM members WHERE role = 'Admin' GROUP BY 1 HAVING count(*) > 5",
    "WH-020": "SELECT group_name FROM members WHERE role = 'db_owner' GROUP BY 1 HAVING count(*) > 3",
    "EH-012": "SELECT 1 FROM exports WHERE NOT is_running OR is_disabled", "EH-020": "SELECT 1 FROM functions",
    "LH-003": "SELECT 1 FROM catalog WHERE coalesce(lower(format) <> 'delta', true)",
    **{rule: f"SELECT 1 FROM documented WHERE kind = '{kind}' AND {_blank('description')}" for rule, kind in (("WH-035", "procedure"), ("WH-038", "schema"), ("SM-008", "measure"))},
    "WH-036": f"SELECT 1 FROM defaults WHERE NOT is_nullable AND {_blank('default_value')}",
    "WH-021": "SELECT src FROM dependencies GROUP BY src HAVING count(DISTINCT dst) > 10",
    "WH-022": "SELECT DISTINCT src, dst FROM dependencies WHERE src_schema <> dst_schema",
    "EH-011": "SELECT 1 FROM streamed", "EH-013": "SELECT 1 FROM volumes WHERE n_rows > 0 AND n_hot < n_rows * 0.5",
    "EH-024": "SELECT 1 FROM volumes WHERE n_rows >= 1000000 AND table_name NOT IN (SELECT table_name FROM streamed)",
    "SM-029": "SELECT hierarchy FROM levels GROUP BY 1 HAVING count(*) <= 2",
    "EH-010": "SELECT DISTINCT entity FROM failures WHERE ts > TIMESTAMP '2024-01-24'",
    "WH-023": "SELECT 1 FROM query_log WHERE status = 'Succeeded' AND elapsed_ms > 60000",
    "WH-025": "SELECT 1 FROM query_log WHERE status = 'Failed'", "EH-009": "SELECT 1 FROM query_log WHERE status = 'Failed'",
    "LH-002": "SELECT 1",
}


@query("inventory_audit", "WITH " + ", ".join(f"{n} AS ({q})" for n, q in INPUTS.items()) + ", hits AS (" + " UNION ALL ".join(
    f"SELECT '{r}' AS rule_id, count(*) AS n_issues FROM ({q})" for r, q in INVENTORY_HITS.items()) + "), rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{r}', '{s}', '{h}')" for r, s, h, _ in RULES) + """) r(rule_id, severity, on_hit))
SELECT rule_id, severity, CASE WHEN n_issues = 0 THEN 'PASS' ELSE on_hit END AS status, n_issues FROM rules JOIN hits USING (rule_id)""")
def inventory_audit(t):
    """The same audit with inventories, logs and settings at hand: the rules that have nothing to look at in ``full_audit``."""
    source = t.pick(["supplier", "customer", "part", "orders", "nation", "region", "lineitem", "events"])
    frames = {}
    for name, sql in INPUTS.items():
        for table, df in source.items():
            sql = re.sub(rf"\bFROM {table}\b", f"FROM {{{table}}}", sql)
        frames[name] = t.spark.sql(sql, **{k: v for k, v in source.items() if f"{{{k}}}" in sql})
    inputs = Inputs(**frames, store_name="no layer", as_of="2024-01-31 00:00:00")
    results = run_audit(t.pick(["region", "nation"]), inputs=inputs)
    return results.filter(F.col("rule_id").isin(*INVENTORY_HITS)).select("rule_id", "severity", "status", "n_issues")
