"""Column-content queries over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V
from plumbline.operators import columns as C
from plumbline.operators import profile as P
from plumbline.plans.registry import query
from plumbline.plans.sample_sql import SAMPLE_COLUMNS, counts_sql, profile_cell, with_profile
from plumbline.sources.facts import column_facts

ALL = list(SAMPLE_COLUMNS)

MAXED = """, maxed AS (
  SELECT *, max(n_distinct) OVER (PARTITION BY table_name) AS max_distinct FROM profile)"""


def _sql(body: str, tables, extra: str = "", maxed: bool = False) -> str:
    text = with_profile("", tables, extra)
    return text + (MAXED if maxed else "") + body


@query("high_card_text", _sql("""
SELECT table_name, column_name, n_distinct, max_distinct, max_len FROM maxed
WHERE max_len > 100 AND n_distinct > 100 AND n_distinct > max_distinct * 0.7""", ALL, maxed=True))
def high_card_text(t):
    return C.high_card_text(P.column_profile(t.pick()), min_distinct=100)


@query("free_text_columns", _sql(f"""
SELECT table_name, column_name, n_distinct, max_len FROM profile
WHERE max_len > 200 AND n_distinct > 30 AND regexp_matches(lower(column_name), '{V.FREE_TEXT_NAME}')""", ALL))
def free_text_columns(t):
    return C.free_text_columns(P.column_profile(t.pick()), min_distinct=30)


UUID_SQL = ("lower(substr(md5(CAST(event_id AS VARCHAR)),1,8) || '-' || substr(md5(CAST(event_id AS VARCHAR)),9,4) || '-' || "
            "substr(md5(CAST(event_id AS VARCHAR)),13,4) || '-' || substr(md5(CAST(event_id AS VARCHAR)),17,4) || '-' || "
            "substr(md5(CAST(event_id AS VARCHAR)),21,12))")


def _events_with_uuid(t):
    digest = F.md5(F.col("event_id").cast("string"))
    parts = [F.substring(digest, *span) for span in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return t.events.select("event_id", "event_type", "props", F.concat_ws("-", *parts).alias("event_uuid"))


@query("guid_columns", f"""
WITH profile AS ({profile_cell('events', 'event_uuid', 's', expr=UUID_SQL)}
UNION ALL {profile_cell('events', 'props', 's')})
SELECT table_name, column_name, n_distinct, max_len FROM profile
WHERE max_len BETWEEN 32 AND 40 AND n_distinct > 1000 AND regexp_matches(lower(column_name), 'guid|uuid|objectid')""")
def guid_columns(t):
    return C.guid_columns(P.column_profile({"events": _events_with_uuid(t)}, columns=["event_uuid", "props"]))


def _share_sql(column: str, expr: str) -> str:
    return (f"SELECT '{column}' AS column_name, count({expr}) AS n_values, "
            f"count(*) FILTER (WHERE regexp_matches(lower({expr}), '{V.UUID_VALUE}')) AS n_match, "
            f"round(count(*) FILTER (WHERE regexp_matches(lower({expr}), '{V.UUID_VALUE}'))::DOUBLE / count({expr}), 4) AS match_share "
            f"FROM events")


@query("guid_content", " UNION ALL ".join([
    _share_sql("event_uuid", UUID_SQL), _share_sql("props", "props"), _share_sql("event_type", "event_type")]))
def guid_content(t):
    return C.match_share(_events_with_uuid(t), ["event_uuid", "props", "event_type"], V.UUID_VALUE)


VIEWS = "(SELECT * FROM events WHERE event_type = 'view')"


@query("constant_columns", f"""
WITH profile AS ({profile_cell('events', 'event_type', 's', VIEWS)} UNION ALL {profile_cell('events', 'value', 'd', VIEWS)}
UNION ALL {profile_cell('events', 'user_id', 'i', VIEWS)} UNION ALL {profile_cell('events', 'props', 's', VIEWS)})
SELECT table_name, column_name, min_value AS only_value FROM profile WHERE n_distinct = 1""")
def constant_columns(t):
    views = t.events.filter("event_type = 'view'")
    return C.constant_columns(P.column_profile({"events": views}, columns=["event_type", "value", "user_id", "props"]))


@query("bool_as_text", _sql("""
SELECT table_name, column_name, min_value, max_value FROM profile
WHERE n_distinct = 2 AND max_len > 0 AND max_len <= 10
  AND (lower(min_value) IN ('yes','no','f','o') OR lower(max_value) IN ('yes','no','f','o'))""", ALL))
def bool_as_text(t):
    words = V.BOOLEAN_WORDS + ("f", "o")
    return C.bool_as_text(P.column_profile(t.pick()), words)


ORDER_TEXT = """(SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date_text,
  split_part(o_orderpriority, '-', 1) AS num_priority, o_orderpriority AS num_priority_label FROM orders)"""


def _order_text(t):
    return t.orders.select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date_text"),
        F.split("o_orderpriority", "-")[0].alias("num_priority"),
        F.col("o_orderpriority").alias("num_priority_label"))


ORDER_TEXT_PROFILE = " UNION ALL ".join(
    profile_cell("orders", c, "s", ORDER_TEXT) for c in ("order_date_text", "num_priority", "num_priority_label"))


@query("date_as_text", f"""
WITH profile AS ({ORDER_TEXT_PROFILE})
SELECT table_name, column_name, min_value, max_value, max_len FROM profile
WHERE max_len BETWEEN 8 AND 30 AND kind = 'string' AND regexp_matches(lower(column_name), '{V.DATE_NAME}')""")
def date_as_text(t):
    return C.date_as_text(P.column_profile({"orders": _order_text(t)}))


@query("number_as_text", f"""
WITH profile AS ({ORDER_TEXT_PROFILE})
SELECT table_name, column_name, min_value, max_value FROM profile
WHERE kind = 'string' AND max_len BETWEEN 1 AND 20 AND regexp_matches(lower(column_name), '{V.NUMBER_PREFIX}')
  AND try_cast(min_value AS DOUBLE) IS NOT NULL AND try_cast(max_value AS DOUBLE) IS NOT NULL""")
def number_as_text(t):
    return C.number_as_text(P.column_profile({"orders": _order_text(t)}))


@query("text_parse_rates", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count({c}) AS n_values, count(try_cast({c} AS DOUBLE)) AS n_number, "
    f"count(try_cast({c} AS TIMESTAMP)) AS n_date FROM {ORDER_TEXT}"
    for c in ("order_date_text", "num_priority", "num_priority_label")))
def text_parse_rates(t):
    return C.parse_rates(_order_text(t), ["order_date_text", "num_priority", "num_priority_label"])


def _exact_sql(table: str, column: str) -> str:
    bad = f"count(*) FILTER (WHERE abs({column} * 100 - round({column} * 100)) > 1e-6)"
    return (f"SELECT '{table}' AS table_name, '{column}' AS column_name, count({column}) AS n_values, {bad} AS n_inexact, "
            f"max(CAST(floor(abs({column})) AS BIGINT)) AS max_whole, {bad} = 0 AS is_exact, "
            f"CASE WHEN {bad} = 0 THEN 'decimal(' || CAST(length(CAST(max(CAST(floor(abs({column})) AS BIGINT)) AS VARCHAR)) + 2 AS VARCHAR) "
            f"|| ',2)' END AS decimal_type FROM {table}")


@query("float_exactness", " UNION ALL ".join(
    _exact_sql(t, c) for t, c in (("lineitem", "l_extendedprice"), ("lineitem", "l_discount"),
                                  ("events", "value"), ("part", "p_retailprice"))))
def float_exactness(t):
    parts = [("lineitem", ["l_extendedprice", "l_discount"]), ("events", ["value"]), ("part", ["p_retailprice"])]
    out = None
    for name, cols in parts:
        one = C.float_exactness(t[name], cols).select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("oversized_strings", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n_values, CAST(max(length({c})) AS BIGINT) AS max_len, "
    f"round(quantile_cont(length({c}), 0.95), 2)::DOUBLE AS p_len FROM {t} HAVING max(length({c})) > 500"
    for t, c in (("documents", "text"), ("pages", "html"), ("pages", "url"), ("conversations", "text"))))
def oversized_strings(t):
    out = None
    for name, cols in (("documents", ["text"]), ("pages", ["html", "url"]), ("conversations", ["text"])):
        one = C.observed_lengths(t[name], cols).select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out.filter("max_len > 500").withColumn("p_len", F.round("p_len", 2))


@query("blob_columns", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS n_values, count(*) FILTER (WHERE length({c}) > 8000) AS n_over, "
    f"round(count(*) FILTER (WHERE length({c}) > 8000)::DOUBLE / count({c}), 4) AS over_share FROM {t}"
    for t, c in (("documents", "text"), ("pages", "html"), ("conversations", "text"))))
def blob_columns(t):
    out = None
    for name, col in (("documents", "text"), ("pages", "html"), ("conversations", "text")):
        one = C.blob_columns(t[name], [col]).select(F.lit(name).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("high_precision_ts", _sql("""
SELECT table_name, column_name, kind, n_distinct FROM profile
WHERE kind = 'date' AND n_distinct > 500 AND (column_name = 'ts' OR regexp_matches(lower(column_name), 'timestamp|datetime|_ts$|_at$'))
""", ALL))
def high_precision_ts(t):
    return C.high_precision_ts(P.column_profile(t.pick()), min_distinct=500)


@query("time_grains", """
SELECT 'raw' AS grain, count(DISTINCT ts) AS n_distinct FROM events
UNION ALL SELECT 'hour', count(DISTINCT date_trunc('hour', ts)) FROM events
UNION ALL SELECT 'day', count(DISTINCT CAST(ts AS DATE)) FROM events""")
def time_grains(t):
    profile = P.column_profile({"events": C.time_grain_columns(t.events, "ts")})
    return profile.select(F.col("column_name").alias("grain"), "n_distinct")


@query("low_card_in_fact", _sql("""
SELECT table_name, column_name, n_distinct, max_distinct FROM maxed
WHERE n_distinct > 2 AND n_distinct <= 20 AND max_distinct > 1000 AND max_len > 0 AND max_len <= 50""", ALL, maxed=True))
def low_card_in_fact(t):
    return C.low_card_in_fact(P.column_profile(t.pick()), table_above=1000)


@query("string_keys", f"""
WITH profile AS ({profile_cell('customer', 'c_name_key', 's', expr='c_name')} UNION ALL {profile_cell('customer', 'c_acctbal', 'd')}
UNION ALL {profile_cell('orders', 'o_orderkey', 'i')} UNION ALL {profile_cell('orders', 'o_orderstatus', 's')})
SELECT table_name, max(n_distinct) AS max_distinct FROM profile GROUP BY table_name
HAVING NOT bool_or(regexp_matches(lower(column_name), '(key|id)$') AND kind = 'number')
   AND bool_or(regexp_matches(lower(column_name), '(key|id)$') AND kind = 'string' AND max_len > 0) AND max(n_distinct) > 100""")
def string_keys(t):
    customer = t.customer.select(F.col("c_name").alias("c_name_key"), "c_acctbal")
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    return C.string_keys(P.column_profile({"customer": customer, "orders": orders}), table_above=100)


@query("many_high_card", _sql("""
SELECT table_name, count(*) AS n_columns FROM profile WHERE n_distinct > 20 AND max_len > 0
GROUP BY table_name HAVING count(*) > 1""", ALL))
def many_high_card(t):
    return C.many_high_card(P.column_profile(t.pick()), min_distinct=20, columns=1)


@query("near_unique_numeric", _sql("""
SELECT table_name, column_name, n_distinct, max_distinct, round(n_distinct::DOUBLE / max_distinct, 5) AS unique_share FROM maxed
WHERE kind = 'number' AND n_distinct > max_distinct * 0.95 AND n_distinct > 1000
  AND NOT regexp_matches(lower(column_name), 'key|id|pk')""", ALL, maxed=True))
def near_unique_numeric(t):
    return C.near_unique_numeric(P.column_profile(t.pick()))


LABELS = "(SELECT *, quality * 2 + 1 AS grade FROM labels)"


@query("odd_binary", f"""
WITH profile AS ({profile_cell('labels', 'quality', 'i', LABELS)} UNION ALL {profile_cell('labels', 'toxic', 'i', LABELS)}
UNION ALL {profile_cell('labels', 'grade', 'i', LABELS)})
SELECT table_name, column_name, min_value, max_value FROM profile
WHERE n_distinct = 2 AND kind = 'number' AND NOT (min_value = '0' AND max_value = '1') AND NOT (min_value = '-1' AND max_value = '0')""")
def odd_binary(t):
    labels = t.labels.select("quality", "toxic", (F.col("quality") * 2 + 1).alias("grade"))
    return C.odd_binary(P.column_profile({"labels": labels}))


@query("underscore_columns", "SELECT 'events' AS table_name, '_value' AS column_name, count(DISTINCT value) AS n_distinct FROM events")
def underscore_columns(t):
    events = t.events.select(F.col("value").alias("_value"), F.col("props").alias("__props"), "event_type")
    return C.underscore_columns(P.column_profile({"events": events}))


@query("repeated_columns", """
WITH uses AS (
  SELECT 'text' AS base_name, 'documents' AS table_name, text AS value FROM documents
  UNION ALL SELECT 'text', 'conversations', text FROM conversations UNION ALL SELECT 'text', 'benchmark', text FROM benchmark
  UNION ALL SELECT 'nationkey', 'nation', CAST(n_nationkey AS VARCHAR) FROM nation
  UNION ALL SELECT 'nationkey', 'customer', CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'nationkey', 'supplier', CAST(s_nationkey AS VARCHAR) FROM supplier
), owned AS (SELECT base_name, value, count(DISTINCT table_name) AS n FROM uses GROUP BY ALL)
SELECT base_name, count(*) AS n_values, count(*) FILTER (WHERE n > 1) AS n_shared, 3::BIGINT AS n_tables,
       CASE base_name WHEN 'text' THEN 'benchmark, conversations, documents' ELSE 'customer, nation, supplier' END AS tables
FROM owned GROUP BY base_name""")
def repeated_columns(t):
    tables = t.pick()
    repeated = C.repeated_columns(column_facts(tables), tables_above=2, strip_prefix=True)
    overlap = C.value_overlap(tables, {
        "text": {"documents": "text", "conversations": "text", "benchmark": "text"},
        "nationkey": {"nation": "n_nationkey", "customer": "c_nationkey", "supplier": "s_nationkey"}})
    return repeated.join(overlap, "base_name")


def _pii_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT source, '{label}' AS pii_class, count(*) FILTER (WHERE regexp_matches(text, '{pattern}')) AS n_rows FROM documents "
        f"GROUP BY source HAVING count(*) FILTER (WHERE regexp_matches(text, '{pattern}')) > 0" for label, pattern in V.PII_PATTERNS)


@query("sensitive_content", _pii_sql())
def sensitive_content(t):
    return C.sensitive_content(t.documents, "text", "source")


@query("unmasked_sensitive", f"""
SELECT doc_id, source FROM documents d WHERE regexp_matches(text, '{dict(V.PII_PATTERNS)['email']}')
  AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def unmasked_sensitive(t):
    found = t.documents.filter(F.col("text").rlike(dict(V.PII_PATTERNS)["email"])).select("doc_id", "source")
    return C.unmasked(found, t.labels, ["doc_id"])


@query("mixed_types", """
WITH cells AS (
  SELECT 'order_note' AS column_name, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
      WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS VARCHAR) ELSE o_orderstatus END AS v FROM orders
  UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM orders
), counted AS (
  SELECT column_name, CASE WHEN regexp_matches(v, '^[+-]?[0-9]+$') THEN 'integer' WHEN regexp_matches(v, '^[+-]?[0-9]+\\.[0-9]+$') THEN 'decimal'
      WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' ELSE 'text' END AS shape, count(*) AS n_rows
  FROM cells GROUP BY ALL)
SELECT column_name, shape, n_rows, count(*) OVER (PARTITION BY column_name) AS n_shapes FROM counted
QUALIFY n_shapes > 1""")
def mixed_types(t):
    key = F.col("o_orderkey") % 3
    note = (F.when(key == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .when(key == 1, F.col("o_custkey").cast("string")).otherwise(F.col("o_orderstatus")))
    return C.mixed_formats(t.orders.select(note.alias("order_note"), "o_orderstatus"), ["order_note", "o_orderstatus"])


@query("legacy_or_nested_types", """
SELECT 'embeddings' AS table_name, 'embedding' AS column_name, 'array<float>' AS data_type, count(*) AS n_rows,
       CAST(sum(len(embedding)) AS BIGINT) AS n_elements, CAST(max(len(embedding)) AS INTEGER) AS max_elements FROM embeddings""")
def legacy_or_nested_types(t):
    tables = t.pick()
    legacy = C.legacy_types(column_facts(tables))
    return C.nested_load(tables).unionByName(legacy, allowMissingColumns=True)


@query("naming_audit", f"""
WITH names AS (
  SELECT DISTINCT 'part' AS kind, p_name AS name FROM part UNION ALL SELECT DISTINCT 'priority', o_orderpriority FROM orders
  UNION ALL SELECT DISTINCT 'event', event_type FROM events UNION ALL SELECT DISTINCT 'source', source FROM documents)
SELECT kind, count(*) AS n_names, count(*) FILTER (WHERE regexp_matches(name, '[^A-Za-z0-9_]')) AS n_bad,
       count(*) FILTER (WHERE name IS NULL OR trim(name) = '') AS n_blank,
       count(*) FILTER (WHERE regexp_matches(lower(name), '{V.DATE_TABLE_NAME}')) AS n_date_like,
       count(*) FILTER (WHERE regexp_matches(lower(name), '{"|".join(w for _, ws in V.LAYER_WORDS for w in ws)}')) AS n_layered
FROM names GROUP BY kind""")
def naming_audit(t):
    names = None
    for kind, df, col in (("part", t.part, "p_name"), ("priority", t.orders, "o_orderpriority"),
                          ("event", t.events, "event_type"), ("source", t.documents, "source")):
        one = df.select(F.lit(kind).alias("kind"), F.col(col).alias("name")).distinct()
        names = one if names is None else names.unionByName(one)
    return C.naming_audit(names)


@query("audit_columns", counts_sql())
def audit_columns(t):
    tables = t.pick()
    return C.audit_columns(column_facts(tables)).join(P.row_counts(tables), "table_name")
