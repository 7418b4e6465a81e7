"""Query-log queries. The sample events play the part of a log: type is the command,
value the elapsed time, errors are failures, the user is the query template."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import logs as L
from plumbline.plans.registry import query
from plumbline.session import scratch_path
from plumbline.sources.facts import pick
from plumbline.sources.querylog import QUERY_LOG, log_view, read_query_log

AS_OF = "2024-01-31 00:00:00"
ORDERS_AS_OF = "2001-08-01"

LOG = """WITH log AS (
  SELECT event_id AS query_id, 'user ' || CAST(user_id AS VARCHAR) AS query_text, event_type AS command_type,
         'db' || CAST(user_id % 3 AS VARCHAR) AS database, ts AS start_time, value AS elapsed_ms,
         CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Succeeded' END AS status FROM events)
"""
MEAN = "(sum(elapsed_ms::DECIMAL(18,4))::DOUBLE / count(elapsed_ms))"


def log(t):
    events = t.events.withColumn("template", F.concat(F.lit("user "), "user_id"))
    return log_view(
        events, query_id="event_id", text="template", kind="event_type", started="ts", elapsed="value",
        failed=F.col("event_type") == "error",
        database=F.concat(F.lit("db"), (F.col("user_id") % 3).cast("string")))


@query("slow_queries", LOG + """
SELECT query_id, left(query_text, 300) AS query_text, command_type, elapsed_ms, elapsed_ms > 300 AS is_slow
FROM log WHERE status = 'Succeeded' ORDER BY elapsed_ms DESC, query_id LIMIT 15""")
def slow_queries(t):
    return L.slow_queries(log(t), slow_ms=300)


@query("slow_total", LOG + """
SELECT count(*) AS n_queries, count(*) FILTER (WHERE elapsed_ms > 300) AS n_slow FROM log WHERE status = 'Succeeded'""")
def slow_total(t):
    return L.slow_total(log(t), slow_ms=300)


@query("frequent_queries", LOG + f"""
SELECT left(query_text, 300) AS query_text, count(*) AS n_runs, {MEAN} AS avg_ms, max(elapsed_ms) AS max_ms,
       count(*) > 10 AND {MEAN} > 60 AS is_hot
FROM log WHERE status = 'Succeeded' GROUP BY 1 ORDER BY n_runs DESC, query_text LIMIT 15""")
def frequent_queries(t):
    return L.frequent_queries(log(t), slow_ms=60)


@query("frequent_slow", LOG + f"""
SELECT left(query_text, 300) AS query_text, count(*) AS n_runs, {MEAN} AS avg_ms, max(elapsed_ms) AS max_ms, true AS is_hot
FROM log WHERE status = 'Succeeded' GROUP BY 1 HAVING count(*) > 10 AND {MEAN} > 60""")
def frequent_slow(t):
    return L.frequent_queries(log(t), k=None, slow_ms=60).filter("is_hot")


@query("failed_queries", LOG + """
SELECT query_id, left(query_text, 300) AS query_text, command_type, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS started
FROM log WHERE status = 'Failed' ORDER BY start_time DESC, query_id DESC LIMIT 10""")
def failed_queries(t):
    return L.failed_queries(log(t))


CLASSES = (("license", r"license"), ("secret", r"token ="), ("email", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"))


@query("failure_categories", "SELECT CASE " + " ".join(
    f"WHEN regexp_matches(lower(text), '{p}') THEN '{c}'" for c, p in CLASSES) + """ ELSE 'other' END AS category,
  count(*) AS n_failures FROM documents GROUP BY 1""")
def failure_categories(t):
    return L.failure_categories(t.documents, "text", CLASSES)


@query("daily_volume", LOG + f"SELECT CAST(start_time AS DATE) AS day, count(*) AS n_queries, {MEAN} AS avg_ms FROM log GROUP BY 1")
def daily_volume(t):
    return L.daily_volume(log(t))


@query("recent_days", LOG + f"""
SELECT CAST(start_time AS DATE) AS day, count(*) AS n_queries, {MEAN} AS avg_ms FROM log GROUP BY 1 ORDER BY day DESC LIMIT 14""")
def recent_days(t):
    return L.daily_volume(log(t), 14)


@query("recent_health", LOG + f"""
SELECT count(*) AS n_queries, {MEAN} AS avg_ms, CASE WHEN count(*) = 0 THEN 'N/A' WHEN {MEAN} < 40 THEN 'PASS' WHEN {MEAN} < 60 THEN 'WARN' ELSE 'FAIL' END AS status
FROM log WHERE status = 'Succeeded' AND start_time > TIMESTAMP '2024-01-24'""")
def recent_health(t):
    return L.recent_health(log(t), AS_OF, warn_ms=40, fail_ms=60)


@query("command_profile", LOG + f"""
SELECT database, command_type, count(*) AS n_queries, {MEAN} AS avg_ms, max(elapsed_ms) AS max_ms,
       round(quantile_cont(elapsed_ms, 0.95), 4) AS p95_ms, count(*) FILTER (WHERE status = 'Failed') AS n_failed, {MEAN} > 50 AS is_slow
FROM log WHERE start_time > TIMESTAMP '2024-01-24' GROUP BY ALL""")
def command_profile(t):
    return L.command_profile(log(t), AS_OF, slow_ms=50)


@query("ingestion_failures", """
SELECT user_id, json_extract_string(props, '$.k') AS code, count(*) AS n_failures, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_failure
FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-24' GROUP BY ALL""")
def ingestion_failures(t):
    failed = t.events.filter("event_type = 'error'").withColumn("code", F.get_json_object("props", "$.k"))
    return L.ingestion_failures(failed, ["user_id", "code"], "ts", AS_OF)


LATE = "date_diff('microsecond', max(ts), TIMESTAMP '2024-01-31') / 3600000000.0"


@query("data_freshness", f"""
SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest, CAST(floor({LATE} / 24) AS BIGINT) AS days_old
FROM events GROUP BY user_id HAVING {LATE} > 24""")
def data_freshness(t):
    return L.data_freshness(t.events, "user_id", "ts", AS_OF, days=1)


@query("ingestion_latency", f"""
SELECT event_type, count(*) AS n_rows, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest, round({LATE}, 3)::DOUBLE AS hours_old
FROM events GROUP BY event_type HAVING count(*) >= 500 AND {LATE} > 0.01""")
def ingestion_latency(t):
    return L.ingestion_latency(t.events, "event_type", "ts", AS_OF, min_rows=500, hours=0.01)


@query("view_freshness", f"""
WITH v AS (SELECT user_id, max(ts) FILTER (WHERE event_type = 'view') AS last_run, count(*) FILTER (WHERE event_type = 'error') < 8 AS healthy,
                  count(*) FILTER (WHERE event_type = 'purchase') > 4 AS enabled FROM events GROUP BY user_id)
SELECT 'view ' || CAST(user_id AS VARCHAR) AS name,
       CASE WHEN NOT healthy THEN 'unhealthy' WHEN NOT enabled THEN 'disabled' WHEN last_run IS NULL THEN 'never run'
            WHEN date_diff('microsecond', last_run, TIMESTAMP '2024-01-31') / 3600000000.0 > 24 THEN 'stale' ELSE 'fresh' END AS state,
       round(date_diff('microsecond', last_run, TIMESTAMP '2024-01-31') / 3600000000.0, 3)::DOUBLE AS hours_old FROM v""")
def view_freshness(t):
    return L.view_freshness(event_views(t), AS_OF)


def event_views(t):
    kind = F.col("event_type")
    views = t.events.groupBy("user_id").agg(
        F.max(F.when(kind == "view", F.col("ts"))).alias("last_run"),
        (F.count_if(kind == "error") < 8).alias("is_healthy"), (F.count_if(kind == "purchase") > 4).alias("is_enabled"))
    return views.select(F.concat(F.lit("view "), "user_id").alias("name"), "is_healthy", "is_enabled", "last_run")


@query("stream_candidates", """
SELECT event_type, count(*) AS n_rows FROM events GROUP BY event_type HAVING count(*) >= 500
  AND event_type NOT IN (SELECT event_type FROM events WHERE value > 300)""")
def stream_candidates(t):
    return L.stream_candidates(t.events, "event_type", t.events.filter("value > 300"), min_rows=500)


@query("journal_counts", "SELECT event_type, count(*) AS n_events FROM events WHERE ts > TIMESTAMP '2024-01-24' GROUP BY event_type")
def journal_counts(t):
    return L.journal_counts(t.events, "event_type", "ts", AS_OF)


@query("stale_statistics", """
WITH newest AS (SELECT o_custkey AS c_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, 'stale' AS reason, CAST(date_diff('day', CAST(last AS DATE), DATE '2001-08-01') AS INTEGER) AS days_old FROM newest
WHERE date_diff('day', CAST(last AS DATE), DATE '2001-08-01') > 30
UNION ALL SELECT c_custkey, 'missing', NULL FROM customer c WHERE NOT EXISTS (SELECT 1 FROM newest n WHERE n.c_custkey = c.c_custkey)""")
def stale_statistics(t):
    orders = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    return L.stale_statistics(t.customer, orders, "c_custkey", "o_orderdate", ORDERS_AS_OF)


@query("long_templates", LOG + """
SELECT left(query_text, 300) AS query_text, n_runs, avg_ms, max_ms, n_runs > 10 AND avg_ms > 0.00002 AS is_hot FROM (
  SELECT repeat('x', 300) || command_type AS query_text, count(*) AS n_runs, max(ms) AS max_ms,
         sum(ms::DECIMAL(38,12))::DOUBLE / count(ms) AS avg_ms
  FROM (SELECT *, (query_id % 7) / 100000.0::DOUBLE AS ms FROM log) WHERE status = 'Succeeded' GROUP BY 1)""")
def long_templates(t):
    """Texts that differ only behind 300 characters, with very short times."""
    rows = log(t).withColumns({
        "query_text": F.concat(F.repeat(F.lit("x"), 300), "command_type"), "elapsed_ms": (F.col("query_id") % 7) / F.lit(100000.0)})
    return L.frequent_queries(rows, k=None, slow_ms=0.00002)


@query("query_log_scan", """
SELECT event_type AS command_type, count(*) AS n_runs, CAST(min(event_id) AS BIGINT) AS first_query, true AS pushed FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1""")
def query_log_scan(t):
    """The log as files with a declared schema, read from a moment on; the moment reaches the scan."""
    path = scratch_path(t.spark, "query-log")
    log(t).withColumn("row_count", F.lit(None).cast("bigint")).select(*QUERY_LOG.names).write.parquet(path)
    recent = read_query_log(t.spark, path, since="2024-01-20")
    pushed = "GreaterThanOrEqual(start_time" in recent._jdf.queryExecution().executedPlan().toString()
    return recent.groupBy("command_type").agg(F.count(F.lit(1)).alias("n_runs"), F.min("query_id").alias("first_query")).withColumn("pushed", F.lit(pushed))


@query("tolerant_pick", """
SELECT c_custkey, c_name AS label, 'none' AS phone, c_mktsegment AS segment FROM customer""")
def tolerant_pick(t):
    """Columns by the first spelling that a table has, or a default."""
    c = t.customer
    return c.select("c_custkey", pick(c, "customer_name", "c_name").alias("label"), pick(c, "c_phone", "phone", default="none").alias("phone"),
                    pick(c, "c_mktsegment", "segment").alias("segment"))
