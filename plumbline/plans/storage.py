"""Storage-layout queries. The sample events play the part of a transaction log:

20 tables (by user), one commit per event, a file path per ``props.k``; errors remove
the path, clicks only commit, everything else adds it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.fixed_values import MB
from plumbline.operators import storage as S
from plumbline.plans.catalog import setting_rules_frame
from plumbline.plans.registry import query
from plumbline.session import move, names, remove, scratch_path
from plumbline.sources import txlog as L

AS_OF = "2024-01-31 00:00:00"


def log_events(t):
    table = F.concat(F.lit("store_"), (F.col("user_id") % 20).cast("string"))
    path = F.concat(F.lit("part-"), F.get_json_object("props", "$.k"), F.lit(".parquet"))
    return t.events.select(
        table.alias("table_name"), F.col("event_id").alias("version"), path.alias("path"), "ts", "event_type",
        F.col("user_id"), F.floor(F.col("value") * 4 * MB).cast("bigint").alias("size"))


def file_actions(t):
    return log_events(t).filter("event_type <> 'click'").select(
        "table_name", "version", "path", "size", F.col("ts").alias("modified"),
        F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"))


OPERATIONS = {"signup": "WRITE", "purchase": "MERGE", "error": "DELETE", "view": "OPTIMIZE", "click": "VACUUM END"}


def commits(t):
    names = F.create_map(*[F.lit(x) for kv in OPERATIONS.items() for x in kv])
    log = log_events(t)
    return log.select(
        "table_name", "version", "user_id", F.col("ts").alias("committed"), F.element_at(names, F.col("event_type")).alias("operation"),
        F.when(F.col("user_id") % 3 == 0, '["k"]').otherwise("[]").alias("zorder_by"))


LOG = """WITH log AS (
  SELECT 'store_' || CAST(user_id % 20 AS VARCHAR) AS table_name, event_id AS version,
         'part-' || json_extract_string(props, '$.k') || '.parquet' AS path, ts, event_type, user_id,
         CAST(floor(value * 4 * 1048576) AS BIGINT) AS size FROM events
), actions AS (SELECT *, CASE WHEN event_type = 'error' THEN 'remove' ELSE 'add' END AS action FROM log WHERE event_type <> 'click'
), commits AS (SELECT *, CASE event_type WHEN 'signup' THEN 'WRITE' WHEN 'purchase' THEN 'MERGE' WHEN 'error' THEN 'DELETE'
     WHEN 'view' THEN 'OPTIMIZE' ELSE 'VACUUM END' END AS operation, CASE WHEN user_id % 3 = 0 THEN '["k"]' ELSE '[]' END AS zorder_by FROM log
), latest AS (SELECT * FROM actions QUALIFY row_number() OVER (PARTITION BY table_name, path ORDER BY version DESC) = 1
), live AS (SELECT table_name, path, version, size FROM latest WHERE action = 'add'
), stats AS (SELECT table_name, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS total_bytes,
     count(*) FILTER (WHERE size < 26214400) AS n_small, count(*) FILTER (WHERE size > 1073741824) AS n_large,
     round(sum(size)::DOUBLE / count(*) / 1048576, 2) AS avg_mb FROM live GROUP BY table_name)
"""


@query("active_files", LOG + "SELECT * FROM live")
def active_files(t):
    return S.active_files(file_actions(t))


@query("file_size_stats", LOG + "SELECT * FROM stats")
def file_size_stats(t):
    return S.file_size_stats(S.active_files(file_actions(t)))


@query("small_files", LOG + "SELECT * FROM stats WHERE n_files > 10 AND n_small > n_files * 0.1")
def small_files(t):
    return S.small_files(S.file_size_stats(S.active_files(file_actions(t))), share=0.1)


@query("large_unpartitioned", LOG + """
SELECT * FROM stats WHERE total_bytes > 10737418240
  AND table_name NOT IN (SELECT table_name FROM log GROUP BY table_name HAVING max(size) > 2000000000)""")
def large_unpartitioned(t):
    partitioned = log_events(t).groupBy("table_name").agg(F.max("size").alias("m")).filter("m > 2000000000")
    return S.large_unpartitioned(S.file_size_stats(S.active_files(file_actions(t))), partitioned)


@query("maintenance_history", LOG + """, early AS (SELECT * FROM commits WHERE NOT (operation LIKE 'VACUUM%' AND user_id % 4 = 1 AND ts > TIMESTAMP '2024-01-15'))
SELECT table_name, CAST(floor(date_diff('microsecond', max(ts) FILTER (WHERE operation LIKE 'VACUUM%'), TIMESTAMP '2024-01-31') / 86400000000.0) AS BIGINT) AS vacuum_days,
       CASE WHEN max(ts) FILTER (WHERE operation LIKE 'VACUUM%') IS NULL THEN 'never' WHEN vacuum_days > 7 THEN 'stale' ELSE 'recent' END AS vacuum,
       CASE WHEN max(ts) FILTER (WHERE operation = 'OPTIMIZE') IS NULL THEN 'never' ELSE 'done' END AS optimize,
       coalesce(bool_or(operation = 'OPTIMIZE' AND length(zorder_by) > 2), false) AS has_zorder FROM early GROUP BY table_name""")
def maintenance_history(t):
    log = commits(t)
    late = F.col("operation").startswith("VACUUM") & (F.col("user_id") % 4 == 1) & (
        F.col("committed") > F.lit("2024-01-15").cast("timestamp_ntz"))
    return S.maintenance_history(log.filter(~late), AS_OF)


@query("write_amplification", LOG + """
SELECT table_name, count(*) AS n_ops, count(*) FILTER (WHERE operation IN ('MERGE','DELETE','UPDATE')) AS n_rewrites
FROM commits GROUP BY table_name HAVING count(*) > 10 AND n_rewrites::DOUBLE / n_ops > 0.14""")
def write_amplification(t):
    return S.write_amplification(commits(t), share=0.14)


@query("operation_counts", LOG + "SELECT table_name, operation, count(*) AS n_ops FROM commits GROUP BY ALL")
def operation_counts(t):
    return S.operation_counts(commits(t))


@query("version_count", LOG + """
SELECT table_name, count(DISTINCT version) AS n_versions FROM log GROUP BY table_name HAVING count(DISTINCT version) > 100""")
def version_count(t):
    return S.version_count(log_events(t))


@query("last_versions", LOG + """
SELECT table_name, version, path FROM log QUALIFY dense_rank() OVER (PARTITION BY table_name ORDER BY version DESC) <= 50""")
def last_versions(t):
    from plumbline.sources.txlog import last_versions as newest
    return newest(log_events(t).select("table_name", "version", "path"), 50)


EVENT_RULES = [
    ("K-01", "error", "k", "<=", "50", "0"), ("K-02", "click", "k", "!=", "7", None),
    ("K-03", "view", "k", "=", "3", None), ("K-04", "signup", "owner|k2", "set", None, None),
]


@query("property_audit", """
SELECT 'K-01' AS rule_id, event_type AS entity_kind, CAST(event_id AS VARCHAR) AS entity, 'k' AS "key", json_extract_string(props, '$.k') AS value
FROM events WHERE event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50
UNION ALL SELECT 'K-02', event_type, CAST(event_id AS VARCHAR), 'k', json_extract_string(props, '$.k') FROM events
WHERE event_type = 'click' AND json_extract_string(props, '$.k') = '7'
UNION ALL SELECT 'K-03', event_type, CAST(event_id AS VARCHAR), 'k', json_extract_string(props, '$.k') FROM events
WHERE event_type = 'view' AND json_extract_string(props, '$.k') <> '3'
UNION ALL SELECT 'K-04', event_type, CAST(event_id AS VARCHAR), 'owner|k2', NULL FROM events WHERE event_type = 'signup'""")
def property_audit(t):
    entities = t.events.select(
        F.col("event_type").alias("entity_kind"), F.col("event_id").cast("string").alias("entity"),
        F.from_json("props", "map<string,string>").alias("properties"))
    return S.property_audit(entities, setting_rules_frame(t.spark, EVENT_RULES))


EXTENTS = """WITH parts AS (SELECT event_type AS table_name, CAST(ts AS DATE) AS day, user_id, count(*) AS n_rows,
  CAST(sum(length(props)) AS BIGINT) AS original_bytes, CAST(sum(length(json_extract_string(props, '$.k'))) AS BIGINT) * 5 AS compressed_bytes
  FROM events GROUP BY ALL)
"""


def event_extents(t):
    return S.extents(t.events.withColumn("day", F.to_date("ts")), "event_type", ["day", "user_id"],
                     F.length("props"), F.length(F.get_json_object("props", "$.k")) * 5)


@query("extents", EXTENTS + "SELECT * FROM parts")
def extents(t):
    return event_extents(t)


@query("extent_fragmentation", EXTENTS + """
SELECT table_name, count(*) AS n_extents, CAST(sum(n_rows) AS BIGINT) AS n_rows, round(sum(n_rows)::DOUBLE / count(*), 2) AS rows_per_extent
FROM parts GROUP BY table_name HAVING count(*) > 100 AND sum(n_rows)::DOUBLE / count(*) < 100000""")
def extent_fragmentation(t):
    return S.extent_fragmentation(event_extents(t))


@query("compression_ratio", EXTENTS + """
SELECT table_name, CAST(sum(original_bytes) AS BIGINT) AS original_bytes, CAST(sum(compressed_bytes) AS BIGINT) AS compressed_bytes,
       round((1.0 - sum(compressed_bytes)::DOUBLE / sum(original_bytes)) * 100, 1)::DOUBLE AS saved_pct
FROM parts GROUP BY table_name HAVING saved_pct < 40 AND sum(original_bytes) > 1000""")
def compression_ratio(t):
    return S.compression_ratio(event_extents(t), min_bytes=1000)


@query("storage_by_table", """
SELECT source AS table_name, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS total_bytes FROM documents
GROUP BY source ORDER BY total_bytes DESC, table_name LIMIT 20""")
def storage_by_table(t):
    return S.storage_by_table(t.documents, "source", "n_chars")


@query("hot_cold", """
SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-16') AS n_hot,
       round(n_hot::DOUBLE / n_rows, 4) AS hot_share FROM events GROUP BY user_id HAVING n_hot::DOUBLE / n_rows < 0.5""")
def hot_cold(t):
    return S.hot_cold(t.events, "user_id", F.col("ts") > F.lit("2024-01-16").cast("timestamp_ntz"))


@query("change_feed_gap", LOG + """
SELECT * FROM stats WHERE n_files > 50 AND table_name NOT IN (SELECT table_name FROM log WHERE user_id % 20 = 3 AND event_type = 'signup')""")
def change_feed_gap(t):
    with_feed = log_events(t).filter("user_id % 20 = 3 and event_type = 'signup'")
    return S.change_feed_gap(S.file_size_stats(S.active_files(file_actions(t))), with_feed, min_files=50)


@query("vacuum_candidates", LOG + """
SELECT table_name, path, size, strftime(modified, '%Y-%m-%d %H:%M:%S') AS modified FROM (
  SELECT table_name, path, max(size) AS size, max(ts) AS modified FROM actions GROUP BY ALL) l
WHERE modified < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY
  AND NOT EXISTS (SELECT 1 FROM live v WHERE v.table_name = l.table_name AND v.path = l.path)""")
def vacuum_candidates(t):
    actions = file_actions(t)
    listing = actions.groupBy("table_name", "path").agg(F.max("size").alias("size"), F.max("modified").alias("modified"))
    return S.vacuum_candidates(listing, S.active_files(actions), AS_OF).withColumn(
        "modified", F.date_format("modified", "yyyy-MM-dd HH:mm:ss"))


def _log_files(t, root):
    """The sample log as files: ten commits a table, the last action on a path in each."""
    n = t.events.agg(F.max("event_id")).first()[0] + 1
    grouped = log_events(t).withColumns({"event": F.col("version"), "version": F.floor(F.col("version") * 10 / n).cast("bigint")})
    last = grouped.filter("event_type <> 'click'").groupBy("table_name", "version", "path").agg(F.max_by(F.struct("event_type", "size", "ts"), "event").alias("x"))
    millis = F.unix_millis(F.col("x.ts").cast("timestamp"))
    add = F.to_json(F.struct(F.struct("path", F.col("x.size").alias("size"), millis.alias("modificationTime")).alias("add")))
    gone = F.to_json(F.struct(F.struct("path", millis.alias("deletionTimestamp"), F.lit(True).alias("dataChange")).alias("remove")))
    lines = last.select("table_name", "version", F.when(F.col("x.event_type") == "error", gone).otherwise(add).alias("line"))
    about = grouped.select("table_name", "version").distinct().select("table_name", "version", F.to_json(F.struct(F.struct(F.lit("WRITE").alias("operation")).alias("commitInfo"))).alias("line"))
    L.write_commits(lines.unionByName(about), root)


REPLAYED = """WITH n AS (SELECT max(event_id) + 1 AS n FROM events), log AS (
  SELECT 'store_' || CAST(user_id % 20 AS VARCHAR) AS table_name, event_id, CAST(floor(event_id * 10 / n) AS BIGINT) AS version,
         'part-' || json_extract_string(props, '$.k') || '.parquet' AS path, event_type, CAST(floor(value * 4 * 1048576) AS BIGINT) AS size FROM events, n WHERE event_type <> 'click')
SELECT table_name, path, version, size FROM (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY table_name, path ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'"""


@query("replayed_log", REPLAYED)
def replayed_log(t):
    """JSON commits, a checkpoint in two parts at version 6, a later one that isn't whole, and no commits up to 6."""
    root = scratch_path(t.spark, "log")
    _log_files(t, root)
    for table in names(t.spark, root):
        folder = f"{root}/{table}/_delta_log"
        every = L.read_log(t.spark, f"{folder}/*.json")
        L.write_checkpoint(L.state_lines(every.filter("version <= 6")), folder, 6, 2)
        L.write_checkpoint(L.state_lines(every.filter("version <= 8")), folder, 8, 2)
        remove(t.spark, f"{folder}/{8:020d}.checkpoint.{2:010d}.{2:010d}.parquet")
        for k in range(7):
            remove(t.spark, f"{folder}/{k:020d}.json")
    return _state(t, L.replay(t.spark, root))


def _state(t, log):
    """Live files; a checkpoint's lines carry its version, so the commit that added a file comes from the log as it was."""
    live = S.active_files(L.file_actions(log)).drop("version")
    n = t.events.agg(F.max("event_id")).first()[0] + 1
    added = file_actions(t).filter("action = 'add'").groupBy("table_name", "path").agg(F.floor(F.max("version") * 10 / n).cast("bigint").alias("version"))
    return live.join(added, ["table_name", "path"]).select("table_name", "path", "version", "size")


@query("snapshot_replay", REPLAYED)
def snapshot_replay(t):
    """The first commits are taken into a snapshot of our own; the rest is replayed on top of it."""
    root, own = scratch_path(t.spark, "log"), scratch_path(t.spark, "snapshots")
    _log_files(t, root)
    for table in names(t.spark, root):
        folder = f"{root}/{table}/_delta_log"
        for k in range(5, 10):
            move(t.spark, f"{folder}/{k:020d}.json", f"{root}-later/{table}/{k:020d}.json")
        L.snapshot(t.spark, root, table, own, 2)
        for k in range(5, 10):
            move(t.spark, f"{root}-later/{table}/{k:020d}.json", f"{folder}/{k:020d}.json")
        for k in range(5):
            remove(t.spark, f"{folder}/{k:020d}.json")
    return _state(t, L.replay(t.spark, root, own))


@query("listed_files", """
SELECT 'store_' || CAST(user_id % 20 AS VARCHAR) AS table_name, count(DISTINCT least(9, CAST(floor(event_id * 10 / (SELECT max(event_id) + 1 FROM events)) AS BIGINT))) AS n_files, true AS has_bytes
FROM events GROUP BY 1""")
def listed_files(t):
    """The storage listing of the log's own files."""
    root = scratch_path(t.spark, "log")
    _log_files(t, root)
    listed = L.list_files(t.spark, f"{root}/*/_delta_log", "*.json").withColumn("table_name", F.regexp_extract("path", r"([^/]+)/_delta_log/", 1))
    return listed.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_files"), (F.min("length") > 0).alias("has_bytes"))
