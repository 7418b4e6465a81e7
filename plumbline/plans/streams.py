"""Streaming queries over the sample events, each drained into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.registry import query
from plumbline.session import scratch_path
from plumbline.streaming import jobs as J
from plumbline.streaming import quantiles as Q
from plumbline.streaming import silence as S


def stream(t):
    return J.read_events(t.spark, t.root, "events.parquet")


def _shown(df, *columns):
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns})


CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
METRICS = """event_type, count(*) AS n_events, sum(value::DECIMAL(18,4))::DOUBLE / count(value) AS avg_value, max(value) AS max_value,
  count(*) FILTER (WHERE event_type = 'error') AS n_failed"""


@query("stream_tumbling_metrics", f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, {METRICS}
FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS w FROM events) WHERE w + INTERVAL 6 HOUR <= {CLOSED} GROUP BY w, event_type""")
def stream_tumbling_metrics(t):
    job = J.windowed_metrics(stream(t), "ts", ["event_type"], "value", F.col("event_type") == "error", "6 hours")
    return _shown(t.spark.read.parquet(J.drain(job, "tumbling")), "window_start", "window_end")


@query("stream_sliding_metrics", f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(w + INTERVAL 2 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, {METRICS}
FROM (SELECT e.*, date_trunc('day', ts) - INTERVAL (k) DAY AS w FROM events e, (VALUES (0), (1)) s(k))
WHERE w + INTERVAL 2 DAY <= {CLOSED} GROUP BY w, event_type""")
def stream_sliding_metrics(t):
    job = J.windowed_metrics(stream(t), "ts", ["event_type"], "value", F.col("event_type") == "error", "2 days", "1 day")
    return _shown(t.spark.read.parquet(J.drain(job, "sliding")), "window_start", "window_end")


@query("stream_failure_counts", """
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, user_id, code, count(*) AS n_failures,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_failure
FROM (SELECT *, date_trunc('day', ts) AS w, json_extract_string(props, '$.k') AS code FROM events WHERE event_type = 'error')
WHERE w + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events WHERE event_type = 'error') GROUP BY w, user_id, code""")
def stream_failure_counts(t):
    events = stream(t).withColumn("code", F.get_json_object("props", "$.k"))
    job = J.failure_counts(events, "ts", ["user_id", "code"], F.col("event_type") == "error")
    return _shown(t.spark.read.parquet(J.drain(job, "failures")), "window_start", "last_failure")


@query("stream_silence_alarms", """
WITH marked AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events),
sessions AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS active_from, strftime(max(ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS silent_since, count(*) AS n_events
FROM sessions GROUP BY user_id, s HAVING max(ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_silence_alarms(t):
    job = J.silence_alarms(stream(t), "ts", "user_id")
    return _shown(t.spark.read.parquet(J.drain(job, "silence")), "active_from", "silent_since")


@query("stream_daily_view", """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n_events, sum(value::DECIMAL(18,4))::DOUBLE AS sum_value FROM events GROUP BY ALL""")
def stream_daily_view(t):
    state = J.drain_view(stream(t), "daily-view", "day", ["day", "event_type"], ["n_events", "sum_value"], J.daily_sums)
    return J.newest_view(t.spark, state).withColumn("sum_value", F.col("sum_value").cast("double"))


@query("stream_silences", """
WITH final AS (SELECT user_id, epoch_ms(ts) AS ms FROM events WHERE epoch_ms(ts) < (SELECT max(epoch_ms(ts)) - 600000 FROM events)),
gaps AS (SELECT user_id, ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ms) AS next FROM final),
told AS (
  SELECT user_id, 'silent' AS state, ms + 86400000 AS due, ms FROM gaps
  WHERE next >= ms + 86400000 OR next IS NULL AND ms + 86400000 <= (SELECT max(epoch_ms(ts)) - 600000 FROM events)
  UNION ALL SELECT user_id, 'resumed', next, ms FROM gaps WHERE next >= ms + 86400000)
SELECT user_id, state, strftime(make_timestamp(due * 1000), '%Y-%m-%d %H:%M:%S') AS "at", strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S') AS last_seen FROM told""")
def stream_silences(t):
    """Alarms at the deadline and returns, in two runs from one checkpoint."""
    job, sink, checkpoint = S.silences(stream(t), "ts", "user_id"), scratch_path(t.spark, "silences"), scratch_path(t.spark, "silences-checkpoint")
    J.drain(job, "silences", sink, checkpoint)
    return _shown(t.spark.read.parquet(J.drain(job, "silences", sink, checkpoint)), "at", "last_seen")


@query("stream_quantiles", f"""
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(value) AS n_values, true AS median_within, true AS p95_within
FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS w FROM events) WHERE w + INTERVAL 6 HOUR <= {CLOSED} GROUP BY w, event_type""")
def stream_quantiles(t):
    """Sketched quantiles of each window; whether their ranks among the window's values lie within the bound."""
    job = Q.windowed_sketches(stream(t), "ts", ["event_type"], "value", "6 hours")
    return _within(t, t.spark.read.parquet(J.drain(job, "quantiles")), "6 hours")


@query("quantile_rollup", f"""
SELECT strftime(date_trunc('week', w), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(value) AS n_values, true AS median_within, true AS p95_within
FROM (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS w FROM events) WHERE w + INTERVAL 6 HOUR <= {CLOSED}
GROUP BY date_trunc('week', w), event_type""")
def quantile_rollup(t):
    """The windows' sketches merged to days and these to weeks, without the events."""
    job = Q.windowed_sketches(stream(t), "ts", ["event_type"], "value", "6 hours")
    windows = t.spark.read.parquet(J.drain(job, "rollup"))
    days = Q.rolled_up(windows, "window_start", ["event_type"], "day")
    return _within(t, Q.rolled_up(days, "window_start", ["event_type"], "week"), "week", windows.agg(F.max("window_end")).first()[0])


def _within(t, sketched, frame, until=None):
    """Exact ranks of the sketches' quantiles, by a join back to the events."""
    told = sketched.withColumns({"median": Q.quantile("sketch", 0.5), "p95": Q.quantile("sketch", 0.95)})
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    start = F.date_trunc(frame, "ts") if until is not None else F.window("ts", frame)["start"]
    if until is not None:
        events = events.filter(F.col("ts") < F.lit(until))
    e = events.select(start.alias("window_start"), "event_type", "value").filter("value is not null")
    ranks = e.join(told.select("window_start", "event_type", "median", "p95"), ["window_start", "event_type"]).groupBy("window_start", "event_type").agg(
        *[F.avg((F.col("value") < F.col(q)).cast("double")).alias(f"{q}_low") for q in ("median", "p95")],
        *[F.avg((F.col("value") <= F.col(q)).cast("double")).alias(f"{q}_high") for q in ("median", "p95")])
    both = told.join(ranks, ["window_start", "event_type"], "left")

    def within(q, p):  # the wanted rank lies between those of the values below and up to the quantile, give or take the bound
        return F.coalesce((F.col(f"{q}_low") <= p + Q.RANK_ERROR) & (F.col(f"{q}_high") >= p - Q.RANK_ERROR), F.lit(True)).alias(f"{q}_within")

    return _shown(both.select("window_start", "event_type", "n_values", within("median", 0.5), within("p95", 0.95)), "window_start")
