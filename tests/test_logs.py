"""Query-log rules at their limits, and streams against their batch twins."""

import datetime as dt
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.operators import logs as L
from plumbline.sources.querylog import QUERY_LOG, read_query_log
from plumbline.streaming import jobs as J

AS_OF = "2024-01-31 00:00:00"
NOW = dt.datetime(2024, 1, 31)


def run(i, text, ms, status="Succeeded", days=1.0, reason=None, kind="Query"):
    return (i, text, kind, "main", NOW - dt.timedelta(days=days), float(ms) if ms is not None else None, 1, status, reason)


@pytest.fixture(scope="module")
def log(spark):
    data = [run(1, "a", 60_000), run(2, "b", 60_001), run(3, "c", None), run(4, "bad", 99_999, "Failed", reason="Timeout expired")]
    data += [run(10 + i, "hot", 10_001) for i in range(11)] + [run(40 + i, "ten", 90_000) for i in range(10)]
    return spark.createDataFrame(data, QUERY_LOG)


def test_slow_queries(log):
    assert [(r.query_id, r.is_slow) for r in L.slow_queries(log).collect()][:3] == [(40, True), (41, True), (42, True)]
    got = {r.query_id: r.is_slow for r in L.slow_queries(log, k=100).collect()}
    assert got[1] is False and got[2] is True and 4 not in got
    assert L.slow_total(log).first().n_slow == 11


def test_frequent_queries(log):
    assert rows(L.frequent_queries(log, k=None).filter("is_hot"), "query_text") == [("hot",)]


def test_health_bands(spark):
    for ms, want in ((4_999, "PASS"), (5_000, "WARN"), (29_999, "WARN"), (30_000, "FAIL")):
        log = spark.createDataFrame([run(1, "q", ms), run(2, "old", 1e9, days=7.0), run(3, "f", 1e9, "Failed")], QUERY_LOG)
        assert L.recent_health(log, AS_OF).first().status == want
    assert L.recent_health(log.filter("false"), AS_OF).first().status == "N/A"


def test_failure_classes(spark):
    df = spark.createDataFrame([("Timeout expired",), ("Permission DENIED",), ("syntax error near",), ("deadlock victim",), ("?",), (None,)], "m string")
    assert dict(rows(L.failure_categories(df, "m"))) == {"timeout": 1, "permission": 1, "syntax": 1, "deadlock": 1, "other": 2}


def test_freshness_limits(spark):
    def at(**delta):
        return NOW - dt.timedelta(**delta)
    df = spark.createDataFrame([("at", at(days=7)), ("late", at(days=7, seconds=1)), ("new", at(hours=1)), ("late", at(days=9))],
                               "entity string, ts timestamp_ntz")
    assert rows(L.data_freshness(df, "entity", "ts", AS_OF), "entity") == [("late",)]
    views = spark.createDataFrame([("ok", True, True, at(hours=24)), ("old", True, True, at(hours=24, seconds=1)),
                                   ("never", True, True, None), ("sick", False, True, at(hours=1)), ("off", True, False, at(hours=1))],
                                  "name string, is_healthy boolean, is_enabled boolean, last_run timestamp_ntz")
    assert dict(rows(L.view_freshness(views, AS_OF), "name", "state")) == {
        "ok": "fresh", "old": "stale", "never": "never run", "sick": "unhealthy", "off": "disabled"}
    many = spark.createDataFrame([("big", at(hours=1, seconds=1))] * 1000 + [("few", at(hours=5))] * 999 + [("prompt", at(hours=1))] * 1000,
                                 "entity string, ts timestamp_ntz")
    assert rows(L.ingestion_latency(many, "entity", "ts", AS_OF), "entity") == [("big",)]


def test_stale_statistics_and_stream_candidates(spark):
    tables = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    stats = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2023, 12, 31)), ("c", None), (None, NOW)],
                                  "name string, updated timestamp_ntz")
    got = rows(L.stale_statistics(tables, stats, "name", "updated", "2024-01-31"), "name", "reason")
    assert got == [("b", "stale"), ("d", "missing")]
    events = spark.createDataFrame([("x",)] * 3 + [("y",)] * 3 + [("z",)] * 2, "entity string")
    streamed = spark.createDataFrame([("y",)], "entity string")
    assert rows(L.stream_candidates(events, "entity", streamed, 3)) == [("x", 3)]


def test_log_scan_prunes(spark, log, tmp_path):
    log.write.parquet(str(tmp_path / "log"))
    recent = read_query_log(spark, str(tmp_path / "log"), since="2024-01-30")
    assert "PushedFilters: [IsNotNull(start_time), GreaterThanOrEqual(start_time" in recent._jdf.queryExecution().executedPlan().toString()
    assert recent.count() == log.count()


# ---- streams ----

@pytest.fixture(scope="module")
def folder(spark, t, tmp_path_factory):
    """The events in six files in time order."""
    root = tmp_path_factory.mktemp("stream")
    events = t.events.orderBy("ts").withColumn("part", F.expr("cast(datediff(ts, date'2024-01-01') div 5 as int)")).cache()
    for part in range(6):
        out = str(root / f"tmp{part}")
        events.filter(F.col("part") == part).drop("part").coalesce(1).write.parquet(out)
        name = next(f for f in os.listdir(out) if f.endswith(".parquet"))
        target = root / "in" / f"{part}.parquet"
        os.makedirs(target.parent, exist_ok=True)
        target.write_bytes(open(f"{out}/{name}", "rb").read())
        os.utime(target, (1_700_000_000 + part, 1_700_000_000 + part))
    return str(root / "in")


def stream(spark, folder):
    return J.read_events(spark, folder, files_per_trigger=1)


def batch(t):
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def closed(twin, events, end, lateness="10 minutes"):
    last = events.agg(F.max("ts").alias("m")).first().m
    minutes = dt.timedelta(minutes=int(lateness.split()[0]))
    return twin.filter(F.col(end) <= F.lit(last - minutes))


def test_windowed_metrics_equal_batch(spark, t, folder):
    args = ("ts", ["event_type"], "value", F.col("event_type") == "error", "6 hours")
    out = spark.read.parquet(J.drain(J.windowed_metrics(stream(spark, folder), *args), "tumbling"))
    twin = closed(J.windowed_metrics(batch(t), *args), batch(t), "window_end")
    assert rows(out) == rows(twin) and out.count() > 100


def test_silence_equals_batch(spark, t, folder):
    out = spark.read.parquet(J.drain(J.silence_alarms(stream(spark, folder), "ts", "user_id"), "silence"))
    twin = closed(J.silence_alarms(batch(t), "ts", "user_id"), batch(t), "silent_since")
    assert rows(out) == rows(twin) and out.count() > 10


def test_daily_view_equals_batch_and_survives_a_repeated_batch(spark, t, folder, tmp_path):
    state, checkpoint = str(tmp_path / "state"), str(tmp_path / "checkpoint")
    keys, sums = ["day", "event_type"], ["n_events", "sum_value"]
    J.drain_view(stream(spark, folder), "view", "day", keys, sums, J.daily_sums, state, checkpoint)
    want = rows(J.daily_sums(t.events))
    assert rows(J.newest_view(spark, state), "day", "event_type", "n_events", "sum_value") == want
    # the last batch runs again, as after a failure between its write and its commit
    last = spark.read.parquet(f"{folder}/5.parquet")
    J.merge_view(state, "day", keys, sums, J.daily_sums)(last, 5)
    assert rows(J.newest_view(spark, state), "day", "event_type", "n_events", "sum_value") == want
    # nothing new: a second run changes nothing
    J.drain_view(stream(spark, folder), "view", "day", keys, sums, J.daily_sums, state, checkpoint)
    assert rows(J.newest_view(spark, state), "day", "event_type", "n_events", "sum_value") == want


def test_late_rows_are_dropped(spark, tmp_path):
    def write(name, *events):
        path = tmp_path / "in" / name
        df = spark.createDataFrame([(i, dt.datetime.fromisoformat(ts), 1, "error", 1.0, '{"k": 1}') for i, ts in events], J.EVENT_SCHEMA)
        df.coalesce(1).write.parquet(str(tmp_path / f"w{name}"))
        part = next(f for f in os.listdir(tmp_path / f"w{name}") if f.endswith(".parquet"))
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes((tmp_path / f"w{name}" / part).read_bytes())
        os.utime(path, (1_700_000_000 + int(name[0]), 1_700_000_000 + int(name[0])))
    write("1.parquet", (1, "2024-01-01 01:00:00"), (2, "2024-01-03 12:00:00"))
    write("2.parquet", (3, "2024-01-03 13:00:00"))
    write("3.parquet", (4, "2024-01-01 02:00:00"), (5, "2024-01-03 14:00:00"))   # row 4 is two days late
    write("4.parquet", (6, "2024-01-06 00:00:00"))
    job = J.failure_counts(stream(spark, str(tmp_path / "in")), "ts", ["user_id"], F.col("event_type") == "error")
    out = spark.read.parquet(J.drain(job, "late"))
    assert [(r.window_start.day, r.n_failures) for r in out.orderBy("window_start").collect()] == [(1, 1), (3, 3)]
