"""Silences by timers, sketched quantiles and the maintained view, against batch twins."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from plumbline.streaming import jobs as J
from plumbline.streaming import quantiles as Q
from plumbline.streaming import silence as S

from conftest import rows

T0 = dt.datetime(2024, 1, 1)
HOUR = 3_600_000


def put(spark, folder, number, events):
    """One file of (user_id, hours after the start) at a fixed time."""
    out = f"{folder}/tmp{number}"
    data = [(k, T0 + dt.timedelta(hours=h) if h is not None else None, u, "view", float(k), "{}") for k, (u, h) in enumerate(events)]
    spark.createDataFrame(data, J.EVENT_SCHEMA).coalesce(1).write.parquet(out)
    name = next(f for f in os.listdir(out) if f.endswith(".parquet"))
    os.makedirs(f"{folder}/in", exist_ok=True)
    os.rename(f"{out}/{name}", f"{folder}/in/{number}.parquet")
    os.utime(f"{folder}/in/{number}.parquet", (1_700_000_000 + number,) * 2)


def twin(events, gap=24, lateness=1 / 6):
    """Silences of the rows that are final, from all rows at once."""
    end = max(h for _, h in events if h is not None) - lateness
    out = []
    for user in {u for u, _ in events}:
        seen = sorted(h for u, h in events if u == user and h is not None and h < end)
        for a, b in zip(seen, [*seen[1:], None]):
            if b is not None and b - a >= gap:
                out += [(user, "silent", a + gap, a), (user, "resumed", b, a)]
            elif b is None and a + gap <= end:
                out.append((user, "silent", a + gap, a))
    return sorted(out, key=repr)


def told(spark, folder, sink, checkpoint, **options):
    job = S.silences(J.read_events(spark, f"{folder}/in", files_per_trigger=1), "ts", "user_id", **options)
    out = spark.read.parquet(J.drain(job, "s", sink, checkpoint))
    hours = lambda c: (F.unix_millis(c) - F.unix_millis(F.lit(T0))) / HOUR
    return rows(out.select("user_id", "state", hours("at").alias("at"), hours("last_seen").alias("last")))


def test_silence_return_and_restart(spark, tmp_path):
    r = random.Random(1)
    # user 1 falls silent for good, 2 comes back, 3 never pauses, null is an entity; rows of a file are in any order
    files = [[(1, 0), (2, 1), (3, 2), (3, 20), (None, 5), (3, None)], [(3, 40), (3, 60), (2, 61)], [(3, 80), (2, 70), (None, 90), (3, 100)], [(3, 120), (3, 140), (2, 141)]]
    folder, sink, checkpoint = str(tmp_path), str(tmp_path / "sink"), str(tmp_path / "cp")
    so_far = []
    for n, events in enumerate(files):
        r.shuffle(events)
        put(spark, folder, n, events)
        so_far += events
        if n % 2:  # stopped and started again from the checkpoint
            assert told(spark, folder, sink, checkpoint) == twin(so_far)


def test_times_are_rounded_and_bounds_count(spark, tmp_path):
    ms, end = 1 / HOUR, 100 - 1 / 6
    # 1: its deadline is the watermark; 2: back at the last time that is final; 3: microseconds; 4: back a moment too late to be told
    events = [(1, end - 24), (2, 0), (2, end - ms), (3, 0.9995 * ms), (3, 30 + 0.0004 * ms), (4, 50), (4, end), (5, 100 - 0.4 * ms)]
    put(spark, str(tmp_path), 0, events)
    found = [(u, s, round(a * HOUR), round(b * HOUR)) for u, s, a, b in told(spark, str(tmp_path), str(tmp_path / "sink"), str(tmp_path / "cp"))]
    day, end = 24 * HOUR, 100 * HOUR - 600_000
    assert sorted(found) == sorted([
        (1, "silent", end, end - day), (2, "silent", day, 0), (2, "resumed", end - 1, 0),
        (3, "silent", day + 1, 1), (3, "resumed", 30 * HOUR, 1), (3, "silent", 54 * HOUR, 30 * HOUR), (4, "silent", 74 * HOUR, 50 * HOUR)])


def test_advance_does_not_depend_on_batches():
    r = random.Random(3)
    for _ in range(200):
        times = sorted(r.randrange(300) for _ in range(r.randrange(1, 12)))
        gap, end = r.randrange(1, 60), max(times) + r.randrange(100)
        whole = S.advance(None, False, times, end, gap)
        last, alarmed, pending, out = None, False, [], []
        for mark in [*sorted(r.randrange(end + 1) for _ in range(4)), end]:
            new = [t for t in times if t < mark + 5 and t not in pending and (last is None or t > last)]
            last, alarmed, pending, more = S.advance(last, alarmed, sorted({*pending, *new}), mark, gap)
            out += more
        assert (last, alarmed, out) == (whole[0], whole[1], S.advance(None, False, sorted(set(times)), end, gap)[3])


def test_forgotten_entities_start_anew(spark, tmp_path):
    for n, events in enumerate([[(1, 0), (3, 1)], [(3, 100)], [(3, 200)], [(1, 300), (3, 301)], [(3, 400)]]):
        put(spark, str(tmp_path), n, events)
    out = told(spark, str(tmp_path), str(tmp_path / "sink"), str(tmp_path / "cp"), forget="1 day")
    assert [x for x in out if x[0] == 1] == [(1, "silent", 24.0, 0.0), (1, "silent", 324.0, 300.0)]  # no word of the return


def test_sketches_merge_within_the_bound(spark):
    r = random.Random(5)
    data = [(T0 + dt.timedelta(minutes=r.randrange(3 * 1440)), k % 2, r.lognormvariate(0, 2)) for k in range(30_000)]
    data += [(T0, 7, None)]
    events = spark.createDataFrame(data, "ts timestamp, k int, value double").repartition(7)
    days = Q.rolled_up(Q.windowed_sketches(events, "ts", ["k"], "value", "1 hour"), "window_start", ["k"], "day")
    out = days.select(F.day("window_start").alias("day"), "k", "n_values", *[Q.quantile("sketch", p).alias(str(p)) for p in (0.5, 0.95)], F.octet_length("sketch").alias("bytes")).collect()
    for row in out:
        own = sorted(v for t, k, v in data if t.day == row.day and k == row.k and v is not None)
        assert row.n_values == len(own) and row.bytes < 16_000
        for p in (0.5, 0.95):
            if own:
                assert abs(sum(v <= row[str(p)] for v in own) / len(own) - p) <= Q.RANK_ERROR + 1 / len(own)
            else:
                assert row[str(p)] is None
