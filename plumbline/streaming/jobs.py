"""Structured Streaming jobs over an event stream."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.logs import exact_mean
from plumbline.session import commit_small, cut_lineage, names, read_small, remove, scratch_path

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def read_events(
    spark: SparkSession, folder: str, glob: str = "*.parquet", schema: T.StructType = EVENT_SCHEMA,
    files_per_trigger: int | None = None, ts: str = "ts",
) -> DataFrame:
    """Parquet files arriving in ``folder`` as a stream, event time as a timestamp."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_metrics(
    events: DataFrame, ts: str, keys: list[str], value: str, failed: Column,
    window: str = "1 hour", slide: str | None = None, lateness: str = "10 minutes",
) -> DataFrame:
    """Count, mean, max and failures per window and key; tumbling, or sliding with ``slide``."""
    frame = F.window(ts, window, slide) if slide else F.window(ts, window)
    return (
        events.withWatermark(ts, lateness).groupBy(frame, *keys).agg(
            F.count(F.lit(1)).alias("n_events"),
            exact_mean(value).alias("avg_value"),
            F.max(value).alias("max_value"), F.count_if(failed).alias("n_failed"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                *keys, "n_events", "avg_value", "max_value", "n_failed")
    )


def failure_counts(
    events: DataFrame, ts: str, keys: list[str], failed: Column, window: str = "1 day", lateness: str = "10 minutes",
) -> DataFrame:
    """Failures per window and (entity, code); rows later than ``lateness`` are dropped."""
    return (
        events.filter(failed).withWatermark(ts, lateness).groupBy(F.window(ts, window), *keys)
        .agg(F.count(F.lit(1)).alias("n_failures"), F.max(ts).alias("last_failure"))
        .select(F.col("window.start").alias("window_start"), *keys, "n_failures", "last_failure")
    )


def silence_alarms(events: DataFrame, ts: str, entity: str, gap: str = "1 day", lateness: str = "10 minutes") -> DataFrame:
    """One row per entity and silence longer than ``gap``: the end of a session is the start of silence.

    Both bounds are aggregates and not fields of the session key: the optimizer moves a
    filter on the key below the merging of sessions, where it would cut them apart.
    """
    return (
        events.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap), entity)
        .agg(F.min(ts).alias("active_from"), (F.max(ts) + F.expr(f"interval {gap}")).alias("silent_since"),
             F.count(F.lit(1)).alias("n_events"))
        .select(entity, "active_from", "silent_since", "n_events")
    )


def merge_view(state: str, part: str, keys: list[str], sums: list[str], summarize):
    """foreachBatch handler that keeps an aggregated view below ``state``, in parts by the key ``part``.

    A batch reads and writes only the parts it touches, into a folder of its own. Its manifest, a small file that
    names the newest folder of every part, is renamed into place when they are written: that commits the batch. So a
    half-written batch isn't seen and is written again from the same base, and a repeated one changes nothing.
    Folders that neither of the last two manifests names are removed. A null ``part`` is a part.
    """
    label = F.coalesce(F.col(part).cast("string"), F.lit("null"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = manifests(spark, state)
        if batch_id in done:
            return
        before = manifest(spark, state, max(done)) if done else {}
        written = f"{state}/batch={batch_id}"
        fresh = cut_lineage(summarize(batch), "batch")
        touched = [r[0] for r in fresh.select(label).distinct().collect()]  # parts of a batch, not rows
        base = [f"{state}/{before[p]}" for p in touched if p in before]
        if base:
            fresh = fresh.unionByName(spark.read.schema(fresh.schema).parquet(*base))
        # sums keep their declared type, so every batch writes the same schema
        merged = fresh.groupBy(*keys).agg(*[F.sum(s).cast(fresh.schema[s].dataType).alias(s) for s in sums])
        merged.withColumn("_part", F.md5(label)).write.mode("overwrite").partitionBy("_part").parquet(written)
        now = before | {p: f"batch={batch_id}/_part={hashlib.md5(p.encode()).hexdigest()}" for p in touched}
        commit_small(spark, f"{state}/manifests/{batch_id:012d}.json", json.dumps(now))
        live = {*before.values(), *now.values()}
        old = {f for k in done for f in manifest(spark, state, k).values()} - live
        for folder in sorted(old):
            remove(spark, f"{state}/{folder}")
        for k in done[:-1]:
            remove(spark, f"{state}/manifests/{k:012d}.json")
    return handle


def manifests(spark: SparkSession, state: str) -> list[int]:
    """Numbers of the committed batches whose manifests are kept, in order."""
    return sorted(int(n.removesuffix(".json")) for n in names(spark, f"{state}/manifests") if n.endswith(".json"))


def manifest(spark: SparkSession, state: str, batch_id: int) -> dict[str, str]:
    """The folder of each part as of a committed batch."""
    return json.loads(read_small(spark, f"{state}/manifests/{batch_id:012d}.json"))


def newest_view(spark: SparkSession, state: str) -> DataFrame:
    """The view as of the newest committed batch."""
    folders = manifest(spark, state, manifests(spark, state)[-1])
    return spark.read.parquet(*[f"{state}/{f}" for f in sorted(folders.values())])


def daily_sums(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.try_sum(F.col("value").try_cast("decimal(38,12)")).alias("sum_value"))


def drain(job: DataFrame, label: str, sink: str | None = None, checkpoint: str | None = None) -> str:
    """Run an append-mode job over everything available into parquet; returns the folder."""
    spark = job.sparkSession
    out = sink or scratch_path(spark, label)
    query = (
        job.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True).start(out)
    )
    query.awaitTermination()
    return out


def drain_view(events: DataFrame, label: str, part: str, keys: list[str], sums: list[str], summarize, state: str | None = None,
               checkpoint: str | None = None) -> str:
    """Run the incrementally maintained view over everything available; returns the state folder."""
    spark = events.sparkSession
    state = state or scratch_path(spark, label)
    query = (
        events.writeStream.foreachBatch(merge_view(state, part, keys, sums, summarize))
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return state
