"""Query-log and ingest analytics. ``as_of`` is always given, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V
from plumbline.functions import predicates as P
from plumbline.operators.spread import exact_percentile
from plumbline.operators.storage import days_between, hours_between
from plumbline.sources.facts import falsy

SECOND = 1000


def since(df: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days; a plain comparison, so it reaches the scan."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {int(days)} days")
    return df.filter(F.col(ts) > start)


def exact_mean(column: str) -> Column:
    """Mean that doesn't depend on the order of rows where twelve decimals hold every value; else the mean of doubles."""
    value, exact = F.col(column), F.col(column).try_cast("decimal(38,12)")
    held = F.bool_and(value.isNull() | (exact.cast("double") == value.cast("double")))
    return F.coalesce(F.when(held, F.try_sum(exact).cast("double") / F.count(column)), F.avg(value.cast("double")))


def succeeded(log: DataFrame) -> DataFrame:
    return log.filter("status = 'Succeeded'")


def slow_queries(log: DataFrame, k: int = 15, slow_ms: float = 60 * SECOND) -> DataFrame:
    """The ``k`` slowest successful runs, each with a flag for the alarm limit."""
    return (succeeded(log).orderBy(F.desc("elapsed_ms"), "query_id").limit(k)
            .select("query_id", F.left("query_text", F.lit(300)).alias("query_text"), "command_type", "elapsed_ms",
                    (F.col("elapsed_ms") > slow_ms).alias("is_slow")))


def slow_total(log: DataFrame, slow_ms: float = 60 * SECOND) -> DataFrame:
    """How many runs pass the alarm limit, over the whole log and not only the top."""
    return succeeded(log).agg(F.count(F.lit(1)).alias("n_queries"), F.count_if(F.col("elapsed_ms") > slow_ms).alias("n_slow"))


def query_templates(log: DataFrame) -> DataFrame:
    """Runs per text: grouped by a digest of the whole text, shown by its first 300 characters."""
    digest = F.sha2(F.col("query_text").cast("binary"), 256).alias("digest")
    return succeeded(log).groupBy(digest).agg(
        F.min(F.left("query_text", F.lit(300))).alias("query_text"), F.count(F.lit(1)).alias("n_runs"),
        exact_mean("elapsed_ms").alias("avg_ms"), F.max("elapsed_ms").alias("max_ms"))


def frequent_queries(log: DataFrame, k: int | None = 15, min_runs: int = 10, slow_ms: float = 10 * SECOND) -> DataFrame:
    """Templates by number of runs; flagged when both frequent and slow."""
    flagged = query_templates(log).withColumn(
        "is_hot", (F.col("n_runs") > min_runs) & (F.col("avg_ms") > slow_ms))
    top = flagged if k is None else flagged.orderBy(F.desc("n_runs"), "query_text", "digest").limit(k)
    return top.drop("digest")


def failed_queries(log: DataFrame, k: int = 10) -> DataFrame:
    return (log.filter("status = 'Failed'").orderBy(F.desc("start_time"), F.desc("query_id")).limit(k)
            .select("query_id", F.left("query_text", F.lit(300)).alias("query_text"), "command_type",
                    F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("started")))


def failure_categories(df: DataFrame, message: str, classes=V.FAILURE_CLASSES) -> DataFrame:
    """Failures per class of message; the first matching class wins, the rest are other."""
    low = F.lower(message)
    picks = [F.when(low.rlike(pattern), F.lit(label)) for label, pattern in classes]
    return df.groupBy(F.coalesce(*picks, F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("n_failures"))


def daily_volume(log: DataFrame, k: int | None = None) -> DataFrame:
    days = log.groupBy(F.to_date("start_time").alias("day")).agg(
        F.count(F.lit(1)).alias("n_queries"), exact_mean("elapsed_ms").alias("avg_ms"))
    return days if k is None else days.orderBy(F.desc("day")).limit(k)


def recent_health(
    log: DataFrame, as_of: str, days: int = 7, warn_ms: float = 5 * SECOND, fail_ms: float = 30 * SECOND,
) -> DataFrame:
    row = since(succeeded(log), "start_time", as_of, days).agg(
        F.count(F.lit(1)).alias("n_queries"), exact_mean("elapsed_ms").alias("avg_ms"))
    status = (F.when(F.col("n_queries") == 0, "N/A").when(F.col("avg_ms") < warn_ms, "PASS")
              .when(F.col("avg_ms") < fail_ms, "WARN").otherwise("FAIL"))
    return row.withColumn("status", status)


def command_profile(
    log: DataFrame, as_of: str, days: int = 7, slow_ms: float = 30 * SECOND, exact: bool = True,
) -> DataFrame:
    """Count, mean, max, 95th percentile and failures per database and command type."""
    keys = ["database", "command_type"]
    recent = since(log, "start_time", as_of, days)
    aggs = [F.count(F.lit(1)).alias("n_queries"), exact_mean("elapsed_ms").alias("avg_ms"),
            F.max("elapsed_ms").alias("max_ms"), F.count_if(F.col("status") == "Failed").alias("n_failed")]
    if exact:
        p95 = exact_percentile(recent, keys, "elapsed_ms", 0.95, "p95_ms")
        out = recent.groupBy(*keys).agg(*aggs).join(p95, keys)
    else:
        out = recent.groupBy(*keys).agg(*aggs, F.percentile_approx("elapsed_ms", 0.95, 10_000).alias("p95_ms"))
    return out.withColumn("p95_ms", F.round("p95_ms", 4)).withColumn("is_slow", F.col("avg_ms") > slow_ms)


def ingestion_failures(df: DataFrame, keys: list[str], ts: str, as_of: str, days: int = 7) -> DataFrame:
    return since(df, ts, as_of, days).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_failures"), F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss").alias("last_failure"))


def data_freshness(df: DataFrame, entity: str, ts: str, as_of: str, days: int = 7) -> DataFrame:
    newest = df.groupBy(entity).agg(F.max(ts).alias("_last"))
    return newest.filter(hours_between("_last", as_of) > 24 * days).select(
        entity, F.date_format("_last", "yyyy-MM-dd HH:mm:ss").alias("newest"), days_between("_last", as_of).alias("days_old"))


def ingestion_latency(df: DataFrame, entity: str, ts: str, as_of: str, min_rows: int = 1000, hours: float = 1.0) -> DataFrame:
    sums = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"), F.max(ts).alias("_last"))
    late = hours_between("_last", as_of)
    return sums.filter((F.col("n_rows") >= min_rows) & (late > hours)).select(
        entity, "n_rows", F.date_format("_last", "yyyy-MM-dd HH:mm:ss").alias("newest"), F.round(late, 3).alias("hours_old"))


def view_freshness(views: DataFrame, as_of: str, hours: float = 24.0) -> DataFrame:
    """Unhealthy, disabled, never run or stale views. ``views`` is (name, is_healthy, is_enabled, last_run)."""
    age = hours_between("last_run", as_of)
    state = (F.when(falsy(F.col("is_healthy")), "unhealthy").when(falsy(F.col("is_enabled")), "disabled")
             .when(F.col("last_run").isNull(), "never run").when(age > hours, "stale").otherwise("fresh"))
    return views.select("name", state.alias("state"), F.round(age, 3).alias("hours_old"))


def stale_views(views: DataFrame, as_of: str, hours: float = 24.0) -> DataFrame:
    """Views to refresh, healthy or not: never run, or last run too long ago."""
    return views.filter(F.col("last_run").isNull() | (hours_between("last_run", as_of) > hours))


def stream_candidates(df: DataFrame, entity: str, streamed: DataFrame, min_rows: int = 1_000_000) -> DataFrame:
    """High-volume entities that are not in ``streamed`` (one column named like the entity)."""
    big = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") >= min_rows)
    return big.join(streamed.select(entity).distinct(), entity, "left_anti")


def journal_counts(df: DataFrame, kind: str, ts: str, as_of: str, days: int = 7) -> DataFrame:
    return since(df, ts, as_of, days).groupBy(kind).agg(F.count(F.lit(1)).alias("n_events"))


def stale_statistics(tables: DataFrame, stats: DataFrame, name: str, updated: str, as_of: str, days: int = 30) -> DataFrame:
    """Entries whose newest statistics are too old, and entries that have none."""
    newest = stats.filter(~P.blank(F.col(name).cast("string"))).groupBy(name).agg(F.max(updated).alias("_last"))
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("_last"))
    old = newest.filter(age > days).select(name, F.lit("stale").alias("reason"), age.alias("days_old"))
    none = tables.select(name).distinct().join(newest, name, "left_anti").select(
        name, F.lit("missing").alias("reason"), F.lit(None).cast("int").alias("days_old"))
    return old.unionByName(none)
