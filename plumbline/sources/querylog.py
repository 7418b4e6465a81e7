"""Query-log scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_LOG = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("query_text", T.StringType()),
    T.StructField("command_type", T.StringType()),
    T.StructField("database", T.StringType()),
    T.StructField("start_time", T.TimestampNTZType()),
    T.StructField("elapsed_ms", T.DoubleType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("failure_reason", T.StringType()),
])


def read_query_log(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Parquet scan of one row per execution; ``since`` is pushed down to the scan."""
    log = spark.read.schema(QUERY_LOG).parquet(path)
    return log if since is None else log.filter(F.col("start_time") >= F.lit(since).cast("timestamp_ntz"))


def log_view(
    df: DataFrame, *, query_id: str, text: str, kind: str, started: str, elapsed: str,
    failed, database=None, reason=None,
) -> DataFrame:
    """Present any execution table as a query log. ``failed`` is a boolean Column."""
    return df.select(
        F.col(query_id).cast("bigint").alias("query_id"),
        F.col(text).cast("string").alias("query_text"),
        F.col(kind).alias("command_type"),
        (F.lit("main") if database is None else database).alias("database"),
        F.col(started).alias("start_time"),
        F.col(elapsed).cast("double").alias("elapsed_ms"),
        F.when(failed, "Failed").otherwise("Succeeded").alias("status"),
        (F.lit(None).cast("string") if reason is None else reason).alias("failure_reason"),
    )
