"""Storage layout: transaction-log replay, file sizes, maintenance, settings, extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed_values as V


def active_files(actions: DataFrame) -> DataFrame:
    """Files live after replay: the newest add of a path is not older than its newest remove.

    ``actions`` is (table_name, version, path, action, size). Aggregates longs only,
    so the replay is one hash aggregation with map-side combine.
    """
    is_add = F.col("action") == "add"
    version = F.col("version")
    last = actions.groupBy("table_name", "path").agg(
        F.max(F.when(is_add, version)).alias("added"),
        F.max(F.when(~is_add, version)).alias("removed"),
        F.max_by(F.when(is_add, F.col("size")), F.when(is_add, version)).alias("size"))
    return last.filter("added is not null and (removed is null or added >= removed)").select(
        "table_name", "path", F.col("added").alias("version"), "size")


def file_size_stats(files: DataFrame, small: int = V.SMALL_FILE, large: int = V.LARGE_FILE) -> DataFrame:
    return files.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes"),
        F.count_if(F.col("size") < small).alias("n_small"), F.count_if(F.col("size") > large).alias("n_large"),
    ).withColumn("avg_mb", F.round(F.col("total_bytes") / F.col("n_files") / V.MB, 2))


def small_files(stats: DataFrame, min_files: int = 10, share: float = 0.5) -> DataFrame:
    return stats.filter((F.col("n_files") > min_files) & (F.col("n_small") > F.col("n_files") * share))


def large_unpartitioned(stats: DataFrame, partitioned: DataFrame, limit: int = V.LARGE_TABLE) -> DataFrame:
    """Tables above ``limit`` bytes without a partitioning; ``partitioned`` lists those that have one."""
    return stats.filter(F.col("total_bytes") > limit).join(
        partitioned.select("table_name").distinct(), "table_name", "left_anti")


def maintenance_history(commits: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Last vacuum, last optimize and any z-ordering per table, with what is overdue.

    ``commits`` is (table_name, operation, committed, zorder_by).
    """
    op = F.upper("operation")
    vacuum, optimize = op.startswith("VACUUM"), op == "OPTIMIZE"
    last = commits.groupBy("table_name").agg(
        F.max(F.when(vacuum, F.col("committed"))).alias("last_vacuum"),
        F.max(F.when(optimize, F.col("committed"))).alias("last_optimize"),
        F.coalesce(F.bool_or(optimize & F.coalesce(F.length("zorder_by") > 2, F.lit(False))), F.lit(False)).alias("has_zorder"))
    age = days_between("last_vacuum", as_of)
    return last.select(
        "table_name", age.alias("vacuum_days"),
        F.when(F.col("last_vacuum").isNull(), "never").when(age > days, "stale").otherwise("recent").alias("vacuum"),
        F.when(F.col("last_optimize").isNull(), "never").otherwise("done").alias("optimize"), "has_zorder")


def days_between(start: str, as_of: str) -> Column:
    """Whole days of 24 hours from column ``start`` to ``as_of``."""
    return F.expr(f"cast(floor(timestampdiff(MICROSECOND, {start}, timestamp_ntz '{as_of}') / 86400000000D) as bigint)")


def hours_between(start: str, as_of: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, {start}, timestamp_ntz '{as_of}') / 3600000000D")


def write_amplification(commits: DataFrame, min_ops: int = 10, share: float = 0.5) -> DataFrame:
    rewrite = F.col("operation").isin("MERGE", "DELETE", "UPDATE")
    ops = commits.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_ops"), F.count_if(rewrite).alias("n_rewrites"))
    return ops.filter((F.col("n_ops") > min_ops) & (F.col("n_rewrites") / F.col("n_ops") > share))


def operation_counts(commits: DataFrame) -> DataFrame:
    return commits.groupBy("table_name", F.coalesce("operation", F.lit("UNKNOWN")).alias("operation")).agg(
        F.count(F.lit(1)).alias("n_ops"))


def version_count(actions: DataFrame, limit: int = 100) -> DataFrame:
    """Tables with more than ``limit`` versions, over the whole log."""
    return (actions.select("table_name", "version").distinct().groupBy("table_name")
            .agg(F.count(F.lit(1)).alias("n_versions")).filter(F.col("n_versions") > limit))


def property_audit(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Settings that differ from what the rules expect.

    ``entities`` is (entity_kind, entity, properties map). ``rules`` is the setting-rule
    table: catalog-sized, so it is broadcast. A key may list alternatives with ``|``;
    tests are =, !=, <= and set.
    """
    keys = F.split("key", r"\|")
    found = F.element_at(F.filter(
        F.transform(keys, lambda k: F.try_element_at(F.col("properties"), k)), lambda v: v.isNotNull()), 1)
    found = F.when(F.size(F.filter(F.transform(keys, lambda k: F.try_element_at(F.col("properties"), k)),
                                   lambda v: v.isNotNull())) > 0, found)
    value = F.lower(F.coalesce(found, F.col("unset_value")))
    number, bound = F.col("value").try_cast("double"), F.col("expected").try_cast("double")
    unset = F.col("value").isNull() | F.col("value").isin("", "null", "{}", "[]")
    good = (F.when(F.col("test") == "set", ~unset)
            .when(F.col("test") == "=", F.col("value").eqNullSafe(F.col("expected")))
            .when(F.col("test") == "!=", ~F.col("value").eqNullSafe(F.col("expected")))
            .when(F.col("test") == "<=", F.coalesce(number <= bound, F.lit(False))))
    return (
        entities.join(F.broadcast(rules), "entity_kind").withColumn("value", value)
        .filter(~good).select("rule_id", "entity_kind", "entity", "key", "value")
    )


def extents(df: DataFrame, table: str, extent: list[str], original: Column, compressed: Column | None = None) -> DataFrame:
    """(table_name, extent..., n_rows, original_bytes, compressed_bytes)."""
    return df.groupBy(F.col(table).alias("table_name"), *extent).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(original).alias("original_bytes"),
        F.sum(F.lit(0) if compressed is None else compressed).alias("compressed_bytes"))


def extent_fragmentation(parts: DataFrame, min_extents: int = 100, rows_below: int = 100_000) -> DataFrame:
    sums = parts.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_extents"), F.sum("n_rows").alias("n_rows"))
    per = F.col("n_rows") / F.col("n_extents")
    return sums.withColumn("rows_per_extent", F.round(per, 2)).filter(
        (F.col("n_extents") > min_extents) & (F.col("n_rows") > 0) & (per < rows_below))


def compression_ratio(parts: DataFrame, below: float = 40.0, min_bytes: int = 100 * V.MB) -> DataFrame:
    sums = parts.groupBy("table_name").agg(
        F.sum("original_bytes").alias("original_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"))
    saved = F.when(F.col("original_bytes") > 0, F.round(
        (F.lit(1.0) - F.col("compressed_bytes") / F.col("original_bytes")) * 100, 1)).otherwise(F.lit(0.0))
    return sums.withColumn("saved_pct", saved).filter(
        (F.col("saved_pct") < below) & (F.col("original_bytes") > min_bytes))


def storage_by_table(df: DataFrame, table: str, size: str, k: int | None = 20) -> DataFrame:
    """The ``k`` largest tables, or all with None."""
    sums = df.groupBy(F.col(table).alias("table_name")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("total_bytes"))
    return sums if k is None else sums.orderBy(F.desc("total_bytes"), "table_name").limit(k)


def hot_cold(df: DataFrame, entity: str, is_hot: Column, below: float = 0.5) -> DataFrame:
    sums = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(is_hot).alias("n_hot"))
    return sums.withColumn("hot_share", F.round(F.col("n_hot") / F.col("n_rows"), 4)).filter(
        F.col("n_hot") / F.col("n_rows") < below)


def change_feed_gap(stats: DataFrame, with_feed: DataFrame, min_files: int = 100) -> DataFrame:
    """Tables of many files whose change feed is off; ``with_feed`` lists those with it on."""
    return stats.filter(F.col("n_files") > min_files).join(
        with_feed.select("table_name").distinct(), "table_name", "left_anti")


def vacuum_candidates(listing: DataFrame, live: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Listed files that are not live and older than the retention.

    ``listing`` is (table_name, path, size, modified), ``live`` (table_name, path).
    """
    old = F.col("modified") < F.expr(f"timestamp_ntz '{as_of}' - interval {int(days)} days")
    return listing.filter(old).join(live.select("table_name", "path"), ["table_name", "path"], "left_anti")
