"""Column profiles of whole tables and the reports drawn from them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.spread import top_per_group
from plumbline.sources.facts import kind_of

TIME_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"
LONG_TEXT = 64


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _as_text(value: str, data_type: T.DataType) -> str:
    """One spelling per value across types: fractions with six digits where that is exact, times with microseconds."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        plain = f"try_cast({value} as decimal(38,6))"
        return f"if(cast({plain} as double) = cast({value} as double), cast({plain} as string), cast({value} as string))"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return f"date_format({value}, '{TIME_TEXT}')"
    return f"cast({value} as string)"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def scalar_fields(df: DataFrame, columns: list[str] | None = None) -> list[T.StructField]:
    return [f for f in df.schema.fields
            if kind_of(f.dataType) != "other" and (columns is None or f.name in columns)]


# Expressions over every column of every table are built as SQL text: one parse per
# table instead of dozens of gateway calls per column.

def _stats(table: str, df: DataFrame, fields: list[T.StructField], sketch: int | None) -> DataFrame:
    """Rows, nulls, min, max and longest text of every column in one scan and one small row.

    No grouping key, so string minima stream through without a sort.
    """
    aggs, cells = ["count(1) as n"], []
    for i, f in enumerate(fields):
        c, kind = _quoted(f.name), kind_of(f.dataType)
        longest = f"max(length({c}))" if kind == "string" else "max(0)"
        aggs += [f"count({c}) as c{i}", f"min({c}) as lo{i}", f"max({c}) as hi{i}", f"{longest} as len{i}"]
        if sketch is not None:
            aggs.append(
                f"coalesce(hll_sketch_estimate(hll_sketch_agg(if({c} is null, null, xxhash64({c})), {sketch})), 0) as nd{i}")
        distinct = f"nd{i}" if sketch is not None else "cast(null as bigint)"
        cells.append(
            f"named_struct('table_name', {_literal(table)}, 'column_name', {_literal(f.name)}, 'kind', '{kind}', "
            f"'n_rows', n, 'n_nulls', n - c{i}, 'approx_distinct', {distinct}, "
            f"'min_value', {_as_text(f'lo{i}', f.dataType)}, 'max_value', {_as_text(f'hi{i}', f.dataType)}, "
            f"'max_len', cast(coalesce(len{i}, 0) as bigint))")
    return df.selectExpr(*aggs).selectExpr(f"inline(array({', '.join(cells)}))")


def _cell(index: int, f: T.StructField) -> str:
    """Typed cell of one column: numbers stay numbers, long text becomes a SHA-256 digest."""
    c = _quoted(f.name)
    slots = {"l": "cast(null as bigint)", "d": "cast(null as double)",
             "t": "cast(null as timestamp_ntz)", "s": "cast(null as string)"}
    if isinstance(f.dataType, (T.BooleanType, T.IntegralType)):
        slots["l"] = f"cast({c} as bigint)"
    elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        slots["d"] = f"cast({c} as double)"
    elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        slots["t"] = f"cast({c} as timestamp_ntz)"
    elif isinstance(f.dataType, T.DecimalType):
        slots["s"] = f"cast({c} as string)"
    else:
        slots["s"] = f"if(length({c}) > {LONG_TEXT}, concat('sha256:', sha2({c}, 256)), {c})"
    return f"named_struct('cid', {index}, " + ", ".join(f"'{k}', {v}" for k, v in slots.items()) + ")"


def _distinct_counts(tables: Mapping[str, DataFrame], fields: Mapping[str, list[T.StructField]]) -> DataFrame:
    """Exact distinct counts of all columns of all tables: one shared pair of aggregations.

    Equal cells collapse on the map side, so only distinct values are shuffled
    and a value that fills a third of a column costs one row per task.
    """
    labels, frames, cid = [], [], 0
    for table, df in tables.items():
        cells = []
        for f in fields[table]:
            cells.append(_cell(cid, f))
            labels.append((cid, table, f.name))
            cid += 1
        frames.append(df.selectExpr(f"inline(array({', '.join(cells)}))"))
    counted = (
        _union(frames).filter("l is not null or d is not null or t is not null or s is not null")
        .groupBy("cid", "l", "d", "t", "s").agg(F.lit(1).alias("one"))
        .groupBy("cid").agg(F.count(F.lit(1)).alias("n_distinct"))
    )
    names = next(iter(tables.values())).sparkSession.createDataFrame(
        labels, "cid int, table_name string, column_name string")
    # one row per column on both sides
    return names.join(counted, "cid", "left").select(
        "table_name", "column_name", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def column_profile(
    tables: Mapping[str, DataFrame], mode: str = "exact", columns: list[str] | None = None,
    sketch_bits: int = 12,
) -> DataFrame:
    """One row per scalar column: kind, rows, nulls, distinct, min, max, longest text.

    ``exact`` gives ``n_distinct``, counted exactly. ``approx`` is a single scan and gives
    ``approx_distinct`` from sketches instead; no rule reads that column. ``hybrid`` gives both.
    """
    if mode not in ("exact", "approx", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    fields = {t: scalar_fields(df, columns) for t, df in tables.items()}
    tables = {t: df for t, df in tables.items() if fields[t]}
    sketch = None if mode == "exact" else sketch_bits
    stats = _union([_stats(t, df, fields[t], sketch) for t, df in tables.items()])
    if mode == "approx":
        return stats
    counted = stats.join(_distinct_counts(tables, fields), ["table_name", "column_name"], "left")
    return counted if mode == "hybrid" else counted.drop("approx_distinct")


# ---- reports over a profile (one row per column, so everything below is small) ----

def table_overview(profile: DataFrame, large: int = 5000, medium: int = 1000) -> DataFrame:
    sums = profile.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"), F.max("n_distinct").alias("est_rows"),
        F.sum("max_len").alias("total_max_len"))
    return sums.withColumn(
        "memory_class",
        F.when(F.col("total_max_len") > large, "large")
        .when(F.col("total_max_len") > medium, "medium").otherwise("small"))


def memory_hotspots(profile: DataFrame, k: int | None = 20) -> DataFrame:
    """The ``k`` costliest columns, or all with None."""
    cost = F.col("n_distinct") * F.col("max_len")
    weight = (F.when(cost > 1_000_000, "very high").when(cost > 100_000, "high")
              .when(cost > 10_000, "medium").otherwise("low"))
    spots = profile.filter("max_len > 0 and n_distinct > 0").select(
        "table_name", "column_name", "n_distinct", "max_len", cost.alias("memory_cost"), weight.alias("weight"))
    return spots if k is None else spots.orderBy(F.desc("memory_cost"), "table_name", "column_name").limit(k)


def cardinality_histogram(profile: DataFrame) -> DataFrame:
    n = F.col("n_distinct")
    bucket = (F.when(n <= 1, "1").when(n <= 10, "2-10").when(n <= 100, "11-100")
              .when(n <= 10_000, "101-10K").when(n <= 1_000_000, "10K-1M").otherwise(">1M"))
    return profile.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_columns"))


def null_share(profile: DataFrame) -> DataFrame:
    """Share of null values per column, measured."""
    return profile.select(
        "table_name", "column_name", "n_rows", "n_nulls",
        F.when(F.col("n_rows") == 0, F.lit(0.0))
        .otherwise(F.round(F.col("n_nulls") / F.col("n_rows"), 4)).alias("null_share"))


def nullable_tables(facts: DataFrame, share: float = 0.9, min_columns: int = 5) -> DataFrame:
    """Tables of more than ``min_columns`` columns that declare almost everything nullable."""
    sums = facts.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"), F.count_if("is_nullable").alias("n_nullable"))
    return sums.filter(
        (F.col("n_columns") > min_columns) & (F.col("n_nullable") / F.col("n_columns") > share))


def type_distribution(facts: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Columns per declared type; with a profile also the values and nulls they hold."""
    if profile is None:
        return facts.groupBy("data_type").agg(F.count(F.lit(1)).alias("n_columns"))
    return (
        facts.join(profile.select("table_name", "column_name", "n_rows", "n_nulls"),
                   ["table_name", "column_name"], "left")
        .groupBy("data_type").agg(
            F.count(F.lit(1)).alias("n_columns"),
            F.sum(F.coalesce(F.col("n_rows") - F.col("n_nulls"), F.lit(0))).alias("n_values"),
            F.sum(F.coalesce("n_nulls", F.lit(0))).alias("n_nulls"))
    )


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _union([df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows")
                   for t, df in tables.items()])


def row_count_classes(counts: DataFrame, near_empty: int = 10, large: int = 1_000_000) -> DataFrame:
    n = F.col("n_rows")
    return counts.select("table_name", "n_rows", (
        F.when(n == 0, "empty").when(n <= near_empty, "near-empty")
        .when(n > large, "large").otherwise("normal")).alias("row_class"))


def wide_tables(facts: DataFrame, limits: tuple[int, int, int] = (30, 50, 100)) -> DataFrame:
    """Column counts with the highest limit passed; single-column tables are named too."""
    n = F.col("n_columns")
    verdict = (F.when(n > limits[2], f"over {limits[2]}").when(n > limits[1], f"over {limits[1]}")
               .when(n > limits[0], f"over {limits[0]}").when(n == 1, "single column"))
    return (
        facts.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"))
        .select("table_name", "n_columns", verdict.alias("verdict")).filter("verdict is not null")
    )


def modal_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per column, ties to the smallest: a proposal for its default."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns])))
    counted = cells.filter("value is not null").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(counted, ["column_name"], [F.desc("n"), F.asc("value")], 1)
