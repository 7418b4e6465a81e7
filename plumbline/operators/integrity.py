"""Keys, references and skew."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import predicates as P
from plumbline.operators.spread import chunked_pairs, exact_percentile, keyed_filter, range_chunks, top_per_group


def key_candidates(profile: DataFrame) -> DataFrame:
    """Key-like columns with their measured uniqueness."""
    return profile.filter(P.key_like(F.col("column_name"))).select(
        "table_name", "column_name", "n_rows", "n_distinct", "n_nulls",
        ((F.col("n_nulls") == 0) & (F.col("n_distinct") == F.col("n_rows"))).alias("is_unique"))


def propose_primary_key(candidates: DataFrame, facts: DataFrame) -> DataFrame:
    """First unique key-like column of each table by position."""
    placed = candidates.filter("is_unique").join(
        facts.select("table_name", "column_name", "ordinal"), ["table_name", "column_name"])
    return top_per_group(placed, ["table_name"], [F.asc("ordinal")], 1).select(
        "table_name", "column_name", "n_rows")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once; counting runs map-side first."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def orphan_rows(child: DataFrame, parent: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Child rows whose reference is set but has no parent."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c, _ in on])
    return keyed_filter(child.filter(present), parent, on, keep=False)


def orphan_summary(child: DataFrame, parent: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Orphan rows per missing key. Counts per key first, so the join never sees child rows."""
    c, p = on
    counted = child.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n_rows"))
    return keyed_filter(counted, parent, [(c, p)], keep=False)


def unused_parents(parent: DataFrame, child: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """Parents that no child refers to; ``on`` pairs (parent column, child column)."""
    return keyed_filter(parent, child, on, keep=False)


def _common_type(a: T.DataType, b: T.DataType) -> str:
    if a == b:
        return a.simpleString()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        whole = isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType)
        return "bigint" if whole else "double"
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return "timestamp_ntz" if isinstance(a, times) and isinstance(b, times) else "string"


def fk_discovery(
    pairs: Iterable[tuple[str, DataFrame, str, str, DataFrame, str]], threshold: float = 0.0,
) -> DataFrame:
    """Containment of child values in candidate parent keys.

    ``pairs`` holds (child name, child, column, parent name, parent, column). Both
    sides are reduced to distinct values and meet in one grouping, so a hot
    reference value costs one row per task and no join is needed. Values are compared in
    the pair's common type: whole numbers as such, other numbers as doubles, else as text.
    """
    frames = []
    for child_name, child, c, parent_name, parent, p in pairs:
        pair = f"{child_name}.{c} -> {parent_name}.{p}"
        common = _common_type(child.schema[c].dataType, parent.schema[p].dataType)
        for side, df, col in (("c", child, c), ("p", parent, p)):
            frames.append(df.filter(f"`{col}` is not null").selectExpr(
                f"'{pair}' as pair", f"cast(cast(`{col}` as {common}) as string) as value", f"{int(side == 'c')} as c", f"{int(side == 'p')} as p"))
    tagged = reduce(DataFrame.unionByName, frames)
    return (
        tagged.groupBy("pair", "value").agg(F.max("c").alias("c"), F.max("p").alias("p"))
        .groupBy("pair").agg(F.sum("c").alias("n_child_values"), F.sum(F.col("c") * F.col("p")).alias("n_contained"),
                             F.sum("p").alias("n_parent_values"))
        .withColumn("containment", F.round(F.col("n_contained") / F.col("n_child_values"), 4))
        .filter(F.col("containment") >= threshold)
    )


def transitions(df: DataFrame, key: str, order: list[str], value: str, chunk: Column | None = None) -> DataFrame:
    """Directed edges between neighbouring values of each key, with counts.

    Works per ``chunk``: ranges of about equally many rows unless given, so no busy key or day is one task.
    """
    if chunk is None:
        df, chunk = range_chunks(df.select(key, value, *order), [key, *order])
    return chunked_pairs(df, key, order, value, chunk)


def reciprocal_edges(edges: DataFrame, src: str = "src", dst: str = "dst", n: str = "n") -> DataFrame:
    """Pairs linked in both directions: one grouping on the unordered pair, no self-join."""
    a, b = F.least(src, dst), F.greatest(src, dst)
    forward = F.col(src) == F.col("node_a")
    return (
        edges.filter(F.col(src) != F.col(dst)).withColumns({"node_a": a, "node_b": b})
        .groupBy("node_a", "node_b").agg(
            F.sum(F.when(forward, F.col(n)).otherwise(0)).alias("n_forward"),
            F.sum(F.when(~forward, F.col(n)).otherwise(0)).alias("n_backward"))
        .filter("n_forward > 0 and n_backward > 0")
    )


def fk_skew(df: DataFrame, column: str) -> DataFrame:
    """Rows per reference value: how uneven a join on it would be."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    spread = counted.agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"), F.max("n").alias("max_rows"))
    # two one-row results side by side
    both = spread.unionByName(exact_percentile(counted, [], "n", 0.5, "median_rows"), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("n_keys", "n_rows", "max_rows", "median_rows")]).select(
        F.lit(column).alias("column_name"), "*",
        F.round(F.col("max_rows") / F.col("n_rows"), 6).alias("top_share"))
