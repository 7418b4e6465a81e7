"""Relationship graphs and inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import predicates as P
from plumbline.operators.spread import keyed_filter


def endpoints(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    both = edges.select(F.col(src).alias("node")).unionByName(edges.select(F.col(dst).alias("node")))
    return both.filter(~P.blank(F.col("node").cast("string")))


def disconnected_nodes(
    nodes: DataFrame, node: str, edges: DataFrame, ends: tuple[str, ...] = ("src", "dst"), exempt: str | None = None,
) -> DataFrame:
    """Nodes at no end of any edge; names matching ``exempt`` are let off."""
    linked = reduce(DataFrame.unionByName, [edges.select(F.col(e).alias("_node")) for e in ends])
    lone = keyed_filter(nodes, linked, [(node, "_node")], keep=False)
    return lone if exempt is None else lone.filter(~F.lower(F.col(node).cast("string")).rlike(exempt))


def node_degree(edges: DataFrame, above: int = 5) -> DataFrame:
    return endpoints(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") > above)


def edge_flags(edges: DataFrame) -> DataFrame:
    """Bidirectional, inactive and implicitly summarised edges, with the status of each check.

    ``edges`` needs cross_filter, is_active and summarize_by.
    """
    both = F.lower(F.col("cross_filter")).isin("2", "both", "bothdirections")
    inactive = F.lower(F.col("is_active").cast("string")).isin("false", "0")
    implicit = ~F.coalesce(F.lower("summarize_by"), F.lit("")).isin("none", "", "0")
    sums = edges.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(both).alias("both"),
                     F.count_if(inactive).alias("inactive"), F.count_if(implicit).alias("implicit"))
    hits = sums.select("n_edges", F.inline(F.array(*[
        F.struct(F.lit(check).alias("check"), F.col(col).alias("n_hits"), F.lit(fails).alias("fails_above"))
        for check, col, fails in (("bidirectional", "both", 3), ("inactive", "inactive", None),
                                  ("implicit_summary", "implicit", None))])))
    status = (F.when(F.col("n_edges") == 0, "N/A").when(F.col("n_hits") == 0, "PASS")
              .when(F.col("n_hits") > F.col("fails_above"), "FAIL").otherwise("WARN"))
    return hits.select("check", "n_edges", "n_hits", status.alias("status"))


def cross_group_edges(edges: DataFrame, src_group: str, dst_group: str, by: list[str] | None = None) -> DataFrame:
    """Edges whose ends lie in different groups, counted per pair of groups (or ``by``)."""
    keys = by or [src_group, dst_group]
    return edges.filter(F.col(src_group) != F.col(dst_group)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_edges"))


def excess_members(members: DataFrame, groups: list[str], limit: int = 5, privileged: Column | None = None) -> DataFrame:
    rows = members if privileged is None else members.filter(privileged)
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_members")).filter(F.col("n_members") > limit)


def duplicate_records(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """Groups of records that agree on ``keys``, with the record that would be kept."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(id_column).alias("keep_id")).filter("n_rows > 1")


def status_health(df: DataFrame, entity: str, status: str, healthy: tuple[str, ...]) -> DataFrame:
    """Status counts per entity; a blank status counts as healthy."""
    ok = P.blank(F.col(status)) | F.lower(status).isin([h.lower() for h in healthy])
    sums = df.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(~ok).alias("n_failing"))
    return sums.withColumn("status", F.when(F.col("n_failing") == 0, "PASS").otherwise("FAIL"))


def version_parts(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def version_check(df: DataFrame, version: str, floor: tuple[int, ...]) -> DataFrame:
    """Rows whose dotted version is below ``floor``; blank versions are skipped."""
    parts = version_parts(F.col(version))
    padded = F.concat(parts, F.array_repeat(F.lit(0), F.greatest(F.lit(len(floor)) - F.size(parts), F.lit(0))))
    return df.filter(~P.blank(F.col(version)) & (padded < F.array(*[F.lit(n) for n in floor])))


def inventory_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"))


def format_share(items: DataFrame, group: list[str], fmt: str, wanted: str) -> DataFrame:
    """Items per group and those not in the wanted format."""
    other = F.coalesce(F.lower(fmt) != wanted, F.lit(True))
    return items.groupBy(*group).agg(F.count(F.lit(1)).alias("n_items"), F.count_if(other).alias("n_other"))


def computed_share(facts: DataFrame, computed: DataFrame, above: float = 0.3) -> DataFrame:
    """Tables whose share of computed columns is above ``above``."""
    totals = facts.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_columns"))
    derived = computed.groupBy("table_name").agg(F.count(F.lit(1)).alias("n_computed"))
    return totals.join(derived, "table_name").withColumn(
        "share", F.round(F.col("n_computed") / F.col("n_columns"), 4)).filter(F.col("share") > above)


def computed_columns(df: DataFrame, guesses: dict[str, Column]) -> DataFrame:
    """Share of rows in which a column equals a function of the others; one scan for all guesses."""
    row = df.agg(F.count(F.lit(1)).alias("n_rows"), *[
        F.count_if(F.col(c).eqNullSafe(expr)).alias(f"m{i}") for i, (c, expr) in enumerate(guesses.items())])
    return row.select("n_rows", F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("n_match")) for i, c in enumerate(guesses)]))
    ).withColumn("share", F.round(F.col("n_match") / F.col("n_rows"), 4))


def pseudo_hierarchies(levels: DataFrame, hierarchy: str, at_most: int = 2) -> DataFrame:
    return levels.groupBy(hierarchy).agg(F.count(F.lit(1)).alias("n_levels")).filter(F.col("n_levels") <= at_most)
