"""Applies the transforms of a fix plan and reports what became of each target."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from plumbline.operators import fixes as X
from plumbline.operators.discovery import unique_column_sets
from plumbline.operators.profile import column_profile

#: What a transform gets: a table, its name, and the columns that the target names.
Transform = Callable[[DataFrame, str, tuple[str, ...]], DataFrame]
#: What transforms have to know about a table beyond its rows: by table, by name of the setting.
About = Mapping[str, Mapping[str, object]]

OUTCOMES = "fix_id string, rule_id string, target string, outcome string, reason string, path string"
RUNS = "fix_id string, target string, done string, problem string, path string"
#: Copies that are planned and written at a time.
AT_ONCE = 8


def split_target(target: str) -> tuple[str, tuple[str, ...]]:
    """``table[column]`` as table and columns; a plain name is a table."""
    table, _, columns = target.partition("[")
    return table, tuple(c.strip() for c in columns.rstrip("]").split(",") if c.strip())


def transforms(parents: Mapping[str, tuple[DataFrame, str]] | None = None, order: Mapping[str, str] | None = None, about: About | None = None) -> dict[str, Transform]:
    """The transforms of the fix catalog by the name a plan's command gives them.

    ``parents``: parent table and key for each child column, for ``drop_orphans`` (a null reference is no
    orphan); ``order``: the column that says which record is first, by table, for ``dedup_records`` and ``trim_members``.
    ``about`` holds settings by table: ``time``, ``as_of`` and ``days`` (retention_filter, add_audit_columns), ``defaults``,
    ``name``, ``description``, ``format``, ``expression``, ``keep`` (trim_members), ``record`` and ``aliases``, ``bucket`` (partition_rewrite),
    ``candidates`` (mark_keys), ``matches`` (repair_view_source), ``stale``, ``key`` and ``build`` (refresh_view).
    A setting that is missing makes the target fail, not the plan.
    """
    told = about or {}

    def of(table: str, name: str):
        return told[table][name]

    def drop_orphans(df: DataFrame, table: str, cols: tuple[str, ...]) -> DataFrame:
        for c in cols:
            parent, key = parents[c]
            df = X.drop_orphans(df.filter(df[c].isNotNull()), parent, [(c, key)]).unionByName(df.filter(df[c].isNull()))
        return df

    out: dict[str, Transform] = {
        "hide_columns": lambda df, table, cols: X.hide_columns(df, extra=list(cols)),
        "drop_constant_columns": lambda df, table, cols: X.drop_constant_columns(df, table),
        "mask_columns": lambda df, table, cols: X.mask_columns(df, dict.fromkeys(cols, "default")),
        "compact_files": lambda df, table, cols: df.hint("rebalance"),
        "compute_stats": lambda df, table, cols: column_profile({table: df}),
        "propose_primary_key": lambda df, table, cols: unique_column_sets(df, 2, list(cols) or None),
        "add_audit_columns": lambda df, table, cols: X.add_audit_columns(df, F.col(of(table, "time"))),
        "fill_defaults": lambda df, table, cols: X.fill_defaults(df, told.get(table, {}).get("defaults")),
        "retention_filter": lambda df, table, cols: X.retention_filter(df, of(table, "time"), of(table, "as_of"), told[table].get("days", 365)),
        "partition_rewrite": lambda df, table, cols: df.withColumn("bucket", of(table, "bucket")).hint("rebalance", "bucket"),
        "rewrite_expressions": lambda df, table, cols: X.rewrite_expressions(df, cols[0] if cols else of(table, "expression")),
        "fill_formats": lambda df, table, cols: X.fill_formats(df, of(table, "name"), of(table, "format"), expression=told[table].get("expression")),
        "fill_descriptions": lambda df, table, cols: X.fill_descriptions(df, of(table, "name"), of(table, "description"), told[table].get("expression")),
        "clean_names": lambda df, table, cols: X.clean_names(df, cols[0] if cols else of(table, "name")),
        "drop_alias_records": lambda df, table, cols: X.drop_alias_records(df, of(table, "record"), of(table, "aliases")),
        "mark_date_table": lambda df, table, cols: X.mark_date_table(df, cols[0] if cols else of(table, "name")),
        "mark_keys": lambda df, table, cols: X.mark_keys(df, of(table, "candidates")),
        "single_direction": lambda df, table, cols: X.single_direction(df),
        "no_implicit_summary": lambda df, table, cols: X.no_implicit_summary(df),
        "repair_view_source": lambda df, table, cols: X.repair_view_source(df, of(table, "matches")),
        "refresh_view": lambda df, table, cols: X.refresh_view(df, of(table, "stale"), of(table, "key"), of(table, "build")),
    }
    if parents is not None:
        out["drop_orphans"] = drop_orphans
    if order is not None:
        out["dedup_records"] = lambda df, table, cols: X.dedup_records(df, list(cols), order[table])
        out["trim_members"] = lambda df, table, cols: X.trim_members(df, list(cols), order[table], told.get(table, {}).get("keep", 5))
    return out


def apply_plan(spark: SparkSession, plan: DataFrame, tables: Mapping[str, DataFrame], root: str, known: Mapping[str, Transform], at_once: int = AT_ONCE) -> DataFrame:
    """(fix_id, rule_id, target, outcome, reason, path): one row per row of the plan.

    Only the different targets that can run come to the driver: fixes times tables, however many rows the plan has, as
    findings by key name no table. ``fixed``: the repaired copy lies in ``path``, below ``root``, which must not exist yet.
    ``skipped``: the row is a command for another system, or its table or transform isn't known here. ``failed``: the transform
    can't be planned or lacks a setting, or its copy is already there. ``at_once`` copies are written side by side, so that the
    few tasks of one leave no cores idle; copies to the same path come one after the other.
    """
    table = F.substring_index("target", "[", 1)
    name = F.substring_index(F.regexp_replace("command", "^transform:", ""), " ", 1)
    has_table, has_transform = table.isin(*tables), name.isin(*known)
    reason = (F.when(~F.col("is_transform"), F.lit("a command for another system")).when(~has_table, F.concat(F.lit("no table "), table))
              .when(~has_transform, F.concat(F.lit("no transform "), name)))
    told = plan.withColumn("reason", reason)
    copies: dict[str, list] = {}
    for r in told.filter("reason is null").select("fix_id", "target", name.alias("name")).distinct().orderBy("fix_id", "target").collect():
        of, columns = split_target(r.target)
        path = f"{root.rstrip('/')}/{r.fix_id}/{of}" + "".join(f".{c}" for c in columns)
        copies.setdefault(path, []).append((r, of, columns))

    def copied(path: str) -> list[tuple]:
        runs = []
        for r, of, columns in copies[path]:
            try:
                X.write_copy(known[r.name](tables[of], of, columns), path)
                runs.append((r.fix_id, r.target, "fixed", None, path))
            except (AnalysisException, KeyError, IndexError) as problem:
                runs.append((r.fix_id, r.target, "failed", f"{type(problem).__name__}: {problem}", None))
        return runs

    with ThreadPoolExecutor(at_once) as pool:
        runs = [run for own in pool.map(inheritable_thread_target(spark)(copied), copies) for run in own]
    done = spark.createDataFrame(runs, RUNS)
    return told.join(F.broadcast(done), ["fix_id", "target"], "left").select(  # as many rows as copies were tried
        "fix_id", "rule_id", "target", F.coalesce("done", F.lit("skipped")).alias("outcome"), F.coalesce("reason", "problem").alias("reason"), "path")
