"""Transaction logs (newline-delimited JSON) and storage listings."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from plumbline.session import commit_small, move, names, remove, scratch_path

_STRINGS = T.MapType(T.StringType(), T.StringType())

LOG_SCHEMA = T.StructType([
    T.StructField("commitInfo", T.StructType([
        T.StructField("timestamp", T.LongType()),
        T.StructField("operation", T.StringType()),
        T.StructField("operationParameters", _STRINGS),
        T.StructField("operationMetrics", _STRINGS),
    ])),
    T.StructField("metaData", T.StructType([
        T.StructField("id", T.StringType()),
        T.StructField("partitionColumns", T.ArrayType(T.StringType())),
        T.StructField("configuration", _STRINGS),
    ])),
    T.StructField("add", T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("modificationTime", T.LongType()),
        T.StructField("partitionValues", _STRINGS),
        T.StructField("stats", T.StringType()),
    ])),
    T.StructField("remove", T.StructType([
        T.StructField("path", T.StringType()),
        T.StructField("deletionTimestamp", T.LongType()),
        T.StructField("dataChange", T.BooleanType()),
    ])),
    T.StructField("protocol", T.StructType([
        T.StructField("minReaderVersion", T.IntegerType()),
        T.StructField("minWriterVersion", T.IntegerType()),
    ])),
    T.StructField("_corrupt_record", T.StringType()),
])


def read_log(spark: SparkSession, glob: str) -> DataFrame:
    """One distributed scan over every table and version below ``glob``.

    Malformed lines are skipped, table and version come from the file name.
    """
    return _commit_lines(spark, [glob])


def _commit_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = (
        spark.read.schema(LOG_SCHEMA)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(paths)
    )
    where = F.col("_metadata.file_path")
    return (
        raw.withColumn("table_name", F.regexp_extract(where, r"([^/]+)/_delta_log/\d+\.json$", 1))
        .withColumn("version", F.expr(r"try_cast(regexp_extract(_metadata.file_path, '(\\d+)\\.json$', 1) as bigint)"))
        .filter(F.col("_corrupt_record").isNull() & F.col("version").isNotNull())
        .select("table_name", "version", "commitInfo", "metaData", "add", "remove", "protocol")
    )


def read_checkpoints(spark: SparkSession, glob: str) -> DataFrame:
    """The state that checkpoint files hold, shaped like ``read_log``: parquet, whole or in parts.

    Rows carry the checkpoint's version, so united with the commits behind it a replay is whole even
    where the early commits are gone.
    """
    return _checkpoint_rows(spark, [glob])


def _checkpoint_rows(spark: SparkSession, paths: list[str]) -> DataFrame:
    schema = T.StructType([f for f in LOG_SCHEMA.fields if f.name not in ("commitInfo", "_corrupt_record")])
    where = F.col("_metadata.file_path")
    name = r"([^/]+)/_delta_log/(\d+)\.checkpoint[^/]*\.parquet$"
    return (
        spark.read.schema(schema).parquet(*paths)
        .withColumn("table_name", F.regexp_extract(where, name, 1))
        .withColumn("version", F.regexp_extract(where, name, 2).try_cast("bigint"))
        .filter(F.col("version").isNotNull())
        .select("table_name", "version", F.lit(None).cast(LOG_SCHEMA["commitInfo"].dataType).alias("commitInfo"), "metaData", "add", "remove", "protocol")
    )


def read_whole_log(spark: SparkSession, root: str) -> DataFrame:
    """Commits and checkpoints of every table below ``root``; either kind may be missing."""
    parts = []
    for read, pattern in ((read_log, "*.json"), (read_checkpoints, "*.parquet")):
        try:
            parts.append(read(spark, f"{root.rstrip('/')}/*/_delta_log/{pattern}"))
        except AnalysisException:
            if pattern == "*.parquet" and not parts:
                raise
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


_COMMIT = re.compile(r"(\d{20})\.json")
_CHECKPOINT = re.compile(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet")


def whole_checkpoints(listed: list[str]) -> dict[int, list[str]]:
    """Names of the files of each checkpoint version, of those whose parts are all there; a single file goes before parts."""
    parts: dict[tuple[int, int], dict[int, str]] = {}
    for name in listed:
        if m := _CHECKPOINT.fullmatch(name):
            parts.setdefault((int(m[1]), int(m[3] or 1)), {})[int(m[2] or 1)] = name
    out: dict[int, list[str]] = {}
    for (version, n), have in sorted(parts.items(), reverse=True):
        if sorted(have) == list(range(1, n + 1)):
            out[version] = [have[k] for k in sorted(have)]
    return out


def replay_files(spark: SparkSession, folders: list[str]) -> tuple[list[str], list[str], int]:
    """(commits, checkpoint files, newest version) that a replay needs of one table.

    The first folder is the table's log, others hold snapshots of our own. The newest whole checkpoint of all is the base;
    ``_last_checkpoint`` is a hint that may name one that is gone or not whole, so the listing decides. Commits behind the
    base have to follow it without a gap, else the log can't be replayed.
    """
    best, listed = (-1, []), names(spark, folders[0])
    for folder in folders:
        for version, found in whole_checkpoints(listed if folder == folders[0] else names(spark, folder)).items():
            best = max(best, (version, [f"{folder}/{n}" for n in found]))
    behind = sorted((int(m[1]), n) for n in listed if (m := _COMMIT.fullmatch(n)) and int(m[1]) > best[0])
    if [v for v, _ in behind] != list(range(best[0] + 1, best[0] + 1 + len(behind))):
        raise ValueError(f"{folders[0]}: commits are missing behind version {best[0]}")
    return [f"{folders[0]}/{n}" for _, n in behind], best[1], behind[-1][0] if behind else best[0]


def replay(spark: SparkSession, root: str, snapshots: str | None = None) -> DataFrame:
    """The log lines that make up the present state of every table below ``root``: base checkpoints and the commits behind them.

    Earlier commits are not read, and need not be there. ``snapshots`` is a folder for states written by ``snapshot``.
    """
    commits_, bases = [], []
    for table in names(spark, root):
        folders = [f"{root}/{table}/_delta_log"] + ([f"{snapshots}/{table}/_delta_log"] if snapshots else [])
        if names(spark, folders[0]):
            json_files, base, _ = replay_files(spark, folders)
            commits_ += json_files
            bases += base
    parts = [_commit_lines(spark, commits_)] * bool(commits_) + [_checkpoint_rows(spark, bases)] * bool(bases)
    if not parts:
        raise ValueError(f"no transaction log below {root}")
    return reduce(DataFrame.unionByName, parts)


def write_commits(lines: DataFrame, root: str) -> None:
    """Write (table_name, version, line) as ``<table>/_delta_log/<version>.json``, each commit a file of its own."""
    spark = lines.sparkSession
    draft = scratch_path(spark, "commits")
    lines.select("table_name", "version", "line").repartition("table_name", "version").write.partitionBy("table_name", "version").text(draft)
    for table in names(spark, draft):
        for version in names(spark, f"{draft}/{table}") if "=" in table else ():
            for k, file in enumerate(n for n in names(spark, f"{draft}/{table}/{version}") if n.startswith("part-")):
                if k:
                    raise ValueError("a commit has several files")
                move(spark, f"{draft}/{table}/{version}/{file}", f"{root}/{table.partition('=')[2]}/_delta_log/{int(version.partition('=')[2]):020d}.json")
    remove(spark, draft)


def write_checkpoint(state: DataFrame, folder: str, version: int, parts: int = 1) -> None:
    """The lines of one table's state as a checkpoint, and the hint to it when every part is in place."""
    spark = state.sparkSession
    draft = scratch_path(spark, "checkpoint")
    state.select("metaData", "add", "remove", "protocol").repartition(parts).write.parquet(draft)
    written = [n for n in names(spark, draft) if n.startswith("part-")]
    for k, file in enumerate(written, 1):
        part = f".{k:010d}.{len(written):010d}" if len(written) > 1 else ""
        move(spark, f"{draft}/{file}", f"{folder}/{version:020d}.checkpoint{part}.parquet")
    remove(spark, draft)
    remove(spark, f"{folder}/_last_checkpoint")
    commit_small(spark, f"{folder}/_last_checkpoint", json.dumps({"version": version, "parts": len(written)}))


def snapshot(spark: SparkSession, root: str, table: str, snapshots: str, parts: int = 1) -> int:
    """Write the present state of a table below ``snapshots`` for the next replay; returns its version. The table's own log isn't touched."""
    folders = [f"{root}/{table}/_delta_log", f"{snapshots}/{table}/_delta_log"]
    commits_, base, newest = replay_files(spark, folders)
    if commits_:
        lines = reduce(DataFrame.unionByName, [_commit_lines(spark, commits_)] + [_checkpoint_rows(spark, base)] * bool(base))
        write_checkpoint(state_lines(lines), folders[1], newest, parts)
    return newest


def state_lines(log: DataFrame) -> DataFrame:
    """The lines that hold after a replay: the newest line of each path, as add or as tombstone, and each table's newest settings."""
    path = F.coalesce("add.path", "remove.path")
    # within a commit a path is removed before it is added again
    last = log.filter("add is not null or remove is not null").groupBy("table_name", path.alias("path")).agg(
        F.max(F.struct("version", F.col("add").isNotNull().alias("is_add"), F.struct("add.path", "add.size", "add.modificationTime", "add.stats").alias("a"),
                       F.struct("remove.path", "remove.deletionTimestamp", "remove.dataChange").alias("r"))).alias("x"))
    null = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields}
    values = F.lit(None).cast(LOG_SCHEMA["add"].dataType["partitionValues"].dataType).alias("partitionValues")
    add = F.when(F.col("x.is_add"), F.struct("x.a.path", "x.a.size", "x.a.modificationTime", values, "x.a.stats")).cast(LOG_SCHEMA["add"].dataType)
    gone = F.when(~F.col("x.is_add"), F.col("x.r")).cast(LOG_SCHEMA["remove"].dataType)
    files = last.select("table_name", F.col("x.version").alias("version"), null["metaData"], add.alias("add"), gone.alias("remove"), null["protocol"])
    w = W.partitionBy("table_name").orderBy(F.col("version").desc())
    newest = log.filter("metaData is not null").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return files.unionByName(newest.select("table_name", "version", "metaData", null["add"], null["remove"], null["protocol"]))


def file_actions(log: DataFrame) -> DataFrame:
    """(table_name, version, path, action, size, modified) for every add and remove line."""
    adds = log.filter("add is not null").select(
        "table_name", "version", F.col("add.path").alias("path"), F.lit("add").alias("action"),
        F.col("add.size").alias("size"), F.timestamp_millis("add.modificationTime").alias("modified"))
    removes = log.filter("remove is not null").select(
        "table_name", "version", F.col("remove.path").alias("path"), F.lit("remove").alias("action"),
        F.lit(None).cast("bigint").alias("size"),
        F.timestamp_millis("remove.deletionTimestamp").alias("modified"))
    return adds.unionByName(removes)


def commits(log: DataFrame) -> DataFrame:
    """(table_name, version, operation, committed, parameters) per commit line."""
    return log.filter("commitInfo is not null").select(
        "table_name", "version",
        F.coalesce("commitInfo.operation", F.lit("UNKNOWN")).alias("operation"),
        F.timestamp_millis("commitInfo.timestamp").alias("committed"),
        F.col("commitInfo.operationParameters").alias("parameters"))


def table_settings(log: DataFrame) -> DataFrame:
    """The newest metadata line per table: partition columns and settings map."""
    w = W.partitionBy("table_name").orderBy(F.col("version").desc())
    return (
        log.filter("metaData is not null")
        .withColumn("_n", F.row_number().over(w)).filter("_n = 1")
        .select("table_name", F.col("metaData.partitionColumns").alias("partition_columns"),
                F.col("metaData.configuration").alias("properties"))
    )


def last_versions(actions: DataFrame, n: int = 50) -> DataFrame:
    """Rows of the newest ``n`` versions of each table.

    Ranks distinct (table, version) pairs, not rows, and the rank filter is
    applied before the shuffle, so a table with very many log lines stays spread.
    """
    w = W.partitionBy("table_name").orderBy(F.col("version").desc())
    kept = (
        actions.select("table_name", "version").distinct()
        .withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n)
        .select("table_name", "version")
    )
    return actions.join(kept, ["table_name", "version"], "left_semi")


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of every file below ``path``; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob).load(path)
        .select("path", "length", "modificationTime")
    )
