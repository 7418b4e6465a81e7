"""Transaction logs, files, extents and settings."""

import json
import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.functions.fixed_values import GB, MB
from plumbline.operators import fixes as X
from plumbline.operators import storage as S
from plumbline.plans.catalog import SETTING_RULES, setting_rules_frame
from plumbline.sources import txlog as T

DAY = 86_400_000
BASE = 1_704_067_200_000  # 2024-01-01 UTC
AS_OF = "2024-01-31 00:00:00"


def add(path, size, at=BASE):
    return {"add": {"path": path, "size": size, "modificationTime": at, "partitionValues": {}, "stats": None}}


def remove(path, at=BASE):
    return {"remove": {"path": path, "deletionTimestamp": at, "dataChange": True}}


def commit(operation, day, **parameters):
    return {"commitInfo": {"timestamp": BASE + day * DAY, "operation": operation, "operationParameters": parameters}}


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """t1: removes, a re-added path and a malformed line; t2: metadata twice and 101 versions."""
    root = tmp_path_factory.mktemp("log")
    files = {
        "t1": [
            [commit("WRITE", 0), {"metaData": {"id": "1", "partitionColumns": [], "configuration": {}}}, add("a", 10), add("b", 20)],
            [commit("DELETE", 1), remove("a"), "not json at all"],
            [commit("OPTIMIZE", 2, zOrderBy="[]"), remove("b"), add("c", 30)],
            [commit("WRITE", 3), add("a", 11)],
            [commit("VACUUM END", 22)],
        ],
        "t2": [
            [commit("WRITE", 0), {"metaData": {"id": "2", "partitionColumns": ["day"], "configuration": {"delta.checkpointInterval": "51"}}}],
            [commit("OPTIMIZE", 1, zOrderBy='["k"]'),
             {"metaData": {"id": "2", "partitionColumns": ["day", "k"], "configuration": {"delta.checkpointInterval": "50", "delta.enableChangeDataFeed": "true"}}}],
        ] + [[commit("WRITE", 2), add(f"f{i}", MB)] for i in range(99)],
    }
    for table, versions in files.items():
        folder = root / table / "_delta_log"
        os.makedirs(folder)
        for v, lines in enumerate(versions):
            text = "\n".join(line if isinstance(line, str) else json.dumps(line) for line in lines)
            (folder / f"{v:020d}.json").write_text(text)
    return T.read_log(spark, f"{root}/*/_delta_log/*.json").cache()


def test_log_scan(log):
    assert rows(log.groupBy("table_name").agg(F.max("version").alias("v")), "table_name", "v") == [("t1", 4), ("t2", 100)]
    assert log.filter("table_name = 't1'").count() == 12  # the malformed line is gone


def test_replay_subtracts_removes_and_keeps_re_added_paths(log):
    live = S.active_files(T.file_actions(log)).filter("table_name = 't1'")
    assert rows(live, "path", "version", "size") == [("a", 3, 11), ("c", 2, 30)]


def test_replay_in_one_commit_keeps_the_added_file(spark):
    actions = spark.createDataFrame([("t", 1, "p", "remove", None), ("t", 1, "p", "add", 5)],
                                    "table_name string, version long, path string, action string, size long")
    assert S.active_files(actions).count() == 1


def test_newest_metadata_wins(log):
    got = {r.table_name: r for r in T.table_settings(log).collect()}
    assert got["t2"].partition_columns == ["day", "k"]
    assert got["t2"].properties["delta.checkpointInterval"] == "50"


def test_versions(log):
    assert rows(S.version_count(log)) == [("t2", 101)]
    assert S.version_count(log.filter("version < 100")).count() == 0
    assert T.last_versions(log, 2).select("table_name", "version").distinct().count() == 4


def test_maintenance(log):
    commits = T.commits(log).withColumn("zorder_by", F.element_at("parameters", "zOrderBy")).withColumn(
        "committed", F.col("committed").cast("timestamp_ntz"))
    got = {r.table_name: r for r in S.maintenance_history(commits, AS_OF).collect()}
    assert (got["t1"].vacuum, got["t1"].vacuum_days, got["t1"].optimize, got["t1"].has_zorder) == ("stale", 8, "done", False)
    assert (got["t2"].vacuum, got["t2"].vacuum_days, got["t2"].has_zorder) == ("never", None, True)
    on_time = S.maintenance_history(commits, "2024-01-30 00:00:00").filter("table_name = 't1'").first()
    assert (on_time.vacuum, on_time.vacuum_days) == ("recent", 7)


def stats(spark, *tables):
    return spark.createDataFrame(tables, "table_name string, n_files long, n_small long, total_bytes long")


def test_file_limits(spark):
    files = spark.createDataFrame([("t", f"p{i}", s) for i, s in enumerate((25 * MB - 1, 25 * MB, GB, GB + 1))],
                                  "table_name string, path string, size long")
    got = S.file_size_stats(files).first()
    assert (got.n_files, got.n_small, got.n_large) == (4, 1, 1)
    small = stats(spark, ("hit", 11, 6, 0), ("few", 10, 10, 0), ("half", 12, 6, 0))
    assert rows(S.small_files(small), "table_name") == [("hit",)]
    big = stats(spark, ("hit", 1, 0, 10 * GB + 1), ("at", 1, 0, 10 * GB), ("cut", 1, 0, 11 * GB))
    cut = spark.createDataFrame([("cut",)], "table_name string")
    assert rows(S.large_unpartitioned(big, cut), "table_name") == [("hit",)]
    many = stats(spark, ("hit", 101, 0, 0), ("at", 100, 0, 0), ("cut", 200, 0, 0))
    assert rows(S.change_feed_gap(many, cut), "table_name") == [("hit",)]


def test_write_amplification_limits(spark):
    def ops(table, rewrites, writes):
        return [(table, "MERGE")] * rewrites + [(table, "WRITE")] * writes
    commits = spark.createDataFrame(ops("hit", 6, 5) + ops("few", 10, 0) + ops("half", 6, 6), "table_name string, operation string")
    assert rows(S.write_amplification(commits), "table_name") == [("hit",)]


def test_extent_and_compression_limits(spark):
    parts = spark.createDataFrame(
        [("hit", 99_999)] * 101 + [("few", 10)] * 100 + [("full", 100_000)] * 101, "table_name string, n_rows long")
    assert rows(S.extent_fragmentation(parts), "table_name") == [("hit",)]
    sizes = spark.createDataFrame([("hit", 1000 * MB, 601 * MB), ("at", 1000 * MB, 600 * MB), ("small", 100 * MB, 90 * MB)],
                                  "table_name string, original_bytes long, compressed_bytes long")
    assert rows(S.compression_ratio(sizes), "table_name", "saved_pct") == [("hit", 39.9)]


def test_settings(spark):
    settings = spark.createDataFrame([
        ("table", "good", {"delta.autoOptimize.optimizeWrite": "true", "delta.logRetentionDuration": "interval 30 days",
                           "delta.dataSkippingNumIndexedCols": "32", "delta.parquet.vorder.enabled": "TRUE", "delta.enableChangeDataFeed": "true",
                           "delta.columnMapping.mode": "name", "delta.enableDeletionVectors": "true", "delta.checkpointInterval": "50"}),
        ("table", "bare", {}),
        ("table", "odd", {"delta.checkpointInterval": "51", "delta.deletedFileRetentionDuration": "interval 7 days", "delta.columnMapping.mode": "none"}),
    ], "entity_kind string, entity string, properties map<string,string>")
    got = rows(S.property_audit(settings, setting_rules_frame(spark)), "entity", "rule_id")
    assert [r for e, r in got if e == "good"] == []
    assert [r for e, r in got if e == "bare"] == ["LH-020", "LH-021", "LH-024", "LH-026", "LH-027", "LH-028", "LH-029"]
    assert ("odd", "LH-030") in got and ("odd", "LH-021") not in got and ("odd", "LH-028") in got
    assert len({r[0] for r in SETTING_RULES}) == 25


def test_vacuum_candidates(spark):
    listing = spark.createDataFrame([("t", "live", 1, "2024-01-01"), ("t", "dead", 1, "2024-01-23"), ("t", "at", 1, "2024-01-24"),
                                     ("t", "fresh", 1, "2024-01-30")], "table_name string, path string, size long, d string")
    listing = listing.withColumn("modified", F.col("d").cast("timestamp_ntz"))
    live = spark.createDataFrame([("t", "live")], "table_name string, path string")
    assert rows(S.vacuum_candidates(listing, live, AS_OF), "path") == [("dead",)]


def test_listing_does_not_read_contents(spark, tmp_path):
    for name, text in (("a.txt", "12345"), ("sub/b.txt", "1")):
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    got = T.list_files(spark, str(tmp_path))
    assert rows(got, "length") == [(1,), (5,)]
    assert "content" not in got._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]


def test_compaction_plan_bins(spark):
    files = spark.createDataFrame([("t", f"part-{i:03d}", 10) for i in range(95)] + [("u", "part-000", 10), ("u", "part-big", 500)],
                                  "table_name string, path string, size long")
    plan = X.compact_plan(files, target_bytes=100, small_below=100)
    assert rows(plan) == sorted([("t", b, 10, 100) for b in range(9)] + [("t", 9, 5, 50), ("u", 0, 1, 10)], key=repr)
    one_task = X.compact_plan(files, target_bytes=100, small_below=100, chunk=F.lit(0))
    assert rows(one_task) == rows(plan)


def test_rewrites_keep_every_row(spark, t, tmp_path):
    before = t.lineitem.groupBy(*t.lineitem.columns).count()
    for name, write in {
        "compact": lambda p: X.compact_files(t.lineitem, p),
        "zorder": lambda p: X.write_copy(X.zorder(t.lineitem, ["l_partkey", "l_suppkey"], 16), p),
        "partition": lambda p: X.partition_rewrite(t.lineitem, F.year("l_shipdate"), "y", p),
    }.items():
        path = str(tmp_path / name)
        write(path)
        after = spark.read.parquet(path).drop("y")
        after = after.groupBy(*t.lineitem.columns).count()
        assert before.exceptAll(after).count() == 0 and after.exceptAll(before).count() == 0
        with pytest.raises(Exception, match="already exists"):
            write(path)


def test_zorder_narrows_both_columns(spark, t):
    def touched(df, column, value):
        hit = df.groupBy(F.spark_partition_id().alias("p")).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
        return hit.filter((F.col("lo") <= value) & (F.col("hi") >= value)).count()
    z = X.zorder(t.lineitem, ["l_partkey", "l_quantity"], 16).cache()
    plain = t.lineitem.repartition(16).cache()
    for column, value in (("l_partkey", 57), ("l_quantity", 13)):
        assert touched(z, column, value) <= touched(plain, column, value) * 0.7


def test_whole_checkpoints():
    n = "{:020d}.checkpoint".format
    listed = [f"{n(3)}.parquet", f"{n(5)}.{1:010d}.{2:010d}.parquet", f"{n(5)}.{2:010d}.{2:010d}.parquet", f"{n(7)}.{1:010d}.{2:010d}.parquet",
              f"{n(9)}.{1:010d}.{2:010d}.parquet", f"{n(9)}.parquet", "_last_checkpoint", f"{0:020d}.json"]
    found = T.whole_checkpoints(listed)
    assert sorted(found) == [3, 5, 9] and len(found[5]) == 2 and found[9] == [f"{n(9)}.parquet"]


def test_a_gap_in_the_log_is_told(spark, tmp_path):
    folder = tmp_path / "t" / "_delta_log"
    folder.mkdir(parents=True)
    for v in (0, 1, 3):
        (folder / f"{v:020d}.json").write_text('{"add": {"path": "a%d", "size": %d}}\n' % (v, v))
    with pytest.raises(ValueError, match="missing"):
        T.replay(spark, str(tmp_path))
    (folder / f"{2:020d}.json").write_text('{"remove": {"path": "a0"}}\n{"add": {"path": "a1", "size": 7}}\n')
    assert rows(S.active_files(T.file_actions(T.replay(spark, str(tmp_path)))), "path", "size") == [("a1", 7), ("a3", 3)]
    assert T.snapshot(spark, str(tmp_path), "t", str(tmp_path / "own")) == 3
    for v in range(4):
        (folder / f"{v:020d}.json").unlink()
    (folder / f"{4:020d}.json").write_text('{"remove": {"path": "a3"}}\n')
    assert rows(S.active_files(T.file_actions(T.replay(spark, str(tmp_path), str(tmp_path / "own")))), "path", "size") == [("a1", 7)]
    assert T.snapshot(spark, str(tmp_path), "t", str(tmp_path / "own")) == 4
