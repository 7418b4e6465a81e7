"""Cases found in review: each failed before its operator was mended."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.operators import columns as C
from plumbline.operators import fixes as X
from plumbline.operators import graph as G
from plumbline.operators import integrity as I
from plumbline.operators import logs as L
from plumbline.operators import profile as P
from plumbline.operators import report as R
from plumbline.operators import spread as S
from plumbline.plans.audit import Inputs, collect_findings, run_audit
from plumbline.session import cut_lineage


@pytest.mark.parametrize("mode", ["exact", "hybrid"])
def test_large_unique_key_is_unique(spark, mode):
    profile = P.column_profile({"big": spark.range(200_000)}, mode)
    assert rows(I.key_candidates(profile), "n_distinct", "is_unique") == [(200_000, True)]


def test_small_and_large_values_keep_their_digits(spark):
    tiny = spark.createDataFrame([(1e-7, 1e15), (1.0, 3e15)], "a double, b double")
    profile = P.column_profile({"t": tiny})
    assert rows(C.odd_binary(profile), "column_name", "min_value") == [("a", "1.0E-7"), ("b", "1000000000000000.000000")]
    means = tiny.agg(L.exact_mean("a").alias("a"), L.exact_mean("b").alias("b")).first()
    assert means.a == pytest.approx(0.50000005) and means.b == 2e15
    small = spark.createDataFrame([(0.00001,), (0.00003,)], "x double")
    assert small.agg(L.exact_mean("x")).first()[0] == pytest.approx(0.00002)
    huge = spark.createDataFrame([(1e30,), (3e30,), (None,)], "x double")
    assert huge.agg(L.exact_mean("x")).first()[0] == 2e30


def test_excess_keeps_what_other_groups_keep(spark):
    df = spark.createDataFrame([("a", m) for m in "xyz"] + [("b", m) for m in "wxyz"] + [("c", "x")] * 4, "g string, m string")
    assert rows(X.excess_rows(df, ["g"], "m", 2)) == [("a", "z"), ("b", "y"), ("b", "z"), ("c", "x"), ("c", "x")]


def test_ties_go_by_the_other_columns(spark):
    df = spark.createDataFrame([("a", 1, v) for v in "qzbd"], "g string, o int, v string")
    assert {tuple(rows(X.dedup_records(df.repartition(k), ["g"], "o"), "v")) for k in (1, 2, 3)} == {(("b",),)}
    assert rows(X.trim_members(df, ["g"], "o", 2), "v") == [("b",), ("d",)]


def test_whole_names_are_replaced(spark):
    triaged = spark.createDataFrame([("v", "d1", "d10 | join d1 | d1x", "source missing")], "name string, source_table string, query string, state string")
    matches = spark.createDataFrame([("v", "n$1", 1.0)], "name string, new_source string, score double")
    assert rows(X.repair_view_source(triaged, matches), "new_query") == [("d10 | join n$1 | d1x",)]


def test_versions_of_fewer_parts(spark):
    df = spark.createDataFrame([("10",), ("9",), ("10.0.1",), ("9.9",)], "v string")
    assert rows(G.version_check(df, "v", (10, 0))) == [("9",), ("9.9",)]


def test_types_of_references(spark):
    child = spark.createDataFrame([(1.0,), (2.5,)], "c double")
    parent = spark.createDataFrame([(1,), (2,)], "p int")
    assert rows(I.fk_discovery([("a", child, "c", "b", parent, "p")]), "containment") == [(0.5,)]


@pytest.mark.parametrize("keep", [True, False])
def test_a_hot_key_of_a_membership_filter_is_split(spark, keep):
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
                                           "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "32k")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
        rows_ = cut_lineage(spark.range(60_000).repartition(8).select(F.when(F.col("id") % 5 > 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.uuid().alias("pad")))
        out = S.keyed_filter(rows_, cut_lineage(spark.range(3000).select(F.col("id").alias("m"))), [("k", "m")], keep)
        out.write.format("noop").mode("overwrite").save()
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def edges(spark, n_both):
    return spark.createDataFrame([(f"a{i}", f"b{i}", "both" if i < n_both else "single", "true", "none") for i in range(8)],
                                 "src string, dst string, cross_filter string, is_active string, summarize_by string")


@pytest.mark.parametrize("n_both,status", [(0, "PASS"), (2, "WARN"), (6, "FAIL")])
def test_bidirectional_edges_have_three_outcomes(spark, n_both, status):
    out = run_audit({"t": spark.range(3)}, inputs=Inputs(edges=edges(spark, n_both)))
    assert rows(out.filter("rule_id = 'SM-021'"), "status", "n_issues") == [(status, n_both)]


@pytest.mark.parametrize("ms,status", [(1000.0, "PASS"), (8000.0, "WARN"), (40_000.0, "FAIL")])
def test_recent_health_has_three_outcomes(spark, ms, status):
    log = spark.createDataFrame([("q", "select", "c", "d", "2024-01-30 00:00:00", ms, "Succeeded")],
                                "query_id string, query_text string, command_type string, database string, start_time string, elapsed_ms double, status string")
    log = log.withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
    out = run_audit({"t": spark.range(3)}, inputs=Inputs(query_log=log, as_of="2024-01-31 00:00:00"))
    assert rows(out.filter("rule_id = 'WH-039'"), "status") == [(status,)]


def test_orphans_are_counted_and_few_tables_tell_nothing(spark):
    child = spark.createDataFrame([(1,), (8,), (8,), (9,)], "p_id int")
    parent = spark.createDataFrame([(1,)], "id int")
    inp = Inputs(tables={"c": child, "p": parent}, references=[("c", "p_id", "p", "id")])
    found, absent, _ = collect_findings(inp)
    assert rows(found.filter("rule_id = 'WH-009'"), "target") == [("c[p_id]",)] and "WH-014" in absent


def test_findings_are_read_from_what_was_written(spark):
    found, _, _ = collect_findings(Inputs(tables={"t": spark.range(3)}))
    plan = R.offender_sample(found)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan


def test_catalog_rules_fire_and_pass(spark):
    made = lambda rows_, schema: spark.createDataFrame(rows_, schema)
    day = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    inp = Inputs(
        tables={"t": made([(1, "x@y.z", 2)], "id int, email string, c_id int"), "u": made([(1,)], "id int")}, references=[("t", "c_id", "u", "id")],
        masked=made([("u", "email")], "table_name string, column_name string"),
        failures=made([("store",)], "entity string").withColumn("ts", day),
        catalog=made([("t", "Delta"), ("u", "csv"), ("v", None)], "table_name string, format string"),
        statistics=made([("t",)], "table_name string").withColumn("updated", F.lit("2023-11-01").cast("timestamp_ntz")),
        dependencies=made([("v", f"t{i}", "a", "b" if i == 3 else "a") for i in range(12)], "src string, dst string, src_schema string, dst_schema string"),
        documented=made([("procedure", "p", " "), ("schema", "s", "has one"), ("measure", "m", None)], "kind string, name string, description string"),
        defaults=made([("t", "id", "false", None), ("t", "email", "true", None)], "table_name string, column_name string, is_nullable string, default_value string"),
        computed=made([("t", "c_id")], "table_name string, column_name string"), indexed=made([("t", "id")], "table_name string, column_name string"),
        streamed=made([("t",)], "table_name string"), volumes=made([("t", 5, 1), ("big", 2_000_000, 2_000_000)], "table_name string, n_rows long, n_hot long"),
        exports=made([("e", "true", "true"), ("f", "true", "false")], "name string, is_running string, is_disabled string"),
        extents=made([("w", 10, 10**9, 9 * 10**8), ("z", 10, 10**9, 9 * 10**8)], "table_name string, n_rows long, original_bytes long, compressed_bytes long"),
        encoded=made([("z",)], "table_name string"), functions=made([("f",)], "name string"), levels=made([("h",), ("h",), ("k",)] + [("l",)] * 3, "hierarchy string"),
        store_name="sales", as_of="2024-01-31 00:00:00")
    found, absent, errors = collect_findings(inp)
    targets = {}
    for r in found.collect():
        targets.setdefault(r.rule_id, set()).add(r.target)
    want = {
        "WH-018": {"t[email]"}, "EH-010": {"store"}, "LH-003": {"u", "v"}, "LH-002": {"sales"}, "WH-008": {"t"}, "WH-032": {"u"},
        "WH-021": {"v"}, "WH-022": {"v t3"}, "WH-035": {"p"}, "WH-036": {"t[id]"}, "SM-008": {"m"}, "WH-042": {"t"}, "WH-044": {"t[c_id]"},
        "EH-011": {"t"}, "EH-024": {"big"}, "EH-013": {"t"}, "EH-012": {"e"}, "EH-018": {"w"}, "EH-020": {"f"}, "SM-029": {"h", "k"}}
    assert {k: targets.get(k) for k in want} == want
    assert errors == {} and "WH-038" not in targets and not set(want) & set(absent)


def test_replay_from_a_checkpoint(spark, tmp_path):
    """Commits 0 to 2 are gone; the checkpoint of version 2 holds what they left."""
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    from plumbline.operators.storage import active_files
    from plumbline.sources import txlog

    log = tmp_path / "sales" / "_delta_log"
    log.mkdir(parents=True)
    state = [{"add": {"path": p, "size": 10, "modificationTime": 0}} for p in ("a", "b", "c")]
    pq.write_table(pa.Table.from_pylist(state), log / "00000000000000000002.checkpoint.parquet")
    (log / "00000000000000000003.json").write_text(json.dumps({"remove": {"path": "b", "deletionTimestamp": 1}}) + "\n" + json.dumps({"add": {"path": "d", "size": 5, "modificationTime": 2}}))
    whole = txlog.read_whole_log(spark, str(tmp_path))
    assert rows(active_files(txlog.file_actions(whole)), "path", "size") == [("a", 10), ("c", 10), ("d", 5)]
    commits_only = txlog.read_log(spark, f"{tmp_path}/*/_delta_log/*.json")
    assert rows(active_files(txlog.file_actions(commits_only)), "path") == [("d",)]


@pytest.mark.parametrize("fine", [1, 7, 4096])
def test_percentile_of_a_narrow_range(spark, fine):
    import numpy as np

    values = np.random.default_rng(3).random(3000) / 1000 + 1
    df = spark.createDataFrame([(int(i % 3 == 0), float(v)) for i, v in enumerate(values)], "g int, v double")
    got = {r.g: r.q for r in S.exact_percentile(df, ["g"], "v", 0.95, "q", fine).collect()}
    for g in (0, 1):
        assert got[g] == pytest.approx(np.percentile([v for i, v in enumerate(values) if int(i % 3 == 0) == g], 95), abs=1e-12)


def counted(batch):
    return batch.groupBy("k", "day").agg(F.count(F.lit(1)).alias("n"))


def test_view_writes_what_a_batch_touches(spark, tmp_path):
    import os

    from plumbline.streaming import jobs as J

    state = str(tmp_path / "view")
    handle = J.merge_view(state, "day", ["k", "day"], ["n"], counted)

    def batch(*days):
        return spark.createDataFrame([(k, d) for d in days for k in "ab"], "k string, day string")

    handle(batch(*"uvwxyz", None), 0)
    before = J.manifest(spark, state, 0)
    handle(batch("x"), 1)
    after = J.manifest(spark, state, 1)
    assert [d for d in after if after[d] != before[d]] == ["x"] and len(after) == 7
    assert sum(n.startswith("_part") for n in os.listdir(f"{state}/batch=1")) == 1  # one day was written
    handle(batch("x"), 1)  # a repeated batch changes nothing
    assert rows(J.newest_view(spark, state).filter("day = 'x'"), "k", "n") == [("a", 2), ("b", 2)]
    # a batch that was half written: files without a manifest
    spark.createDataFrame([("a", "y", 99)], "k string, day string, n bigint").withColumn("_part", F.lit("half")).write.partitionBy("_part").parquet(f"{state}/batch=2")
    assert rows(J.newest_view(spark, state), "n") == [(1,)] * 12 + [(2,)] * 2
    handle(batch("y", None), 2)
    handle(batch("w"), 3)
    assert J.manifests(spark, state) == [2, 3]
    want = {None: 2, "u": 1, "v": 1, "w": 2, "x": 2, "y": 2, "z": 1}
    assert rows(J.newest_view(spark, state)) == sorted([(k, d, n) for d, n in want.items() for k in "ab"], key=repr)


def test_view_of_an_empty_batch(spark, tmp_path):
    from plumbline.streaming import jobs as J

    state = str(tmp_path / "view")
    handle = J.merge_view(state, "day", ["k", "day"], ["n"], counted)
    handle(spark.createDataFrame([("a", "x")], "k string, day string"), 0)
    handle(spark.createDataFrame([], "k string, day string"), 1)
    assert J.manifests(spark, state) == [0, 1] and rows(J.newest_view(spark, state)) == [("a", "x", 1)]
