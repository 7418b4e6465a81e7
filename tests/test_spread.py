"""Skew-safe building blocks against brute force."""

import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from plumbline.operators import spread as S


@pytest.fixture(scope="module")
def hot(spark):
    """2000 rows, a third of them under one key, with repeated values."""
    rng = random.Random(7)
    data = [(("hot" if i % 3 == 0 else f"k{rng.randrange(40)}"), i, float(rng.choice([rng.randrange(50), rng.uniform(-5, 900)])),
             rng.choice("abc")) for i in range(2000)]
    return data, spark.createDataFrame(data, "k string, i long, v double, c string").cache()


def test_running_sum(hot):
    data, df = hot
    got = {r.i: r.s for r in S.chunked_running_sum(
        df.withColumn("n", F.col("i") % 7), ["k"], ["i"], "n", F.expr("i div 100"), "s").collect()}
    totals, want = {}, {}
    for k, i, _, _ in sorted(data, key=lambda r: r[1]):
        totals[k] = totals.get(k, 0) + i % 7
        want[i] = totals[k]
    assert got == want


def test_neighbour_pairs(hot):
    data, df = hot
    want, last = {}, {}
    for k, i, _, c in sorted(data, key=lambda r: r[1]):
        if k in last:
            want[(last[k], c)] = want.get((last[k], c), 0) + 1
        last[k] = c
    got = S.chunked_pairs(df, "k", ["i"], "c", F.expr("i div 50"))
    assert {(r.src, r.dst): r.n for r in got.collect()} == want


def test_neighbour_pairs_with_single_row_chunks(hot):
    data, df = hot
    one = S.chunked_pairs(df, "k", ["i"], "c", F.col("i"))
    many = S.chunked_pairs(df, "k", ["i"], "c", F.lit(0))
    assert rows(one) == rows(many)


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.95, 1.0])
def test_percentile_per_group(hot, p):
    data, df = hot
    got = {r.k: r.q for r in S.exact_percentile(df, ["k"], "v", p, "q").collect()}
    for k in {r[0] for r in data}:
        want = np.percentile([r[2] for r in data if r[0] == k], p * 100)
        assert got[k] == pytest.approx(want, abs=1e-9)


def test_percentile_overall_and_nulls(spark, hot):
    data, df = hot
    more = df.unionByName(spark.createDataFrame([("n", 1, None, "a"), ("n", 2, float("nan"), "a")], df.schema))
    got = S.exact_percentile(more, [], "v", 0.9, "q").collect()
    assert len(got) == 1
    assert got[0].q == pytest.approx(np.percentile([r[2] for r in data], 90), abs=1e-9)


def test_top_per_group_limits_before_the_shuffle(hot):
    data, df = hot
    top = S.top_per_group(df, ["k"], [F.desc("v"), F.asc("i")], 3)
    want = []
    for k in {r[0] for r in data}:
        want += sorted([r for r in data if r[0] == k], key=lambda r: (-r[2], r[1]))[:3]
    assert rows(top) == sorted(want, key=repr)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("WindowGroupLimit") == 2  # before and after the shuffle


def test_keyed_filter(hot, spark):
    data, df = hot
    members = spark.createDataFrame([("hot",), ("hot",), ("k1",)], "m string")
    kept = S.keyed_filter(df, members, [("k", "m")])
    dropped = S.keyed_filter(df, members, [("k", "m")], keep=False)
    assert kept.count() == sum(r[0] in ("hot", "k1") for r in data)
    assert kept.count() + dropped.count() == len(data)


def test_words_of_candidates_are_never_sent(t, monkeypatch):
    from plumbline.operators import spread, text
    pairs = text.overlap_pairs(t.benchmark, "item_id", t.documents, "doc_id")
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [candidate_id" in plan and "BroadcastHashJoin [candidate_id" not in plan
    want = rows(pairs)
    monkeypatch.setattr(spread.sent_or_merged, "__defaults__", (0,))  # and none of the texts
    assert "Broadcast" not in (merged := text.overlap_pairs(t.benchmark, "item_id", t.documents, "doc_id"))._jdf.queryExecution().sparkPlan().toString()
    assert rows(merged) == want
