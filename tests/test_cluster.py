"""Rank buckets, the curve and what files a box touches."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import fixes as X
from plumbline.operators import statistics as ST


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (1, 4), (2, 1)])
def test_the_curve_visits_neighbours(spark, dims, bits):
    names = [f"b{k}" for k in range(dims)]
    points = list(itertools.product(range(1 << bits), repeat=dims))
    df = spark.createDataFrame(points, ", ".join(f"{n} int" for n in names))
    rows = X.with_hilbert_index(df, names, bits, "place").orderBy("place").collect()
    assert [r.place for r in rows] == list(range(len(points)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[n] - b[n]) for n in names) == 1


def test_rank_buckets_of_any_type(spark):
    r = random.Random(2)
    data = [(r.choice(["a", "b", "c", "zz", "é"]) + str(r.randrange(50)), dt.datetime(2020, 1, 1) + dt.timedelta(hours=r.randrange(9999)), r.random() if r.random() < 0.9 else None) for _ in range(800)]
    df = spark.createDataFrame(data, "s string, t timestamp_ntz, x double")
    out = X.with_rank_buckets(df, {"s": "_s", "t": "_t", "x": "_x"}, 3).collect()
    for column, bucket in (("s", "_s"), ("t", "_t"), ("x", "_x")):
        key = (lambda r: r[column].encode()) if column == "s" else (lambda r: r[column])
        own = sorted((r for r in out if r[column] is not None), key=key)
        assert [r[bucket] for r in own] == sorted(r[bucket] for r in own)
        sizes = [sum(r[bucket] == k for r in own) for k in range(8)]
        assert max(sizes) <= 2 * len(own) / 8 and all(r[bucket] == 0 for r in out if r[column] is None)
    assert X.with_rank_buckets(df.filter("false"), {"s": "_s"}, 3).count() == 0


def test_rows_stay_and_boxes_touch_fewer_files(spark, tmp_path):
    df = spark.range(4000).select(F.col("id"), F.concat(F.lit("k"), F.lpad(F.pmod(F.xxhash64("id"), F.lit(1000)).cast("string"), 4, "0")).alias("s"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)).alias("n"))
    df.repartition(16).write.parquet(str(tmp_path / "a"))
    X.write_copy(X.cluster(df, ["s", "n"], 16), str(tmp_path / "b"))
    box = {"s": ("k0100", "k0200"), "n": (100, 200)}
    before, after = (ST.files_touched(spark, str(tmp_path / p), box).first() for p in "ab")
    assert before == (16, 16) and after.n_touched <= 4
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.exceptAll(df).count() == 0 and back.count() == 4000
