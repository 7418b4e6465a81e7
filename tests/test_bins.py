"""Packing of small files."""

import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.operators import fixes as X


def plain(sizes, target):
    """First fit, largest first, bin after bin."""
    bins, filled = [None] * len(sizes), []
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        size = min(sizes[k], target)
        b = next((b for b, f in enumerate(filled) if f + size <= target), len(filled))
        if b == len(filled):
            filled.append(0)
        filled[b] += size
        bins[k] = b
    return bins


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=60), st.integers(1, 25))
def test_first_fit(sizes, target):
    assert X.first_fit(sizes, target) == plain(sizes, target)


def check(spark, sizes, target, in_task):
    files = spark.createDataFrame([(f"t{k % 2}", f"f{k}", s) for k, s in enumerate(sizes)], "table_name string, path string, size bigint")
    rows = X.compact_bins(files, target, target, in_task).collect()
    assert len({(r.table_name, r.path) for r in rows}) == len(rows)
    for t in ("t0", "t1"):
        own = [s for k, s in enumerate(sizes) if f"t{k % 2}" == t and s < target]
        filled = {}
        for r in rows:
            if r.table_name == t:
                filled.setdefault(r.bin, []).append(r.size)
        assert all(sum(b) <= target and len(b) > 1 for b in filled.values())
        n_bins = len(filled) + len(own) - sum(map(len, filled.values()))
        assert n_bins <= 1.25 * math.ceil(sum(own) / target) + 1
        for r in rows:
            if r.table_name == t:
                assert (r.n_files, r.total_bytes) == (len(filled[r.bin]), sum(filled[r.bin]))


def test_bins_in_one_and_many_groups(spark):
    r = random.Random(4)
    sizes = [r.choice([1, 5, 20, 39]) * r.randrange(1, 3) for _ in range(900)] + [200, 150, 100]
    check(spark, sizes, 100, 100_000)
    check(spark, sizes, 100, 40)
    check(spark, [], 100, 10)
    check(spark, [0, 0, 99, 1], 100, 10)
