"""References and keys found in the data, against all pairs tried one by one."""

import itertools
import random
from decimal import Decimal

from pyspark.sql import functions as F

from plumbline.operators import discovery as D
from plumbline.plans.estate import REFERENCES
from plumbline.plans.integrity import fk_discovery

from conftest import rows


def frames(spark, seed):
    r = random.Random(seed)
    parent = [(k, f"n{k % 7}", float(k), "x" * 70 if k == 3 else f"t{k}") for k in range(30)]
    child = [(r.randrange(30), f"n{r.randrange(9)}", float(r.randrange(40)), f"t{r.randrange(30)}", None) for _ in range(80)]
    other = [(Decimal(k), None if k % 5 else k) for k in range(0, 60, 2)]
    return {
        "parent": spark.createDataFrame(parent, "a_key bigint, a_name string, a_size double, a_text string"),
        "child": spark.createDataFrame(child, "b_key int, b_name string, b_size double, b_text string, b_none string"),
        "other": spark.createDataFrame(other, "c_key decimal(10,2), c_size int")}


def wanted(tables, threshold, same_stem):
    values = {(t, c): [r[c] for r in df.collect() if r[c] is not None] for t, df in tables.items() for c in df.columns}
    out = []
    for (ct, c), (pt, p) in itertools.permutations(values, 2):
        child, parent = values[ct, c], values[pt, p]
        text = [isinstance(v[0], str) if v else None for v in (child, parent)]
        if ct == pt or not child or not parent or text[0] != text[1] or same_stem and c[2:] != p[2:]:
            continue
        if text[0] and max(map(len, child + parent)) > D.KEY_TEXT or not text[0] and any(v != int(v) for v in child + parent):
            continue
        share = len(set(child) & set(parent)) / len(set(child))
        if len(set(parent)) == len(parent) and share >= threshold and share > 0:
            out.append((ct, c, pt, p, len(set(child)), len(set(child) & set(parent)), len(set(parent)), round(share, 4)))
    return sorted(out, key=repr)


def test_references_by_all_pairs(spark, monkeypatch):
    tables = frames(spark, 4)
    for threshold, same in ((0.5, True), (0.01, False)):
        assert rows(D.references(tables, threshold, same)) == wanted(tables, threshold, same)
    monkeypatch.setattr(D, "WORD", 4)  # sets of columns over several words
    assert rows(D.references(tables, 0.01, False)) == wanted(tables, 0.01, False)


def test_the_known_references_are_found(t):
    found = {tuple(r[c] for c in ("child_table", "child_column", "parent_table", "parent_column")) for r in fk_discovery(t).collect()}
    named_alike = {r for r in REFERENCES if r[1][2:] == r[3][2:] or r[1] == r[3]}
    assert len(named_alike) == 8 and named_alike <= found


def test_one_scan_a_table(t):
    plan = D.references(t.pick(["orders", "customer", "nation"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") - plan.count("ReusedExchange") <= 3 * 3  # before reuse each branch is shown once
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def minimal(data, names, most):
    found = []
    for n in range(1, most + 1):
        for s in itertools.combinations(range(len(names)), n):
            if any(set(u) <= set(s) for u in found) or any(r[k] is None for r in data for k in s):
                continue
            if data and len({tuple(r[k] for k in s) for r in data}) == len(data):
                found.append(s)
    return sorted(", ".join(names[k] for k in s) for s in found)


def test_unique_sets_by_all_combinations(spark):
    r = random.Random(2)
    names = ["a", "b", "c d", "e", "f"]
    for size in (0, 1, 7, 60):
        data = [(r.randrange(6), r.randrange(6), str(r.randrange(4)), None if r.random() < 0.1 else k, float(r.randrange(3))) for k in range(size)]
        df = spark.createDataFrame(data, "a int, b int, `c d` string, e int, f double") if data else spark.createDataFrame([], "a int, b int, `c d` string, e int, f double")
        data = [tuple(x) for x in df.collect()]
        assert sorted(x.columns for x in D.unique_column_sets(df, 4).collect()) == minimal(data, names, 4)


def test_a_pair_and_no_superset(t):
    from plumbline.plans.integrity import unique_lines
    found = {r.columns for r in D.unique_column_sets(unique_lines(t), 3, ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag"]).collect()}
    assert "l_orderkey, l_linenumber" in found and not any("l_orderkey" in f and "l_linenumber" in f and f.count(",") > 1 for f in found)


def test_hashes_only_point_to_equal_rows(spark, monkeypatch):
    r = random.Random(5)
    data = [(k, r.randrange(40), r.randrange(40), "2024-01-01 00:00:00.00000%d" % (k % 10)) for k in range(100)]
    df = spark.createDataFrame(data, "a int, b int, c int, t string").selectExpr("*", "cast(t as timestamp_ntz) + make_dt_interval(0, 0, 0, a div 10) as at").drop("t")
    names, data = df.columns, [tuple(x) for x in df.collect()]
    want = minimal(data, names, 2)
    assert "at" in want  # times that differ in microseconds alone
    assert sorted(x.columns for x in D.unique_column_sets(df, 2).collect()) == want
    monkeypatch.setattr(D, "_hash", lambda columns: F.xxhash64(F.col(f"`{columns[0]}`") if columns[0] == "a" else F.lit(1)))
    assert D._without_equal_rows(df, [("a",), ("b",), ("b", "c"), ("at",)]) == [(n,) if "," not in n else tuple(n.split(", ")) for n in ("a", "b", "b, c", "at") if len(set(map(tuple, df.select(*n.split(", ")).collect()))) == 100]


def test_one_hash_a_row_is_shuffled(spark):
    wide = spark.range(20_000).selectExpr("id div 2 as a", "id % 2 as b", *[f"id % 2 + {k} as c{k}" for k in range(9)], "sha2(string(id div 2), 512) as long")
    seen = []
    count = D._repeated
    D._repeated = lambda cells, value: seen.append(cells.count()) or count(cells, value)
    try:
        found = D.unique_column_sets(wide, 2).count()
        assert found == 2 * 10 and sum(seen) < 20_000  # digests of a part of the rows, not of each for every pair
        assert [x.columns for x in D.propose_keys({"wide": wide}).collect()] == ["a, b"]
    finally:
        D._repeated = count


def test_columns_without_a_partner_are_not_read(spark):
    from plumbline.operators import discovery as D

    a = spark.sql("select id as a_key, cast(id as string) as a_code, cast(id as double) / 2 as a_price from range(10)")
    b = spark.sql("select id as b_key, id as b_code, id as b_other, id as own_price from range(20)")
    found = D.references({"a": a, "b": b})
    assert [tuple(r) for r in found.collect()] == [("a", "a_key", "b", "b_key", 10, 10, 20, 1.0)]
    fields = [(t, f) for t, df in (("a", a), ("b", b)) for f in D._reference_fields(df)]
    assert [(t, f.name) for t, f in D._shared(spark, fields)] == [("a", "a_key"), ("b", "b_key")]
    assert D.references({"a": a.select("a_price"), "b": b.select("b_other")}).schema == found.schema
