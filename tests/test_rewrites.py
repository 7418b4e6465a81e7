"""Calls found by their parentheses."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.operators import fixes as X

from conftest import rows


def plain(text, name):
    """Calls of ``name`` unwrapped, by walking the text; quotes and brackets are skipped."""
    tokens = re.findall(rf"(?is)'[^']*'|\"[^\"]*\"|\[[^\]]*\]|(?<!\w){name}\s*\(\s*|\w+|.", text)

    def walk(k, call):
        """(written as it is, rewritten arguments, place behind the end or None)."""
        args = [""]
        while k < len(tokens):
            t = tokens[k]
            opened = bool(re.fullmatch(rf"(?is){name}\s*\(\s*", t))
            if t == "(" or opened:
                inner, end = walk(k + 1, opened)
                if end is None:
                    return [*args[:-1], args[-1] + t + ",".join(inner) if opened else args[-1] + t + inner[0]], None
                args[-1] += inner[0].strip(" ") if opened else t + inner[0] + ")"
                k = end
                continue
            if t == ")" and call is not None:
                return args, k + 1
            if t == "," and call:
                args.append("")
            else:
                args[-1] += t
            k += 1
        return args, None if call is not None else k

    return walk(0, None)[0][0]


TEXTS = ["LOG(SUM(a)) + 1", "LOG(SUM(a)) + SUM(b)", "1 + log ( LOG( x , 2), 3 )", "LOG(", ")LOG(x))", "(LOG(a", 'LOG(")") & "LOG(x)"', "[LOG(] + LOG([)])", "BLOG(x)", "LOG(LOG(LOG((1))))",
         "LOG()", "", "a, b", "LOG(a,(b,c),d),e", "x" * 3000, "LOG(" * 40 + "1" + ")" * 40 + "+2", "LOG('it''s)', 1)"]


def unwrapped(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    out = df.withColumn("r", X.rewrite_calls(F.col("t"), {"LOG": lambda args: F.element_at(args, 1)}))
    return [r.r for r in out.orderBy("id").collect()]


def test_calls_of_any_depth(spark):
    texts = [*TEXTS, None]
    assert unwrapped(spark, texts) == [plain(t, "LOG") if t is not None else None for t in texts]
    assert unwrapped(spark, TEXTS[:2]) == ["SUM(a) + 1", "SUM(a) + SUM(b)"]


def test_random_calls(spark):
    found = []

    @settings(max_examples=400, database=None, derandomize=True)
    @given(st.lists(st.sampled_from(["LOG(", "log (", "(", ")", ",", "a", " ", "'(", "'", "[", "]", '"', "f("]), max_size=16))
    def collect(parts):
        found.append("".join(parts))

    collect()
    assert unwrapped(spark, found) == [plain(t, "LOG") for t in found]


def test_error_guards(spark):
    df = spark.createDataFrame([("IFERROR(a)",), ("IFERROR(f(x, y), IFERROR(b, c)) + d",), ("IFERROR(a, b, c)",)], "t string")
    assert rows(X.rewrite_expressions(df, "t", ["SM-FIX-IFERROR"]), "rewritten", "is_changed") == sorted([
        ("IFERROR(a)", False), ("IF(ISERROR(f(x, y)), IF(ISERROR(b), c, b), f(x, y)) + d", True), ("IFERROR(a, b, c)", False)], key=repr)


def test_files_grow_in_number_and_not_in_size(spark, tmp_path, t, monkeypatch):
    from plumbline.plans import QUERIES
    from plumbline.operators import fixes as X
    assert X.files_for(spark.range(10), 8, 100) == 8 and X.files_for(spark.range(10_001), 8, 100) == 101
    written = {}
    monkeypatch.setattr(X.files_for, "__defaults__", (100,))
    for name in ("zorder_rewrite", "compact_by_bins", "statistics_store"):
        copy, write = X.write_copy, type(t.lineitem.write).parquet
        monkeypatch.setattr(type(t.lineitem.write), "parquet", lambda w, path, *a, **k: (written.setdefault(name, []).append(w._df.rdd.getNumPartitions()), write(w, path, *a, **k))[1])
        QUERIES[name](spark, t.root).count()
        monkeypatch.setattr(type(t.lineitem.write), "parquet", write)
    few = t.lineitem.rdd.getNumPartitions()
    assert max(written["zorder_rewrite"]) > 8 and max(written["compact_by_bins"]) > 24 and min(written["statistics_store"][:2]) >= few


def test_copies_are_written_side_by_side(spark, tmp_path):
    import threading

    from plumbline.plans.apply import apply_plan

    both = threading.Barrier(2, timeout=60)

    def waits(df, table, cols):
        both.wait()  # breaks, if copies come one after the other
        return df

    tables = {"a": spark.range(3), "b": spark.range(5)}
    plan = spark.createDataFrame(
        [("f", "r", "a", "transform:waits", True), ("f", "r", "b", "transform:waits", True), ("g", "r", "a", "transform:once", True),
         ("g", "r", "b[x,y]", "transform:once", True), ("g", "r", "b[x, y]", "transform:once", True)],
        "fix_id string, rule_id string, target string, command string, is_transform boolean")
    done = apply_plan(spark, plan, tables, str(tmp_path / "out"), {"waits": waits, "once": lambda df, table, cols: df}).collect()
    assert sorted(r.outcome for r in done) == ["failed", "fixed", "fixed", "fixed", "fixed"]  # one path can be written once
    assert {r.path.rsplit("out/", 1)[1]: spark.read.parquet(r.path).count() for r in done if r.path} == {"f/a": 3, "f/b": 5, "g/a": 3, "g/b.x.y": 5}
