"""Profiles and the rules over them, at and around every limit."""

import datetime as dt
import decimal

import pytest
from conftest import rows
from pyspark.sql import types as T

from plumbline.operators import columns as C
from plumbline.operators import profile as P
from plumbline.sources.facts import column_facts

PROFILE = ("table_name string, column_name string, kind string, n_rows long, n_nulls long, n_distinct long, "
           "min_value string, max_value string, max_len long")


def profile(spark, *cells):
    """(table, column, kind, distinct, min, max, longest)"""
    return spark.createDataFrame([(t, c, k, 100, 0, d, lo, hi, n) for t, c, k, d, lo, hi, n in cells], PROFILE)


def names(df):
    return sorted(r[1] if "column_name" in df.columns else r[0] for r in (
        df.select("table_name", "column_name") if "column_name" in df.columns else df.select("table_name")).collect())


def test_exact_profile_of_every_type(spark):
    df = spark.createDataFrame(
        [(1, 1.5, "a", True, dt.date(2024, 1, 1), decimal.Decimal("1.10"), [1]),
         (1, None, "b" * 70, None, dt.date(2024, 1, 2), decimal.Decimal("1.10"), None),
         (2, 2.5, None, False, None, None, [2]),
         (None, 1.5, "b" * 70, True, dt.date(2024, 1, 1), decimal.Decimal("2.20"), [])],
        "i int, d double, s string, b boolean, x date, m decimal(10,2), nested array<int>")
    got = {r.column_name: r for r in P.column_profile({"f": df}).collect()}
    assert set(got) == {"i", "d", "s", "b", "x", "m"}
    assert [(got[c].n_nulls, got[c].n_distinct) for c in "idsbxm"] == [(1, 2), (1, 2), (1, 2), (1, 2), (1, 2), (1, 2)]
    assert got["s"].max_len == 70 and got["i"].max_len == 0
    assert got["d"].min_value == "1.500000" and got["x"].max_value == "2024-01-02 00:00:00.000000"
    assert [got[c].kind for c in "idsbxm"] == ["number", "number", "string", "bool", "date", "number"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "i int, s string")
    got = P.column_profile({"empty": df}).collect()
    assert [(r.n_rows, r.n_nulls, r.n_distinct, r.min_value, r.max_len) for r in got] == [(0, 0, 0, None, 0)] * 2


def test_quotes_and_spaces_in_names(spark):
    df = spark.createDataFrame([(1, "x")], "`it's` int, `a b` string")
    got = P.column_profile({"o'table": df}).collect()
    assert sorted((r.table_name, r.column_name, r.n_distinct) for r in got) == [("o'table", "a b", 1), ("o'table", "it's", 1)]


def test_modes_agree(t):
    tables = t.pick(["orders", "events"])
    exact = {(r.table_name, r.column_name): r.n_distinct for r in P.column_profile(tables).collect()}
    approx = {(r.table_name, r.column_name): r.approx_distinct for r in P.column_profile(tables, "approx").collect()}
    hybrid = {(r.table_name, r.column_name): r.n_distinct for r in P.column_profile(tables, "hybrid").collect()}
    for key, n in exact.items():
        assert approx[key] == pytest.approx(n, rel=0.06)
    assert hybrid == exact
    assert "n_distinct" not in P.column_profile(tables, "approx").columns
    with pytest.raises(ValueError):
        P.column_profile(tables, "guess")


def test_low_cardinality_limits(spark):
    p = profile(spark, ("t", "key", "number", 10001, "0", "9", 0), ("t", "two", "string", 2, "a", "b", 5),
                ("t", "three", "string", 3, "a", "b", 5), ("t", "twenty", "string", 20, "a", "b", 50),
                ("t", "many", "string", 21, "a", "b", 5), ("t", "long", "string", 5, "a", "b", 51))
    assert names(C.low_card_in_fact(p)) == ["three", "twenty"]
    at_limit = profile(spark, ("t", "key", "number", 10000, "0", "9", 0), ("t", "three", "string", 3, "a", "b", 5))
    assert names(C.low_card_in_fact(at_limit)) == []


def test_guid_lengths(spark):
    p = profile(spark, *[("t", f"guid{n}", "string", 1001, "a", "b", n) for n in (31, 32, 40, 41)],
                ("t", "guid_few", "string", 1000, "a", "b", 36), ("t", "other", "string", 5000, "a", "b", 36))
    assert names(C.guid_columns(p)) == ["guid32", "guid40"]


def test_text_rules(spark):
    p = profile(spark, ("t", "note", "string", 101, "a", "b", 201), ("t", "note_at", "string", 100, "a", "b", 201),
                ("t", "memo", "string", 101, "a", "b", 200), ("u", "big", "string", 20000, "a", "b", 101),
                ("u", "bigger", "number", 28000, "0", "9", 0), ("v", "near", "string", 20000, "a", "b", 101),
                ("v", "max", "number", 30000, "0", "9", 0))
    assert names(C.free_text_columns(p)) == ["note"]
    assert names(C.high_card_text(p)) == ["big"]


def test_typed_text_rules(spark):
    p = profile(spark, ("t", "flag", "string", 2, "No", "Yes", 3), ("t", "flag_n", "number", 2, "0", "1", 0),
                ("t", "pair", "string", 2, "a", "b", 1), ("t", "created", "string", 9, "2024-01-01", "2024-02-01", 10),
                ("t", "created_7", "string", 9, "2024", "2025", 7), ("t", "amount", "string", 9, "1", "9.5", 3),
                ("t", "amount_x", "string", 9, "1", "x", 3), ("t", "amount_21", "string", 9, "1", "2", 21),
                ("t", "one", "string", 1, "a", "a", 1), ("t", "RowNumber", "number", 1, "1", "1", 0))
    assert names(C.bool_as_text(p)) == ["flag"]
    assert names(C.date_as_text(p)) == ["created"]
    assert names(C.number_as_text(p)) == ["amount"]
    assert names(C.constant_columns(p)) == ["one"]


def test_numeric_rules(spark):
    p = profile(spark, ("t", "row_key", "number", 2000, "0", "9", 0), ("t", "price", "number", 1901, "0", "9", 0),
                ("t", "cost", "number", 1900, "0", "9", 0), ("t", "bit", "number", 2, "0", "1", 0),
                ("t", "neg", "number", 2, "-1.000000", "0.000000", 0), ("t", "odd", "number", 2, "1", "3", 0))
    assert names(C.near_unique_numeric(p)) == ["price"]
    assert names(C.odd_binary(p)) == ["odd"]


def test_table_rules(spark):
    p = profile(spark, ("a", "name_key", "string", 1001, "a", "b", 9), ("b", "name_key", "string", 1001, "a", "b", 9),
                ("b", "id", "number", 1001, "0", "9", 0), ("c", "name_key", "string", 1000, "a", "b", 9))
    assert names(C.string_keys(p)) == ["a"]
    many = profile(spark, *[("t", f"c{i}", "string", 50001, "a", "b", 9) for i in range(6)],
                   *[("u", f"c{i}", "string", 50001, "a", "b", 9) for i in range(5)])
    assert names(C.many_high_card(many)) == ["t"]
    under = profile(spark, ("t", "_x", "string", 3, "a", "b", 1), ("t", "__y", "string", 3, "a", "b", 1))
    assert names(C.underscore_columns(under)) == ["_x"]


def wide(spark, table, n):
    return {table: spark.createDataFrame([], ", ".join(f"c{i} int" for i in range(n)))}


def test_wide_table_limits(spark):
    tables = {}
    for n in (1, 30, 31, 50, 51, 100, 101):
        tables.update(wide(spark, f"w{n}", n))
    got = {r.table_name: r.verdict for r in P.wide_tables(column_facts(tables)).collect()}
    assert got == {"w1": "single column", "w31": "over 30", "w50": "over 30", "w51": "over 50", "w100": "over 50", "w101": "over 100"}


def test_row_count_classes(spark):
    counts = spark.createDataFrame([("a", 0), ("b", 1), ("c", 10), ("d", 11), ("e", 1_000_000), ("f", 1_000_001)], "table_name string, n_rows long")
    assert [r.row_class for r in P.row_count_classes(counts).orderBy("table_name").collect()] == [
        "empty", "near-empty", "near-empty", "normal", "normal", "large"]


def test_nullable_share(spark):
    facts = spark.createDataFrame(
        [("six", f"c{i}", True) for i in range(6)] + [("five", f"c{i}", True) for i in range(5)]
        + [("ten", f"c{i}", i > 0) for i in range(10)], "table_name string, column_name string, is_nullable boolean")
    assert names(P.nullable_tables(facts)) == ["six"]


def test_declared_type_rules(spark):
    facts = column_facts({
        "mixed": spark.createDataFrame([], "a date, b timestamp, c string"),
        "plain": spark.createDataFrame([], "a date, b date, created_at timestamp"),
        "text": spark.createDataFrame([], T.StructType([
            T.StructField("a", T.StringType(), True, {"__CHAR_VARCHAR_TYPE_STRING": "varchar(501)"}),
            T.StructField("b", T.StringType(), True, {"__CHAR_VARCHAR_TYPE_STRING": "varchar(500)"}),
            T.StructField("d", T.StringType())])),
        "deep": spark.createDataFrame([], "a array<int>, b map<string,int>, c struct<x:int>")})
    assert rows(C.mixed_declared_types(facts), "table_name", "types") == [
        ("mixed", "date, timestamp"), ("plain", "date, timestamp"), ("text", "string, varchar")]
    assert names(C.declared_oversize(facts)) == ["a"]
    assert names(C.nested_types(facts)) == ["a", "b", "c"]
    assert "plain" not in names(C.audit_columns(facts)) and "mixed" in names(C.audit_columns(facts))


def test_mixed_formats_and_floats(spark):
    df = spark.createDataFrame([("1", "a"), ("2024-01-01", "b"), (None, "c"), ("1.5", "d")], "m string, s string")
    assert rows(C.mixed_formats(df, ["m", "s"]), "column_name", "shape", "n_rows", "n_shapes") == [
        ("m", "date", 1, 3), ("m", "decimal", 1, 3), ("m", "integer", 1, 3)]
    floats = spark.createDataFrame([(1.25, 0.001), (10.5, 1.0), (None, None)], "x double, y double")
    got = {r.column_name: (r.is_exact, r.decimal_type) for r in C.float_exactness(floats, ["x", "y"]).collect()}
    assert got == {"x": (True, "decimal(4,2)"), "y": (False, None)}
